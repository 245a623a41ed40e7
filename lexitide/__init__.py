"""Lexitide: DataFrame operators for measuring and preparing large text collections on Spark."""
