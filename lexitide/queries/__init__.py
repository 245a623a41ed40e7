"""Queries that the entry module registers, with their SQL."""
