"""Copies of records that differ only in white space, case, punctuation or field order.

Records are reduced to a canonical key, range-partitioned and sorted by the key, and each partition is scanned
once; equal neighbours, compared by their full keys, form a run. The ranges are cut at (key hash, record id),
so the copies of one record may fill many partitions; runs with the hash of a partition's first or last record are joined
afterwards by their full keys, two rows for each partition unless keys of one hash meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.plans.lineage import cut

#: What a canonical field keeps.
DROPPED = r"[^\p{L}\p{N}]+"


def canonical(field: Column) -> Column:
    """``field`` with letters and digits only and without letter case; null becomes empty."""
    folded = F.translate(F.replace(F.lower(F.coalesce(field, F.lit(""))), F.lit("ß"), F.lit("ss")), "ς", "σ")
    return F.regexp_replace(folded, DROPPED, "")


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, id) of each record, and (rep, null, key) for the runs with the first and with the last hash of the partition."""
    last_key, rep, first_hash = None, None, None
    begin: list[tuple[int, str]] = []  # runs of the first hash
    end: list[tuple[int, str]] = []  # runs of the latest hash
    latest = None
    kind = {"rep": pa.int64(), "id": pa.int64(), "key": pa.string()}
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, keys, hashes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        new = np.ones(len(ids), bool)
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        if last_key is None:
            first_hash = hashes[0]
        elif keys[0].as_py() == last_key:
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        reps = np.where(at >= 0, ids[at], rep if rep is not None else 0)
        last_key, rep = keys[len(ids) - 1].as_py(), int(reps[-1])
        begin += [(int(ids[k]), keys[int(k)].as_py()) for k in np.flatnonzero(new & (hashes == first_hash))]
        if hashes[-1] != latest:
            latest, end = hashes[-1], []
        end += [(int(ids[k]), keys[int(k)].as_py()) for k in np.flatnonzero(new & (hashes == latest))]
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.string())], list(kind))
    if last_key is not None:
        ends = list(dict.fromkeys(begin + end))
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in ends], pa.int64()), pa.nulls(len(ends), pa.int64()), pa.array([k for _, k in ends], pa.string())], list(kind))


def _members(df: DataFrame, record_id: str, fields: list[str], unordered: bool, singles: bool) -> DataFrame:
    parts = F.array(*[canonical(F.col(f)) for f in fields])
    key = F.concat_ws("\x01", F.array_sort(parts) if unordered else parts)
    keyed = df.select(F.col(record_id).cast("long").alias("id"), key.alias("key")).withColumn("h", _hash(F.col("key")))
    ranged = keyed.repartitionByRange("h", "id").sortWithinPartitions("h", "key", "id")
    runs = ranged.select("id", "key", "h").mapInArrow(_runs, "rep long, id long, key string")
    if not singles:
        runs = runs.where("key is not null or rep <> id")
    runs = cut(runs)
    # Two rows for each partition, but for keys of equal hash.
    whole = runs.where("key is not null").groupBy("key").agg(F.min("rep").alias("first"), F.collect_set("rep").alias("reps")).select("first", F.explode("reps").alias("part")).where("part <> first")
    members = runs.where("key is null").join(whole, F.col("rep") == F.col("part"), "left").select(F.coalesce("first", "rep").alias("rep"), "id")
    return members if singles else members.unionByName(whole.select(F.col("first").alias("rep"), F.col("part").alias("id")))


def copy_pairs(df: DataFrame, record_id: str, fields: list[str], unordered: bool = False) -> DataFrame:
    """(rep, id) of each record that is a copy of another one; ``rep`` is the smallest id of its group.

    Fields are compared after ``canonical``; nulls count as empty. ``unordered`` disregards the order of the
    fields. Ids must be unique; the empty table gives no rows, other columns may have any name.
    """
    return _members(df, record_id, fields, unordered, singles=False)


def collapse_copies(df: DataFrame, record_id: str, fields: list[str], unordered: bool = False) -> DataFrame:
    """(rep, copies): one row for each distinct record with its exact number of copies, itself included."""
    return _members(df, record_id, fields, unordered, singles=True).groupBy("rep").agg(F.count("*").alias("copies"))
