"""Reading and writing of delimited, JSON and text files."""

from __future__ import annotations

import codecs

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitide.functions.dates import read_date
from lexitide.plans.lineage import exists

BOM = codecs.BOM_UTF8.decode()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, dates: tuple[str, ...] = (), infer: bool = False) -> DataFrame:
    """A CSV file with a header; quoted fields may hold line ends and doubled quotation marks.

    Columns are matched to ``schema`` by name, in any order, and a byte order mark is dropped. Without a schema every
    column is a string or, with ``infer``, of the type that all of its values have, which costs a second pass over the
    file. Columns named in ``dates`` are read by ``read_date``: bad dates become null.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', inferSchema=infer and schema is None, enforceSchema=False)
    raw = raw.toDF(*[c.removeprefix(BOM) for c in raw.columns])
    if schema is not None:
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        raw = raw.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])
    return raw.withColumns({c: read_date(F.col(f"`{c}`").cast("string")) for c in dates})


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON file that is one list of objects; what the schema does not name is not read."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_mapping(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A JSON file that is one object, as a row for each of its members; values are strings."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", f"^{BOM}", ""), "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias(key, value))


def read_lines(spark: SparkSession, path: str, number: str = "id", text: str = "text") -> DataFrame:
    """The non-blank lines of a text file, stripped, numbered from 1 in the order of the file.

    Numbers are stable: lines are numbered in their block of their file, and blocks by the lines before them.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias(text), *place).where(F.col(text) != "")
    own = Window.partitionBy("_file", "_block")
    within = lines.withColumn("_at", F.monotonically_increasing_id()).withColumn("_k", F.row_number().over(own.orderBy("_at")))
    sizes = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"))  # a row for each block of the files
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return within.join(sizes.select("_file", "_block", before.alias("_before")), ["_file", "_block"]).select((F.col("_before") + F.col("_k")).alias(number), text)


def write_csv(df: DataFrame, path: str, single: bool = False, index: str | None = None, bom: bool = False) -> None:
    """A folder of CSV files with a header, the column ``index`` first; ``single`` for one file, for small results.

    ``bom`` puts a byte order mark before the first column's name, as spreadsheet programs expect.
    """
    columns = [index, *[c for c in df.columns if c != index]] if index else df.columns
    out = df.select(*columns)
    if bom:
        out = out.withColumnRenamed(columns[0], BOM + columns[0])
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True, escape='"', quote='"')


def write_records(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, one to a line, in a new place: input is never overwritten."""
    df.write.mode("error").json(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Rows whose key is not yet in the parquet table at ``path`` are added to it, so a rerun after a failure repeats
    no work that was written."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.write.mode("append").parquet(path)
