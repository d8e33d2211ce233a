"""Typed, pruned and tolerant reads of CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_table(spark: SparkSession, path: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """Columns by their names in the header, cast leniently to `schema` (S08); of `keep` only those that there are, nothing else is parsed.

    A byte-order mark is dropped. A column of the schema that the file lacks is null, unless `keep` is given.
    """
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    have = {c.lstrip("﻿").strip(): c for c in df.columns}
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    if keep is not None:
        fields = [f for f in fields if f[0] in keep and f[0] in have]
    return df.select(*[(F.col(f"`{have[n]}`").try_cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in fields])


def color_map(df: DataFrame) -> DataFrame:
    """region_id, r, g, b from columns r, g, b (or their full names), else from a hex column (S13). Rows that can't be read are left out; the last of an id counts for all engines alike as the largest colour."""
    have = {c.lower(): c for c in df.columns}
    first = lambda *names: next((have[n] for n in names if n in have), None)
    key, parts, code = first("id", "region_id"), [first("r", "red"), first("g", "green"), first("b", "blue")], first("color_hex_triplet")
    if key is None or None in parts and code is None:
        return df.sparkSession.createDataFrame([], "region_id int, r int, g int, b int")
    if None not in parts:
        rows = df.select(F.col(key).try_cast("int").alias("region_id"), *[F.col(p).try_cast("int").alias(n) for p, n in zip(parts, "rgb", strict=True)])
    else:
        digits = F.ltrim(F.trim(F.col(code).cast("string")), F.lit("#"))
        part = lambda i: F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.conv(F.substring(digits, i, 2), 16, 10).cast("int"))
        rows = df.select(F.col(key).try_cast("int").alias("region_id"), part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))
    best = rows.dropna().groupBy("region_id").agg(F.max(F.struct("r", "g", "b")).alias("c"))
    return best.select("region_id", "c.*")


def json_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path, doc: each file's JSON object as text, {} where it is no object (S14). A document is small and one row."""
    files = spark.read.option("pathGlobFilter", glob).option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.ltrim(F.col("value"), F.lit("\ufeff")).alias("doc"))
    return files.withColumn("doc", F.when(F.json_object_keys("doc").isNotNull(), F.col("doc")).otherwise("{}"))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of the paths that is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(f"none of {paths} exists")
