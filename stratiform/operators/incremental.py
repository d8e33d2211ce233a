"""Runs that redo only what changed (R10, F27, E10): stages by key, with fingerprints of what each key's result was made from.

A stage's output is kept in versions: a folder with the rows and, written after them, the fingerprints. A version without its fingerprints doesn't count, so a run
that breaks off is taken up at the stage that it lost. A key is redone where its fingerprint is new or another one; results of other keys are taken from the last version, and keys that are gone
are left out. A fingerprint is an order-free sum of row hashes, with their number and the stage's own parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Stage:
    """A step from rows to rows that looks at one key's rows at a time; `settings` say what else its results depend on."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    settings: str = ""


def fingerprints(rows: DataFrame, key: str, settings: str = "") -> DataFrame:
    """key, mark: twelve hex digits of what a key's rows and the settings are."""
    h = [F.xxhash64(F.lit(i), F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)") for i in range(2)]
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(h[0]).alias("a"), F.sum(h[1]).alias("b"))
    return sums.select(key, F.substring(F.sha2(F.concat_ws("|", "n", "a", "b", F.lit(settings)), 256), 1, 12).alias("mark"))


class Run:
    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001

    def _versions(self, stage: str) -> list[int]:
        """Complete versions of a stage, oldest first."""
        root = self.path(f"{self.folder}/{stage}")
        system = root.getFileSystem(self.conf)
        if not system.exists(root):
            return []
        found = [int(f.getPath().getName()[1:]) for f in system.listStatus(root) if f.getPath().getName()[1:].isdigit()]
        return sorted(n for n in found if system.exists(self.path(f"{self.folder}/{stage}/v{n}/marks/_SUCCESS")))

    def _drop(self, stage: str, version: int) -> None:
        p = self.path(f"{self.folder}/{stage}/v{version}")
        p.getFileSystem(self.conf).delete(p, True)

    def stage(self, stage: Stage, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The stage's rows for all keys, and key, redone."""
        have = self._versions(stage.name)
        marks = fingerprints(rows, self.key, stage.settings)
        at = f"{self.folder}/{stage.name}/v{have[-1] + 1 if have else 1}"
        if have:
            last = f"{self.folder}/{stage.name}/v{have[-1]}"
            old = self.spark.read.parquet(f"{last}/marks").select(F.col(self.key).alias("_k"), F.col("mark").alias("_m"))
            marks = marks.join(old, F.col(self.key).eqNullSafe(F.col("_k")), "left").select(self.key, "mark", (~F.col("mark").eqNullSafe(F.col("_m"))).alias("redone"))
        else:
            marks = marks.withColumn("redone", F.lit(True))
        marks.write.mode("overwrite").parquet(f"{at}/plan")
        marks = self.spark.read.parquet(f"{at}/plan")
        of = lambda df, redone: df.join(marks.where(F.col("redone") == redone).select(F.col(self.key).alias("_k")), F.col(self.key).eqNullSafe(F.col("_k")), "left_semi")
        out = stage.work(of(rows, True))
        if have:
            kept = self.spark.read.parquet(f"{last}/rows")
            out = out.unionByName(of(kept, False))
        out.write.mode("overwrite").parquet(f"{at}/rows")
        marks.write.mode("overwrite").parquet(f"{at}/marks")
        for n in have[:-1]:  # the last one may still be read
            self._drop(stage.name, n)
        return self.spark.read.parquet(f"{at}/rows"), self.spark.read.parquet(f"{at}/marks").select(self.key, "redone")

    def all(self, stages: list[Stage], rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The last stage's rows, and stage, key, redone of every stage."""
        told = None
        for s in stages:
            rows, redone = self.stage(s, rows)
            one = redone.select(F.lit(s.name).alias("stage"), self.key, "redone")
            told = one if told is None else told.unionByName(one)
        return rows, told
