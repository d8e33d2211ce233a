"""Intermediate tables of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master gets a temporary folder, a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="stratiform-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


class Tables:
    """Tables of one run of an operator. Those of past rounds go with drop(), the rest when the interpreter ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{folder(spark)}/stratiform-{uuid.uuid4().hex}"
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        atexit.register(self._ended)

    def path(self, name: str = "table") -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame) -> DataFrame:
        """The frame as written and read again, which cuts its lineage."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._saved_at = path  # noqa: SLF001
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            self._delete(f._saved_at)  # noqa: SLF001

    def _delete(self, path: str) -> None:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.conf).delete(p, True)

    def _ended(self) -> None:
        with contextlib.suppress(Py4JError, OSError):  # the JVM itself may be gone by now
            self._delete(self.root)
