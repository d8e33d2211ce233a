"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and lost executors cost nothing.

    A table lives until drop() or end(), or until the interpreter ends. Operators take one, or the one that own_scratch() holds for them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{folder(spark)}/stratiform-{uuid.uuid4().hex}"
        # held here, as the session may have been stopped when the interpreter ends
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        atexit.register(self._ended)

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            self._delete(f._scratch_path)  # noqa: SLF001

    def end(self) -> None:
        """Deletes all tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.conf).delete(p, True)

    def release_shuffles(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of frames that are gone."""
        gc.collect()
        self.jvm.System.gc()

    def _ended(self) -> None:
        with contextlib.suppress(Py4JError, OSError):  # the JVM itself may be gone by now
            self.end()


_handed: ContextVar[Scratch | None] = ContextVar("scratch of the step that runs here", default=None)


@contextlib.contextmanager
def own_scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A Scratch that scratch_of() gives to what is called within, on this thread alone; its tables go at the end."""
    scratch = Scratch(spark)
    token = _handed.set(scratch)
    try:
        yield scratch
    finally:
        _handed.reset(token)
        scratch.end()


def scratch_of(spark: SparkSession) -> Scratch:
    """The Scratch of the enclosing own_scratch(), or a new one."""
    return _handed.get() or Scratch(spark)


BATCH_ROWS = 2000


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lets Arrow batches of the session hold `rows` rows at most, so that what a task and its Python worker hold of long texts stays small; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def unused(columns: list[str], name: str) -> str:
    """The name, or one with underscores before it, that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(*columns: str) -> list[Column]:
    """Columns by their plain names, whatever characters these have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def ddl(df: DataFrame, *more: str) -> str:
    """The columns of a frame, and more, as a schema string."""
    return ", ".join([*("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in df.schema), *more])


def give_back() -> None:
    """Returns freed memory of this Python worker to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def fold(key: Column, n: int) -> Column:
    """crc32(key as text) mod n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Cuts a batch so that each slice holds about `most` bytes of text, one row at least."""
    col = batch.column(column)
    n = len(col)
    if not n:
        return
    at = np.frombuffer(col.buffers()[1], np.int32, n + 1 + col.offset)[col.offset :].astype(np.int64) if pa.types.is_string(col.type) else np.concatenate([[0], np.cumsum([len(x or "") for x in col.to_pylist()])])
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        end = min(end, n)
        yield batch.slice(begin, end - begin)
        begin = end


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, *, key: str, text: str, mod: int, out: int, per_label: int, max_chars: int) -> list[tuple[int, str]]:
    """At most `per_label` training rows of each label value, as (label, text) on the driver.

    Rows whose crc32(key) mod `mod` is `out` never take part, nor do texts of more than `max_chars` characters and rows
    without a document. Per label the rows that are left fall into `per_label` hash buckets and each bucket gives the
    row of smallest hash (of a repeated key the smallest text), so the choice depends on keys and texts alone. The driver gets per_label x labels x max_chars
    at most.
    """
    hash_of = lambda k: F.xxhash64(k.cast("string"))
    lab = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null and _y in (0, 1)").where(fold(F.col("_k"), mod) != out).distinct()
    docs = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.col("_k").isNotNull() & (F.length("_t") <= max_chars)).where(fold(F.col("_k"), mod) != out)
    both = docs.select("_k").join(lab, "_k").select("_y", hash_of(F.col("_k")).alias("_h"))
    best = both.groupBy("_y", F.pmod("_h", F.lit(per_label)).alias("_b")).agg(F.min("_h").alias("_h"))
    # at most per_label rows for each label value: bounded whatever the input
    got = docs.withColumn("_h", hash_of(F.col("_k"))).join(F.broadcast(best), "_h").groupBy("_y", "_h").agg(F.min("_k").alias("_k"), F.min("_t").alias("_t")).collect()
    return sorted((int(r["_y"]), str(r["_k"]), r["_t"]) for r in got)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights, bias last, by damped Newton steps on the penalised likelihood; y may be soft."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.ones(len(x)) if w is None else w
    b = np.zeros(x1.shape[1])
    pen = np.full(x1.shape[1], l2 * max(w.sum(), 1.0))
    pen[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        g = x1.T @ (w * (p - y)) + pen * b
        hess = (x1 * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(pen + 1e-9)
        step = np.linalg.solve(hess, g)
        b -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return b


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
