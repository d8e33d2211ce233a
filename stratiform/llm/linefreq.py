"""Line-frequency rules across the documents of a host.

Every line is normalised (lower case, digits to 0, white space runs to one space, trimmed) and
hashed; a line with a character left counts once for each document (row) of a host. Lines over their limit are removed, and a document is
rejected when removal leaves too small a share of its word characters. A line is over the limit when more than LIMIT documents of the host hold it, however
short it is and however large the host. Base rules on repetition and length reject documents beforehand.

Counts are grouped on (host, line), which Spark pre-aggregates before the shuffle, so a host with a third of
all rows or a line in every document is a few rows from each task. Nulls: a null text has no
words and no lines, a null host is a host of its own. Repeated rows count as documents of their own; a line held by exactly the
limit stays. Very long texts are read whole. Empty tables give empty results. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, named, scratch_of, slices, unused

LIMIT, KEPT_SHARE = 10, 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]")
_DIGITS, _SPACE = re.compile(r"[0-9]"), re.compile(r"[\x20\x09-\x0D]+")
_TO_ZERO = str.maketrans("123456789", "000000000")


def words_of(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+; bytes.split() parts at exactly those six."""
    return text.encode("utf-8", "surrogatepass").split()


def normalise(line: str) -> str:
    return b" ".join(line.lower().translate(_TO_ZERO).encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass")


def line_hash(norm: str) -> int:
    return xxhash.xxh3_64_intdigest(norm.encode("utf-8", "surrogatepass")) - (1 << 63)


def chars(words: list[bytes]) -> int:
    """Code points in words: bytes that don't continue one."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    return int(((raw & 0xC0) != 0x80).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _SPACE.sub("", line):
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            hit = np.zeros(n, bool)
            for i, w in enumerate(windows):
                if count[w] > 1:
                    hit[i : i + 3] = True
            repeat = int(hit.sum())
    return n, chars(words), len(SYMBOLS.findall(text)), dup, repeat, n < 50 or 100 * repeat > 50 * n


def lines_of(text: str | None) -> dict[int, tuple[int, int]]:
    """By line hash: how often the line comes, its word characters each time."""
    out: dict[int, tuple[int, int]] = {}
    for line in (text or "").split("\n"):
        norm = normalise(line)
        if norm:
            h = line_hash(norm)
            out[h] = (out.get(h, (0, 0))[0] + 1, len(norm.replace(" ", "")))
    return out


SCAN_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scan(documents: DataFrame, *, key: str, text: str, host: str) -> DataFrame:
    """One pass over whole texts: a row number, the base counts and each document's different lines."""
    docs = documents.select(F.col(key).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.col(text).alias("_text"))
    line = pa.struct([("line", pa.int64()), ("times", pa.int32()), ("chars", pa.int32())])

    def run(batches):
        made = TaskContext.get().partitionId() << 36
        for b in batches:
            for s in slices(b, "_text"):
                texts = s.column("_text").to_pylist()
                got = list(zip(*(measure(t) for t in texts), strict=True)) or [[]] * 6
                found = [lines_of(t) for t in texts]
                ends = np.cumsum([0, *(len(x) for x in found)], dtype=np.int32)
                flat = pa.StructArray.from_arrays([pa.array([h for x in found for h in x], pa.int64()), pa.array([v[0] for x in found for v in x.values()], pa.int32()), pa.array([v[1] for x in found for v in x.values()], pa.int32())], fields=list(line))
                arrays = [s.column("doc_id"), s.column("host"), pa.array(range(made, made + len(texts)), pa.int64()), *(pa.array(c, pa.int64()) for c in got[:5]), pa.array(got[5], pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                made += len(texts)
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "host", "row", *SCAN_COUNTS, "base_failed", "lines"])
            give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, host string, row long, " + ", ".join(f"{n} long" for n in SCAN_COUNTS) + ", base_failed boolean, lines array<struct<line:long,times:int,chars:int>>")


def common_lines(scanned: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """(host, line) of the lines that more than `limit` documents of the host hold."""
    lines = scanned.select("host", F.explode("lines").alias("l")).select("host", "l.line")
    return lines.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > limit).select("host", "line")


def assess(documents: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, kept_share: float = KEPT_SHARE, scratch: Scratch | None = None) -> DataFrame:
    """Counts and the verdict for every row. kept: not base_failed, and at least `kept_share` of the word characters stay."""
    scratch = scratch or scratch_of(documents.sparkSession)
    base = scratch.put(scan(documents, key=key, text=text, host=host), "lines")
    common = scratch.put(common_lines(base, limit=limit), "common")
    lines = base.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.*")
    lost = lines.join(common, ["host", "line"]).groupBy("row").agg(F.sum("times").alias("n_common_lines"), F.sum(F.col("times") * F.col("chars")).alias("common_chars"))
    out = base.drop("lines").join(lost, "row", "left")
    gone = F.coalesce("common_chars", F.lit(0))
    kept = ~F.col("base_failed") & (F.col("word_chars") - gone >= kept_share * F.col("word_chars"))
    return out.select("doc_id", *SCAN_COUNTS, "base_failed", kept.alias("kept"), F.coalesce("n_common_lines", F.lit(0)).cast("long").alias("n_common_lines"), gone.cast("long").alias("common_chars"))


def remove_common_lines(documents: DataFrame, common: DataFrame, *, text: str = "text", host: str = "source") -> DataFrame:
    """documents with the lines named in `common` (host, line) taken out of the text; other columns stay.

    Only a text's own lines meet `common`; which of them are in it comes back to the text by two hashes of host and text.
    """
    columns = documents.columns
    h, g, lines = (unused(columns, c) for c in ("_h", "_g", "_lines"))
    place = F.coalesce(F.col(host).cast("string"), F.lit("\0"))
    hashed = documents.withColumns({h: F.xxhash64(place, F.col(text)), g: F.xxhash64(F.lit(1), place, F.col(text))})

    @F.pandas_udf("array<long>")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series([list(lines_of(t)) for t in texts], dtype=object)

    @F.pandas_udf("string")
    def strip(texts: pd.Series, drop: pd.Series) -> pd.Series:
        out = []
        for t, ls in zip(texts, drop, strict=True):
            gone = set() if ls is None else set(ls)
            out.append(t if t is None or not gone else "\n".join(x for x in t.split("\n") if line_hash(normalise(x)) not in gone))
        return pd.Series(out, dtype=object)

    seen = hashed.select(F.col(h).alias("h"), F.col(g).alias("g"), place.alias("host"), F.explode(own(F.col(text))).alias("line")).distinct()
    found = seen.join(common.select("host", "line").distinct(), ["host", "line"]).groupBy("h", "g").agg(F.collect_set("line").alias(lines))
    found = found.select(F.col("h").alias(h), F.col("g").alias(g), lines)
    return hashed.join(found, [h, g], "left").withColumn(text, strip(F.col(text), F.col(lines))).select(*named(*columns))
