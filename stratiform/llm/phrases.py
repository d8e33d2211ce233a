"""Phrase collocation mining by Apriori passes over the texts, level by level.

Pass 1 counts words for each language. Pass k emits a k-gram only where both of its overlapping (k-1)-grams are frequent, which loses
nothing, as a phrase is never more frequent than a part of it. Each pass counts what a task has seen before anything is shuffled. While
a level is known to fit (MAX_WORDS, MAX_WORD_BYTES, MAX_PAIRS), it is broadcast and grams travel as pairs of numbers; beyond that the same pass is
made of joins with the level table, and gives the same rows. Cuts are then scored from the level tables in exact decimal arithmetic (for up to 10^14 occurrences).

Nulls and texts without a word give nothing; a null language counts as `und`, together with rows that say so. Rows are counted as
they come, repeated ones and those with null or equal ids too. Texts are read whole, cut for bounded memory only where a piece ends. Phrases that
tie in score and count go by their UTF-8 bytes. Empty tables give no row; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, give_back, scratch_of

MIN_COUNT, ABSORB, TOP, LONGEST = 10, 50, 2000, 3
MAX_WORDS, MAX_WORD_BYTES, MAX_PAIRS = 2_000_000, 48 << 20, 6_000_000  # what a broadcast may hold: about 64 MB each
CHUNK_BYTES, CHUNK_KEYS, SALTS = 4 << 20, 3_000_000, 64
NO_LANG = "und"
_WORD, _GAP, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = _GAP
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]


# ---- words of a batch ------------------------------------------------------------------------------------------------

def raw_texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last ends); a null has none."""
    if col.null_count:
        col = pc.fill_null(col, "")
    at = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def windows(raw: np.ndarray, at: np.ndarray, most: int = CHUNK_BYTES):
    """(begin, end) of stretches of about `most` bytes that end where a text or a piece ends; only a longer piece makes a longer one."""
    lo = 0
    while lo < len(raw):
        size = most
        while True:
            hi = min(lo + size, len(raw))
            if hi == len(raw):
                break
            text_end = int(at[np.searchsorted(at, hi, side="right") - 1])
            ends = np.flatnonzero(_CLASS[raw[max(lo, text_end) : hi]] == _BREAK)
            cut = max(lo, text_end) + int(ends[-1]) + 1 if len(ends) else text_end
            if cut > lo:
                hi = cut
                break
            size *= 2
        yield lo, hi
        lo = hi


def words(raw: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray] | None:
    """The words of a stretch, the number of each one's text and a number that neighbours share only within a piece."""
    part = _LOWER[raw[lo:hi]]
    kind = _CLASS[part]
    inside = kind == _WORD
    first, last = np.searchsorted(at, [lo, hi], side="left")
    edge = np.zeros(len(part) + 1, bool)
    edge[0] = edge[-1] = True
    edge[at[first:last] - lo] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    if not len(start):
        return None
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    text = np.searchsorted(at, start + lo, side="right") - 1
    piece = np.cumsum(kind == _BREAK)[start] + text
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(part[inside])])
    return found.dictionary_encode(), text, piece


def read(batch: pa.RecordBatch):
    """Of each stretch of a batch: the words, each one's number among `langs`, its piece, and `langs`."""
    langs = pc.fill_null(batch.column("_lang"), NO_LANG).dictionary_encode()
    of = langs.indices.to_numpy(zero_copy_only=False)
    raw, at = raw_texts(batch.column("_text"))
    for lo, hi in windows(raw, at):
        if (got := words(raw, at, lo, hi)) is not None:
            found, text, piece = got
            yield found, of[text], piece, langs.dictionary


# ---- passes ------------------------------------------------------------------------------------------------------------

class Frequent:
    """The frequent words, numbered by language and word, and from pass 3 on the frequent pairs; sent to every task."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("lang", "ascending"), ("phrase", "ascending")])
        lang = table.column("lang").combine_chunks()
        self.words = table.column("phrase").combine_chunks().cast(pa.binary())
        self.langs = pc.unique(lang)
        self.starts = np.searchsorted(pc.index_in(lang, self.langs).to_numpy(), np.arange(len(self.langs) + 1))
        self.pairs: np.ndarray | None = None

    def numbers(self, found: pa.DictionaryArray, of: np.ndarray, langs: pa.Array) -> np.ndarray:
        """The number of every word, -1 if it isn't frequent in its language."""
        code = found.indices.to_numpy()
        out = np.full(len(code), -1, np.int64)
        for i, lang in enumerate(langs):
            mine = of == i
            j = pc.index_in(lang, self.langs).as_py()
            if j is None or not mine.any():
                continue
            known = pc.index_in(found.dictionary, self.words[self.starts[j] : self.starts[j + 1]])
            number = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            number[number >= 0] += self.starts[j]
            out[mine] = number[code[mine]]
        return out

    def grams(self, number: np.ndarray, piece: np.ndarray, k: int) -> np.ndarray:
        """A 64-bit key for each k-gram whose two (k-1)-grams are frequent: numbers of the first one and of the last word."""
        together = (piece[1:] == piece[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)
        at = np.flatnonzero(together)
        key = (number[at] << 32) | number[at + 1]
        if k == 2 or not len(self.pairs):
            return key if k == 2 else key[:0]
        pair = np.searchsorted(self.pairs, key)
        pair[pair == len(self.pairs)] = 0
        ok = self.pairs[pair] == key
        at, pair = at[ok], pair[ok]
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        return (pair[follows] << 32) | number[at[follows + 1] + 1]

    def spelled(self, key: np.ndarray, k: int) -> tuple[pa.Array, pa.Array]:
        """Language and phrase of each key."""
        head = key >> 32
        parts = [head] if k == 2 else [self.pairs[head] >> 32, self.pairs[head] & 0xFFFFFFFF]
        text = [self.words.take(pa.array(p)) for p in [*parts, key & 0xFFFFFFFF]]
        lang = np.searchsorted(self.starts, parts[0], side="right") - 1
        return self.langs.take(pa.array(lang)), pc.binary_join_element_wise(*text, b" ").cast(pa.string())


def count_words(docs: DataFrame) -> DataFrame:
    """lang, phrase, f of every word, and for each language a row of null phrase with the number of its words."""

    def run(batches):
        for b in batches:
            for found, of, _, langs in read(b):
                code, size = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
                both, times = np.unique(of.astype(np.int64) * size + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(both // size)), found.dictionary.take(pa.array(both % size)).cast(pa.string()), pa.array(times)], names=["lang", "phrase", "f"])
                n = np.bincount(of, minlength=len(langs))
                yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "f"])
            give_back()

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where("f > 0")


def count_known(docs: DataFrame, known, k: int, least: int) -> DataFrame:
    """lang, phrase, f of the frequent k-grams, by the level that `known` broadcasts."""

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            key, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(times)], names=["key", "f"])

        for b in batches:
            for found, of, piece, langs in read(b):
                level = known.value
                held.append(level.grams(level.numbers(found, of, langs), piece, k))
                if sum(map(len, held)) > CHUNK_KEYS:
                    yield flush()
            give_back()
        if held:
            yield flush()
        give_back()

    def spell(batches):
        for b in batches:
            lang, phrase = known.value.spelled(b.column("key").to_numpy(), k)
            yield pa.RecordBatch.from_arrays([lang, phrase, b.column("f")], names=["lang", "phrase", "f"])

    counted = docs.mapInArrow(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return counted.mapInArrow(spell, "lang string, phrase string, f long")


def count_joined(docs: DataFrame, level: DataFrame, k: int, least: int) -> DataFrame:
    """The same by joins, for levels of any size: k-grams are counted after both of their (k-1)-grams are found in the level table."""
    piece = F.explode(F.split(ascii_lower(F.coalesce("_text", F.lit(""))), r"[.,;:!?\x0A-\x0D]")).alias("piece")
    split = docs.select(F.coalesce("_lang", F.lit(NO_LANG)).alias("lang"), piece).select("lang", F.filter(F.split("piece", r"[\x20\x09]+"), lambda w: w != "").alias("ws")).where(F.size("ws") >= k)
    gram = F.transform(F.sequence(F.lit(1), F.size("ws") - (k - 1)), lambda i: F.array_join(F.slice("ws", i, k), " "))
    counted = split.select("lang", F.explode(gram).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("f")).where(F.col("f") >= least)
    first, rest = cut(F.col("phrase"), k, k - 1)[0], cut(F.col("phrase"), k, 1)[1]
    part = lambda name: level.select("lang", F.col("phrase").alias(name))
    return counted.withColumns({"_first": first, "_rest": rest}).join(part("_first"), ["lang", "_first"], "left_semi").join(part("_rest"), ["lang", "_rest"], "left_semi").select("lang", "phrase", "f")


def cut(phrase: Column, k: int, i: int) -> tuple[Column, Column]:
    """The first i words of a phrase of k, and the others."""
    return F.substring_index(phrase, " ", i), F.substring_index(phrase, " ", i - k)


def levels(documents: DataFrame, scratch: Scratch, *, lang: str, text: str, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """lang, n; and for each k the table lang, phrase, f of frequent k-grams."""
    sc = documents.sparkSession.sparkContext
    docs = documents.select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    counted = scratch.put(count_words(docs).where(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    totals, out = counted.where("phrase is null").select("lang", F.col("f").alias("n")), [counted.where("phrase is not null")]
    size = out[0].agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    level = Frequent(out[0].select("lang", "phrase").toArrow()) if size[0] <= MAX_WORDS and size[1] <= MAX_WORD_BYTES else None
    for k in range(2, LONGEST + 1):
        if level is not None and k > 2:
            level = with_pairs(level, out[-1]) if out[-1].count() <= MAX_PAIRS else None
        found = count_known(docs, sc.broadcast(level), k, least) if level is not None else count_joined(docs, out[-1], k, least)
        out.append(scratch.put(found, f"grams{k}"))
        scratch.release_shuffles()
    return totals, out


def with_pairs(level: Frequent, pairs: DataFrame) -> Frequent:
    """The level with the counted pairs of words as well."""
    got = pairs.select("lang", *(c.alias(f"w{i}") for i, c in enumerate(cut(F.col("phrase"), 2, 1)))).toArrow()
    if not len(got):
        level.pairs = np.zeros(0, np.int64)
        return level
    of = pc.index_in(got.column("lang"), level.langs).combine_chunks().to_numpy(zero_copy_only=False)
    number = np.zeros((2, len(got)), np.int64)
    for j in np.unique(of):
        mine, known = of == j, level.words[level.starts[j] : level.starts[j + 1]]
        for i in range(2):
            w = got.column(f"w{i}").combine_chunks().cast(pa.binary()).filter(pa.array(mine))
            number[i, mine] = pc.index_in(w, known).to_numpy() + level.starts[j]
    level.pairs = np.sort((number[0] << 32) | number[1])
    return level


# ---- scores ------------------------------------------------------------------------------------------------------------

def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact."""
    wide = lambda c: c.cast("decimal(14,0)")
    product = (wide(a) * wide(a)).cast("decimal(28,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", product.cast("decimal(36,0)"), (wide(left) * wide(right)).cast("decimal(28,0)"))


def scored(tables: list[DataFrame], k: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of k words, by the cut of lowest score, of ties the first."""
    df = tables[k - 1].select("lang", "phrase", F.col("f").alias("a"))
    for i in range(1, k):
        for side, (part, size) in {"l": (cut(F.col("phrase"), k, i)[0], i), "r": (cut(F.col("phrase"), k, i)[1], k - i)}.items():
            df = df.withColumn("_part", part).join(tables[size - 1].select("lang", F.col("phrase").alias("_part"), F.col("f").alias(f"{side}{i}")), ["lang", "_part"]).drop("_part")
    df = df.withColumns({f"s{i}": score(F.col("a"), F.col(f"l{i}"), F.col(f"r{i}")) for i in range(1, k)})
    best = F.array_min(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(i).alias("i"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")) for i in range(1, k)]))
    return df.withColumn("_b", best).select("lang", "phrase", "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), F.col("_b.s").alias("score"))


def absorbed(tables: list[DataFrame], k: int, share: int) -> DataFrame:
    """lang, phrase of the k-word phrases that lie inside a longer one with `share` percent of their count or more."""
    inside = None
    for size in range(k + 1, len(tables) + 1):
        parts = F.transform(F.sequence(F.lit(1), F.lit(size - k + 1)), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, k), " "))  # noqa: B023
        longer = tables[size - 1].select("lang", F.col("f").alias("_f"), F.explode(parts).alias("phrase"))
        inside = longer if inside is None else inside.unionByName(longer)
    most = inside.groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    return tables[k - 1].join(most, ["lang", "phrase"]).where(100 * F.col("_f") >= share * F.col("f")).select("lang", "phrase")


def best(df: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language and their rank. Hashed parts of a language are cut first, so that a task gets `top` rows of each part at most."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    df = df.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("_salt", "_r")


def mine(documents: DataFrame, *, lang: str = "lang", text: str = "text", least: int = MIN_COUNT, share: int = ABSORB, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of two and three words."""
    scratch = scratch or scratch_of(documents.sparkSession)
    totals, tables = levels(documents, scratch, lang=lang, text=text, least=least)
    every = None
    for k in range(2, LONGEST + 1):
        one = scored(tables, k)
        if k < LONGEST:
            one = one.join(absorbed(tables, k, share), ["lang", "phrase"], "left_anti")
        every = one if every is None else every.unionByName(one)
    # one row for each language
    out = best(every, top).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
