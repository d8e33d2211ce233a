"""Benchmark decontamination with a distributed positional inverted index.

Index: one pass over whole training texts stores a posting (row, position, term) for every word that
is a benchmark term, and an end mark at the position after the last word, which gives a text's length.
Query: the terms of a benchmark window are ordered by the length of their posting lists; positions
are shifted by the term's offset in the window, and the lists are intersected from the rarest term on. What
is left after all terms is an exact phrase match; with a slop for the offsets it is a proximity match. A window with a term that has no posting is dropped
at once.

Built-in functions only. Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A null or empty text
has no words and is clean; a null or wordless item has no window. Rows that repeat a doc_id are documents
of their own; other columns, whatever their names, take no part. Of terms equally rare the first offset (phrases) or word (proximity) comes
first, which changes no phrase match. Very long texts are posted whole. Empty tables give empty or all-clean results. Only benchmark-sized tables, or row lists under
BROADCAST_ROWS, are broadcast; beyond that the joins shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, named, scratch_of, unused

WINDOW, SHARE, BROADCAST_ROWS = 13, 20, 500_000
SLOP = 16  # words on either side of a window's rarest term in which its other terms count as near


def words(text: Column) -> Column:
    """The words of a text, in order; none of a null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, *, item: str, text: str, length: int = WINDOW) -> DataFrame:
    """item, w, size, terms for each window of each item; w is a hash of the terms."""
    w = items.select(F.col(item).alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (length - 1), F.lit(1)))
    w = w.select("item", "ws", F.explode(starts).alias("i")).select("item", F.expr(f"slice(ws, i, {int(length)})").alias("terms"))
    return w.select("item", F.xxhash64(F.array_join("terms", " ")).alias("w"), F.size("terms").alias("size"), "terms")


@dataclass
class PositionalIndex:
    """postings: row, term (hash of a benchmark term), pos; docs: row, doc_id, n_words."""

    postings: DataFrame
    docs: DataFrame
    terms: int


def build_index(documents: DataFrame, vocabulary: DataFrame, scratch: Scratch, *, key: str, text: str) -> PositionalIndex:
    """vocabulary: one column `word` of different words."""
    vocab = vocabulary.select("word", F.xxhash64("word").alias("term")).unionByName(documents.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(None).cast("long").alias("term")))
    n = vocabulary.count()
    marked = documents.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.concat(words(F.col(text)), F.array(F.lit(""))).alias("ws"))
    flat = marked.select("doc_id", "row", F.posexplode("ws").alias("pos", "word"))
    mine = F.when(F.col("term").isNull(), F.col("doc_id")).alias("doc_id")  # the key stands at end marks alone
    kept = scratch.put(flat.join(small(vocab, n), "word").select(mine, "row", "pos", "term"), "postings")
    docs = kept.where("term is null").select("row", "doc_id", F.col("pos").alias("n_words"))
    return PositionalIndex(kept.where("term is not null").select("row", "pos", "term"), docs, n)


def frequencies(index: PositionalIndex) -> DataFrame:
    """term and df, its places in all documents."""
    return index.postings.groupBy("term").agg(F.count("*").alias("df"))


def phrase_matches(index: PositionalIndex, wins: DataFrame, scratch: Scratch) -> DataFrame:
    """row, start, size, w: every place where all the terms of a window stand in order. wins: w, size, terms, each w once."""
    freq = frequencies(index)
    lists = wins.select("w", "size", F.posexplode("terms").alias("off", "word")).withColumn("term", F.xxhash64("word"))
    lists = lists.join(small(freq, index.terms), "term", "left").withColumn("least", F.min(F.coalesce("df", F.lit(0))).over(Window.partitionBy("w"))).where("least > 0")
    lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("df", "off")))
    lists = scratch.put(lists.select("w", "size", "off", "term", "r"), "lists")
    n_lists = lists.count()

    first = lists.where("r = 1").select("w", "size", "off", "term")
    found = index.postings.join(small(first, n_lists), "term").select("w", "size", "row", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    second = lists.where("r = 2").select("w", F.col("off").alias("off2"), F.col("term").alias("term2"))
    probes = found.where("size > 1").join(small(second, n_lists), "w").select("w", "size", "row", "start", (F.col("start") + F.col("off2")).alias("pos"), F.col("term2").alias("term"))
    rare = small(second.select(F.col("term2").alias("term")).distinct(), n_lists)
    both = probes.join(index.postings.join(rare, "term", "left_semi"), ["row", "pos", "term"]).select("w", "size", "row", "start")
    both = scratch.put(both, "both")

    rest = lists.where("r > 2").select("w", "off", "term")
    probes = both.where("size > 2").join(small(rest, n_lists), "w").select("w", "size", "row", "start", (F.col("start") + F.col("off")).alias("pos"), "term")
    rows = both.where("size > 2").select("row").distinct()
    lists_there = index.postings.join(small(rows, rows.count()), "row", "left_semi")
    full = probes.join(lists_there, ["row", "pos", "term"]).groupBy("w", "size", "row", "start").agg(F.count("*").alias("n")).where("n = size - 2")
    parts = [found.where("size = 1"), both.where("size = 2"), full]
    cols = ["row", "start", "size", "w"]
    return scratch.put(parts[0].select(cols).unionByName(parts[1].select(cols)).unionByName(parts[2].select(cols)), "matches")


def proximity_matches(index: PositionalIndex, wins: DataFrame, scratch: Scratch, *, slop: int = SLOP) -> DataFrame:
    """row, w, pos: places of a window's rarest term (of ties the first word) that have all its other terms within `slop` words, in any order. wins: w, terms, each w once.

    The second rarest term is looked for first; only places that have it near are probed for the rest. Places meet in cells of slop + 1
    positions, each probed with its two neighbours, so no list of a document is compared with another as a whole.
    """
    terms = wins.select("w", F.explode(F.array_distinct("terms")).alias("word")).withColumn("term", F.xxhash64("word"))
    of = Window.partitionBy("w")
    terms = terms.join(small(frequencies(index), index.terms), "term", "left").withColumns({"least": F.min(F.coalesce("df", F.lit(0))).over(of), "n": F.count("*").over(of)}).where("least > 0")
    terms = scratch.put(terms.withColumn("r", F.row_number().over(of.orderBy("df", "word"))).select("w", "term", "r", "n"), "near_terms")
    n_terms = terms.count()
    cell = lambda c: F.floor(F.col(c) / (slop + 1))

    def met(places: DataFrame, among: DataFrame) -> DataFrame:
        """places (w, row, p) with each term of `among` (w, term) that stands near."""
        probes = places.join(small(among, n_terms), "w").select("w", "row", "p", "term", F.explode(F.array(*[cell("p") + d for d in (-1, 0, 1)])).alias("cell"))
        here = small(among.select("term").distinct(), n_terms)
        lists = index.postings.join(here, "term", "left_semi").withColumn("cell", cell("pos"))
        return probes.join(lists, ["row", "term", "cell"]).where(F.abs(F.col("pos") - F.col("p")) <= slop).select("w", "row", "p", "term").distinct()

    first = terms.where("r = 1").select("w", "term", "n")
    seeds = index.postings.join(small(first, n_terms), "term").select("w", "row", F.col("pos").alias("p"), "n")
    two = scratch.put(met(seeds.where("n > 1").select("w", "row", "p"), terms.where("r = 2").select("w", "term")).select("w", "row", "p"), "near_two")
    rest = terms.where("r > 2").select("w", "term")
    full = met(two, rest).groupBy("w", "row", "p").agg(F.count("*").alias("m")).join(small(first.select("w", "n"), n_terms), "w").where("m = n - 2").select("w", "row", "p")
    pairs = two.join(small(first.where("n = 2").select("w"), n_terms), "w", "left_semi")
    out = seeds.where("n = 1").select("w", "row", "p").unionByName(pairs.select("w", "row", "p")).unionByName(full)
    return scratch.put(out.select("row", "w", F.col("p").alias("pos")), "near")


def assess(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slop: int | None = SLOP, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near_items for every row of documents.

    n_near_items counts the items that have a window whose terms stand near one another (proximity_matches); it is left out where slop is None.
    """
    scratch = scratch or scratch_of(documents.sparkSession)
    wins = scratch.put(windows(benchmark, item=item, text=item_text), "windows")
    index = build_index(documents, wins.select(F.explode("terms").alias("word")).distinct(), scratch, key=key, text=text)
    once = wins.groupBy("w", "size").agg(F.first("terms").alias("terms"))
    matches = phrase_matches(index, once, scratch)

    end = F.col("start") + F.col("size")
    before = F.max(end).over(Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    hit = matches.select("row", "start", "size").distinct().withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))
    owners = wins.select("w", "item").distinct()
    of = matches.select("row", "w").distinct().join(owners, "w").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    out = index.docs.join(hit, "row", "left").join(of, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    columns = [
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    ]
    if slop is not None:
        near = proximity_matches(index, once, scratch, slop=slop).select("row", "w").distinct().join(owners, "w").groupBy("row").agg(F.countDistinct("item").alias("near"))
        out = out.join(near, "row", "left")
        columns.append(F.coalesce("near", F.lit(0)).cast("long").alias("n_near_items"))
    return out.select(*columns)


def keep_clean(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of documents that aren't contaminated, columns as they were. The verdict is a text's, so rows meet it by 128 bits of their text's hash, not by a key."""
    scratch = scratch or scratch_of(documents.sparkSession)
    columns = documents.columns
    h, g = unused(columns, "_h"), unused(columns, "_g")
    hashed = documents.withColumns({h: F.xxhash64(text), g: F.xxhash64(F.lit(1), F.col(text))})
    keyed = hashed.select(F.struct(F.col(h).alias("h"), F.col(g).alias("g")).alias("doc_id"), F.col(text).alias("text"))
    judged = assess(keyed, benchmark, item=item, item_text=item_text, slop=None, scratch=scratch)
    gone = scratch.put(judged.where("contaminated").select(F.col("doc_id.h").alias(h), F.col("doc_id.g").alias(g)).distinct(), "gone")
    return hashed.join(small(gone, gone.count()), [h, g], "left_anti").select(*named(*columns))
