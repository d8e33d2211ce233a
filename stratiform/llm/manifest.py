"""A Merkle manifest of a dataset: a hash tree for each language over its documents, and a tree over these.

Leaves are hashed where the rows are; a text never moves. A sort by language and key deals leaves over partitions, and with the sizes of the partitions
each leaf gets its rank. Aligned buckets of 2^BLOCK_LEVELS ranks then go to a DuckDB block engine on the executors: for each level one query of ordered
string_agg and sha256 over an Arrow table; it gives the bucket's root, each leaf's siblings and the root that a changed leaf would fold to.
Spark combines bucket roots by built-in functions, FAN of them at a time until one is left for each language, and likewise the languages' roots, and joins each bucket's
outer steps to its rows.

A single node at the end of a level is hashed alone; it has no sibling. A null is `-`, other values are their UTF-8 bytes' number, `:` and the value. Rows that share a key go by their leaf;
rows alike in all five columns are leaves of their own. A null key comes first and is never tampered with (its checksum is unknown), nor changes a null n_chars. A language without rows
has no tree; an empty table gives no row. Other columns, whatever their names, take no part. Very long texts are hashed whole.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, scratch_of
from .ngram_join import BROADCAST_NODES

BLOCK_LEVELS, FAN_LEVELS = 10, 10
TAMPER_EVERY = 7
_STEPS = "array<struct<sib:string,first:boolean>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-`, or the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(documents: DataFrame, *, key: str, source: str, lang: str, size: str, text: str) -> DataFrame:
    """key, grp (the language), leaf, and changed: the leaf if every TAMPER_EVERY-th key's row had one more in `size`."""
    k, n = F.col(key), F.col(size)
    parts = lambda count: digest(field(k), field(F.col(source)), field(F.col(lang)), field(count), field(F.col(text)))
    hit = F.coalesce(F.crc32(k.cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False)) & n.isNotNull()
    # one hash of most rows: a row that stays as it is has its own leaf
    more = parts(n.cast("decimal(20,0)") + 1)
    df = documents.select(k.alias("key"), F.col(lang).alias("grp"), parts(n).alias("leaf"), F.when(hit, more).alias("changed"))
    return df.withColumn("salt", F.monotonically_increasing_id())


def ranked(df: DataFrame, scratch: Scratch, order: list[str]) -> DataFrame:
    """Adds rank, from 0 within grp by `order`, and n, the size of grp, without gathering a group: partitions are ranges of (grp, order) and each one's groups begin
    where those of the partitions before it end."""
    by = [F.asc_nulls_first("grp"), *(F.asc_nulls_first(c) for c in order)]
    placed = scratch.put(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    sizes = placed.groupBy("grp", F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("grp").orderBy("_part")) - F.col("_n")
    starts = sizes.select(F.col("grp").alias("_g"), "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    starts = scratch.put(starts, "starts")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_NODES else starts
    here = (F.shiftright("_at", 33) == F.col("_part")) & F.col("grp").eqNullSafe(F.col("_g"))
    return placed.join(starts, here).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_g", "_part", "_shift")


# ---- the block engine ------------------------------------------------------------------------------------------------

_engine: list[duckdb.DuckDBPyConnection] = []


def engine() -> duckdb.DuckDBPyConnection:
    """One in-memory database for each worker, of one thread; it never writes to disk."""
    if not _engine:
        con = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "400MB", "temp_directory": ""})
        con.execute("SET TimeZone = 'UTC'")
        _engine.append(con)
    return _engine[0]


def blocks(block: pa.Table, levels: int) -> pa.Table:
    """Of whole aligned buckets (grp, bucket, i, n, leaf, changed): i, root, folded, and siblings, the siblings' digests from the bottom as one text.

    A bucket that holds all of its group stops where one node is left; any other goes on to `levels`, as its root has neighbours.
    """
    con = engine()
    con.register("arrow_block", block)
    con.execute("CREATE OR REPLACE TEMP TABLE node AS SELECT grp, bucket, i, n, leaf AS h FROM arrow_block")
    con.execute("CREATE OR REPLACE TEMP TABLE leaf AS SELECT grp, bucket, i, n, salt, coalesce(changed, leaf) AS fold, '' AS siblings FROM arrow_block")
    for level in range(levels):
        going = f"n > (1::BIGINT << {level})"
        con.execute(f"""
            CREATE OR REPLACE TEMP TABLE leaf AS
            SELECT l.grp, l.bucket, l.i, l.n, l.salt,
              CASE WHEN NOT l.{going} THEN fold WHEN (l.i >> {level}) & 1 = 1 THEN sha256(s.h || fold) ELSE sha256(fold || coalesce(s.h, '')) END AS fold,
              siblings || CASE WHEN l.{going} THEN coalesce(s.h, '') ELSE '' END AS siblings
            FROM leaf l LEFT JOIN node s ON s.grp IS NOT DISTINCT FROM l.grp AND s.bucket = l.bucket AND s.i = xor(l.i >> {level}, 1)""")
        con.execute(f"""
            CREATE OR REPLACE TEMP TABLE node AS
            SELECT grp, bucket, i >> 1 AS i, n, CASE WHEN {going} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM node GROUP BY grp, bucket, i >> 1, n""")
    out = con.sql("SELECT l.salt, r.h AS root, l.fold AS folded, l.siblings FROM leaf l JOIN node r ON r.grp IS NOT DISTINCT FROM l.grp AND r.bucket = l.bucket").to_arrow_table()
    con.execute("DROP TABLE leaf; DROP TABLE node")
    con.unregister("arrow_block")
    return out


def in_blocks(df: DataFrame, levels: int) -> DataFrame:
    """Adds bucket, root, folded and siblings to ranked leaves."""
    df = df.withColumn("bucket", F.shiftright("rank", levels)).withColumn("i", F.col("rank") - F.shiftleft("bucket", levels))
    key_type, grp_type = df.schema["key"].dataType.simpleString(), df.schema["grp"].dataType.simpleString()

    def run(block: pa.Table) -> pa.Table:
        got = blocks(block.select(["grp", "bucket", "i", "n", "leaf", "changed", "salt"]), levels)
        out = block.join(got, "salt").combine_chunks()
        return out.select(["key", "grp", "bucket", "leaf", "n", "root", "folded", "siblings"])

    kept = df.select("key", "grp", "bucket", "i", "n", "leaf", "changed", "salt")
    return kept.groupBy("grp", "bucket").applyInArrow(run, f"key {key_type}, grp {grp_type}, bucket long, leaf string, n long, root string, folded string, siblings string")


# ---- the outer tree ----------------------------------------------------------------------------------------------------

def climbed(nodes: DataFrame, scratch: Scratch, levels: int) -> DataFrame:
    """grp, at, root, steps: for the nodes at = 0, 1, ... (of h) of each group the way to the group's root.

    Each round takes 2^levels neighbours as one array and hashes it up by array functions; a round's roots are the next one's nodes, so the way takes log N / levels rounds.
    """
    way = scratch.put(nodes.select("grp", "at", "h", F.col("at").alias("_now"), F.array().cast(_STEPS).alias("steps")), "way")
    now = way.select("grp", "at", "h")
    while True:
        wide = now.groupBy("grp", F.shiftright("at", levels).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("a"))
        wide = wide.withColumn("n", F.sum(F.size("a")).over(Window.partitionBy("grp"))).withColumn("l0", F.col("a.h"))
        for i in range(levels):
            up = F.transform(F.sequence(F.lit(0), F.ceil(F.size(f"l{i}") / 2).cast("int") - 1), lambda j: digest(F.get(f"l{i}", 2 * j), F.coalesce(F.get(f"l{i}", 2 * j + 1), F.lit(""))))  # noqa: B023
            wide = wide.withColumn(f"l{i + 1}", F.when(F.col("n") > (1 << i), up).otherwise(F.col(f"l{i}")))
        steps = lambda p: F.array_compact(F.array(*[F.when(F.col("n") > (1 << i), F.struct(F.coalesce(F.get(f"l{i}", F.shiftright(p, i).bitwiseXOR(F.lit(1))), F.lit("")).alias("sib"), (F.shiftright(p, i).bitwiseAND(F.lit(1)) == 1).alias("first"))) for i in range(levels)]))
        each = wide.select("grp", "up", F.get(f"l{levels}", F.lit(0)).alias("h"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("a") - 1), steps)).alias("pos", "more"))
        each = scratch.put(each.select("grp", (F.shiftleft(F.col("up"), levels) + F.col("pos")).alias("_at"), "up", "h", "more"), "round")
        met = way.drop("h").withColumnRenamed("grp", "_g").join(each, F.col("_g").eqNullSafe(F.col("grp")) & (F.col("_now") == F.col("_at")))
        way = scratch.put(met.select("grp", "at", "h", F.col("up").alias("_now"), F.concat("steps", "more").alias("steps")), "way")
        now = each.select("grp", F.col("up").alias("at"), "h").distinct()
        if now.where("at > 0").isEmpty():
            return way.select("grp", "at", F.col("h").alias("root"), "steps")


def climb(start: Column, steps: Column) -> Column:
    """What a digest folds to along steps."""
    return F.aggregate(steps, start, lambda h, s: F.when(s["first"], digest(s["sib"], h)).otherwise(digest(h, s["sib"])))


def build(documents: DataFrame, *, key: str = "doc_id", source: str = "source", lang: str = "lang", size: str = "n_chars", text: str = "text", levels: int = BLOCK_LEVELS, fan: int = FAN_LEVELS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    scratch = scratch or scratch_of(documents.sparkSession)
    leaf = scratch.put(leaves(documents, key=key, source=source, lang=lang, size=size, text=text), "leaves")
    inner = scratch.put(in_blocks(ranked(leaf, scratch, ["key", "leaf", "salt"]), levels), "blocks")
    scratch.drop(leaf)
    scratch.release_shuffles()
    roots = inner.groupBy("grp", "bucket").agg(F.min("root").alias("h"))
    outer = climbed(roots.select("grp", F.col("bucket").alias("at"), "h"), scratch, fan)
    # one row for each language, ranked in the same way as leaves
    subroots = outer.where("at = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("lang"), F.col("root").alias("h"))
    over = ranked(subroots, scratch, ["lang"])
    top = climbed(over.select("grp", F.col("rank").alias("at"), "h"), scratch, fan)
    langs = over.join(top.drop("grp"), F.col("rank") == F.col("at")).select(F.col("lang").alias("_l"), F.col("h").alias("subroot"), F.col("root").alias("_root"), F.col("steps").alias("_top"))
    ways = outer.join(langs, F.col("grp").eqNullSafe(F.col("_l"))).select(F.col("grp").alias("_g"), F.col("at").alias("_b"), "subroot", "_root", F.concat("steps", "_top").alias("_steps"))
    ways = scratch.put(ways, "ways")
    ways = F.broadcast(ways) if ways.count() <= BROADCAST_NODES // 10 else ways
    out = inner.join(ways, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("bucket") == F.col("_b")))
    proof = F.sha2(F.concat("siblings", F.array_join(F.col("_steps.sib"), "")).cast("binary"), 256)
    out = out.select(F.col("key").alias("doc_id"), "leaf", "subroot", F.col("_root").alias("root"), proof.alias("proof_sha256"), climb(F.col("folded"), F.col("_steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
