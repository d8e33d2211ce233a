"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a key draws for every child: -ln(u) / weight with u from a hash of the key and
the child's name, and descends into the child of least draw. A child is thus taken with a
probability in proportion to its weight, and if a weight changes, keys only enter or leave the
subtree whose weight changed. A shard added after the base layout opens a region of its own,
whose only leaf it is; so growth moves rows into the new shard and nowhere else.

A null key draws as empty text, rows that repeat a key share its shard, and an empty table gives
an empty result. Of equal draws the first child wins; slots go by key, text checksum and size, and rows that agree in these are alike. A null text has no
bytes, a very long one is measured whole. Other columns, whatever their names, take no part. All of it is built-in expressions; the only shuffle numbers the slots.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_SHARDS, RACK_SHARDS, REGION_RACKS, SLOT_BLOCKS = 40, 5, 4, 64


@dataclass
class Node:
    name: str
    weight: float = 1.0
    shard: int | None = None
    children: list[Node] = field(default_factory=list)

    @property
    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total for c in self.children)


def layout(shards: int, base: int = BASE_SHARDS, weights: dict[int, float] | None = None) -> Node:
    """The tree over shards 0 to shards-1; those from `base` on have a region each."""
    w = weights or {}
    root = Node("root")
    per_region = RACK_SHARDS * REGION_RACKS
    for s in range(shards):
        region, rack = (f"g{s // per_region}", f"k{s // RACK_SHARDS}") if s < base else (f"x{s}", f"x{s}")
        if not root.children or root.children[-1].name != region:
            root.children.append(Node(region))
        racks = root.children[-1].children
        if not racks or racks[-1].name != rack:
            racks.append(Node(rack))
        racks[-1].children.append(Node(f"s{s}", w.get(s, 1.0), s))
    return root


def _draw(key: Column, node: Node) -> Column:
    """Exponential of rate `weight`: 53 bits of a hash, never 0."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(node.name)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(node.total)


def descend(df: DataFrame, key: str, tree: Node, out: str) -> DataFrame:
    """Adds the shard column, one projection for each level, so that no expression nests another's draws."""
    regions = [c for c in tree.children if c.total > 0]
    df = df.withColumns({f"_d{i}": _draw(F.col(key), c) for i, c in enumerate(regions)})
    df = df.withColumn("_region", _argmin([f"_d{i}" for i in range(len(regions))])).drop(*[f"_d{i}" for i in range(len(regions))])
    racks = [(i, c) for i, r in enumerate(regions) for c in r.children if c.total > 0]
    widest = max(sum(1 for j, _ in racks if j == i) for i in range(len(regions)))
    df = _level(df, key, "_region", regions, widest, "_rack")
    flat = [c for r in regions for c in r.children if c.total > 0]
    df = _level(df, key, "_rack", flat, max(len(c.children) for c in flat), "_leaf")
    leaves = [c.shard for r in flat for c in r.children if c.total > 0]
    return df.withColumn(out, F.element_at(F.array(*[F.lit(s) for s in leaves]), F.col("_leaf") + 1)).drop("_region", "_rack", "_leaf")


def _argmin(cols: list[str]) -> Column:
    best = F.least(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    out = F.lit(len(cols) - 1)
    for i in range(len(cols) - 2, -1, -1):
        out = F.when(F.col(cols[i]) == best, F.lit(i)).otherwise(out)
    return out


def _level(df: DataFrame, key: str, at: str, parents: list[Node], widest: int, out: str) -> DataFrame:
    """From a parent's number to its chosen child's number, counted over all parents' children."""
    live = [[c for c in p.children if c.total > 0] for p in parents]
    start = [sum(len(x) for x in live[:i]) for i in range(len(live))]
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    cols = {}
    for j in range(widest):
        name = F.element_at(arr([x[j].name if j < len(x) else "" for x in live]), F.col(at) + 1)
        weight = F.element_at(arr([float(x[j].total) if j < len(x) else 0.0 for x in live]), F.col(at) + 1)
        u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), name), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        cols[f"_c{j}"] = F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))
    df = df.withColumns(cols)
    df = df.withColumn(out, F.element_at(arr(start), F.col(at) + 1) + _argmin(list(cols)))
    return df.drop(*cols)


def number_slots(df: DataFrame, shard: str, order: list[str], blocks: int = SLOT_BLOCKS) -> DataFrame:
    """Adds slot, gapless from 0 in each shard.

    A shard's rows fall into `blocks` hash blocks that are numbered apart and then set one after
    the other, so that no task holds a whole shard; the offsets are shards x blocks rows.
    """
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = df.groupBy(shard, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(shard, "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = df.withColumn("_i", F.row_number().over(Window.partitionBy(shard, "_block").orderBy(*order)))
    # bounded: one row for each shard and block
    return numbered.join(F.broadcast(starts), [shard, "_block"]).withColumn("slot", F.col("_start") + F.col("_i") - 1).drop("_start", "_i", "_block", "_n")


def assign(documents: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = BASE_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    df = documents.select(F.col(key).alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    df = descend(df, "doc_id", layout(shards), "shard")
    df = descend(df, "doc_id", layout(shards + 1), "grown_shard")
    df = number_slots(df, "shard", ["doc_id", "text_crc32", "size"])
    return df.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
