"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets and checked pairs.

Equal vectors are one node. A table hashes a node by `k` rotations (three rounds of random signs and a Hadamard transform): each gives the axis,
with its sign, that is nearest to the rotated vector. A node goes to the bucket of its own axes and to those of the next best
combinations (probes), in every table. k follows the number of nodes, so that buckets stay small; the number of tables follows from a
simulation of pairs that have exactly the least cosine, of which at most one in MISS may meet nowhere; closer pairs meet more often.
Where rows of a bucket meet, all cosines are taken in double precision; only pairs that reach the limit are links. Pairs aren't emitted: a pair counts in the
first bucket that both have, and a bucket sends each node's number of links and the edges of a spanning forest.

Groups of near copies: around the smallest node of a crowded code (BALL_LEAST nodes) a ball takes the nodes within half of the limit's angle. Any two of them are linked
by the triangle inequality, so they are counted without being paired, and a bucket's ball members meet only nodes outside their ball. Buckets of more than CELL rows are
dealt over a grid of cells, so that no task holds a whole bucket. Nothing is capped.

Vectors that are null, empty or zero or hold a null or non-finite component are linked with nothing; vectors of different lengths aren't compared. Rows that repeat a key count as rows of their
own; of a component the smallest key names it, null only if no row has a key. An empty table gives an empty result; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, cos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, scratch_of
from .ngram_join import components, small

LIMIT, MISS = 0.9, 1e-3
CELL, BALL_LEAST, OCCUPANCY = 2048, 256, 4096
PROBES = {1: 3, 2: 9, 3: 16}  # codes of a node in each table, its own included; MOST_CODES for longer ones
MOST_CODES, RANKS, SIMULATED = 24, 3, 2000
SEED = 20240607


def hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row; its length is a power of two. Sums of two only, so a row's result doesn't depend on the batch."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def width(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


@lru_cache(maxsize=64)
def signs(dim: int, table: int, function: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table, function]).choice([-1.0, 1.0], (3, width(dim)))


def rotated(x: np.ndarray, dim: int, table: int, function: int) -> np.ndarray:
    x = np.pad(x, ((0, 0), (0, width(dim) - dim)))
    for s in signs(dim, table, function):
        x = hadamard(x * s)
        x = x / np.sqrt(x.shape[1])
    return x


@lru_cache(maxsize=16)
def rank_lists(k: int) -> np.ndarray:
    """Which combinations of the k functions' best axes are probed: those with two steps down at most."""
    out = [np.zeros(k, int)]
    for i in range(k):
        for step in range(1, RANKS):
            out.append(np.eye(k, dtype=int)[i] * step)
        out += [np.eye(k, dtype=int)[i] + np.eye(k, dtype=int)[j] for j in range(i)]
    if k == 2:
        out = [np.array([i, j]) for i in range(RANKS) for j in range(RANKS)]
    return np.array(out)


def table_codes(x: np.ndarray, dim: int, table: int, k: int) -> np.ndarray:
    """The codes of a table for each row of x, its own first, then its probes by what they lose."""
    n, axes = len(x), 2 * width(dim)
    lists = rank_lists(k)
    loss, code = np.zeros((n, len(lists))), np.zeros((n, len(lists)), np.int64)
    for f in range(k):
        r = rotated(x, dim, table, f)
        size = np.abs(r)
        top = min(RANKS, r.shape[1])
        order = np.argsort(-size, axis=1, kind="stable")[:, :top]
        best = np.take_along_axis(size, order, 1)
        axis = 2 * order + (np.take_along_axis(r, order, 1) < 0)
        step = np.minimum(lists[:, f], top - 1)
        loss += best[:, :1] ** 2 - best[:, step] ** 2
        code = code * axes + axis[:, step]
    loss[:, 0] = -1.0
    take = np.argsort(loss, axis=1, kind="stable")[:, : min(PROBES.get(k, MOST_CODES), len(lists))]
    return np.take_along_axis(code, take, 1)


def functions_for(dim: int, nodes: int) -> int:
    k = 1
    while nodes * PROBES.get(k, MOST_CODES) > OCCUPANCY * (2 * width(dim)) ** k:
        k += 1
    return k


@lru_cache(maxsize=64)
def tables_for(dim: int, k: int, limit: float, miss: float = MISS) -> int:
    """So many tables that simulated pairs of cosine `limit` all but `miss` of the time share a code."""
    rng = np.random.default_rng([SEED, dim, k])
    a = rng.standard_normal((SIMULATED, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((SIMULATED, dim))
    b -= (a * b).sum(1)[:, None] * a
    b = limit * a + np.sqrt(1 - limit * limit) * b / np.maximum(np.linalg.norm(b, axis=1), 1e-300)[:, None]
    one, other = table_codes(a, dim, 0, k), table_codes(b, dim, 0, k)
    met = min(max(float((one[:, :, None] == other[:, None, :]).any((1, 2)).mean()), 0.01), 0.9999)
    return max(2, ceil(np.log(miss) / np.log(1 - met)))


def buckets_of(x: np.ndarray, dim: int, k: int, tables: int) -> np.ndarray:
    """Bucket numbers of each row, table after table; no number belongs to two tables."""
    per = (2 * width(dim)) ** k
    return np.concatenate([table_codes(x, dim, t, k) + t * per for t in range(tables)], axis=1)


def units(col: pa.Array) -> tuple[int, np.ndarray]:
    """Dimension and unit vectors of a column of lists that are equally long."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x.shape[1], x / np.sqrt((x * x).sum(axis=1))[:, None]


def by_dim(batch: pa.RecordBatch, most: int = 2048):
    """The batch in parts of one dimension, of `most` rows at most."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        part = batch.filter(pa.array(dims == d)) if len(np.unique(dims)) > 1 else batch
        for i in range(0, len(part), most):
            yield part.slice(i, most)


# ---- nodes and codes ---------------------------------------------------------------------------------------------------

def nodes_of(vectors: DataFrame, scratch: Scratch, *, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """key, h, g of every row (h is null where a vector can't be compared); and the nodes: node, dim, h, g, least key, times, vec."""
    v = F.col(vector)
    kind = vectors.schema[vector].dataType.elementType.typeName()
    v = v if kind in ("float", "double") else v.cast("array<double>")
    able = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    v = F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast("float" if kind == "float" else "double")).otherwise(x))  # one zero
    rows = vectors.select(F.col(key).alias("key"), F.when(able, F.xxhash64(F.lit(0), v)).alias("h"), F.when(able, F.xxhash64(F.lit(1), v)).alias("g"), F.when(able, v).alias("vec"))
    grouped = rows.where("h is not null").groupBy("h", "g").agg(F.min("key").alias("least"), F.count("*").alias("times"), F.first("vec").alias("vec"))
    nodes = scratch.put(grouped.select(F.monotonically_increasing_id().alias("node"), F.size("vec").alias("dim"), "h", "g", "least", "times", "vec"), "nodes")
    return rows.drop("vec"), nodes


def codes(nodes: DataFrame, n: int, limit: float) -> DataFrame:
    """node, dim, bucket for each bucket of a node, and in the first such row a longer code, by which crowds are found."""

    def run(batches):
        for b in batches:
            for part in by_dim(b):
                dim, x = units(part.column("vec"))
                k = functions_for(dim, n)
                got = buckets_of(x, dim, k, tables_for(dim, k, limit))
                crowd = np.zeros(len(x), np.int64)
                for f in range(max(2, k + 1)):
                    r = rotated(x, dim, 0, f)
                    at = np.abs(r).argmax(axis=1)
                    crowd = crowd * 2 * r.shape[1] + 2 * at + (r[np.arange(len(r)), at] < 0)
                m, first = got.shape[1], np.zeros(got.shape, bool)
                first[:, 0] = True
                node, dims = np.repeat(part.column("node").to_numpy(), m), np.full(got.size, dim, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(dims), pa.array(got.ravel()), pa.array(np.repeat(crowd, m), mask=~first.ravel())], names=["node", "dim", "bucket", "crowd"])
            give_back()

    return nodes.select("node", "dim", "vec").mapInArrow(run, "node long, dim int, bucket long, crowd long")


# ---- balls -------------------------------------------------------------------------------------------------------------

def balls(ids: DataFrame, nodes: DataFrame, scratch: Scratch, *, limit: float, least: int) -> DataFrame | None:
    """node, ball: the nodes within half of the limit's angle around the leader of a crowded code, by the nearest leader; None without a crowd."""
    lead = ids.where("crowd is not null").groupBy("dim", "crowd").agg(F.count("*").alias("n"), F.min("node").alias("node")).where(F.col("n") >= least)
    lead = scratch.put(lead.select("node").distinct(), "leaders")
    n = lead.count()
    if not n:
        return None
    half = cos(acos(limit) / 2) + 1e-9
    where = scratch.put(ids.join(small(lead, n), "node").select("dim", "bucket", F.col("node").alias("ball")), "leader_buckets")
    met = ids.join(small(where, where.count()), ["dim", "bucket"]).select("node", "ball").distinct()
    vec = nodes.select("node", "vec", "dim")
    both = met.join(vec, "node").join(small(vec.join(small(lead, n), "node").select(F.col("node").alias("ball"), F.col("vec").alias("center")), n), "ball")

    def run(batches):
        for b in batches:
            for part in by_dim(b):
                c = (units(part.column("vec"))[1] * units(part.column("center"))[1]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("ball"), pa.array(c)], names=["node", "ball", "c"])

    near = both.select("node", "ball", "dim", "vec", "center").mapInArrow(run, "node long, ball long, c double").where(F.col("c") >= half)
    return scratch.put(near.groupBy("node").agg(F.min(F.struct((-F.col("c")).alias("c"), "ball")).alias("b")).select("node", F.col("b.ball").alias("ball")), "balls")


# ---- cells -------------------------------------------------------------------------------------------------------------

def cells(ids: DataFrame, cell: int) -> DataFrame:
    """dim, bucket, a, b, chunk, node, ball: each row in all cells of its bucket's grid where it can meet a node outside its ball.

    A bucket of `cell` rows at most is one cell. In a larger one, every ball with a quarter of `cell` rows has chunks of its own, the rest share chunks.
    """
    at = ["dim", "bucket"]
    per = ids.groupBy(*at, "ball").agg(F.count("*").alias("k")).withColumn("_all", F.sum("k").over(Window.partitionBy(*at)))
    per = per.where((F.col("_all") > 1) & ((F.col("k") < F.col("_all")) | (F.col("ball") < 0)))
    per = per.withColumn("own", F.when((F.col("_all") > cell) & (4 * F.col("k") >= cell), F.col("ball")).otherwise(F.lit(-1)))
    groups = per.groupBy(*at, "own").agg(F.ceil(F.sum("k") / cell).cast("int").alias("chunks"))
    before = F.sum("chunks").over(Window.partitionBy(*at).orderBy("own"))
    groups = groups.withColumns({"_start": (before - F.col("chunks")).cast("int"), "_total": F.sum("chunks").over(Window.partitionBy(*at)).cast("int")})
    plan = per.select(*at, "ball", "own").join(groups, [*at, "own"])
    rows = ids.join(plan, [*at, "ball"]).withColumn("chunk", (F.col("_start") + F.pmod(F.xxhash64("node"), F.col("chunks"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_total") - 1), lambda c: (F.col("own") < 0) | (c < F.col("_start")) | (c >= F.col("_start") + F.col("chunks")))
    rows = rows.select(*at, "chunk", "node", "ball", F.explode(others).alias("_other"))
    return rows.select(*at, F.least("chunk", "_other").alias("a"), F.greatest("chunk", "_other").alias("b"), "chunk", "node", "ball")


def first_met(codes_a: np.ndarray, codes_b: np.ndarray, bucket: int, tables: int, step: int = 400_000) -> np.ndarray:
    """Whether `bucket` is the smallest one that both rows of a pair have."""
    out = np.zeros(len(codes_a), bool)
    none = np.iinfo(np.int64).max
    for lo in range(0, len(codes_a), step):
        a, b = codes_a[lo : lo + step], codes_b[lo : lo + step]
        best = np.full(len(a), none)
        per = a.shape[1] // tables
        for t in range(tables):  # codes of different tables never agree
            mine = a[:, t * per : (t + 1) * per]
            same = (mine[:, :, None] == b[:, None, t * per : (t + 1) * per]).any(2)
            best = np.minimum(best, np.where(same, mine, none).min(1))
        out[lo : lo + step] = best == bucket
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number in the component of each of n numbers."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def meet(t: pa.Table, bucket: int, n: int, limit: float) -> pa.RecordBatch | None:
    """node, links, other: what the rows of one cell have in links that no earlier bucket shows, and a spanning forest of these."""
    dim, x = units(t.column("vec"))
    node, ball, times, chunk = (t.column(c).to_numpy() for c in ("node", "ball", "times", "chunk"))
    a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
    left, right = (np.flatnonzero(chunk == c) for c in (a, b))
    found = []
    for lo in range(0, len(left), 512):
        some = left[lo : lo + 512]
        i, j = np.nonzero(x[some] @ x[right].T >= limit)
        i, j = some[i], right[j]
        ok = (ball[i] < 0) | (ball[i] != ball[j])
        if a == b:
            ok &= node[i] < node[j]
        found.append((i[ok], j[ok]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
    if not len(i):
        return None
    k = functions_for(dim, n)
    tables = tables_for(dim, k, limit)
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    have = buckets_of(x[used], dim, k, tables)
    ok = first_met(have[back[: len(i)]], have[back[len(i) :]], bucket, tables)
    i, j = back[: len(i)][ok], back[len(i) :][ok]
    if not len(i):
        return None
    links = np.bincount(i, weights=times[used][j], minlength=len(used)) + np.bincount(j, weights=times[used][i], minlength=len(used))
    root = forest(len(used), i, j)
    own = links > 0
    return pa.RecordBatch.from_arrays([pa.array(node[used][own]), pa.array(links[own].astype(np.int64)), pa.array(node[used][root][own])], names=["node", "links", "other"])


def met_links(planned: DataFrame, nodes: DataFrame, n: int, limit: float) -> DataFrame:
    """node, links, other from every cell. Rows come sorted by cell, so that a task holds one cell and one batch."""
    at = ["dim", "bucket", "a", "b"]
    rows = planned.join(nodes.select("node", "times", "vec"), "node").repartition(*at).sortWithinPartitions(*at)
    schema_names = [*at, "chunk", "node", "ball", "times", "vec"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held)
            held.clear()
            return meet(t, t.column("bucket")[0].as_py(), n, limit) if len(t) > 1 else None

        last = None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in at])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                now = tuple(keys[:, lo])
                if held and now != last and (out := done()) is not None:
                    yield out
                last = now
                held.append(b.slice(lo, hi - lo))
        if held and (out := done()) is not None:
            yield out
        give_back()

    return rows.select(*schema_names).mapInArrow(run, "node long, links long, other long")


# ---- result ------------------------------------------------------------------------------------------------------------

def near_copies(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", limit: float = LIMIT, cell: int = CELL, ball_least: int = BALL_LEAST, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. The key keeps its type."""
    scratch = scratch or scratch_of(vectors.sparkSession)
    rows, nodes = nodes_of(vectors, scratch, key=key, vector=vector)
    n = nodes.count()
    ids = scratch.put(codes(nodes, n, limit), "codes")
    ball = balls(ids, nodes, scratch, limit=limit, least=ball_least)
    known = ids.drop("crowd").withColumn("ball", F.lit(-1).cast("long")) if ball is None else ids.drop("crowd").join(ball, "node", "left").fillna({"ball": -1})
    found = scratch.put(met_links(cells(known, cell), nodes, n, limit), "links")
    scratch.release_shuffles()
    edges, own = found.select(F.col("node").alias("x"), F.col("other").alias("y")), F.col("times") - 1
    counted = nodes.select("node", "h", "g", "least", "times").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    if ball is not None:
        edges = edges.unionByName(ball.select(F.col("node").alias("x"), F.col("ball").alias("y")))
        counted = counted.join(ball, "node", "left")
        inside = counted.where("ball is not null").groupBy("ball").agg(F.sum("times").alias("_inside"))
        counted, own = counted.join(inside, "ball", "left"), F.coalesce("_inside", "times") - 1
    counted = counted.select("node", "h", "g", "least", (own + F.coalesce("links", F.lit(0))).alias("n_links"))
    edges = scratch.put(edges.where("x <> y").distinct(), "edges")
    if not edges.isEmpty():
        comps = scratch.put(components(edges, scratch), "components")
        named = comps.join(nodes.select("node", "least"), "node").groupBy("comp").agg(F.min("least").alias("_name"))
        counted = counted.join(comps.join(named, "comp").select("node", "_name"), "node", "left").withColumn("least", F.coalesce("_name", "least"))
    # written, so that the join has exchanges of its own and the copies of one vector can be split
    result = scratch.put(counted.select("h", "g", "n_links", F.col("least").alias("component_id")), "counted")
    out = rows.where("h is not null").join(result, ["h", "g"]).select("key", "n_links", "component_id")
    out = out.unionByName(rows.where("h is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")))
    return out.select(F.col("key").alias("vec_id"), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
