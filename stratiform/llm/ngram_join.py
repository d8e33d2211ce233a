"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its 5-word shingles, each a 64-bit hash. Shingles have one order for all documents: by
class of estimated document frequency (log2 of a counter that all documents feed), then by hash. If two documents
have 100 x intersection >= 75 x union, then for any l their l-prefixes, the first n - ceil(0.75 n) + l shingles,
share l shingles at least. Each document chooses its l by the estimated cost of its
prefix (the frequencies of its shingles); a pair has to share the smaller of its two l's.

Documents with equal sets are one node (a 64-bit sum over the set names it). Only what shingles are shared by two
nodes becomes postings. To find classes without all pairs of a group, each shingle's nodes first meet
two leaders; the exact check links them, and then only pairs from different components are made, each time
between a node outside the shingle's largest component and the others. No partner is capped, so no
link is lost: a pair that is never made lies within one component already.

Nulls and texts without a word have no shingle and stay alone; fewer than five words give one shingle, the
whole sequence. Rows with the same doc_id are rows of their own, nodes by their text. Of ties the smallest key, then the smallest hash wins. Very long texts are
hashed whole. Empty tables give an empty result; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, ddl, give_back, named, scratch_of, slices, unused

WORDS, NUM, DEN = 5, 75, 100
MAX_MATCH = 4  # the longest l; any cap is exact, as l = 1 is
TABLE_BITS = (24, 26)  # least and most counters of the frequency table, a byte each: 16 to 64 MB are broadcast, whatever the input
BROADCAST_NODES = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_COEF = _rng.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 3 << 19)
        one = np.ones(1, np.uint64)
        _powers[:] = [np.cumprod(np.concatenate([one, np.full(size, b)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of the different shingles of each text, by document and hash."""
    n = len(col)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not n:
        return none
    at = np.frombuffer(col.buffers()[1], np.int32, n + 1 + col.offset)[col.offset :].astype(np.int64)
    if at[-1] == at[0]:
        return none
    raw = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if col.null_count:  # a null's bytes, if any, are no text
        null = np.asarray(col.is_null())
        raw = raw.copy()
        for i in np.flatnonzero(null & (at[1:] > at[:-1])):
            raw[at[i] : at[i + 1]] = 32
    gap = _GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate([[True], gap[:-1]]) | edge[:-1]
    after = np.concatenate([gap[1:], [True]]) | edge[1:]
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    if not len(start):
        return none
    power, inverse = powers(len(raw))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)])])
    word = mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(at, start, side="right") - 1
    m = len(word)
    owner, value = none
    if m >= WORDS:
        full = doc[: m - WORDS + 1] == doc[WORDS - 1 :]
        h = np.zeros(m - WORDS + 1, np.uint64)
        for i in range(WORDS):
            h += word[i : m - WORDS + 1 + i] * _COEF[i]
        owner, value = doc[: m - WORDS + 1][full], mix(h[full])
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        first = np.searchsorted(doc, short)
        h = np.full(len(short), _COEF[7]) * count[short].astype(np.uint64)
        for i in range(WORDS - 1):
            has = count[short] > i
            h[has] += word[first[has] + i] * _COEF[i]
        owner, value = np.concatenate([owner, short]), np.concatenate([value, mix(h)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new]


def node_ids(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """An order-free 64-bit sum over each set; 0 for an empty set."""
    s = np.zeros(n, np.uint64)
    np.add.at(s, owner, mix(value ^ _COEF[6])) if len(owner) < 1000 else _segment_sum(s, owner, mix(value ^ _COEF[6]))
    return s.view(np.int64)


def _segment_sum(out: np.ndarray, owner: np.ndarray, x: np.ndarray) -> None:
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    out[owner[first]] = np.add.reduceat(x, first)


def required(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with any partner: ceil(0.75 n)."""
    return -(-NUM * n // DEN)


# ---- documents and frequencies -----------------------------------------------------------------------------------

def table_bits(documents: DataFrame) -> int:
    """Size of the counter table, as a power of two: one counter for 32 bytes of stored input, within TABLE_BITS."""
    stored = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # noqa: SLF001
    return min(max((stored // 32).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])


def planes(a: np.ndarray) -> bytes:
    """The first bytes of all values, then the second bytes, and so on: high bytes are mostly 0 and cost next to nothing compressed."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Places in order and values of the counters that aren't 0."""
    gap = np.diff(at, prepend=-1) - 1
    return zstandard.ZstdCompressor(level=3).compress(planes(gap.astype("<u2")) + planes(counts.astype("<u4")))


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What pack() was given."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = len(raw) // 6
    return np.cumsum(from_planes(raw[: 2 * n], "<u2").astype(np.int64) + 1) - 1, from_planes(raw[2 * n :], "<u4").astype(np.int64)


def document_table(documents: DataFrame, scratch: Scratch, *, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """doc_id, node, n and two hashes (h, g) of key and text of every row, and the table of frequency classes; one scan.

    Document rows are written where they are made. Each task also sends its counters for every few million shingles, in groups of 2^16; they are
    added up where a group meets. Counters travel as the gaps between those that aren't 0, and their values, compressed (pack, unpack).
    """
    bits = table_bits(documents)
    low, n_groups = 16, 1 << (bits - 16)
    one = [F.col(key), F.col(text)]
    docs = documents.select(F.col(key).alias("doc_id"), F.xxhash64(*one).alias("h"), F.xxhash64(F.lit(1), *one).alias("g"), F.col(text).alias("_text"))
    kept = docs.select("doc_id", "h", "g")
    names = ["doc_id", "h", "g", "node", "n", "grp", "payload"]
    types = to_arrow_schema(kept.schema).types

    def send(batches):
        held: list[np.ndarray] = []
        size = 0

        def groups():
            found, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cuts = np.searchsorted(found, np.arange(n_groups + 1) << low)
            live = np.flatnonzero(np.diff(cuts))
            body = [pack(found[cuts[g] : cuts[g + 1]] - (g << low), times[cuts[g] : cuts[g + 1]]) for g in live.tolist()]
            n = len(live)
            return pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in types), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(live, pa.int32()), pa.array(body, pa.binary())], names=names)

        for b in batches:
            for s in slices(b, "_text", 1 << 20):
                owner, value = shingles(s.column("_text"))
                n = len(s)
                count = np.bincount(owner, minlength=n)
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in ("doc_id", "h", "g")), pa.array(node_ids(owner, value, n)), pa.array(count, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
                held.append((value >> np.uint64(64 - bits)).astype(np.int32))
                size += len(value)
                if size > 4_000_000:
                    yield groups()
                    size = 0
            give_back()
        if size:
            yield groups()
        give_back()

    def add_up(batches):
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for g, raw in zip(b.column("grp").to_pylist(), b.column("payload").to_pylist(), strict=True):
                at, value = unpack(raw)
                counts.setdefault(g, np.zeros(1 << low, np.int64))[at] += value
        for g, c in counts.items():
            cls = np.floor(np.log2(np.maximum(c, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([cls.tobytes()], pa.binary())], names=["grp", "payload"])

    made = scratch.put(docs.mapInArrow(send, ddl(kept, "node long", "n int", "grp int", "payload binary")), "sets")
    counters = made.where("payload is not null").select("grp", "payload")
    table = np.zeros(1 << bits, np.uint8)
    step = 1 << low
    for g, raw in counters.repartition("grp").mapInArrow(add_up, "grp int, payload binary").collect():  # 2^TABLE_BITS bytes, whatever the input
        table[g * step : (g + 1) * step] = np.frombuffer(raw, np.uint8)
    docs = scratch.put(made.where("payload is null").select("doc_id", "h", "g", "node", "n"), "nodes")
    scratch.drop(made)
    return docs, table


# ---- postings ----------------------------------------------------------------------------------------------------

def bits_of(table: np.ndarray) -> int:
    return len(table).bit_length() - 1


def prefixes(owner: np.ndarray, value: np.ndarray, n_docs: int, table: np.ndarray, floor: int) -> tuple[np.ndarray, ...]:
    """Of each document's adaptive prefix: owner, shingle, rank in 256ths of the prefix, class; and each document's l and n.

    Postings hold a shingle's upper 48 bits. Where two shingles of a document agree in these they become one, so the
    document's l falls by one: fewer matches are asked for and no link is lost.
    """
    merged = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (value[1:] >> np.uint64(16) == value[:-1] >> np.uint64(16))], minlength=n_docs)
    cls = np.maximum(table[value >> np.uint64(64 - bits_of(table))], floor)
    order = np.lexsort((value, cls, owner))
    owner, value, cls = owner[order], value[order], cls[order]
    n = np.bincount(owner, minlength=n_docs)
    first = np.cumsum(n) - n
    rank = np.arange(len(owner)) - first[owner]
    slack = n - required(n)
    base = rank <= slack[owner]
    cost = np.bincount(owner[base], weights=np.exp2(cls[base].astype(float) - floor), minlength=n_docs) / np.maximum(1, slack + 1)
    ell = 1 + (cost >= 4) + (cost >= 16).astype(int) + (cost >= 64)
    ell = np.minimum(np.minimum(ell, MAX_MATCH), np.maximum(1, required(n)))
    keep = rank < slack[owner] + ell[owner]
    owner, rank = owner[keep], rank[keep]
    return owner, value[keep], (rank * 256 // (slack + ell)[owner]).astype(np.uint8), cls[keep], np.maximum(0, ell - merged).astype(np.uint8), n


def shared_postings(documents: DataFrame, table: np.ndarray, n_rows: int, scratch: Scratch, *, text: str) -> DataFrame:
    """tok, node, n, part, ell for each prefix shingle that two nodes or more have (or a part of a frequent one's nodes).

    Prefixes travel as binary columns, dealt by shingle; shingles of a frequent class are dealt by
    shingle and node, so that no task gets all of them.
    """
    sc = documents.sparkSession.sparkContext
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usual = int(np.floor(np.log2(max(1.0, float(np.exp2(table.astype(float)).mean())))) + 1)
    frequent = max(usual + 1, int(np.ceil(np.log2(max(64, n_rows / 1000)))) )
    shared = sc.broadcast((table, usual, frequent))
    groups = max(16, 2 * parts)
    fields = [("grp", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("part", pa.binary())]
    names = [f[0] for f in fields]

    def send(batches):
        table, usual, frequent = shared.value
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush():
            node, n, ell, tok, part, cls = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            key = mix(tok)
            key = np.where(cls >= frequent, mix(key ^ (node.view(np.uint64) & np.uint64(63))), key)
            grp = (key % np.uint64(groups)).astype(np.int32)
            order = np.lexsort((node, grp))
            node, n, ell, tok, part, grp = (a[order] for a in (node, n, ell, tok, part, grp))
            cuts = np.searchsorted(grp, np.arange(groups + 1))
            for g in range(groups):
                a, b = cuts[g], cuts[g + 1]
                if a == b:
                    continue
                own = np.flatnonzero(np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]])) + a
                count = np.diff(np.append(own, b)).astype(np.uint32)
                body = [node[own].tobytes(), planes((n[own].astype(np.uint32) << np.uint32(3)) | ell[own]), planes(count), tok[a:b].astype(np.uint32).tobytes(), (tok[a:b] >> np.uint64(32)).astype(np.uint16).tobytes(), part[a:b].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *(pa.array([x], pa.binary()) for x in body)], names=names)

        for b in batches:
            for s in slices(b, "_text", 1 << 20):
                owner, value = shingles(s.column("_text"))
                ids = node_ids(owner, value, len(s))
                fresh = np.zeros(len(s), bool)
                for i, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                keep = fresh[owner]
                owner, value, part, cls, ell, n = prefixes(owner[keep], value[keep], len(s), table, usual)
                held.append((ids[owner], n[owner], ell[owner], value >> np.uint64(16), part, cls))
                size += len(owner)
                if size > 1_200_000:
                    yield from flush()
                    size = 0
            give_back()
        if size:
            yield from flush()
        give_back()

    def meet(batches):
        _, _, frequent = shared.value
        table = shared.value[0]
        by: dict[int, list[tuple]] = {}
        for b in batches:
            for g, *raw in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                node, low, high, part = (np.frombuffer(raw[i], t) for i, t in ((0, np.int64), (3, np.uint32), (4, np.uint16), (5, np.uint8)))
                sizes, count = from_planes(raw[1], "<u4"), from_planes(raw[2], "<u4")
                tok = low.astype(np.int64) | (high.astype(np.int64) << 32)
                by.setdefault(g, []).append((tok, np.repeat(node, count), np.repeat(sizes, count), part))
        for got in by.values():
            tok, node, sizes, part = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.lexsort((node, tok))
            tok, node, sizes, part = tok[order], node[order], sizes[order], part[order]
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
            tok, node, sizes, part = tok[new], node[new], sizes[new], part[new]
            same = tok[1:] == tok[:-1]
            two = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            two |= table[tok >> (48 - bits_of(table))] >= frequent
            if two.any():
                yield pa.RecordBatch.from_arrays([pa.array(tok[two]), pa.array(node[two]), pa.array((sizes[two] >> 3).astype(np.int32)), pa.array(part[two].astype(np.int32)), pa.array((sizes[two] & 7).astype(np.int32))], names=["tok", "node", "n", "part", "ell"])
        give_back()

    docs = documents.select(F.col(text).alias("_text"))
    sent = docs.mapInArrow(send, "grp int, nodes binary, sizes binary, counts binary, low binary, high binary, part binary")
    return scratch.put(sent.repartition("grp").mapInArrow(meet, "tok long, node long, n int, part int, ell int"), "shared")


def node_sets(documents: DataFrame, nodes: DataFrame, scratch: Scratch, *, text: str) -> DataFrame:
    """node, items (sorted hashes) of the named nodes, each once."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for s in slices(b, "_text", 1 << 20):
                owner, value = shingles(s.column("_text"))
                ids = node_ids(owner, value, len(s))
                n = np.bincount(owner, minlength=len(s))
                fresh = np.zeros(len(s), bool)
                for i, x in enumerate(ids.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                keep = fresh[owner]
                ends = np.concatenate([[0], np.cumsum(n[fresh])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), pa.ListArray.from_arrays(pa.array(ends), pa.array(value[keep].view(np.int64)))], names=["node", "items"])
            give_back()

    count = nodes.count()
    sets = documents.select(F.col(text).alias("_text")).mapInArrow(run, "node long, items array<long>")
    named = F.broadcast(nodes) if count <= BROADCAST_NODES else nodes
    return scratch.put(sets.join(named, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")), "items", "uncompressed")  # hashes don't shrink


# ---- links and components ------------------------------------------------------------------------------------------

def checked(documents: DataFrame, pairs: DataFrame, scratch: Scratch, *, text: str) -> DataFrame:
    """The pairs (x, y) whose sets really have the similarity."""
    pairs = scratch.put(pairs, "pairs")
    sets = node_sets(documents, pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), scratch, text=text)
    scratch.release_shuffles()
    with_y = pairs.join(sets.select(F.col("node").alias("y"), F.col("items").alias("iy")), "y")
    both = with_y.join(sets.select(F.col("node").alias("x"), F.col("items").alias("ix")), "x")
    common = F.size(F.array_intersect("ix", "iy"))
    links = scratch.put(both.where(DEN * common >= NUM * (F.size("ix") + F.size("iy") - common)).select("x", "y"), "links")
    scratch.drop(sets, pairs)
    return links


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp for every linked node; comp is the component's smallest node. Large-star and small-star in turn, until nothing changes."""
    edges = scratch.put(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    mark = None
    while True:
        undirected = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = undirected.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = undirected.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = scratch.put(large.where("u <> v").distinct(), "large")
        least = step.groupBy("u").agg(F.min("v").alias("m"))
        small = step.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = scratch.put(small.where("u <> v").distinct(), "small")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges, step)
        edges = new
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        mark = now


def promising(shared: DataFrame) -> DataFrame:
    """x, y of the pairs whose count `c` of shared prefix shingles can still reach the similarity.

    The document whose prefix ends first in the common order shares with the other one only what both prefixes
    show and what stands after its own prefix. So the overlap is at most c + max(n - prefix length), and it must be
    ceil(75 (nx + ny) / 175); the smaller l is needed in any case.
    """
    after = lambda n, ell: F.expr(f"({NUM} * {n} + {DEN - 1}) div {DEN} - {ell}")
    overlap = F.expr(f"({NUM} * (nx + ny) + {NUM + DEN - 1}) div {NUM + DEN}")
    need = F.greatest(F.least("ex", "ey"), overlap - F.greatest(after("nx", "ex"), after("ny", "ey")))
    return shared.where(F.col("c") >= need).select("x", "y")


def sized(pairs: DataFrame) -> DataFrame:
    return pairs.where((DEN * F.col("nx") >= NUM * F.col("ny")) & (DEN * F.col("ny") >= NUM * F.col("nx")))


def ranked(post: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds a lower bound of each shingle's rank in its document, and `top`, the most that a document can share: a prefix shingle that no other node has is in no overlap, so top = n - such shingles."""
    length = F.expr(f"n - ({NUM} * n + {DEN - 1}) div {DEN} + ell")
    post = post.withColumn("rank", (F.col("part") * length / 256).cast("int")).drop("part")
    top = post.groupBy("node").agg((F.first("n") - F.first(length) + F.count("*")).cast("int").alias("top"))
    return scratch.put(post.join(top, "node"), "ranked")


def leader_pairs(post: DataFrame) -> DataFrame:
    """Each shingle's nodes with the node that can share most and the smallest node, where the shingles they meet at are enough."""
    lead = post.groupBy("tok").agg(F.max(F.struct("top", "node", "n", "ell")).alias("a"), F.min(F.struct("node", "n", "ell")).alias("b"))
    both = post.join(lead, "tok").select("node", "n", "ell", F.explode(F.array(F.struct("a.node", "a.n", "a.ell"), "b")).alias("l"))
    pairs = both.select(F.col("l.node").alias("x"), F.col("l.n").alias("nx"), F.col("l.ell").alias("ex"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("ell").alias("ey")).where("x <> y")
    met = sized(pairs).groupBy("x", "y", "nx", "ny", "ex", "ey").agg(F.count("*").alias("c"))
    return promising(met).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def cross_pairs(post: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of different components that share enough prefix shingles.

    A pair of known sizes needs an overlap of o = ceil(75 (nx + ny) / 175), so it already shares a shingle among
    the first n - o + 1 of each; only those are joined. All shared prefix shingles of the pairs that meet so are then
    counted, against l and against the overlap that is still possible.
    """
    known = post.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = known.groupBy("tok", "comp").agg(F.count("*").alias("k"))
    major = sizes.groupBy("tok").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("tok", F.col("m.comp").alias("major"))
    live = known.join(major, "tok")
    left = live.where("comp <> major").select("tok", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("ell").alias("ex"), F.col("comp").alias("cx"), F.col("rank").alias("rx"), F.col("top").alias("tx"))
    right = live.select("tok", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("ell").alias("ey"), F.col("comp").alias("cy"), F.col("rank").alias("ry"), F.col("top").alias("ty"), (F.col("comp") == F.col("major")).alias("in_major"))
    overlap = F.expr(f"({NUM} * (nx + ny) + {NUM + DEN - 1}) div {NUM + DEN}")
    early = (F.col("rx") <= F.col("nx") - overlap) & (F.col("ry") <= F.col("ny") - overlap)
    able = (F.col("tx") >= overlap) & (F.col("ty") >= overlap)
    pairs = sized(left.join(right, "tok").where("cx <> cy and (in_major or x < y)").where(early & able))
    turned = F.col("x") > F.col("y")  # one order, so that a pair's shingles are counted together
    swap = lambda a, b, name: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(name)
    pairs = pairs.select(swap("x", "y", "x"), swap("y", "x", "y"), swap("nx", "ny", "nx"), swap("ny", "nx", "ny"), swap("ex", "ey", "ex"), swap("ey", "ex", "ey"))
    some = scratch.put(pairs.distinct(), "met")
    scratch.release_shuffles()
    nodes = some.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    # written, so that the joins have exchanges of their own and a node in many pairs can be split
    prefix = scratch.put(post.join(nodes, "node", "left_semi").groupBy("node").agg(F.collect_list("tok").alias("toks")), "prefixes")
    both = some.join(prefix.select(F.col("node").alias("x"), F.col("toks").alias("tx")), "x").join(prefix.select(F.col("node").alias("y"), F.col("toks").alias("ty")), "y")
    return promising(both.withColumn("c", F.size(F.array_intersect("tx", "ty"))))


def components_of(documents: DataFrame, scratch: Scratch, *, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Of every row doc_id, h, g, node and n; and node, comp for the nodes that have a link."""
    docs, table = document_table(documents, scratch, key=key, text=text)
    scratch.release_shuffles()
    n_rows = docs.count()
    shared = shared_postings(documents, table, n_rows, scratch, text=text)
    scratch.release_shuffles()
    post = ranked(shared, scratch)
    scratch.drop(shared)
    scratch.release_shuffles()
    links = checked(documents, leader_pairs(post), scratch, text=text)
    comps = components(links, scratch)
    scratch.release_shuffles()
    more = checked(documents, cross_pairs(post, comps, scratch), scratch, text=text)
    return docs, scratch.put(components(links.unionByName(more), scratch), "components")


def with_least(docs: DataFrame, comps: DataFrame, least: Column, name: str, scratch: Scratch) -> DataFrame:
    """docs with the least value of `least` among the rows of their component; rows without a shingle have null.

    Copies are added up by node before anything meets, so that a group of copies is a few rows from each task.
    """
    n_comps = comps.count()
    nodes = docs.where("n > 0").groupBy("node").agg(F.min(least).alias(name))
    known = nodes.join(small(comps, n_comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = known.groupBy("comp").agg(F.min(name).alias(name))
    # only nodes with a link have another value than their own
    linked = comps.join(best, "comp").select("node", F.col(name).alias("_best"))
    # written, so that the join has an exchange of its own and the copies of one text can be split
    every = scratch.put(nodes.join(small(linked, n_comps), "node", "left").select("node", F.coalesce("_best", name).alias(name)), "best")
    alone = docs.where("n = 0").withColumn(name, F.lit(None).cast(nodes.schema[name].dataType))
    return docs.where("n > 0").join(every, "node").unionByName(alone)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_NODES else df


def join(documents: DataFrame, *, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row. The key keeps its type; a component without any key has null."""
    scratch = scratch or scratch_of(documents.sparkSession)
    docs, comps = components_of(documents, scratch, key=key, text=text)
    out = with_least(docs.select("doc_id", "node", "n"), comps, F.col("doc_id"), "component_id", scratch)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, *, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row of each component, columns as they were; rows without a shingle all stay.

    It is the row of the smallest key (null comes last), of rows that share that key one with the smallest hash of key and text. Rows are told
    apart by 128 bits of that hash, not by their keys. Of rows with the same key and text that is chosen by a hash of all their columns.
    """
    scratch = scratch or scratch_of(documents.sparkSession)
    docs, comps = components_of(documents, scratch, key=key, text=text)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "g")
    least = scratch.put(with_least(docs, comps, order, "least", scratch).where("n > 0").select("h", "g", (F.col("least.h") == F.col("h")).alias("stays")), "least")
    rows = least.groupBy("h", "g").agg(F.first("stays").alias("stays"), F.count("*").alias("times"))
    marks = scratch.put(rows.where("not stays or times > 1").select("h", "g", "stays"), "marks")
    columns = documents.columns
    h, g, stays = unused(columns, "_h"), unused(columns, "_g"), unused(columns, "_stays")
    one = [F.col(key), F.col(text)]
    marked = documents.withColumns({h: F.xxhash64(*one), g: F.xxhash64(F.lit(1), *one)}).join(small(marks.select(F.col("h").alias(h), F.col("g").alias(g), F.col("stays").alias(stays)), marks.count()), [h, g], "left")
    left = marked.where(F.col(stays).isNull()).select(*named(*columns))
    again = marked.where(stays)
    plain = [f.name for f in documents.schema if "map<" not in f.dataType.simpleString()]
    once = again.groupBy(h, g).agg(F.min_by(F.struct(*named(*columns)), F.xxhash64(*named(*plain))).alias("row"))
    return left.unionByName(once.select("row.*"))
