"""Harmonic fields through known voxels of a volume, solved over blocks, and volumes sampled along a field.

The volume is cut into blocks, long along its longest axis; a block is one row and one task's work, whatever the volume's size. A block is first solved
together with a margin of its neighbours' voxels, which is all there is to do where known voxels are near. What is left then lies on the faces between blocks only, and conjugate gradients run over
the faces of all blocks at once: a block sends its faces to its six neighbours, and a local
solve of its own voxels is the preconditioner. A round carries no voxel but those of faces; both of its products come from one pass, so a round is one write and one sum of a
few numbers a block. Tables of past rounds are deleted. All components of the field (say, three displacements) share a round.

Free edges: nothing is known beyond the volume. Points in one voxel are averaged. Without any point the field is 0.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Tables

AXES = ("z", "y", "x")
_KEY = ["bz", "by", "bx"]
_ARRAYS = ["c", "r", "p", "s", "u", "w"]  # on faces: the correction, the residual, the directions and products of conjugate gradients
_PLACE = "bz int, by int, bx int, side int, known binary, "
_STATE = _PLACE + ", ".join(f"{a} binary" for a in _ARRAYS)
_SUMS = ", g array<double>, d array<double>, rr array<double>"
STRETCH, BLOCK_VOXELS = 8, 1 << 17  # a block is so many times longer than wide at most, with so many voxels
TASK_BLOCKS = 16  # that a task starts with


class Layout:
    """Where blocks lie, and the stencil on a block with ghost planes around it."""

    def __init__(self, shape: tuple[int, int, int], block: int, spacing: tuple[float, float, float], parts: int):
        self.shape, self.parts, self.margin = tuple(map(int, shape)), parts, block
        self.edges = [block] * 3
        self.edges[int(np.argmax(self.shape))] = max(block, min(STRETCH * block, BLOCK_VOXELS // (block * block)))
        self.weights = [1.0 / (h * h) for h in spacing]
        self.counts = [-(-n // b) for n, b in zip(self.shape, self.edges, strict=True)]

    def size(self, at: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(min(b, n - i * b) for i, n, b in zip(at, self.shape, self.edges, strict=True))

    def around(self, at: tuple[int, ...]) -> list[tuple[int, int]]:
        """First and last place (exclusive) along each axis of the block and its margin."""
        return [(max(0, i * b - self.margin), min(n, (i + 1) * b + self.margin)) for i, n, b in zip(at, self.shape, self.edges, strict=True)]

    def neighbours(self, at: tuple[int, ...]):
        """(side, place): side 2a is the block before along axis a, 2a + 1 the one behind."""
        for axis in range(3):
            for step in (0, 1):
                to = list(at)
                to[axis] += 2 * step - 1
                if 0 <= to[axis] < self.counts[axis]:
                    yield 2 * axis + step, tuple(to)

    def faces(self, at: tuple[int, ...]) -> np.ndarray:
        """The block's voxels that lie beside another block."""
        out = np.zeros(self.size(at), bool)
        for side, _ in self.neighbours(at):
            out[_plane(side)] = True
        return out

    def diagonal(self, at: tuple[int, ...]) -> np.ndarray:
        """Sum of the weights towards all voxels beside each voxel, in this block or another."""
        return self.sums([(i * b, i * b + n) for i, b, n in zip(at, self.edges, self.size(at), strict=True)], self.shape)

    def sums(self, box: list[tuple[int, int]], shape: tuple[int, ...]) -> np.ndarray:
        """Sum of the weights towards all voxels beside each voxel of a box in a volume of this shape."""
        out = np.zeros([b - a for a, b in box])
        for axis, w in enumerate(self.weights):
            place = np.arange(*box[axis])
            n = w * ((place > 0).astype(float) + (place < shape[axis] - 1))
            out += n.reshape([-1 if i == axis else 1 for i in range(3)])
        return out

    def apply(self, f: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """The weighted Laplacian of f [z, y, x], which is 0 beyond the block."""
        out = f * diagonal
        for axis, w in enumerate(self.weights):
            head, tail = [slice(None)] * 3, [slice(None)] * 3
            head[axis], tail[axis] = slice(1, None), slice(None, -1)
            g = f if w == 1.0 else w * f
            out[tuple(head)] -= g[tuple(tail)]
            out[tuple(tail)] -= g[tuple(head)]
        return out

    def local_solve(self, r: np.ndarray, free: np.ndarray, diagonal: np.ndarray, rtol: float) -> np.ndarray:
        """f [component, z, y, x] whose Laplacian is r on free voxels, with 0 elsewhere and beyond the block: by conjugate gradients on the block.

        Voxels lie in one line, with zeros around each row and plane, so that a neighbour is a shift.
        """
        wide = lambda a: np.pad(a, 1).ravel()
        n = np.array(free.shape) + 2
        shifts = [int(n[1] * n[2]), int(n[2]), 1]
        edge, size = shifts[0], int(n.prod())
        core = slice(edge, size - edge)
        on, diag = wide(free.astype(float))[core], wide(np.where(free, diagonal, 0.0))[core]
        inverse = np.divide(1.0, diag, out=np.zeros_like(diag), where=diag > 0)
        out = np.zeros_like(r)
        for f, start in zip(out, r, strict=True):
            rest, found, p, ap = wide(start)[core] * on, np.zeros(size), np.zeros(size), np.empty(size - 2 * edge)
            z = rest * inverse
            p[core] = z
            found, q = found[core], p[core]
            stop, rz, part = rtol * rtol * np.vdot(rest, rest), np.vdot(rest, z), np.empty_like(ap)
            for _ in range(10 * max(10, start.size)):
                if np.vdot(rest, rest) <= stop:
                    break
                np.multiply(q, diag, out=ap)
                for w, k in zip(self.weights, shifts, strict=True):
                    np.add(p[edge - k : size - edge - k], p[edge + k : size - edge + k], out=part)
                    if w != 1.0:
                        part *= w
                    ap -= part
                ap *= on
                along = np.vdot(q, ap)
                if along <= 0:
                    break
                step = rz / along
                np.multiply(q, step, out=part)
                found += part
                ap *= step
                rest -= ap
                np.multiply(rest, inverse, out=z)
                new = np.vdot(rest, z)
                q *= new / rz
                q += z
                rz = new
            f[:] = np.concatenate([np.zeros(edge), found, np.zeros(edge)]).reshape(n)[1:-1, 1:-1, 1:-1]
        return out


def _plane(side: int) -> tuple:
    """The index of the plane of a block [z, y, x] at a side."""
    return tuple((0 if side % 2 == 0 else -1) if i == side // 2 else slice(None) for i in range(3))


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(bits: bytes, size: tuple[int, ...]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=int(np.prod(size))).astype(bool).reshape(size)


class Block:
    """One row: its place, which voxels are known, and the six arrays [component, voxel of faces] of the iteration."""

    def __init__(self, layout: Layout, row: dict):
        self.layout, self.at, self.bits = layout, tuple(row[k] for k in _KEY), row["known"]
        self.size, self.faces = layout.size(self.at), layout.faces(self.at)
        self.known = _mask(self.bits, self.size)
        self.free = ~self.known[self.faces]
        empty = (layout.parts, int(self.faces.sum()))
        self.arrays = {a: np.frombuffer(row[a], float).reshape(empty) if row[a] else np.zeros(empty) for a in _ARRAYS}

    def whole(self, f: np.ndarray) -> np.ndarray:
        """Values of faces in a block that is 0 within."""
        out = np.zeros((self.layout.parts, *self.size))
        out[:, self.faces] = f
        return out

    def pull(self, ghosts: dict[int, np.ndarray]) -> np.ndarray:
        """On faces: the weighted sum of the neighbours' voxels beside them."""
        out = np.zeros((self.layout.parts, *self.size))
        for side, ghost in ghosts.items():
            out[(slice(None), *_plane(side))] += self.layout.weights[side // 2] * ghost
        return out[:, self.faces]

    def row(self, **sums) -> dict:
        return {**dict(zip(_KEY, self.at, strict=True)), "side": -1, "known": self.bits, **{a: v.tobytes() for a, v in self.arrays.items()}, **sums}

    def with_faces(self, name: str):
        """The block's row, and a row for each neighbour with the face of array `name` that it touches."""
        yield self.row()
        f = self.whole(self.arrays[name])
        for side, to in self.layout.neighbours(self.at):
            yield {**dict(zip(_KEY, to, strict=True)), "side": side ^ 1, name: np.ascontiguousarray(f[(slice(None), *_plane(side))]).tobytes()}


def _rows(batches):
    """Rows of Arrow batches one at a time: a batch may hold many blocks, and only one is spelled out."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _schema(sums: bool) -> pa.Schema:
    fields = [*((k, pa.int32()) for k in _KEY), ("side", pa.int32()), ("known", pa.binary()), *((a, pa.binary()) for a in _ARRAYS)]
    return pa.schema(fields + [(s, pa.list_(pa.float64())) for s in ("g", "d", "rr")] * sums)


def _round(blocks: DataFrame, layout: Layout, name: str, before, after) -> DataFrame:
    """`before` on each block, the faces of array `name` exchanged, then `after` with the neighbours' faces as ghosts."""

    def send(batches):
        for row in _rows(batches):
            block = Block(layout, row)
            before(block)
            yield from pa.Table.from_pylist(list(block.with_faces(name)), _schema(False)).to_batches()

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = Block(layout, next(r for r in rows if r["side"] < 0))
        ghosts = {}
        for r in rows:
            if r["side"] >= 0:
                size = [n for i, n in enumerate(block.size) if i != r["side"] // 2]
                ghosts[r["side"]] = np.frombuffer(r[name], float).reshape(layout.parts, *size)
        return pa.Table.from_pylist([block.row(**after(block, ghosts))], _schema(True))

    sent = blocks.select(*_KEY, "side", "known", *_ARRAYS).mapInArrow(send, _STATE)
    return sent.groupBy(*_KEY).applyInArrow(meet, _STATE + _SUMS)


def harmonic_field(points: DataFrame, values: list[str], *, shape: tuple[int, int, int] | None = None, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), block: int = 16, rtol: float = 1e-6, rounds: int = 500) -> DataFrame:
    """z, y, x and the `values` of every voxel: those of points (z, y, x, values) where there are any, harmonic elsewhere.

    Without a shape the volume ends at the last point. Raises an error if the residual isn't `rtol` of the right side after `rounds` rounds.
    """
    blocks, layout, finished = _solved(points, values, shape, spacing, block, rtol, rounds)

    def spell(batches):
        for row in _rows(batches):
            at, f = finished(row)
            z, y, x = (n.ravel() + k * e for n, k, e in zip(np.indices(f.shape[1:]), at, layout.edges, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.int32()), *(pa.array(v.ravel()) for v in f)], names=[*AXES, *values])

    return blocks.mapInArrow(spell, "z int, y int, x int, " + ", ".join(f"`{v}` double" for v in values))


def harmonic_planes(points: DataFrame, values: list[str], **parameters) -> DataFrame:
    """The field of harmonic_field as packed planes: z, the first y and x, the width, and for each of the `values` one array, row by row. A plane lies within a block; those wider than a block come in pieces."""
    blocks, layout, finished = _solved(points, values, **{"shape": None, "spacing": (1.0, 1.0, 1.0), "block": 16, "rtol": 1e-6, "rounds": 500} | parameters)

    def spell(batches):
        for row in _rows(batches):
            at, f = finished(row)
            _, nz, ny, nx = f.shape
            first = [k * e for k, e in zip(at, layout.edges, strict=True)]
            ends = pa.array(np.arange(nz + 1) * ny * nx, pa.int32())
            whole = [pa.array(np.full(nz, n), pa.int32()) for n in (first[1], first[2], nx)]
            yield pa.RecordBatch.from_arrays([pa.array(first[0] + np.arange(nz), pa.int32()), *whole, *(pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in f)], names=[*AXES, "width", *values])

    return blocks.mapInArrow(spell, "z int, y int, x int, width int, " + ", ".join(f"`{v}` array<double>" for v in values))


def _solved(points: DataFrame, values: list[str], shape, spacing, block: int, rtol: float, rounds: int) -> tuple:
    """Solved blocks, their layout, and a function that gives a row's place and field [component, z, y, x]."""
    spark = points.sparkSession
    tables = Tables(spark)
    if shape is None:
        most = points.agg(*[F.max(a) for a in AXES]).first()
        if most[0] is None:
            raise ValueError("no points and no shape")
        shape = tuple(m + 1 for m in most)
    layout, tight = Layout(shape, block, spacing, len(values)), min(1e-10, 1e-3 * rtol)
    inside = points.where(" and ".join(f"{a} between 0 and {n - 1}" for a, n in zip(AXES, layout.shape, strict=True)))
    mean = inside.groupBy(*[F.col(a).cast("int").alias(a) for a in AXES]).agg(*[F.avg(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    known = mean
    for a, k, b, n in zip(AXES, _KEY, layout.edges, layout.counts, strict=True):  # a point goes to each block that it lies in or within the margin of
        first, last = F.floor((F.col(a) - layout.margin) / b), F.floor((F.col(a) + layout.margin) / b)
        known = known.withColumn(k, F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(n - 1)).cast("int"))))
    nz, ny, nx = layout.counts
    places = spark.range(nz * ny * nx).select((F.col("id") / (ny * nx)).cast("int").alias("bz"), (F.col("id") % (ny * nx) / nx).cast("int").alias("by"), (F.col("id") % nx).cast("int").alias("bx"))

    def total(a: np.ndarray) -> list[float]:
        return (a * a).reshape(layout.parts, -1).sum(1).tolist()

    began = pa.schema([*((k, pa.int32()) for k in _KEY), ("side", pa.int32()), ("known", pa.binary()), ("r", pa.binary()), ("x", pa.binary()), ("u", pa.binary()), ("goal", pa.list_(pa.float64()))])

    def begin(key, _, points: pa.Table) -> pa.Table:
        """A block solved with its margin, the margin's own edges free. What its faces lack, but for the neighbours' voxels, is `r`; the right side's square is `goal`."""
        where = tuple(k.as_py() for k in key)
        box, size = layout.around(where), layout.size(where)
        wide = tuple(b - a for a, b in box)
        mask, f = np.zeros(wide, bool), np.zeros((layout.parts, *wide))
        i = tuple(points.column(a).to_numpy() - low for a, (low, _) in zip(AXES, box, strict=True))
        mask[i] = True
        for k, part in enumerate(f):
            part[i] = points.column(f"_v{k}").to_numpy()
        diagonal = layout.sums([(0, n) for n in wide], wide)
        right = np.array([np.where(mask, 0.0, -layout.apply(v, diagonal)) for v in f])
        own = tuple(slice(k * e - low, k * e - low + n) for k, e, (low, _), n in zip(where, layout.edges, box, size, strict=True))
        goal = total(right[(slice(None), *own)])
        f += layout.local_solve(right, ~mask, diagonal, tight)
        mine, seen, faces, at = np.ascontiguousarray(f[(slice(None), *own)]), mask[own], layout.faces(where), layout.diagonal(where)
        lack = np.array([-layout.apply(v, at)[faces] for v in mine]) if faces.any() else np.zeros((layout.parts, 0))
        return pa.Table.from_pylist([{**dict(zip(_KEY, where, strict=True)), "side": -1, "known": _bits(seen), "r": lack.tobytes(), "x": mine.tobytes(), "u": np.ascontiguousarray(mine[:, faces]).tobytes(), "goal": goal}], began)

    def residual(b: Block, ghosts) -> dict:
        b.arrays["r"] = b.free * (b.arrays["r"] + b.pull(ghosts))
        b.arrays["u"] = np.zeros_like(b.arrays["r"])
        none = [0.0] * layout.parts
        return {"g": none, "d": none, "rr": total(b.arrays["r"])}

    def precondition(b: Block) -> None:
        b.arrays["u"] = layout.local_solve(b.whole(b.arrays["r"]), ~b.known, layout.diagonal(b.at), tight)[:, b.faces]

    def products(b: Block, ghosts) -> dict:
        a = b.arrays
        a["w"] = b.free * (a["r"] - b.pull(ghosts))  # within the block u was solved for r
        return {"g": (a["r"] * a["u"]).sum(1).tolist(), "d": (a["u"] * a["w"]).sum(1).tolist(), "rr": total(a["r"])}

    def advance(alpha: np.ndarray, beta: np.ndarray):
        def run(b: Block) -> None:
            a, al, be = b.arrays, alpha[:, None], beta[:, None]
            a["p"], a["s"] = a["u"] + be * a["p"], a["w"] + be * a["s"]
            a["c"], a["r"] = a["c"] + al * a["p"], a["r"] - al * a["s"]
            precondition(b)

        return run

    def sums(df: DataFrame, *columns: str) -> np.ndarray:
        """Each column's components over all blocks: a few numbers whatever the volume."""
        return np.array(df.agg(*[F.sum(F.get(c, F.lit(i))) for c in columns for i in range(layout.parts)]).first(), float).reshape(len(columns), -1)

    # a few blocks a task, whatever their points pack to: a block's points go to Python by themselves, and its solve takes its time
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-nz * ny * nx // TASK_BLOCKS))
    places, known = places.repartition(parts, *_KEY), known.repartition(parts, *_KEY)
    start = tables.save(places.groupBy(*_KEY).cogroup(known.groupBy(*_KEY)).applyInArrow(begin, _PLACE + "r binary, x binary, u binary, goal array<double>"))
    goal = rtol * rtol * sums(start, "goal")[0]
    now = tables.save(_round(start.select("*", *[F.lit(None).cast("binary").alias(a) for a in ("c", "p", "s", "w")]), layout, "u", lambda b: None, residual))
    alpha = old = None
    if done := bool((sums(now, "rr")[0] <= np.maximum(goal, 1e-300)).all()):
        field = start.select(*_KEY, "known", "x", F.lit(None).cast("binary").alias("c"))
    else:
        last, now = now, tables.save(_round(now, layout, "u", precondition, products))
        tables.drop(last)
    for _ in range(0 if done else rounds):
        g, d, rr = sums(now, "g", "d", "rr")
        if done := bool((rr <= np.maximum(goal, 1e-300)).all()):
            field = start.select(*_KEY, "known", "x").join(now.select(*_KEY, "c").hint("shuffle_hash"), _KEY)
            break
        beta = np.zeros_like(g) if alpha is None else np.where(old > 0, g / np.where(old > 0, old, 1.0), 0.0)
        below = d - (beta * g / np.where(alpha != 0, alpha, 1.0) if alpha is not None else 0.0)
        alpha, old = np.where(below > 0, g / np.where(below > 0, below, 1.0), 0.0), g
        last, now = now, tables.save(_round(now, layout, "u", advance(alpha, beta), products))
        tables.drop(last)
    if not done:
        raise RuntimeError(f"no convergence within {rounds} rounds")

    def finished(row: dict) -> tuple:
        at = tuple(row[k] for k in _KEY)
        size, faces = layout.size(at), layout.faces(at)
        x = np.frombuffer(row["x"], float).reshape(layout.parts, *size)
        if row["c"]:  # the correction within is harmonic between those of the faces
            c, diagonal = np.zeros_like(x), layout.diagonal(at)
            c[:, faces] = np.frombuffer(row["c"], float).reshape(layout.parts, -1)
            x = x + c + layout.local_solve(np.array([-layout.apply(v, diagonal) for v in c]), ~_mask(row["known"], size) & ~faces, diagonal, tight)
        return at, x

    return field, layout, finished


def sampled(volume: DataFrame, field: DataFrame, shape: tuple[int, int, int], *, value: str = "value", moves: tuple[str, str, str] = ("dz", "dy", "dx")) -> DataFrame:
    """z, y, x, value of the volume at each voxel's place moved by the field: trilinear, places beyond the edge held to it.

    A gather join: each target asks its up to eight corners, which come together again by the target.
    """
    place = {a: F.least(F.greatest(F.col(a) + F.col(m), F.lit(0.0)), F.lit(float(n - 1))) for a, m, n in zip(AXES, moves, shape, strict=True)}
    t = field.select(*[F.col(a).alias(f"t{a}") for a in AXES], *[F.floor(p).cast("int").alias(f"low_{a}") for a, p in place.items()], *[(p - F.floor(p)).alias(f"part_{a}") for a, p in place.items()])

    def corner(ups: tuple[int, ...]) -> Column:
        at = [F.least(F.col(f"low_{a}") + up, F.lit(n - 1)).alias(a) for a, up, n in zip(AXES, ups, shape, strict=True)]
        z, y, x = (F.col(f"part_{a}") if up else 1 - F.col(f"part_{a}") for a, up in zip(AXES, ups, strict=True))
        return F.struct(*at, (z * y * x).alias("w"))

    asked = t.select("tz", "ty", "tx", F.explode(F.array(*[corner(c) for c in product((0, 1), repeat=3)])).alias("c")).select("tz", "ty", "tx", "c.*").where("w > 0")
    met = asked.join(volume.select(*AXES, F.col(value).cast("double").alias("_v")), list(AXES))
    return met.groupBy(*[F.col(f"t{a}").alias(a) for a in AXES]).agg(F.sum(F.col("w") * F.col("_v")).alias(value))
