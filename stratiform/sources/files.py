"""Readers and writers of the file formats around a run.

Tables are read with explicit schemas. Images and volumes are read through binaryFile, so any
file system that Spark reads will do, and decoded by numpy: TIFF (8, 16 or 32 bit, one or many pages, strips or tiles, plain, LZW, deflate or PackBits) and
NIfTI-1 (gzip or plain). An image or volume file is the unit that a task decodes.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRUCTURE = "id int, name string, acronym string, color_hex_triplet string, parent_structure_id int, structure_id_path string, depth int, graph_order int, hemisphere_id int"
ALIASES = {"color": "color_hex_triplet", "parent": "parent_structure_id", "parent_id": "parent_structure_id", "structure_id": "id", "atlas_id": "id"}


def normal_structure(df: DataFrame) -> DataFrame:
    """Aliases renamed, missing columns added, lenient casts, defaults, order."""
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    fields = [f.split() for f in STRUCTURE.split(", ")]
    df = df.select(*[(F.col(n).cast("string").try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields]).where("id is not null")
    out = df.withColumns({"name": F.coalesce("name", F.lit("")), "acronym": F.coalesce("acronym", F.lit("")), "depth": F.coalesce("depth", F.lit(0)), "graph_order": F.coalesce("graph_order", "id"), "structure_id_path": F.coalesce(F.nullif("structure_id_path", F.lit("")), F.concat(F.lit("/"), F.col("id").cast("string"), F.lit("/")))})
    return out.orderBy("graph_order", "id")


def structure_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header decides which columns there are; all are read as text and cast leniently. A byte-order mark is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return normal_structure(df.toDF(*[c.lstrip("﻿") for c in df.columns]))


def structure_json(docs: DataFrame, column: str = "doc") -> DataFrame:
    """{"id": {"name", "acronym", "color"}} documents: no parents, depth 0."""
    m = F.from_json(column, "map<string, struct<name: string, acronym: string, color: string>>")
    rows = docs.select(F.explode(m).alias("id", "v")).select(F.col("id"), "v.*")
    return normal_structure(rows)


def merged_lookup(table: DataFrame, tree: DataFrame) -> DataFrame:
    """Names by id from two sources, the table's where not empty."""
    j = table.select("id", *[F.col(c).alias(f"t_{c}") for c in ("name", "acronym", "color_hex_triplet")]).join(tree.select("id", *[F.col(c).alias(f"j_{c}") for c in ("name", "acronym", "color_hex_triplet")]), "id", "full_outer")
    return j.select("id", *[F.coalesce(F.nullif(f"t_{c}", F.lit("")), F.col(f"j_{c}"), F.lit("")).alias(c) for c in ("name", "acronym", "color_hex_triplet")])


def parent_names(structure: DataFrame) -> DataFrame:
    """id to the parent's name, empty without one."""
    p = structure.select(F.col("id").alias("_p"), F.col("name").alias("_n"))
    return structure.join(p, structure["parent_structure_id"] == p["_p"], "left").select("id", F.coalesce("_n", F.lit("")).alias("parent_name"))


def run_directories(files: DataFrame, column: str = "path") -> DataFrame:
    """Folders that hold both metadata.json and metrics.csv."""
    at = files.select(F.regexp_replace(column, r"/[^/]*$", "").alias("dir"), F.element_at(F.split(column, "/"), -1).alias("name"))
    return at.where("name = 'metadata.json'").select("dir").distinct().join(at.where("name = 'metrics.csv'").select("dir"), "dir", "left_semi")


def list_slices(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """Files in name order with slice_id from 0 (S01, R15). A listing is one row a file."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    return files.withColumn("slice_id", F.row_number().over(Window.orderBy("path")) - 1)


def file_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, size and lower-case extension of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.col("length").alias("size"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"))


# ---- TIFF and NIfTI ---------------------------------------------------------------------------------------------

def _lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, that grow one code early."""
    out, table, bits, held, width, last = bytearray(), [], 0, 0, 9, None
    for byte in raw:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        code, held = bits >> (held - width), held - width
        bits &= (1 << held) - 1
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = min(12, (len(table) + 1).bit_length())
    return bytes(out)


def _pack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += raw[i + 1 : i + 2] * (257 - n if n > 128 else 0)
            i += 2 if n > 128 else 1
    return bytes(out)


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _pack_bits}


Fetch = Callable[[int, int], bytes]  # bytes of a file from a place on, so many of them


def tiff_directory(fetch: Fetch) -> tuple[str, list[dict[int, list[int]]]]:
    """Byte order and the tags of each page; reads the headers and no pixel."""
    order = {b"II": "<", b"MM": ">"}[fetch(0, 2)]
    size = {1: 1, 3: 2, 4: 4}
    (at,) = struct.unpack(order + "I", fetch(4, 4))
    pages = []
    while at:
        (n,) = struct.unpack(order + "H", fetch(at, 2))
        raw, tags = fetch(at + 2, 12 * n + 4), {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, 12 * i)
            if kind in size:
                width = size[kind] * count
                body = raw[12 * i + 8 : 12 * i + 8 + width] if width <= 4 else fetch(struct.unpack_from(order + "I", raw, 12 * i + 8)[0], width)
                tags[tag] = np.frombuffer(body, order + {1: "u1", 3: "u2", 4: "u4"}[kind], count).astype(int).tolist()
        pages.append(tags)
        (at,) = struct.unpack_from(order + "I", raw, 12 * n)
    return order, pages


def decode_tiff(raw: bytes) -> np.ndarray:
    """Pages as [page, y, x, channel]: strips or tiles, plain, LZW, deflate or PackBits, with or without differences along rows, channels together or apart."""
    fetch = lambda at, n: raw[at : at + n]
    order, pages = tiff_directory(fetch)
    return np.stack([tiff_rows(fetch, order, tags, 0, tags[257][0]) for tags in pages])


def tiff_rows(fetch: Fetch, order: str, tags: dict[int, list[int]], top: int, bottom: int) -> np.ndarray:
    """Rows top to bottom - 1 of a page as [y, x, channel]; only the strips or tiles that hold them are fetched."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    if one(259, 1) not in _UNPACK:
        raise ValueError(f"TIFF compression {one(259, 1)} is not supported")
    w, h, channels = tags[256][0], tags[257][0], one(277, 1)
    kind = f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(339, 1)]}{one(258, 8) // 8}"
    apart = one(284, 1) == 2
    depth = 1 if apart else channels
    bw, bh = (one(322, w), one(323, h)) if 322 in tags else (w, min(one(278, h), h))
    across, down = -(-w // bw), -(-h // bh)
    first = top // bh
    last = min(-(-bottom // bh), down)
    out = np.zeros(((last - first) * bh, across * bw, channels), kind)
    for i, (o, k) in enumerate(zip(tags.get(324, tags.get(273)), tags.get(325, tags.get(279)), strict=True)):
        layer, place = divmod(i, across * down)
        if not first <= place // across < last:
            continue
        block = np.frombuffer(_UNPACK[one(259, 1)](fetch(o, k)), kind)
        block = block[: len(block) // (bw * depth) * bw * depth].reshape(-1, bw, depth)
        if one(317, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        y, x = (place // across - first) * bh, place % across * bw
        c = slice(layer, layer + 1) if apart else slice(None)
        out[y : y + len(block), x : x + bw, c] = block
    return out[top - first * bh : min(bottom, h) - first * bh, :w]


def encode_tiff(image: np.ndarray, deflate: bool = False) -> bytes:
    """One grey page, uint8, uint16 or float32."""
    h, w = image.shape
    body = np.ascontiguousarray(image, image.dtype.newbyteorder("<")).tobytes()
    body = zlib.compress(body) if deflate else body
    tags = [(256, 4, w), (257, 4, h), (258, 3, image.dtype.itemsize * 8), (259, 3, 8 if deflate else 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(body)), (339, 3, {"u": 1, "i": 2, "f": 3}[image.dtype.kind])]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    pad = b"\0" * (len(body) % 2)
    return b"II*\0" + struct.pack("<I", 8 + len(body) + len(pad)) + body + pad + ifd


def encode_stack(images: list[np.ndarray]) -> bytes:
    """Grey pages one after another in one file."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image in images:
        one = encode_tiff(image)
        (ifd,) = struct.unpack_from("<I", one, 4)
        start = len(out)
        body, head = one[8:ifd], bytearray(one[ifd:])
        for i in range(struct.unpack_from("<H", head)[0]):
            if struct.unpack_from("<H", head, 2 + 12 * i)[0] == 273:
                struct.pack_into("<I", head, 10 + 12 * i, start)
        out += body
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + len(head) - 4
        out += head + b"\0" * (len(head) % 2)
    return bytes(out)


_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


class NiftiHead:
    """Shape (z, y, x), voxel sizes, type and place of a NIfTI-1 volume's values, from its first 352 bytes."""

    def __init__(self, raw: bytes):
        order = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
        dim = struct.unpack_from(order + "8h", raw, 40)
        self.kind = np.dtype(order + _NIFTI[struct.unpack_from(order + "h", raw, 70)[0]])
        self.sizes = [float(p) for p in struct.unpack_from(order + "8f", raw, 76)[3:0:-1]]
        at, self.slope, self.shift = struct.unpack_from(order + "3f", raw, 108)
        self.at, self.shape = int(at), [max(1, d) for d in dim[3:0:-1]]

    def values(self, raw: bytes) -> np.ndarray:
        a = np.frombuffer(raw, self.kind).reshape(-1, *self.shape[1:])
        return a * self.slope + self.shift if self.slope not in (0.0, 1.0) or self.shift else a


def decode_nifti(raw: bytes) -> tuple[np.ndarray, list[float]]:
    """Volume as [z, y, x] and voxel sizes (z, y, x)."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head = NiftiHead(raw)
    return head.values(raw[head.at : head.at + int(np.prod(head.shape)) * head.kind.itemsize]), head.sizes


def encode_nifti(volume: np.ndarray, zooms: tuple[float, float, float]) -> bytes:
    """A plain NIfTI-1 file of a [z, y, x] volume."""
    kind = next(k for k, v in _NIFTI.items() if np.dtype(v) == volume.dtype)
    z, y, x = volume.shape
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, x, y, z, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, kind, volume.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, zooms[2], zooms[1], zooms[0], 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.ascontiguousarray(volume).tobytes()


def encode_npy(array: np.ndarray) -> bytes:
    """An NPY file of an array."""
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def decode_npy(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def encoded(pixels: DataFrame, keys: list[str], kind: str, dtype: str = "uint16") -> DataFrame:
    """keys, content: each group's full image (y, x) as a tiff or npy file, or its volume (z, y, x) as a nifti or npy file (K05, K09). Values are rounded and held to the type."""
    volume = "z" in pixels.columns
    encode = {"tiff": encode_tiff, "npy": encode_npy, "nifti": lambda a: encode_nifti(a, (1.0, 1.0, 1.0))}[kind]
    axes = ["z", "y", "x"] if volume else ["y", "x"]

    def run(key, pdf):
        a = np.zeros([int(pdf[c].max()) + 1 for c in axes])
        a[tuple(pdf[c].to_numpy() for c in axes)] = pdf["value"].to_numpy(float)
        if np.dtype(dtype).kind in "ui":
            a = np.clip(np.rint(a), np.iinfo(dtype).min, np.iinfo(dtype).max)
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "content": [encode(a.astype(dtype))]})

    schema = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return pixels.groupBy(*keys).applyInPandas(run, f"{schema}, content binary")


def decoded(contents: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """keys, z, y, x, value of every pixel of each file, a plane at a time; images have z 0."""

    def planes(raw: bytes) -> np.ndarray:
        if kind == "tiff":
            return decode_tiff(raw)[..., 0]
        a = decode_npy(raw) if kind == "npy" else decode_nifti(raw)[0]
        return a if a.ndim == 3 else a[None]

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                a = planes(b["content"].iloc[i])
                y, x = (n.ravel() for n in np.indices(a.shape[1:]))
                for z in range(a.shape[0]):
                    yield pd.DataFrame({**{k: b[k].iloc[i] for k in keys}, "z": z, "y": y, "x": x, "value": a[z].ravel().astype(float)})

    schema = ", ".join(f"{k} {contents.schema[k].dataType.simpleString()}" for k in keys)
    return contents.select(*keys, "content").mapInPandas(run, f"{schema}, z int, y int, x int, value double")


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """path, page, y, x, channel, value of every pixel."""

    def run(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                a = decode_tiff(raw)
                for page in range(a.shape[0]):
                    y, x, c = np.indices(a.shape[1:])
                    yield pd.DataFrame({"path": p, "page": page, "y": y.ravel(), "x": x.ravel(), "channel": c.ravel(), "value": a[page].ravel().astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, y int, x int, channel int, value double")


def read_nifti(spark: SparkSession, path: str) -> DataFrame:
    """path, z, y, x, value of every voxel, a plane at a time."""

    def run(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                a, _ = decode_nifti(raw)
                for z in range(a.shape[0]):
                    y, x = np.indices(a.shape[1:])
                    yield pd.DataFrame({"path": p, "z": z, "y": y.ravel(), "x": x.ravel(), "value": a[z].ravel().astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, z int, y int, x int, value double")


# ---- sinks ---------------------------------------------------------------------------------------------------------

def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header (K01); `by` splits it into a folder for each value."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A CSV folder for each named sheet."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")
