"""Image stacks and volumes as Spark data sources: `tiff_pixels` and `nifti_voxels`.

spark.dataSource.register(TiffPixels), then spark.read.format("tiff_pixels").load(path). Planning reads headers
only; a partition is a page or a slab of its rows, or a slab of a volume's planes, and fetches just its bytes by seeking. Conditions on page, y,
channel, z and path are pushed down (with spark.sql.python.filterPushdown.enabled) and leave out partitions. A gzip volume can't be entered in the middle, so it is one
partition that is unpacked plane by plane. Files lie where pyarrow's file systems read: local or shared folders, hdfs, s3, gs.
"""

from __future__ import annotations

import fnmatch
import gzip
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .files import NiftiHead, tiff_directory, tiff_rows

SLAB_VALUES = 1 << 20  # values of a partition, if a page or some planes have more
SMALL_BYTES = 1 << 20  # a file below this is read whole where it is read at all: it is not opened for the plan
FEW_FILES = 64
TOGETHER_BYTES, TOGETHER_FILES = 4 << 20, 256  # small files of one partition


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


class Ranges:
    """Parts of a file by place; `fetched` counts their bytes."""

    def __init__(self, path: str):
        system, name = _system(path)
        self.file, self.fetched = system.open_input_file(name), 0

    def __call__(self, at: int, n: int) -> bytes:
        self.fetched += n
        return self.file.read_at(n, at)

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def listed(path: str, patterns: Iterable[str]) -> list[str]:
    """The file, or the files right in the folder whose names fit a pattern, in name order."""
    system, name = _system(path)
    info = system.get_file_info(name)
    head = path[: len(path) - len(name)] if path.endswith(name) else "file://"
    if info.type == fs.FileType.File:
        return [head + name]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = sorted(f.path for f in system.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File)
    return [head + f for f in every if any(fnmatch.fnmatch(f.rpartition("/")[2], p) for p in patterns)]


def sizes(paths: list[str]) -> list[int]:
    """Bytes of files of one file system."""
    return [i.size for i in _system(paths[0])[0].get_file_info([_system(p)[1] for p in paths])] if paths else []


@dataclass
class Bounds:
    """What pushed conditions leave of the columns that partitions are cut by."""

    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    among: dict[str, set] = field(default_factory=dict)

    def take(self, f: Filter, columns: set[str]) -> bool:
        """Whether the condition is one of those that partitions can be left out by."""
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if name not in columns:
            return False
        if isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.among[name] = self.among.get(name, values) & values
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.low[name] = max(self.low.get(name, f.value), f.value)
        elif isinstance(f, LessThan | LessThanOrEqual):
            self.high[name] = min(self.high.get(name, f.value), f.value)
        else:
            return False
        return True

    def may(self, name: str, first, last) -> bool:
        """Whether a value from first to last can pass."""
        if name in self.among and not any(v is not None and first <= v <= last for v in self.among[name]):
            return False
        return self.low.get(name, last) <= last and self.high.get(name, first) >= first


@dataclass
class Slab(InputPartition):
    path: str
    page: int
    top: int
    bottom: int

    def __init__(self, path: str, page: int, top: int, bottom: int):
        super().__init__(f"{path}:{page}:{top}")
        self.path, self.page, self.top, self.bottom = path, page, top, bottom


class Several(InputPartition):
    """Small files that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(paths[0])
        self.paths = paths


class _Reader(DataSourceReader):
    columns: set[str] = set()

    def __init__(self, options: dict):
        self.path, self.slab = options["path"], int(options.get("slabValues", SLAB_VALUES))
        self.patterns = options.get("pattern", self.default).split(",")
        self.bounds = Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Notes the conditions that leave out partitions; Spark still applies them all to rows."""
        for f in filters:
            self.bounds.take(f, self.columns)
            yield f

    def slabs(self, path: str, page: int, rows: int, values: int) -> Iterator[Slab]:
        step = max(1, self.slab // max(1, values))
        for top in range(0, rows, step):
            yield Slab(path, page, top, min(rows, top + step))

    def files(self) -> list[str]:
        return [p for p in listed(self.path, self.patterns) if self.bounds.may("path", p, p)]


class TiffReader(_Reader):
    columns, default = {"path", "page", "y", "channel"}, "*.tif,*.tiff"

    def partitions(self) -> list[InputPartition]:
        """Pages or slabs of them by the headers of large files, and small files many at a time, whose headers their task reads. Few files are all planned by headers."""
        paths = self.files()
        if len(paths) <= FEW_FILES:
            return self.planned(paths)
        large, out, held, size = [], [], [], 0
        for path, n in zip(paths, sizes(paths), strict=True):
            if n > SMALL_BYTES:
                large.append(path)
                continue
            held.append(path)
            size += n
            if size >= TOGETHER_BYTES or len(held) >= TOGETHER_FILES:
                out.append(Several(held))
                held, size = [], 0
        return out + [Several(held)] * bool(held) + self.planned(large)

    def planned(self, paths: list[str]) -> list[Slab]:
        out = []
        for path in paths:
            with Ranges(path) as fetch:
                _, pages = tiff_directory(fetch)
            for page, tags in enumerate(pages):
                if self.bounds.may("page", page, page) and self.bounds.may("channel", 0, tags.get(277, [1])[0] - 1):
                    out += [s for s in self.slabs(path, page, tags[257][0], tags[256][0] * tags.get(277, [1])[0]) if self.bounds.may("y", s.top, s.bottom - 1)]
        return out

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        for slab in self.planned(part.paths) if isinstance(part, Several) else [part]:
            yield from self.rows(slab)

    def rows(self, part: Slab) -> Iterator[pa.RecordBatch]:
        with Ranges(part.path) as fetch:
            order, pages = tiff_directory(fetch)
            a = tiff_rows(fetch, order, pages[part.page], part.top, part.bottom)
        channels = [c for c in range(a.shape[2]) if self.bounds.may("channel", c, c)]
        a = a[:, :, channels]
        y, x, c = (n.ravel() for n in np.indices(a.shape, np.int32))
        n = a.size
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array(np.full(n, part.page, np.int32)), pa.array(y + np.int32(part.top)), pa.array(x), pa.array(np.array(channels, np.int32)[c]), pa.array(a.ravel().astype(float))], names=["path", "page", "y", "x", "channel", "value"])


class NiftiReader(_Reader):
    columns, default = {"path", "z"}, "*.nii,*.nii.gz"

    def partitions(self) -> list[Slab]:
        out = []
        for path in self.files():
            with Ranges(path) as fetch:
                if fetch(0, 2) == b"\x1f\x8b":
                    out.append(Slab(path, 1, 0, 0))  # unpacked from its beginning
                    continue
                head = NiftiHead(fetch(0, 352))
            out += [s for s in self.slabs(path, 0, head.shape[0], head.shape[1] * head.shape[2]) if self.bounds.may("z", s.top, s.bottom - 1)]
        return out

    def read(self, part: Slab) -> Iterator[pa.RecordBatch]:
        with Ranges(part.path) as fetch:
            if part.page:
                with gzip.GzipFile(fileobj=fetch.file) as f:
                    head = NiftiHead(start := f.read(352))
                    f.read(head.at - len(start))
                    for z in range(head.shape[0]):
                        plane = head.values(f.read(head.shape[1] * head.shape[2] * head.kind.itemsize))
                        if self.bounds.may("z", z, z):
                            yield self.batch(part.path, z, plane)
            else:
                head = NiftiHead(fetch(0, 352))
                one = head.shape[1] * head.shape[2] * head.kind.itemsize
                yield self.batch(part.path, part.top, head.values(fetch(head.at + part.top * one, (part.bottom - part.top) * one)))

    def batch(self, path: str, top: int, a: np.ndarray) -> pa.RecordBatch:
        z, y, x = (n.ravel() for n in np.indices(a.shape, np.int32))
        return pa.RecordBatch.from_arrays([pa.array([path] * a.size, pa.string()), pa.array(z + np.int32(top)), pa.array(y), pa.array(x), pa.array(a.ravel().astype(float))], names=["path", "z", "y", "x", "value"])


class TiffPixels(DataSource):
    """path, page, y, x, channel, value of every pixel."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pixels"

    def schema(self) -> str:
        return "path string, page int, y int, x int, channel int, value double"

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self.options)


class NiftiVoxels(DataSource):
    """path, z, y, x, value of every voxel."""

    @classmethod
    def name(cls) -> str:
        return "nifti_voxels"

    def schema(self) -> str:
        return "path string, z int, y int, x int, value double"

    def reader(self, schema) -> DataSourceReader:
        return NiftiReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session and lets it push conditions down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TiffPixels, NiftiVoxels):
        spark.dataSource.register(source)


def write_files(contents: DataFrame, folder: str) -> int:
    """Writes rows of (name, content) as files of a folder that all executors share; how many. A task that runs again writes the same files; a file appears whole or not at all."""
    _, plain = _system(folder)
    _system(folder)[0].create_dir(plain, recursive=True)

    def run(batches):
        for b in batches:
            system, base = _system(folder)
            for name, content in zip(b["name"], b["content"], strict=True):
                with system.open_output_stream(f"{base}/_{name}.part") as f:
                    f.write(content)
                system.move(f"{base}/_{name}.part", f"{base}/{name}")
            yield pd.DataFrame({"n": [len(b)]})

    return int(contents.select("name", "content").mapInPandas(run, "n long").groupBy().sum("n").first()[0] or 0)
