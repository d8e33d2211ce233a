"""The data sources on bytes put together by hand, and what they read of a file."""

import gzip
import struct

import numpy as np
import pytest

from stratiform.sources import files, pixels


def big_endian_stack(path, pages):
    """A big-endian TIFF of 16-bit pages, each in strips of two rows, its directory before its pixels."""
    out = bytearray(b"MM\0*" + struct.pack(">I", 8))
    for i, a in enumerate(pages):
        h, w = a.shape
        strips = [a[y : y + 2].astype(">u2").tobytes() for y in range(0, h, 2)]
        base = len(out)
        ifd = 2 + 12 * 9 + 4
        lists = base + ifd
        data = lists + 8 * len(strips)
        places = [data + sum(map(len, strips[:k])) for k in range(len(strips))]
        end = data + sum(map(len, strips))
        tags = [(256, 3, 1, w << 16), (257, 3, 1, h << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (262, 3, 1, 1 << 16), (273, 4, len(strips), lists), (277, 3, 1, 1 << 16), (278, 3, 1, 2 << 16), (279, 4, len(strips), lists + 4 * len(strips))]
        out += struct.pack(">H", 9) + b"".join(struct.pack(">HHII", *t) for t in tags) + struct.pack(">I", end if i + 1 < len(pages) else 0)
        out += struct.pack(f">{len(strips)}I", *places) + struct.pack(f">{len(strips)}I", *map(len, strips)) + b"".join(strips)
    path.write_bytes(bytes(out))


def plain_volume(path, a, packed=False):
    head = bytearray(352)
    struct.pack_into("<i8h", head, 0, 348, *[0] * 8)
    struct.pack_into("<8h", head, 40, 3, a.shape[2], a.shape[1], a.shape[0], 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 4, 16)
    struct.pack_into("<3f", head, 108, 352, 2.0, 1.0)
    raw = bytes(head) + a.astype("<i2").tobytes()
    path.write_bytes(gzip.compress(raw) if packed else raw)


@pytest.fixture
def stack(tmp_path):
    r = np.random.default_rng(1)
    pages = [r.integers(0, 60_000, (40, 64)) for _ in range(6)]
    big_endian_stack(tmp_path / "a.tif", pages)
    return tmp_path, np.array(pages)


def test_pages_equal_their_bytes(spark, stack):
    folder, pages = stack
    pixels.register(spark)
    got = spark.read.format("tiff_pixels").option("slabValues", 500).load(f"file://{folder}").toPandas()
    assert len(got) == pages.size and (pages[got.page, got.y, got.x] == got.value).all() and set(got.channel) == {0}
    assert len(got.groupby(["page", "y", "x"])) == pages.size and set(got.path) == {f"file://{folder}/a.tif"}
    assert (files.decode_tiff((folder / "a.tif").read_bytes())[..., 0] == pages).all()


def test_one_page_is_read_without_the_rest(spark, stack):
    folder, pages = stack
    pixels.register(spark)
    df = spark.read.format("tiff_pixels").load(str(folder / "a.tif")).where("page = 3 and y between 10 and 12")
    got = df.toPandas()
    assert len(got) == 3 * 64 and (pages[3][got.y, got.x] == got.value).all()
    whole = pixels.TiffReader({"path": str(folder / "a.tif"), "slabValues": "256"})
    some = pixels.TiffReader({"path": str(folder / "a.tif"), "slabValues": "256"})
    for f in (pixels.EqualTo(("page",), 3), pixels.GreaterThanOrEqual(("y",), 10), pixels.LessThanOrEqual(("y",), 12)):
        assert some.bounds.take(f, some.columns)
    assert len(whole.partitions()) == 6 * 10 and [(s.page, s.top) for s in some.partitions()] == [(3, 8), (3, 12)]
    with pixels.Ranges(str(folder / "a.tif")) as fetch:
        order, tags = files.tiff_directory(fetch)
        heads = fetch.fetched
        files.tiff_rows(fetch, order, tags[3], 8, 12)
        assert heads < 2500 and fetch.fetched - heads == 4 * 64 * 2


def test_volumes_by_planes(spark, tmp_path):
    a = np.random.default_rng(2).integers(-500, 500, (9, 7, 5))
    plain_volume(tmp_path / "v.nii", a)
    plain_volume(tmp_path / "w.nii.gz", a, packed=True)
    pixels.register(spark)
    got = spark.read.format("nifti_voxels").option("slabValues", 70).load(str(tmp_path)).toPandas()
    assert len(got) == 2 * a.size and (2 * a[got.z, got.y, got.x] + 1 == got.value).all()
    some = spark.read.format("nifti_voxels").load(str(tmp_path)).where("z in (2, 8)").toPandas()
    assert set(some.z) == {2, 8} and len(some) == 2 * 2 * 35 and (2 * a[some.z, some.y, some.x] + 1 == some.value).all()
    reader = pixels.NiftiReader({"path": str(tmp_path / "v.nii"), "slabValues": "35"})
    reader.bounds.take(pixels.In(("z",), (2, 8)), reader.columns)
    assert [s.top for s in reader.partitions()] == [2, 8]


def test_stacks_written_and_read(spark, tmp_path):
    r = np.random.default_rng(3)
    images = [[r.random((5, 4)).astype("f4") for _ in range(3)] for _ in range(4)]
    rows = [(f"s{i}.tif", files.encode_stack(s)) for i, s in enumerate(images)]
    assert pixels.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(3), f"file://{tmp_path}/out") == 4
    pixels.register(spark)
    got = spark.read.format("tiff_pixels").load(f"file://{tmp_path}/out").toPandas()
    assert len(got) == 4 * 3 * 20 and all(abs(images[int(p[-5])][g][y, x] - v) < 1e-6 for p, g, y, x, v in zip(got.path, got.page, got.y, got.x, got.value, strict=True))
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("tiff_pixels").load("/nowhere").count()
