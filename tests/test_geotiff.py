"""TIFF codec, directories, and the data source."""

import io
import random
import struct

import numpy as np
import pytest

from rillflow.sources.geotiff import geotiff_directories, read_geotiff, write_geotiff
from rillflow.sources.tiff import lzw_decode, lzw_encode, read_directory, write_raster


def codes(*values, width=9):
    bits = "".join(f"{v:0{width}b}" for v in values)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_the_example_of_the_specification():
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    stream = codes(256, 7, 258, 8, 8, 258, 6, 6, 257)
    assert lzw_encode(data) == stream and lzw_decode(stream) == data


def test_lzw_round_trips():
    rng = random.Random(1)
    for data in (b"", b"a", bytes(100_000), rng.randbytes(30_000), bytes(rng.choices(b"ab", k=60_000)), b"abc" * 9_000, rng.randbytes(255) * 40):
        assert lzw_decode(lzw_encode(data)) == data
    # Width changes fall where the format puts them, one code early for who reads.
    for n in (250, 254, 255, 256, 511, 766, 1022, 1790, 3838, 3839, 3840):
        data = rng.randbytes(n)
        assert lzw_decode(lzw_encode(data)) == data


@pytest.mark.parametrize("codec", ["lzw", "deflate", "none"])
@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "float64"])
def test_rasters_round_trip(codec, dtype):
    a = (np.arange(50 * 37) % 200).reshape(50, 37).astype(dtype)
    f = io.BytesIO()
    write_raster(f, a, 16, codec, 10.0, 50.0, 0.25, 199)
    d = read_directory(f)
    assert (d.width, d.height, d.codec, d.west, d.north, d.size_x, d.nodata, d.epsg, d.block_width) == (37, 50, codec, 10.0, 50.0, 0.25, 199.0, 4326, 16)
    out = np.zeros_like(a)
    for b in range(len(d.offsets)):
        f.seek(d.offsets[b])
        v = d.values(b, f.read(d.sizes[b]))
        r, c = d.place(b)
        out[r : r + v.shape[0], c : c + v.shape[1]] = v
    assert (out == a).all() and d.blocks(0, 15, 0, 15) == [0] and d.blocks(15, 16, 30, 99) == [1, 2, 4, 5]


def classic(a, order, rows, predictor=1):
    """A classic TIFF in strips, by hand."""
    e = "<" if order == b"II" else ">"
    strips = [a[i : i + rows] for i in range(0, len(a), rows)]
    data = [(np.diff(s, axis=1, prepend=0) if predictor == 2 else s).astype(e + a.dtype.str[1:]).tobytes() for s in strips]
    at, offsets = 8, []
    for x in data:
        offsets.append(at)
        at += len(x)
    lists = struct.pack(f"{e}{len(data)}I", *offsets) + struct.pack(f"{e}{len(data)}I", *map(len, data))
    tags = [(256, 3, 1, a.shape[1]), (257, 3, 1, a.shape[0]), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, len(data), at), (277, 3, 1, 1), (278, 3, 1, rows), (279, 4, len(data), at + 4 * len(data)), (317, 3, 1, predictor), (339, 3, 1, 1)]
    body = b"".join(struct.pack(e + "HHI", *t[:3]) + (struct.pack(e + "HH", t[3], 0) if t[1] == 3 else struct.pack(e + "I", t[3])) for t in tags)
    return struct.pack(e + "2sHI", order, 42, at + len(lists)) + b"".join(data) + lists + struct.pack(e + "H", len(tags)) + body + struct.pack(e + "I", 0)


@pytest.mark.parametrize("order, predictor", [(b"II", 1), (b"MM", 1), (b"II", 2)])
def test_classic_files_in_strips(spark, tmp_path, order, predictor):
    a = (np.arange(9 * 5) * 37 % 251).reshape(9, 5).astype("uint16")
    (tmp_path / "a.TIF").write_bytes(classic(a, order, 4, predictor))
    got = {(r["r"], r["c"]): r["value"] for r in read_geotiff(spark, str(tmp_path), split=40).collect()}
    assert got == {(r, c): float(a[r, c]) for r in range(9) for c in range(5)}
    d = geotiff_directories(spark, str(tmp_path)).first()
    assert (d["width"], d["height"], d["nodata"], d["blocks"], d["dtype"], d["codec"]) == (5, 9, None, 3, "u2", "none")


def test_tiles_written_and_read_by_window(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [(r, c, None if (r + c) % 7 == 0 else r * 100.0 + c) for r in range(70) for c in range(45) if (r, c) != (3, 3)]
    cells = spark.createDataFrame(rows, "r long, c long, h double").repartition(5)
    write_geotiff(cells, path, "h", 32, 10.0, 20.0, 0.5, block=16, dtype="float64")
    write_geotiff(cells, path, "h", 32, 10.0, 20.0, 0.5, block=16, dtype="float64")
    found = geotiff_directories(spark, path)
    assert {(r["file"].rpartition("/")[2], r["north"], r["west"]) for r in found.collect()} == {(f"tile_{i}_{j}.tif", 10.0 - 16 * i, 20.0 + 16 * j) for i in range(3) for j in range(2)}
    want = {(r, c): v for r, c, v in rows if v is not None}
    for split in (1 << 20, 3000):
        got = read_geotiff(spark, path, frame=(10.0, 20.0, 0.5), split=split)
        assert {(r["r"], r["c"]): r["value"] for r in got.where("value is not null").collect()} == want and got.count() == 6 * 32 * 32
    part = read_geotiff(spark, path, (30, 35, 10, 40), (10.0, 20.0, 0.5))
    assert {(r["r"], r["c"]): r["value"] for r in part.where("value is not null").collect()} == {x: v for x, v in want.items() if 30 <= x[0] <= 35 and 10 <= x[1] <= 40}
    assert part.count() == 6 * 31


def test_a_folder_without_rasters_and_a_wrong_file(spark, tmp_path):
    assert read_geotiff(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        geotiff_directories(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        read_directory(io.BytesIO(b"no tiff at all, but long enough"))
