"""GeoTIFF rasters as a Spark data source: cells in, tiles out.

Reading splits large files by blocks and puts small ones together; a task opens its files, reads their directories, and of
the blocks only those that meet the window. Writing gets cells dealt by tile and in order, holds one tile at a time, and
gives files their names when the whole job has succeeded.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .tiff import read_directory, write_raster

#: Bytes of files, or of a file's blocks, that one task reads.
SPLIT = 64 << 20
CELLS = "file string, r long, c long, value double"


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, list[pyarrow.fs.FileInfo]]:
    """Files under a path, by name: a file or a folder, local or of any store that Arrow opens."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pyarrow.fs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
    return fs, sorted((f for f in found if f.is_file and f.base_name.lower().endswith((".tif", ".tiff"))), key=lambda f: f.path)


@dataclass
class Part(InputPartition):
    """Files, each with its first block and the one after its last (None: all)."""

    files: list[tuple[str, int, int | None]]

    def __post_init__(self):
        super().__init__(None)


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.window = [options.get(k) for k in ("north", "west", "size")], [int(options[k]) if k in options else None for k in ("r0", "r1", "c0", "c1")]

    def partitions(self) -> list[InputPartition]:
        fs, files = _files(self.path)
        parts, held, size = [], [], 0
        for f in files:
            if f.size > self.split:
                with fs.open_input_file(f.path) as opened:
                    d = read_directory(opened)
                per = max(1, math.ceil(len(d.offsets) * self.split / f.size))
                parts += [Part([(f.path, a, min(a + per, len(d.offsets)))]) for a in range(0, len(d.offsets), per)]
                continue
            if held and size + f.size > self.split:
                parts.append(Part(held))
                held, size = [], 0
            held.append((f.path, 0, None))
            size += f.size
        return parts + [Part(held)] if held or not parts else parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, (frame, (r0, r1, c0, c1)) = _files(self.path)[0] if partition.files else None, self.window
        for path, first, last in partition.files:
            with fs.open_input_file(path) as f:
                d = read_directory(f)
                # Rows and columns count from a corner of all files, if it is given, else from each file's own.
                dr, dc = (0, 0) if None in frame else (round((float(frame[0]) - d.north) / float(frame[2])), round((d.west - float(frame[1])) / float(frame[2])))
                bounds = [(-dr if r0 is None else r0 - dr), (d.height - 1 if r1 is None else r1 - dr), (0 if c0 is None else c0 - dc), (d.width - 1 if c1 is None else c1 - dc)]
                bounds[0] = max(bounds[0], 0)
                for b in d.blocks(*bounds):
                    if b < first or (last is not None and b >= last):
                        continue
                    f.seek(d.offsets[b])
                    a = d.values(b, f.read(d.sizes[b]) if d.sizes[b] else b"")
                    br, bc = d.place(b)
                    r, c = (x.ravel() for x in np.indices(a.shape))
                    r, c, v = r + br, c + bc, a.ravel().astype(np.float64)
                    keep = (r >= bounds[0]) & (r <= bounds[1]) & (c >= bounds[2]) & (c <= bounds[3])
                    void = np.isnan(v) if d.nodata is None else np.isnan(v) | (v == np.float64(np.dtype(d.dtype).type(d.nodata)))
                    r, c, v, void = r[keep], c[keep], v[keep], void[keep]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(r), pa.string()), pa.array(r + dr, pa.int64()), pa.array(c + dc, pa.int64()), pa.array(v, mask=void)], ["file", "r", "c", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class GeoTiffWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.edge, self.block, self.codec = int(options["edge"]), int(options.get("block", 256)), options.get("codec", "lzw")
        self.west, self.north, self.size = (float(options[k]) for k in ("west", "north", "size"))
        self.dtype, self.nodata, self.job = options.get("dtype", "float32"), float(options.get("nodata", -9999)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        held, files, now = None, [], None

        def finish() -> None:
            tr, tc = now
            name = f"{root}/{self.job}-{uuid.uuid4().hex}.part"
            out = io.BytesIO()
            write_raster(out, held, self.block, self.codec, self.west + tc * self.edge * self.size, self.north - tr * self.edge * self.size, self.size, self.nodata)
            with fs.open_output_stream(name) as f:
                f.write(out.getvalue())
            files.append((name, f"{root}/tile_{tr}_{tc}.tif"))

        for b in iterator:
            r, c, v = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            v = np.where(np.isnan(v.astype(np.float64)), self.nodata, v)
            tr, tc = r // self.edge, c // self.edge
            ends = np.flatnonzero(np.r_[True, (tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1]), True]) if len(r) else []
            for i, j in zip(ends[:-1], ends[1:]):
                if now != (int(tr[i]), int(tc[i])):
                    if now is not None:
                        finish()
                    now, held = (int(tr[i]), int(tc[i])), np.full((self.edge, self.edge), self.nodata, self.dtype)
                held[r[i:j] % self.edge, c[i:j] % self.edge] = v[i:j]
        if now is not None:
            finish()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pyarrow.fs.FileSelector(root)):
                if f.base_name.endswith(".tif"):
                    fs.delete_file(f.path)
        for m in messages:
            for part, name in m.files if m else ():
                fs.move(part, name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(self.job):
                fs.delete_file(f.path)


class GeoTiff(DataSource):
    """Options of a read: path, split, a window r0, r1, c0, c1 (bounds included), and north, west, size of the frame in which
    rows and columns count. Of a write: path, edge, block, codec (lzw, deflate, none), west, north, size, dtype, nodata.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(dict(self.options), overwrite)


def read_geotiff(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, frame: tuple[float, float, float] | None = None, split: int = SPLIT) -> DataFrame:
    """Cells (file, r, c, value) of all TIFF files under a path; null where there is no data.

    window (first and last row, first and last column) leaves out the blocks of files that do not meet it; frame (north, west,
    size) makes rows and columns those of one raster over all files, whose cells have that size.
    """
    spark.dataSource.register(GeoTiff)
    read = spark.read.format("geotiff").option("split", split)
    for k, v in zip(("r0", "r1", "c0", "c1"), window or ()):
        read = read.option(k, v)
    for k, v in zip(("north", "west", "size"), frame or ()):
        read = read.option(k, repr(v))
    return read.load(path)


def write_geotiff(cells: DataFrame, path: str, value: str, edge: int, north: float, west: float, size: float, **options) -> None:
    """Cells (r, c, value) as one file for each square of edge by edge cells; null and missing cells hold no data.

    Each tile is made by one task, which holds one tile at a time. Files appear when all are written.
    """
    cells.sparkSession.dataSource.register(GeoTiff)
    tile = [F.floor(F.col(k) / edge) for k in ("r", "c")]
    dealt = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("value")).repartition(*tile).sortWithinPartitions(*tile)
    write = dealt.write.format("geotiff").mode("overwrite").options(edge=edge, north=repr(north), west=repr(west), size=repr(size), **options)
    write.save(path)


def geotiff_directories(spark: SparkSession, path: str) -> DataFrame:
    """What each file says of itself: file, width, height, west, north, size_x, size_y, nodata, epsg, dtype, codec, block_width, block_height, blocks.

    Only directories are read.
    """
    names = [(f.path,) for f in _files(path)[1]]
    listed = spark.createDataFrame(names, "file string").repartition(max(1, len(names) // 64))

    def run(batches):
        fs = pyarrow.fs.FileSystem.from_uri(path)[0]
        for b in batches:
            rows = []
            for name in b["file"]:
                with fs.open_input_file(name) as f:
                    d = read_directory(f)
                rows.append((name, d.width, d.height, d.west, d.north, d.size_x, d.size_y, d.nodata, d.epsg, d.dtype[1:], d.codec, d.block_width, d.block_height, len(d.offsets)))
            import pandas as pd

            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIRECTORY.split(", ")])

    return listed.mapInPandas(run, DIRECTORY)


DIRECTORY = "file string, width long, height long, west double, north double, size_x double, size_y double, nodata double, epsg long, dtype string, codec string, block_width long, block_height long, blocks long"
