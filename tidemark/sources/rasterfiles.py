"""Rasters as a Spark data source: read by strips or tiles, so no task holds an image, and written a strip at a time with commit and abort."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.shipping import ship_package
from tidemark.sources.geotiff import Layout, directory, layout

NAME = "tidemark_raster"
#: Compressed bytes that a reading task takes on, what opening a file counts as there, and rows of a strip that is written.
SHARE, OPENING, STRIP = 8 << 20, 128 << 10, 64
SUFFIX = "_3B_AnalyticMS_toar_clip.tif"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and place of an absolute path or a URI, as driver and tasks see them."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class Part(InputPartition):
    """Share k of n of a file's blocks; the file's header is read by the task, not by the driver."""

    path: str
    k: int
    n: int


@dataclass
class Parts(InputPartition):
    """What a task reads: a share of a large file, or some small files."""

    parts: list[Part]


class RasterReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.folder, self.suffix, self.fail = options["path"], options.get("suffix", SUFFIX), options.get("corrupt", "fail") == "fail"
        self.share, self.tasks, self.kinds = int(options.get("share", SHARE)), int(options.get("tasks", 1)), to_arrow_schema(schema)
        self.bands = [b.strip() for b in options.get("bands", "b,g,red,nir").split(",")]

    def partitions(self) -> list[Parts]:
        store_, place = store(self.folder)
        files = [f for f in store_.get_file_info(fs.FileSelector(place, recursive=True)) if f.is_file and f.path.endswith(self.suffix)]
        load = min(self.share, max(sum(f.size + OPENING for f in files) // max(1, self.tasks), 1))
        out, room = [], 0
        for f in sorted(files, key=lambda f: f.path):
            n = max(1, -(-f.size // self.share))
            cost = f.size // n + OPENING
            for k in range(n):
                if cost > room:
                    out.append(Parts([]))
                    room = load
                out[-1].parts.append(Part(f.path, k, n))
                room -= cost
        return out

    def read(self, given: Parts) -> Iterator[pa.RecordBatch]:
        store_, _ = store(self.folder)
        for part in given.parts:
            with store_.open_input_file(part.path) as f:
                try:
                    t = layout(lambda o, n, f=f: f.read_at(n, o))
                    yield from self._blocks(part, t, f)
                except (ValueError, KeyError, IndexError, zlib.error, EOFError) as why:
                    if self.fail:
                        raise ValueError(f"{part.path}: {why}") from why

    def _blocks(self, part: Part, t: Layout, f) -> Iterator[pa.RecordBatch]:
        """A batch a block of a share: of images with a plane a band, the blocks of one place together, and only of the bands that are asked for."""
        name = part.path.rsplit("/", 1)[-1].removesuffix(self.suffix)
        wanted = {b: self.bands.index(b) for b in self.kinds.names if b in self.bands}
        if max(wanted.values(), default=0) >= t.bands:
            raise ValueError(f"{t.bands} bands")
        cells = len(t.offsets) // (1 if t.planar == 1 else t.bands)
        for cell in range(part.k * cells // part.n, (part.k + 1) * cells // part.n):
            _, y, x = t.spot(cell)
            if t.planar == 1:
                a = t.block(cell, f.read_at(t.counts[cell], t.offsets[cell]))
                planes = {b: a[:, :, i] for b, i in wanted.items()}
            else:
                at = {b: i * cells + cell for b, i in wanted.items()}
                planes = {b: t.block(k, f.read_at(t.counts[k], t.offsets[k]))[:, :, 0] for b, k in at.items()}
            h, w = min(t.bh, t.h - y), min(t.bw, t.w - x)
            r, c = np.divmod(np.arange(h * w), w)
            own = {"image_id": lambda: pa.array([name] * (h * w), pa.string()), "r": lambda: pa.array(r + y), "c": lambda: pa.array(c + x)}
            columns = [own[n]() if n in own else pa.array(np.ascontiguousarray(planes[n]).ravel().astype(planes[n].dtype.newbyteorder("="))) for n in self.kinds.names]
            yield pa.RecordBatch.from_arrays([v.cast(kind) for v, kind in zip(columns, self.kinds.types, strict=True)], schema=self.kinds)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are staged, and their names."""

    files: list[tuple[str, str]]


class _Image:
    """One image as it is written: strips in order, those that no pixel falls into are 0."""

    def __init__(self, store_: fs.FileSystem, place: str, h: int, w: int, options: dict) -> None:
        self.store, self.place, self.h, self.w = store_, place, h, w
        self.dtype, self.bands = np.dtype(options.get("dtype", "u1")).newbyteorder("<"), options["bands"].split(",")
        self.packed, self.at, self.buffer = options.get("compression") == "deflate", 0, None
        georef = options.get("georef")
        self.georef, self.epsg = tuple(float(v) for v in georef.split(",")) if georef else None, int(options["epsg"]) if options.get("epsg") else None
        self.strips: list[bytes] = []
        self.out = None if self.packed else store_.open_output_stream(place)
        if self.out:
            sizes = [min(STRIP, h - y) * w * len(self.bands) * self.dtype.itemsize for y in range(0, h, STRIP)]
            self.out.write(directory(h, w, len(self.bands), self.dtype, [0, *np.cumsum(sizes)[:-1].tolist()], sizes, STRIP, False, self.georef, self.epsg))

    def _flush(self) -> None:
        rows = min(STRIP, self.h - self.at * STRIP)
        a = self.buffer if self.buffer is not None else np.zeros((rows, self.w, len(self.bands)), self.dtype)
        self.out.write(a.tobytes()) if self.out else self.strips.append(zlib.compress(a.tobytes()))
        self.at, self.buffer = self.at + 1, None

    def put(self, strip: int, r: np.ndarray, c: np.ndarray, values: list[np.ndarray]) -> None:
        while self.at < strip:
            self._flush()
        if self.buffer is None:
            self.buffer = np.zeros((min(STRIP, self.h - strip * STRIP), self.w, len(self.bands)), self.dtype)
        for k, v in enumerate(values):
            self.buffer[r - strip * STRIP, c, k] = v

    def close(self) -> None:
        while self.at * STRIP < self.h:
            self._flush()
        if self.packed:
            counts = [len(s) for s in self.strips]
            with self.store.open_output_stream(self.place) as out:
                out.write(directory(self.h, self.w, len(self.bands), self.dtype, [0, *np.cumsum(counts)[:-1].tolist()], counts, STRIP, True, self.georef, self.epsg))
                for s in self.strips:
                    out.write(s)
        else:
            self.out.close()


class RasterWriter(DataSourceArrowWriter):
    """Rows (image_id, r, c, bands..., _h, _w) in the order of image_id and r; see write_rasters. Files are staged under a name of the attempt's own and moved when
    all tasks are done; a failed job leaves nothing."""

    def __init__(self, options: dict) -> None:
        self.options, self.staging = dict(options), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store_, place = store(self.options["path"])
        mine, files, image, name = f"{place}/{self.staging}/{uuid.uuid4().hex}", [], None, None
        store_.create_dir(mine, recursive=True)
        for b in iterator:
            r, c, h, w = (b.column(k).to_numpy(zero_copy_only=False) for k in ("r", "c", "_h", "_w"))
            ids, values = b.column("image_id").to_pylist(), [b.column(k).to_numpy(zero_copy_only=False) for k in self.options["bands"].split(",")]
            strip = r // STRIP
            fresh = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1] or strip[i] != strip[i - 1]]
            for i, j in zip(fresh, [*fresh[1:], len(ids)], strict=True):
                if ids[i] != name:
                    if image:
                        image.close()
                    name = ids[i]
                    files.append((f"{mine}/{name}{self.options['suffix']}", f"{place}/{name}{self.options['suffix']}"))
                    image = _Image(store_, files[-1][0], int(h[i]), int(w[i]), self.options)
                image.put(int(strip[i]), r[i:j], c[i:j], [v[i:j] for v in values])
        if image:
            image.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store_, place = store(self.options["path"])
        for m in messages:
            for staged, final in m.files if m else []:
                store_.move(staged, final)
        store_.delete_dir(f"{place}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:
        store_, place = store(self.options["path"])
        if store_.get_file_info(f"{place}/{self.staging}").type == fs.FileType.Directory:
            store_.delete_dir(f"{place}/{self.staging}")


class RasterSource(DataSource):
    """Options. Reading: path, suffix, bands (names in the files' order), corrupt (fail or skip), share (compressed bytes a task), tasks (so many at least, where there are as many files). Only the columns of the stated schema are
    made; of files with a plane a band, only their planes are read. Writing: path, suffix, bands, dtype, compression (none or deflate), georef, epsg."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "image_id string, r int, c int, " + ", ".join(f"{b.strip()} int" for b in self.options.get("bands", "b,g,red,nir").split(","))

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(RasterSource)


def read_pixels(spark: SparkSession, folder: str, columns: list[str], bands: list[str], suffix: str = SUFFIX, kind: str = "int", corrupt: str = "fail", share: int = SHARE) -> DataFrame:
    """(image_id, r, c, columns...), a row a pixel, of the TIFFs in folder whose names end in suffix. bands names the files' bands in order, columns the ones wanted. folder is an absolute path or a URI
    that driver and tasks reach alike."""
    register(spark)
    schema = "image_id string, r int, c int" + "".join(f", {c} {kind}" for c in columns)
    options = {"bands": ",".join(bands), "suffix": suffix, "corrupt": corrupt, "share": str(share), "tasks": str(spark.sparkContext.defaultParallelism)}
    return spark.read.format(NAME).schema(schema).options(**options).load(folder)


def write_rasters(pixels: DataFrame, folder: str, bands: list[str], suffix: str = "_class.tif", dtype: str = "u1", georef: tuple | None = None, epsg: int | None = None, compression: str = "none") -> None:
    """Writes pixels (image_id, r, c, bands...) as a TIFF an image; cells without a pixel are 0, a pixel given twice has one of its values. An image is one task's, which holds a strip of it (with deflate, its
    compressed strips as well)."""
    spark = pixels.sparkSession
    register(spark)
    size = pixels.groupBy("image_id").agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    rows = pixels.select(F.col("image_id").cast("string").alias("image_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *bands)
    rows = rows.join(size.withColumn("image_id", F.col("image_id").cast("string")), "image_id").repartition("image_id").sortWithinPartitions("image_id", "r", "c")
    options = {"bands": ",".join(bands), "suffix": suffix, "dtype": dtype, "compression": compression} | ({"georef": ",".join(map(repr, georef))} if georef else {}) | ({"epsg": str(epsg)} if epsg else {})
    rows.write.format(NAME).mode("append").options(**options).save(folder)
