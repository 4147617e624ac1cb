"""GeoTIFF rasters: decoded from binary files of any store into pixel tables, and written as one-band images."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_package

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}

GEOREF = "struct<xtr: double, xscale: double, xshear: double, ytr: double, yshear: double, yscale: double>"


#: Bits of the codes after a clear code, and where each begins: the width grows as entries are added, one code early.
_WIDTH = np.array([9, *[9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12 for n in range(258, 4096)]], np.int64)
_BEGIN = np.concatenate((np.zeros(1, np.int64), np.cumsum(_WIDTH)[:-1]))


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first. Between two clear codes the place and width of every code are known beforehand, so NumPy cuts
    them out; and the string of an entry is what the output holds where its code stood, and one byte more, so each code is one copy."""
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(8, np.uint8))).astype(np.int64)
    out, at, limit = bytearray(), 0, 8 * len(data)
    while at + 9 <= limit:
        n = int(np.searchsorted(_BEGIN + _WIDTH, limit - at, "right"))
        bit = at + _BEGIN[:n]
        i = bit >> 3
        word = (raw[i] << 24) | (raw[i + 1] << 16) | (raw[i + 2] << 8) | raw[i + 3]
        codes = (word >> (32 - _WIDTH[:n] - (bit & 7))) & ((1 << _WIDTH[:n]) - 1)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stop[0]) if len(stop) else n
        where, length = [0] * n, [0] * n
        for k, code in enumerate(codes[:n].tolist()):
            where[k] = len(out)
            if code < 256:
                out.append(code)
            elif code - 258 < k - 1:
                w = where[code - 258]
                out += out[w : w + length[code - 258] + 1]
            elif code - 258 == k - 1:  # the entry that this code completes
                w = where[k - 1]
                out += out[w : w + length[k - 1]]
                out.append(out[w])
            else:
                raise ValueError("a code without an entry")
            length[k] = len(out) - where[k]
        if not len(stop) or codes[n] == 257:
            break
        at += int(_BEGIN[n] + _WIDTH[n])
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


_DECODE = {1: bytes, 5: _lzw, 8: zlib.decompress, 32773: _packbits, 32946: zlib.decompress}


@dataclass
class Layout:
    """Where the strips or tiles of a TIFF lie and what they hold."""

    h: int
    w: int
    bands: int
    dtype: np.dtype
    planar: int
    predictor: int
    how: Callable[[bytes], bytes]
    tiled: bool
    bw: int
    bh: int
    offsets: tuple
    counts: tuple
    georef: tuple | None
    epsg: int | None

    def spot(self, k: int) -> tuple[int | None, int, int]:
        """(band, or None where a block has all; first row; first column) of block k."""
        across, down = -(-self.w // self.bw), -(-self.h // self.bh)
        plane, cell = divmod(k, across * down)
        return (None if self.planar == 1 else plane), (cell // across) * self.bh, (cell % across) * self.bw

    def block(self, k: int, raw: bytes) -> np.ndarray:
        """(rows, columns, bands) of block k, cut at the image's edges."""
        _, y, x = self.spot(k)
        rows, depth = self.bh if self.tiled else min(self.bh, self.h - y), self.bands if self.planar == 1 else 1
        a = np.frombuffer(self.how(raw)[: rows * self.bw * depth * self.dtype.itemsize], self.dtype).reshape(rows, self.bw, depth)
        if self.predictor == 2:
            a = np.cumsum(a, axis=1, dtype=self.dtype)
        return a[: self.h - y, : self.w - x]


def layout(read: Callable[[int, int], bytes]) -> Layout:
    """The layout of a baseline TIFF whose bytes read(offset, number) gives; only its directory is read."""
    end = {b"II": "<", b"MM": ">"}.get((head := read(0, 8))[:2])
    if end is None or struct.unpack(f"{end}H", head[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(f"{end}I", head[4:8])[0]
    tags: dict[int, tuple] = {}
    n_tags = struct.unpack(f"{end}H", read(at, 2))[0]
    entries = read(at + 2, 12 * n_tags)
    for i in range(n_tags):
        tag, kind, n = struct.unpack(f"{end}HHI", entries[12 * i : 12 * i + 8])
        size = _SIZES.get(kind, 1) * n
        if kind in _CODES:
            value = entries[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else read(struct.unpack(f"{end}I", entries[12 * i + 8 : 12 * i + 12])[0], size)
            tags[tag] = struct.unpack(f"{end}{n}{_CODES[kind]}", value)
    w, h, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
    tiled = 324 in tags
    bw, bh = (tags[322][0], tags[323][0]) if tiled else (w, min(tags.get(278, (h,))[0], h))
    scale, tie, keys = tags.get(33550), tags.get(33922), tags.get(34735)
    georef = (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]) if scale and tie else None
    if 34264 in tags:
        m = tags[34264]
        georef = (m[3], m[0], m[1], m[7], m[4], m[5])
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0} if keys else {}
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    dtype = np.dtype(f"{end}{kind}{tags.get(258, (8,))[0] // 8}")
    return Layout(h, w, bands, dtype, tags.get(284, (1,))[0], tags.get(317, (1,))[0], _DECODE[tags.get(259, (1,))[0]], tiled, bw, bh, offsets, counts, georef, found.get(3072) or found.get(2048))


def decode(raw: bytes) -> tuple[np.ndarray, tuple, int | None]:
    """(array of rows, columns, bands; georeference or None; EPSG or None) of a baseline TIFF in strips or tiles."""
    t = layout(lambda o, n: raw[o : o + n])
    out = np.zeros((t.h, t.w, t.bands), t.dtype)
    for k, (o, n) in enumerate(zip(t.offsets, t.counts, strict=True)):
        (plane, y, x), part = t.spot(k), t.block(k, raw[o : o + n])
        out[y : y + part.shape[0], x : x + part.shape[1], slice(None) if plane is None else slice(plane, plane + 1)] = part
    return out, t.georef, t.epsg


def directory(h: int, w: int, n: int, dtype: np.dtype, offsets: list[int], counts: list[int], rows: int, compressed: bool, georef: tuple | None, epsg: int | None) -> bytes:
    """The head of a TIFF whose strips of so many rows follow it: header and directory. offsets are counted from the end of the head."""
    bits, form = dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[dtype.kind]
    tags = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (bits,) * n), (259, 3, (8 if compressed else 1,)), (262, 3, (1,)), (273, 4, tuple(offsets)), (277, 3, (n,)), (278, 4, (rows,)), (279, 4, tuple(counts)), (284, 3, (1,)), (339, 3, (form,) * n)]
    if georef:
        if georef[2] or georef[4]:
            tags.append((34264, 12, (georef[1], georef[2], 0.0, georef[0], georef[4], georef[5], 0.0, georef[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
        else:
            tags += [(33550, 12, (georef[1], -georef[5], 0.0)), (33922, 12, (0.0, 0.0, 0.0, georef[0], georef[3], 0.0))]
    if epsg:
        tags.append((34735, 3, (1, 1, 0, 1, 3072, 0, 1, epsg)))
    tags.sort()
    head, extra, free = io.BytesIO(), io.BytesIO(), 8 + 2 + 12 * len(tags) + 4
    head.write(b"II*\0" + struct.pack("<IH", 8, len(tags)))
    data_at = free + sum(s for s in (struct.calcsize(f"<{len(v)}{_CODES[k]}") for _, k, v in tags) if s > 4)
    if data_at + max((o + c for o, c in zip(offsets, counts, strict=True)), default=0) >= 1 << 32:
        raise ValueError("an image of 4 GB or more is no classic TIFF")
    for tag, kind, v in tags:
        v = tuple(data_at + o for o in v) if tag == 273 else v
        raw = struct.pack(f"<{len(v)}{_CODES[kind]}", *v)
        head.write(struct.pack("<HHI", tag, kind, len(v)))
        if len(raw) > 4:
            head.write(struct.pack("<I", free + extra.tell()))
            extra.write(raw)
        else:
            head.write(raw.ljust(4, b"\0"))
    return head.getvalue() + b"\0\0\0\0" + extra.getvalue()


def encode(a: np.ndarray, georef: tuple | None = None, epsg: int | None = None) -> bytes:
    """A TIFF of (rows, columns) or (rows, columns, bands), deflated in one strip."""
    a = a[:, :, None] if a.ndim == 2 else a
    a = a.astype(a.dtype.newbyteorder("<"))
    body = zlib.compress(a.tobytes())
    return directory(*a.shape, a.dtype, [0], [len(body)], a.shape[0], True, georef, epsg) + body


def read_rasters(spark: SparkSession, folder: str, suffix: str = "_3B_AnalyticMS_toar_clip.tif") -> DataFrame:
    """(image_id, h, w, n_bands, georef, epsg, dtype, bands): a row an image, bands as binaries of row-major pixels. Corrupt files give nulls. An image
    is decoded within one task."""
    schema = f"image_id string, h int, w int, n_bands int, georef {GEOREF}, epsg int, dtype string, bands array<binary>"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    names = ("xtr", "xscale", "xshear", "ytr", "yshear", "yscale")

    def run(batches):
        for b in batches:
            rows = []
            for name, raw in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                row = dict.fromkeys(("h", "w", "n_bands", "georef", "epsg", "dtype", "bands")) | {"image_id": name.removesuffix(suffix)}
                try:
                    a, georef, epsg = decode(raw)
                    row |= {"h": a.shape[0], "w": a.shape[1], "n_bands": a.shape[2], "georef": dict(zip(names, georef, strict=True)) if georef else None, "epsg": epsg, "dtype": a.dtype.newbyteorder("<").str, "bands": [np.ascontiguousarray(a[:, :, k]).astype(a.dtype.newbyteorder("<")).tobytes() for k in range(a.shape[2])]}
                except (ValueError, KeyError, struct.error, zlib.error, IndexError):
                    pass
                rows.append(row)
            kinds = pa.schema([("image_id", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("n_bands", pa.int32()), ("georef", pa.struct([(n, pa.float64()) for n in names])), ("epsg", pa.int32()), ("dtype", pa.string()), ("bands", pa.list_(pa.binary()))])
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    ship_package(spark)
    return named.mapInArrow(run, schema)


def pixels_of(rasters: DataFrame, names: list[str]) -> DataFrame:
    """(image_id, r, c, names...) of rasters' first bands, a row a pixel; images without bands give none."""
    schema = "image_id string, r int, c int, " + ", ".join(f"{n} int" for n in names)

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                if x["bands"] is None or len(x["bands"]) < len(names):
                    continue
                h, w = x["h"], x["w"]
                cols = [np.frombuffer(v, x["dtype"]).astype(np.int32) for v in x["bands"][: len(names)]]
                r, c = np.divmod(np.arange(h * w, dtype=np.int32), w)
                yield pa.RecordBatch.from_arrays([pa.array([x["image_id"]] * (h * w), pa.string()), pa.array(r), pa.array(c), *map(pa.array, cols)], names=["image_id", "r", "c", *names])

    ship_package(rasters.sparkSession)
    return rasters.select("image_id", "h", "w", "dtype", "bands").mapInArrow(run, schema)


def masks_of(rasters: DataFrame, band: int = 8) -> DataFrame:
    """(image_id, r, c, masked): whether the usable-data mask's band isn't 0."""
    out = pixels_of(rasters, [f"b{i}" for i in range(1, band + 1)])
    return out.select("image_id", "r", "c", (F.col(f"b{band}") != 0).alias("masked"))


def encoded(classes: DataFrame, georef: tuple | None = None, epsg: int | None = None) -> DataFrame:
    """(image_id, tif) of class rasters (image_id, r, c, cls): one byte a pixel. An image is one task's group."""

    def run(group: pa.Table) -> pa.Table:
        r, c, v = (group.column(k).to_numpy() for k in ("r", "c", "cls"))
        a = np.zeros((r.max() + 1, c.max() + 1), np.uint8)
        a[r, c] = v
        return pa.table({"image_id": [group.column("image_id")[0].as_py()], "tif": pa.array([encode(a, georef, epsg)], pa.binary())})

    ship_package(classes.sparkSession)
    return classes.select(F.col("image_id").cast("string").alias("image_id"), "r", "c", "cls").groupBy("image_id").applyInArrow(run, "image_id string, tif binary")
