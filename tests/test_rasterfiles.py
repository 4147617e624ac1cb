import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import geotiff, rasterfiles


def tiled(a, planar, tile=16):
    """A TIFF of (rows, columns, bands) in deflated tiles, with a plane a band or not, written by hand."""
    import zlib

    h, w, n = a.shape
    parts = [a[:, :, [k]] for k in range(n)] if planar == 2 else [a]
    blocks = []
    for p in parts:
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                t = np.zeros((tile, tile, p.shape[2]), a.dtype)
                q = p[y : y + tile, x : x + tile]
                t[: q.shape[0], : q.shape[1]] = q
                blocks.append(zlib.compress(t.tobytes()))
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [16] * n), (259, "H", [8]), (277, "H", [n]), (284, "H", [planar]), (322, "I", [tile]), (323, "I", [tile]), (324, "I", [0] * len(blocks)), (325, "I", [len(b) for b in blocks])]
    free = 8 + 2 + 12 * len(tags) + 4
    first = free + sum(s for s in (struct.calcsize(f"<{len(v)}{k}") for _, k, v in tags) if s > 4)
    tags[8] = (324, "I", [first + sum(len(b) for b in blocks[:i]) for i in range(len(blocks))])
    head, extra = b"II*\0" + struct.pack("<IH", 8, len(tags)), b""
    for tag, k, v in tags:
        raw = struct.pack(f"<{len(v)}{k}", *v)
        head += struct.pack("<HHI", tag, {"H": 3, "I": 4}[k], len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", free + len(extra)))
        extra += raw if len(raw) > 4 else b""
    return head + b"\0\0\0\0" + extra + b"".join(blocks)


def test_tiles_strips_and_planes(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {f"i{k}": rng.integers(0, 60000, (37 + k, 50, 4)).astype("<u2") for k in range(3)}
    for (name, a), planar in zip(images.items(), (1, 2, 2)):
        (tmp_path / f"{name}.tif").write_bytes(tiled(a, planar))
        assert (geotiff.decode(tiled(a, planar))[0] == a).all()
    df = rasterfiles.read_pixels(spark, str(tmp_path), ["nir", "b"], ["b", "g", "red", "nir"], ".tif", share=4000)
    assert df.rdd.getNumPartitions() > 6 and df.columns == ["image_id", "r", "c", "nir", "b"]
    got = df.collect()
    assert len(got) == sum(a.shape[0] * a.shape[1] for a in images.values())
    assert all((x.nir, x.b) == tuple(images[x.image_id][x.r, x.c, [3, 0]]) for x in got)
    assert rasterfiles.read_pixels(spark, str(tmp_path), ["g"], ["b", "g"], ".tif").count() == len(got)


@pytest.mark.parametrize("compression", ["none", "deflate"])
def test_round_trip(spark, tmp_path, compression):
    df = spark.range(3 * 150 * 40).selectExpr("concat('i', id % 3) AS image_id", "CAST(id / 3 / 40 AS INT) AS r", "CAST(id / 3 % 40 AS INT) AS c", "CAST(pmod(xxhash64(id), 200) AS INT) AS cls").where("image_id <> 'i1' OR r NOT BETWEEN 60 AND 140")
    rasterfiles.write_rasters(df, str(tmp_path / "out"), ["cls"], georef=(10.0, 3.0, 0.0, 20.0, 0.0, -3.0), epsg=32604, compression=compression)
    assert sorted(os.listdir(tmp_path / "out")) == ["i0_class.tif", "i1_class.tif", "i2_class.tif"]
    back = rasterfiles.read_pixels(spark, str(tmp_path / "out"), ["cls"], ["cls"], "_class.tif")
    assert back.count() == 3 * 150 * 40 and df.exceptAll(back).isEmpty()
    assert back.join(df, ["image_id", "r", "c"], "left_anti").where("cls <> 0 OR image_id <> 'i1'").isEmpty()
    _, georef, epsg = geotiff.decode((tmp_path / "out" / "i1_class.tif").read_bytes())
    assert georef == (10.0, 3.0, 0.0, 20.0, 0.0, -3.0) and epsg == 32604


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.range(400).selectExpr("concat('i', id % 4) AS image_id", "CAST(id / 4 AS INT) AS r", "0 AS c", "CAST(id AS INT) AS cls")
    broken = df.withColumn("cls", F.when(F.col("image_id") == "i3", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("cls")))
    with pytest.raises(Exception):
        rasterfiles.write_rasters(broken, str(tmp_path / "out"), ["cls"])
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []
    rasterfiles.write_rasters(df, str(tmp_path / "out"), ["cls"])
    assert len(os.listdir(tmp_path / "out")) == 4


def test_corrupt_files(spark, tmp_path):
    (tmp_path / "bad.tif").write_bytes(b"not a raster")
    (tmp_path / "good.tif").write_bytes(geotiff.encode(np.ones((2, 3), "u1")))
    assert rasterfiles.read_pixels(spark, str(tmp_path), ["b"], ["b"], ".tif", corrupt="skip").count() == 6
    with pytest.raises(Exception):
        rasterfiles.read_pixels(spark, str(tmp_path), ["b"], ["b"], ".tif").count()


def lzw(data):
    """A plain encoder."""
    out, bits, table, width, w = 0, 0, {}, 9, b""

    def put(code):
        nonlocal out, bits
        out, bits = (out << width) | code, bits + width

    put(256)
    table, n = {bytes([i]): i for i in range(256)}, 258
    for x in data:
        c = bytes([x])
        if w + c in table:
            w += c
            continue
        put(table[w])
        table[w + c], n = n, n + 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        w = c
        if n == 4094:
            put(table[w])
            put(256)
            table, n, width, w = {bytes([i]): i for i in range(256)}, 258, 9, b""
    if w:
        put(table[w])
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    return (out << (-bits % 8)).to_bytes((bits + 7) // 8, "big")


def test_lzw_over_many_tables():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"a" * 5000, bytes(rng.integers(0, 256, 20_000).astype(np.uint8)), bytes(rng.integers(0, 4, 60_000).astype(np.uint8))):
        assert geotiff._lzw(lzw(data)) == data


def test_small_files_share_tasks(spark, tmp_path):
    n = 300
    pixels = spark.range(n * 6).select(F.concat(F.lit("i"), F.floor(F.col("id") / 6).cast("string")).alias("image_id"), (F.col("id") % 6 / 3).cast("int").alias("r"), (F.col("id") % 3).cast("int").alias("c"), (F.col("id") % 251).cast("int").alias("cls"))
    folder = str(tmp_path / "many")
    rasterfiles.write_rasters(pixels, folder, ["cls"], "_q.tif", compression="deflate")
    back = rasterfiles.read_pixels(spark, folder, ["cls"], ["cls"], "_q.tif")
    assert back.rdd.getNumPartitions() <= 20 < n and back.exceptAll(pixels).isEmpty() and back.count() == 6 * n
    with open(f"{folder}/i7_q.tif", "wb") as f:  # the other files of its task stay
        f.write(b"no TIFF at all")
    left = rasterfiles.read_pixels(spark, folder, ["cls"], ["cls"], "_q.tif", corrupt="skip")
    assert left.count() == 6 * (n - 1)
