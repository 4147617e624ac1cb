"""Shorelines by joins against the plain version, image by image."""

import numpy as np
import plain_site as plain
import pytest
from pyspark.sql import functions as F

from tidemark.operators import contours, raster, vector
from tidemark.plans import site


def classes(spark, images):
    """A class table of {name: (water, masked)}."""
    rows = [(n, r, c, int(w[r, c]), bool(m[r, c])) for n, (w, m) in images.items() for r in range(w.shape[0]) for c in range(w.shape[1])]
    return spark.createDataFrame(rows, "image_id string, r int, c int, cls int, masked boolean").repartition(3)


def coast(rng, h, w, noise):
    """Water on the right of a winding coast, with specks."""
    edge = w / 2 + 4 * np.sin(np.arange(h) / 5) + rng.normal(0, 1, h)
    return (np.arange(w)[None, :] > edge[:, None]) ^ (rng.random((h, w)) < noise)


@pytest.mark.parametrize("tile", [256, 7])
def test_contours_in_order(spark, tile):
    rng = np.random.default_rng(3)
    images = {"coast": coast(rng, 31, 40, 0.05), "noise": rng.random((17, 23)) < 0.5, "plain": np.zeros((5, 5), bool), "ring": np.zeros((40, 40), bool), "spiral": np.zeros((41, 41), bool)}
    images["ring"][3:37, 4:36] = True
    images["ring"][8:30, 10:30] = False
    a = images["spiral"]
    r, c, d, step = 20, 20, 0, 2
    for turn in range(18):
        for _ in range(step):
            a[r, c] = True
            r, c = r + (0, 1, 0, -1)[d], c + (1, 0, -1, 0)[d]
        d, step = (d + 1) % 4, step + 2 * (turn % 2)
        if not (1 <= r < 40 and 1 <= c < 40):
            break
    df = classes(spark, {n: (w, np.zeros_like(w)) for n, w in images.items()})
    got = {}
    for x in sorted(contours.ordered(raster.segments(df.select("image_id", "r", "c", (1 - F.col("cls")).alias("cls"))), tile).collect(), key=lambda x: (x.image_id, x.seq)):
        got.setdefault(x.image_id, []).append((x.seq, x.line, x.r, x.c))
    for n, w in images.items():
        want = [(k, *p) for k, line in enumerate(plain.contour_lines(~w)) for p in line.tolist()]
        assert [x[1:] for x in got.get(n, [])] == want and [x[0] for x in got.get(n, [])] == list(range(len(want)))


def agree(spark, images, s):
    got = {}
    for x in site.shorelines(classes(spark, images), s).orderBy("image_id", "seq").collect():
        got.setdefault(x.image_id, []).append((x.x, x.y))
    for n, (w, m) in images.items():
        water = plain.clean_classes(w, s.least_land, s.least_water, s.erosion, s.dilation)
        want = plain.shoreline(water, m, s)
        assert n in got if want is not None else n not in got, n
        if want is not None:
            assert len(want) == len(got[n]) and np.allclose(want, got[n], atol=1e-6), n


SETTINGS = [
    {"reference": [(60.0, 117.0), (66.0, 40.0), (58.0, 3.0)], "max_dist_from_ref": 18.0},
    {"sigma": 0.8, "max_gap": 4.0, "min_length": 9.0},
    {"sigma": 0.8, "window": 3, "compat": False, "reference": [(60.0, 117.0), (58.0, 3.0)], "max_dist_from_ref": 12.0},
    {"sigma": None, "compat": False, "max_gap": 3.5, "min_length": 6.0},
    {"sigma": 2.0, "window": 5, "reference": [(9000.0, 9000.0), (9100.0, 9000.0)]},
]


@pytest.mark.parametrize("more", SETTINGS)
def test_shorelines(spark, more):
    rng = np.random.default_rng(8)
    s = site.Settings(**({"georef": (0.0, 3.0, 0.0, 120.0, 0.0, -3.0), "least_land": 6, "least_water": 6, "erosion": False, "dilation": False} | more))
    images = {f"i{k}": (coast(rng, 40, 44, 0.02), rng.random((40, 44)) < 0.004 * k) for k in range(4)}
    images |= {"small": (coast(rng, 12, 44, 0.02), np.zeros((12, 44), bool)), "land": (np.zeros((9, 9), bool), np.zeros((9, 9), bool)), "cloud": (coast(rng, 20, 20, 0), np.ones((20, 20), bool))}
    agree(spark, images, s)


def test_no_images(spark):
    df = spark.createDataFrame([], "image_id string, r int, c int, cls int, masked boolean")
    assert site.shorelines(df, site.Settings(georef=(0.0, 3.0, 0.0, 0.0, 0.0, -3.0), reference=[(1.0, 1.0), (9.0, 9.0)])).collect() == []


def test_inside_polygons(spark):
    rng = np.random.default_rng(5)
    ring = rng.random((40, 2)) * 20
    pts = np.concatenate((rng.random((500, 2)) * 24 - 2, ring, (ring + np.roll(ring, -1, 0)) / 2, np.round(rng.random((200, 2)) * 20)))
    edges = spark.createDataFrame([("p", *map(float, a), *map(float, b)) for a, b in zip(ring, np.roll(ring, -1, 0))], "line string, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([("p", "i", k, *map(float, p)) for k, p in enumerate(pts)], "line string, image_id string, seq int, x double, y double")
    want = set(np.flatnonzero(plain.strictly_inside(pts, ring)).tolist())
    for side in (0.5, 3.0, 100.0):
        assert {r.seq for r in vector.inside_polygons(points, edges, "line", side).collect()} == want


def test_nearest_point(spark):
    rng = np.random.default_rng(6)
    pts = {"a": rng.random((300, 2)) * 100, "b": np.concatenate((np.zeros((40, 2)), rng.random((5, 2)) * 1e4)), "c": np.array([[5.0, 5.0]] * 3), "far": np.array([[-1e6, 1e6]])}
    refs = {n: np.concatenate((rng.random((30, 2)) * 120 - 10, np.array([[1e5, -1e5]]))) for n in (*pts, "none")}
    p = spark.createDataFrame([(n, k, *map(float, v)) for n, x in pts.items() for k, v in enumerate(x)], "image_id string, idx int, x double, y double")
    r = spark.createDataFrame([(n, k, *map(float, v)) for n, x in refs.items() for k, v in enumerate(x)], "image_id string, ref int, rx double, ry double")
    got = {(x.image_id, x.ref): (x.idx, x.d) for x in vector.nearest_point(p, r).collect()}
    assert len(got) == 4 * 31
    for n, x in pts.items():
        for k, v in enumerate(refs[n]):
            d = np.hypot(*(x - v).T)
            assert abs(got[n, k][1] - d.min()) < 1e-6 and abs(d[got[n, k][0]] - d.min()) < 1e-9 * max(1, d.min())
    assert vector.nearest_point(p.limit(0), r).collect() == []


def test_nearest_point_far_from_crowds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    crowd = np.concatenate((np.round(rng.random((1500, 2)) * 40, 1), 1e-7 * rng.random((200, 2)), [[9e4, 9e4]]))
    refs = np.concatenate((rng.random((30, 2)) * 60 - 10, rng.random((30, 2)) * 1e-7, np.stack((np.linspace(1e3, 9e6, 400), np.full(400, 20.0)), 1)))
    rows = [("a", k % 7 * 10_000 + k, *map(float, v)) for k, v in enumerate(np.concatenate((crowd, crowd)))]
    p = spark.createDataFrame([*rows, ("a", -1, None, 3.0), ("null", 8, None, None), ("null", 5, 1.0, None)], "image_id string, idx bigint, x double, y double")
    r = spark.createDataFrame([("a", k, *map(float, v)) for k, v in enumerate(refs)] + [("a", 1000, None, 1.0), ("null", 1, 0.0, 0.0), ("gone", 1, 0.0, 0.0)], "image_id string, ref int, rx double, ry double")
    kept, inner = [], vector.cut
    monkeypatch.setattr(vector, "cut", lambda df: kept.append(inner(df)) or kept[-1])
    got = {(x.image_id, x.ref): (x.idx, x.d) for x in vector.nearest_point(p, r).collect()}
    assert got.pop(("a", 1000)) == (-1, None) and got.pop(("null", 1)) == (5, None) and len(got) == len(refs)
    idx, at = np.array([x[1] for x in rows]), np.array([x[2:] for x in rows])
    for k, v in enumerate(refs):
        d = np.sqrt((v[0] - at[:, 0]) * (v[0] - at[:, 0]) + (v[1] - at[:, 1]) * (v[1] - at[:, 1]))
        assert got["a", k] == (idx[d == d.min()].min(), d.min())
    # what a round keeps are a few parts a reference; the rings met the whole crowd from afar
    assert max(df.count() for df in kept if "split" in df.columns and "rx" in df.columns) < 12 * len(refs)


def test_resume_from_many_partitions(spark):
    ids = [f"{k * 7919 % 5000:05d}" for k in range(5000)] + ["00001"] * 300
    scenes = spark.createDataFrame([(i,) for i in ids], "image_id string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for start in (0, 1, 25, 299, 2500, 5299, 5300, 9000):
            left = site.resume_from(scenes, start)
            assert [r.image_id for r in left.collect()] == sorted(ids)[start:]
        spread = site.resume_from(scenes, 25)
        assert spread.select(F.spark_partition_id().alias("p")).distinct().count() > 1  # an offset puts all rows into one task
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cleaning_reads_its_classes_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    own = spark.range(400).select(F.lit("a").alias("image_id"), (F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), (F.col("id") % 20 > 8).cast("int").alias("cls"))
    own = own.withColumn("cls", F.udf(seen, "int")("cls"))
    assert raster.clean(own, 20, 20).count() == 400
    assert read.value == 400
