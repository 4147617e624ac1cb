"""Drawn shapes, tide atlases, model registries and reference look-ups against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import annotation, catalog, ml, registry, tides


def test_shapes_fill_rows(spark):
    rng = np.random.default_rng(2)
    rings = {k: rng.random((int(rng.integers(3, 9)), 2)) * 24 for k in range(12)}
    rings[0] = np.array([[2.0, 2.0], [2.0, 9.0], [8.0, 9.0], [8.0, 2.0]])  # corners on centres
    df = spark.createDataFrame([("i", k, n, float(r), float(c)) for k, ring in rings.items() for n, (r, c) in enumerate(ring)], "image_id string, shape int, seq int, r double, c double")
    got = {(x.shape, x.r, c) for x in annotation.row_intervals(df).collect() for c in range(x.c0, x.c1 + 1)}
    want = set()
    for k, ring in rings.items():
        for r in range(25):
            for c in range(25):
                n = 0
                for (r0, c0), (r1, c1) in zip(ring, np.roll(ring, -1, 0)):
                    if min(r0, r1) <= r < max(r0, r1) and c0 + (c1 - c0) * (r - r0) / (r1 - r0) > c:
                        n += 1
                if n % 2:
                    want.add((k, r, c))
    assert got == want


def test_labels_rectangles_and_earlier_classes(spark):
    shapes = spark.createDataFrame([("i", "a", 1, 1, 3, 600), ("i", "b", 3, 5, 2, 4), ("j", "c", 0, 0, 0, 0)], "image_id string, shape string, r0 int, c0 int, r1 int, c1 int")
    pixels = spark.range(5 * 700).selectExpr("'i' AS image_id", "CAST(id / 700 AS INT) AS r", "CAST(id % 700 AS INT) AS c").unionByName(spark.createDataFrame([("j", 0, 0), ("k", 0, 0)], "image_id string, r int, c int"))
    classes = spark.createDataFrame([("i", "a", 1), ("i", "b", 2), ("j", "c", 3)], "image_id string, shape string, cls int")
    done = spark.createDataFrame([("i", 2, 300)], "image_id string, r int, c int")
    got = {(x.image_id, x.r, x.c): (x.shape, x.cls) for x in annotation.label_pixels(pixels, annotation.row_intervals(annotation.rectangle(shapes)), classes, done).collect()}
    assert got == {("i", r, c): ("a", 1) for r in (1, 2, 3) for c in range(1, 601) if (r, c) != (2, 300)} | {("j", 0, 0): ("c", 3)}


def test_atlas_between_places_and_at_coasts(spark):
    grid = spark.createDataFrame([("ocean", "M2", 0, 0, 1.0, 0.5), ("ocean", "M2", 1, 0, 3.0, 0.5), ("ocean", "M2", 0, 1, 1.0, 0.5), ("load", "K1", 0, 0, 0.2, -0.1)], "part string, name string, i bigint, j bigint, re double, im double")
    model: tides.TideModel = tides.GridAtlas(grid, 10.0, 20.0, 0.5)
    at = dt.datetime(2020, 5, 6, 7, 8, 9, 999)
    points = spark.createDataFrame([(1, 10.0, 20.0, at), (2, 10.25, 20.0, at), (3, 10.25, 20.25, at), (4, 11.2, 21.2, at), (4, 11.2, 21.2, at), (5, None, 20.0, at)], "id int, lon double, lat double, ts timestamp_ntz")
    s = (at.replace(microsecond=0) - dt.datetime(2000, 1, 1, 12)).total_seconds()

    def height(name, re, im):
        speed, f0, f1, u1 = tides.CONSTITUENTS[name]
        n = math.radians(tides.NODE + tides.NODE_A_DAY * s / 86400)
        a = math.radians(speed * s / 3600 + u1 * math.sin(n))
        return (f0 + f1 * math.cos(n)) * (re * math.cos(a) + im * math.sin(a))

    k = height("K1", 0.2, -0.1)
    got = sorted(((r.id, r.tide) for r in model.tide(points).collect()), key=str)
    want = [(1, height("M2", 1.0, 0.5) + k), (2, height("M2", 2.0, 0.5) + k), (3, height("M2", 5 / 3, 0.5) + k), (4, None), (4, None)]
    assert [g[0] for g in got][:5] == [1, 2, 3, 4, 4]
    assert all(a[1] == b[1] or abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want))
    bad = tides.GridAtlas(grid.withColumn("name", F.lit("XX")), 10.0, 20.0, 0.5)
    with pytest.raises(Exception):
        bad.tide(points).collect()


def test_registry(spark, tmp_path):
    folder = str(tmp_path / "m")
    assert registry.publish(spark, folder, "default", "logistic", [([[1.0, -1.0]], [0.0])]) == 1
    assert registry.publish(spark, folder, "default", "logistic", [([[-1.0, 1.0]], [0.0])]) == 2
    assert registry.publish(spark, folder, "deep", "mlp", [([[1, 0], [0, 1], [-1, -1]], [0, 0, 0]), ([[1, 0, 0], [0, 1, 0], [0, 0, 1]], [0, 0, 0.5])]) == 1
    with pytest.raises(ValueError):
        registry.publish(spark, folder, "x", "logistic", [([[1.0]], [0.0, 1.0])])
    rows = [(1, [3.0, 1.0], "deep"), (2, [1.0, 3.0], "deep"), (3, [-1.0, -1.0], "deep"), (4, [3.0, 1.0], "none"), (5, [1.0, 3.0], None), (6, None, "deep"), (7, [1.0, None], "deep"), (8, [1.0], "deep")]
    df = spark.createDataFrame(rows, "id int, x array<double>, kind string")
    got = {r.id: (r.model, r.version, r.cls, r.error) for r in registry.classify(df, "x", spark.read.schema(registry.MODELS).parquet(folder), F.col("kind")).collect()}
    assert got == {1: ("deep", 1, 0, None), 2: ("deep", 1, 1, None), 3: ("deep", 1, 2, None), 4: ("default", 2, 0, None), 5: ("default", 2, 1, None), 6: ("deep", 1, None, "no features"), 7: ("deep", 1, None, "no features"), 8: ("deep", 1, None, "features don't fit")}


def test_references_with_and_without_a_join(spark, monkeypatch):
    names = ["a_shoreline.geojson", "a_shoreline_2000-01_2000-2002_11-02.geojson", "a_shoreline_2001-01_2001-2001_01-12.geojson", "b_shoreline.geojson"]
    refs = spark.createDataFrame([(n,) for n in names], "file string")
    days = [dt.datetime(2001, 1, 5), dt.datetime(2001, 6, 5), dt.datetime(1999, 12, 1), dt.datetime(2002, 12, 1), dt.datetime(2001, 6, 5)]
    scenes = spark.createDataFrame([(str(d)[:10], d) for d in days], "id string, ts timestamp_ntz")
    want = sorted([("2001-01-05", names[1]), ("2001-06-05", names[2]), ("1999-12-01", names[0]), ("2002-12-01", names[1]), ("2001-06-05", names[2])])
    assert sorted((r.id, r.file) for r in catalog.reference_for(scenes, refs).collect()) == want
    monkeypatch.setattr(catalog, "FEW_REFERENCES", 2)
    assert sorted((r.id, r.file) for r in catalog.reference_for(scenes, refs).collect()) == want
    assert {r.file for r in catalog.reference_for(scenes, refs.limit(0)).collect()} == {None}
