"""Tie points against windows of whole images, and what they move."""

import json

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import catalog, coreg, kernels, ml
from tidemark.plans import site
from tidemark.sources import metadata

PAIRS = "image_id string, r int, c int, ref double, img double, masked boolean"


def frame_of(spark, images):
    rows = [(n, r, c, float(a[r, c]), None if np.isnan(b[r, c]) else float(b[r, c]), bool(m[r, c])) for n, a, b, m in images for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, PAIRS).repartition(7)


def test_levels_and_shifts(spark):
    a = np.random.default_rng(3).random((64, 64)) * 100
    clear, cloudy = np.zeros(a.shape, bool), np.ones(a.shape, bool)
    noise = np.random.default_rng(4).random((64, 64))
    df = frame_of(spark, [("clear", a, np.roll(a, (-2, 3), (0, 1)), clear), ("cloudy", a, a, cloudy), ("other", a, noise, clear), ("flat", a, np.ones(a.shape), clear), ("far", a, np.roll(a, 20, 0), clear)])
    shifts, ties = site.coregister(df, grid_res=16, window=32)
    got = {r.image_id: (r.level, round(r.dr), round(r.dc), r.points > 0) for r in shifts.collect()}
    assert got == {"clear": (2, 2, -3, True), "cloudy": (0, 0, 0, False), "other": (1, 0, 0, False), "flat": (1, 0, 0, False), "far": (1, 0, 0, False)}
    assert {r.image_id for r in site.failed_images(shifts).collect()} == {"cloudy", "other", "flat", "far"}
    assert site.still_to_do(df.select("image_id").distinct(), shifts.where("level = 2")).count() == 4


def test_tiles_don_t_show(spark):
    """An image over many tiles has the tie points that windows cut from the whole image have."""
    rng = np.random.default_rng(5)
    a = rng.random((150, 90)) * 50
    b = np.roll(a, (1, -1), (0, 1)) + rng.random(a.shape)
    m = rng.random(a.shape) < 0.05
    df = frame_of(spark, [("x", a, b, m)])
    got = {(r.r, r.c): (round(r.dr, 9), round(r.dc, 9), round(r.reliability, 9), r.better) for r in coreg.tie_points(df, grid_res=7, window=16, max_shift=3).collect()}
    r, c = np.indices(a.shape).reshape(2, -1)
    plain = kernels.lattice_shifts(r, c, a[r, c], b[r, c], m[r, c], (0, 0), 7, 16, 3, 1000)
    assert got == {(i, j): (round(u, 9), round(v, 9), round(q, 9), y) for i, j, u, v, q, y in plain} and len(got) > 200


def test_warp_follows_a_bent_image(spark):
    """Two halves shifted unlike each other come back, away from the seam and the edges; masks move alike."""
    a = np.random.default_rng(6).random((96, 96)) * 100
    b = np.vstack((np.roll(a, (0, 2), (0, 1))[:48], np.roll(a, (0, -2), (0, 1))[48:]))
    df = frame_of(spark, [("x", a, b, np.zeros(a.shape, bool))])
    shifts, ties = site.coregister(df, grid_res=8, window=24)
    moved = coreg.warp(df.select("image_id", "r", "c", "img", (F.col("img") > 90).alias("cloud")), ties, shifts, ["img", "cloud"], 8).collect()
    got = {(r.r, r.c): (r.img, r.cloud) for r in moved}
    assert len(moved) == len(got) == a.size
    inner = [(r, c) for r in [*range(12, 30), *range(66, 84)] for c in range(12, 84)]
    assert np.mean([got[k] == (a[k], a[k] > 90) for k in inner]) > 0.97


def test_empty_pairs(spark):
    shifts, ties = site.coregister(spark.createDataFrame([], PAIRS), 6, 16)
    assert shifts.count() == ties.count() == 0


def test_class_scores_of_nulls_and_nothing(spark):
    rows = [("a", 1, 1, True), ("a", 0, 1, True), ("a", None, 1, True), ("a", 1, None, True), ("a", 0, 0, False), ("a", 2, 2, None), ("b", 1, 1, False)]
    got = {(r.image_id, r["class"]): (r.tp, r.fp, r.tn, r.fn, r.dice, r.recall) for r in ml.class_scores(spark.createDataFrame(rows, "image_id string, truth int, pred int, inside boolean")).collect()}
    assert got == {("a", 1): (1, 1, 0, 0, 2 / 3, 1.0), ("a", 0): (0, 0, 1, 1, 0.0, 0.0)}


def test_performance_of_a_perfect_and_a_shifted_guess(spark):
    coast = np.where(np.arange(40)[None, :] >= 20, 1, 0) * np.ones((40, 1), int)
    off = np.where(np.arange(40)[None, :] >= 22, 1, 0) * np.ones((40, 1), int)
    rows = lambda n, a: [(n, r, c, int(a[r, c]), False) for r in range(40) for c in range(40)]
    schema = "image_id string, r int, c int, cls int, masked boolean"
    truth = spark.createDataFrame(rows("same", coast) + rows("off", coast), schema).drop("masked")
    pred = spark.createDataFrame(rows("same", coast) + rows("off", off), schema)
    s = site.Settings(georef=(0.0, 3.0, 0.0, 120.0, 0.0, -3.0), least_land=10, least_water=10, erosion=False, dilation=False, max_dist_from_ref=30.0, reference=[(60.0, 117.0), (60.0, 3.0)], compat=False)
    t = spark.createDataFrame([("t0", 0.0, 60.0, 115.0, 60.0)], "name string, x0 double, y0 double, x1 double, y1 double")
    out = site.performance(truth, pred, t, s)
    scores = {(r.image_id, r["class"]): r for r in out["scores"].collect()}
    assert scores["same", 1].dice == scores["same", 0].dice == 1.0 and scores["off", 1].fn > 0 == scores["off", 1].fp
    assert scores["same", 1].tp + scores["same", 1].tn < 1600  # only pixels near the line
    errors = {r.image_id: r.error for r in out["errors"].collect()}
    assert abs(errors["same"]) < 0.5 and abs(abs(errors["off"]) - 6.0) < 0.5


def test_site_entries(spark):
    rows = [("a", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]), ("b", [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]), ("c", []), ("d", None)]
    sites = spark.createDataFrame(rows, "site string, ring array<array<double>>").withColumns({"start": F.lit("2024-01-02").cast("date"), "stop": F.lit("2024-03-04").cast("date")})
    got = {r.site: r.entry and json.loads(r.entry) for r in catalog.site_entries(sites).collect()}
    assert got["c"] is None and got["d"] is None
    assert got["a"]["geometry_filter"]["config"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    assert got["b"]["geometry_filter"]["config"]["coordinates"] == [[[0, 0], [1, 0], [0, 0]]]
    assert got["a"]["date_range_filter"]["config"] == {"gte": "2024-01-02T00:00:00.000Z", "lte": "2024-03-04T00:00:00.000Z"}
    assert got["a"]["cloud_cover_filter"]["config"] == {"lte": 0.3}


def test_class_infos(spark, tmp_path):
    for name, label in (("class_info", "sand"), ("class_info_reef", "coral")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"labels": {label: 1}, "colors": {label: [0.1, 0.2, 0.3]}}))
    rows = spark.createDataFrame([("x", "reef"), ("y", "unknown"), ("z", None)], "image_id string, model string")
    got = {r.image_id: (dict(r.labels), r.colors) for r in metadata.with_class_info(rows, metadata.read_class_infos(spark, str(tmp_path))).collect()}
    assert {k: list(v[0]) for k, v in got.items()} == {"x": ["coral"], "y": ["sand"], "z": ["sand"]} and got["x"][1] == {"coral": [0.1, 0.2, 0.3]}


def test_pixel_size_of_scenes_without_metadata(spark):
    scenes = spark.createDataFrame([("20240101_101500_10_a",), ("20240101_101500_99_b",), ("20250101_000000_00_c",), (None,)], "id string")
    meta = spark.createDataFrame([("20240101_101500_20_x", 3.0), ("20240101_101500_30_x", 4.0)], "id string, pixel_resolution double")
    assert {r.id: r.pixel_size for r in metadata.with_pixel_size(scenes, meta).collect()} == {"20240101_101500_10_a": 3.0, "20240101_101500_99_b": 3.0, "20250101_000000_00_c": None, None: None}
