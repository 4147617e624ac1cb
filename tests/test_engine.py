import datetime as dt
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as geo
from tidemark.functions import ids
from tidemark.operators import catalog, ml, raster, regions, series, vector
from tidemark.plans import site
from tidemark.sources import geojson, geotiff, metadata
from tidemark.streaming import scenes


def one(df):
    return df.first()[0]


def row(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- functions


def test_item_times(spark):
    df = spark.createDataFrame([("20221115_204452_79_248",), ("20170101_001349_abcd",)], "id string")
    assert [r[0] for r in df.select(ids.item_time(F.col("id"))).collect()] == [dt.datetime(2022, 11, 15, 20, 44, 52, 790000), dt.datetime(2017, 1, 1, 0, 13, 49)]


def test_months_wrap_and_errors(spark):
    assert row(spark, ids.month_in_range(F.lit(1), F.lit(11), F.lit(2)))[0] and not row(spark, ids.month_in_range(F.lit(5), F.lit(11), F.lit(2)))[0]
    with pytest.raises(Exception, match="1..12"):
        row(spark, ids.month_in_range(F.lit(13), F.lit(1), F.lit(2)))


def test_period_and_names(spark):
    p = row(spark, ids.reference_period(F.lit("a_shoreline_2020-01_2019-2021_11-02.geojson")).alias("p")).p
    assert tuple(p) == (2019, 2021, 11, 2)
    assert row(spark, ids.reference_period(F.lit("a_shoreline.geojson")))[0] is None
    assert row(spark, ids.name_valid(F.lit("20221115x204452y79")))[0] and not row(spark, ids.name_valid(F.lit("2022111_2044520_79")))[0]
    assert row(spark, ids.epsg_of(F.lit("urn:ogc:def:crs:EPSG::32604")))[0] == 32604


def test_pixels_and_world_are_inverse(spark):
    g = F.struct(*[F.lit(v).alias(k) for k, v in {"xtr": 10.0, "xscale": 3.0, "xshear": 0.5, "ytr": 99.0, "yshear": -0.25, "yscale": -3.0}.items()])
    df = spark.range(50).select((F.col("id") % 7).alias("r"), (F.col("id") * 1.5).alias("c")).withColumn("p", geo.pix2world(F.col("r"), F.col("c"), g)).withColumn("q", geo.world2pix(F.col("p.x"), F.col("p.y"), g))
    assert one(df.agg(F.max(F.abs(F.col("q.r") - F.col("r")) + F.abs(F.col("q.c") - F.col("c"))))) < 1e-9


def test_utm_round_trip_and_known_point(spark):
    df = spark.range(100).select((-161.5 + F.col("id") * 0.05).alias("lon"), (15 + F.col("id") * 0.2).alias("lat")).withColumn("p", geo.lonlat_to_utm(F.col("lon"), F.col("lat"), 32604)).withColumn("q", geo.utm_to_lonlat(F.col("p.x"), F.col("p.y"), 32604))
    assert one(df.agg(F.max(F.abs(F.col("q.lon") - F.col("lon")) + F.abs(F.col("q.lat") - F.col("lat"))))) < 1e-7
    p = row(spark, geo.lonlat_to_utm(F.lit(-159.0), F.lit(0.0), 32604).alias("p")).p
    assert abs(p.x - 500000) < 1e-6 and abs(p.y) < 1e-6


def test_point_along_both_modes(spark):
    args = (F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(-10.0), F.lit(0.0))
    assert row(spark, geo.point_along(*args).alias("p")).p.x == 5 and row(spark, geo.point_along(*args, compat=False).alias("p")).p.x == -5


# --- vector


def transects(spark):
    return spark.createDataFrame([("a", 0.0, 0.0, 100.0, 0.0), ("w", 0.0, 0.0, -100.0, -1.0)], "name string, x0 double, y0 double, x1 double, y1 double")


def test_transect_median_and_missing(spark, monkeypatch):
    v = spark.createDataFrame([("i", k, x, y) for k, (x, y) in enumerate([(50.0, 0.0), (60.0, 10.0), (80.0, -20.0), (70.0, 36.0), (-50.0, 0.5)])] + [("j", 0, 2000.0, 0.0)], "image_id string, seq int, x double, y double")
    want = {("i", "a"): 60.0, ("i", "w"): None, ("j", "a"): None, ("j", "w"): None}

    def got(**how):
        return {(r.image_id, r["name"]): r.dist for r in vector.transect_intersect(v, transects(spark), **how).collect()}

    assert got() == want  # phi of w is close to -pi, that of the vertex close to pi
    assert abs(got(compat=False)["i", "w"] - 50) < 0.1
    monkeypatch.setattr(vector, "BROADCAST_TRANSECTS", 1)
    assert got() == want


def test_translation_invariance(spark):
    v = spark.range(300).select(F.lit("i").alias("image_id"), F.col("id").alias("seq"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 41 - 20).cast("double").alias("y"))
    t = transects(spark)
    moved = vector.transect_intersect(v.withColumns({"x": F.col("x") + 3000, "y": F.col("y") - 700}), t.select("name", *[(F.col(c) + d).alias(c) for c, d in (("x0", 3000), ("y0", -700), ("x1", 3000), ("y1", -700))]))
    a = {r["name"]: r.dist for r in vector.transect_intersect(v, t).collect()}
    b = {r["name"]: r.dist for r in moved.collect()}
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-6) for k in a)


def test_crop_window(spark):
    v = spark.createDataFrame([("i", 0, 5.5, 5.0), ("i", 1, 1.5, 5.0), ("i", 2, 8.0, 8.0), ("i", 3, 5.0, 9.5)], "image_id string, seq int, r double, c double")
    m = spark.createDataFrame([("i", r, c, (r, c) == (7, 6)) for r in range(10) for c in range(10)], "image_id string, r int, c int, masked boolean")
    size = spark.createDataFrame([("i", 10, 10)], "image_id string, h int, w int")
    assert sorted(r.seq for r in vector.crop_by_mask(v, m, size).collect()) == [3]
    m2 = m.withColumn("masked", F.lit(False))
    assert sorted(r.seq for r in vector.crop_by_mask(v, m2, size).collect()) == [0, 2, 3]


# --- series


def test_interpolation_over_empty_days(spark):
    g = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), 0.0), ("s", dt.datetime(2024, 1, 11), 10.0), ("z", dt.datetime(2024, 1, 1), 5.0)], "series string, ts timestamp_ntz, sl double")
    o = spark.createDataFrame([("s", dt.datetime(2024, 1, d), d) for d in (1, 4, 11, 12)] + [("z", dt.datetime(2023, 12, 31), 0), ("none", dt.datetime(2024, 1, 1), 9)], "series string, ts timestamp_ntz, k int")
    got = {(r.series, r.k): r.sl for r in series.interpolate(o, g).collect()}
    assert got == {("s", 1): 0.0, ("s", 4): 3.0, ("s", 11): 10.0, ("s", 12): None, ("z", 0): None, ("none", 9): None}


def test_against_numpy_interp(spark):
    rng = np.random.default_rng(1)
    t0 = dt.datetime(2024, 1, 1)
    gt, ot = np.sort(rng.choice(10**6, 300, False)), rng.choice(10**6, 200, False)
    gv = rng.random(300)
    g = spark.createDataFrame([("s", t0 + dt.timedelta(seconds=int(t)), float(v)) for t, v in zip(gt, gv)], "series string, ts timestamp_ntz, sl double")
    o = spark.createDataFrame([("s", t0 + dt.timedelta(seconds=int(t)), int(t)) for t in ot], "series string, ts timestamp_ntz, k long")
    for r in series.interpolate(o, g).collect():
        if gt[0] <= r.k <= gt[-1]:
            assert abs(r.sl - np.interp(r.k, gt, gv)) < 1e-9
        else:
            assert r.sl is None


def test_matrix_and_correction(spark):
    o = spark.createDataFrame([(dt.datetime(2024, 1, 1), "b", "x", 2.0), (dt.datetime(2024, 1, 1), "a", "x", None), (dt.datetime(2024, 1, 1), "c", "y", 1.0), (dt.datetime(2024, 1, 2), "d", "x", None)], "ts timestamp_ntz, image_id string, transect string, dist double")
    m = series.matrix(o, ["x", "y"]).collect()
    assert len(m) == 1 and (m[0].x, m[0].y) == (2.0, 1.0)
    g = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), 0.6)], "series string, ts timestamp_ntz, sl double")
    c = {(r.image_id, r.transect): (r.dist, r.tide_status) for r in series.tide_correct(o.withColumn("series", F.lit("s")), g).collect()}
    assert abs(c["b", "x"][0] - 7.0) < 1e-9 and c["b", "x"][1] == "corrected" and c["d", "x"] == (None, "uncorrected")


def test_qaqc_modes(spark):
    o = spark.createDataFrame([(k, n, float(v)) for n in "ab" for k, v in enumerate([0, 1, 2, 100])], "ts int, transect string, dist double")
    for compat, lost in ((True, 1), (False, 2)):
        assert series.qaqc(o, 30, compat).where("dist IS NULL").count() == lost


def test_tide_range_has_its_end(spark):
    t = dt.datetime(2024, 1, 1)
    bounds = spark.createDataFrame([("a", t, t + dt.timedelta(hours=2)), ("b", t, t + dt.timedelta(minutes=29)), ("c", t, t - dt.timedelta(1)), ("d", None, t)], "site string, start timestamp_ntz, stop timestamp_ntz")
    got = [tuple(r) for r in series.tide_range(bounds, "30 MINUTES").orderBy("site", "ts").collect()]
    assert got == [("a", t + dt.timedelta(minutes=30 * k)) for k in range(5)] + [("b", t)]


# --- catalogue


def test_chunks(spark):
    df = spark.createDataFrame([("one", "x")] + [("many", f"{i:04}") for i in range(1001)], "site string, id string")
    n = {(r.site, r.chunk): r["count"] for r in catalog.order_chunks(df).groupBy("site", "chunk").count().collect()}
    assert n == {("many", 0): 334, ("many", 1): 334, ("many", 2): 333}
    assert catalog.order_chunks(df, compat=False).where("site = 'one'").count() == 1


def test_windows_share_borders(spark):
    df = spark.createDataFrame([("s", dt.datetime(2020, 1, 1), dt.datetime(2021, 6, 1)), ("t", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2))], "site string, start timestamp_ntz, stop timestamp_ntz")
    got = sorted((r.site, r.n, r.win_start, r.win_stop) for r in catalog.date_windows(df).collect())
    assert [g[0] for g in got] == ["s", "s", "s", "t"] and got[0][3] == got[1][2] and got[2][3] == dt.datetime(2021, 6, 1)


class Client(catalog.OrderClient):
    def __init__(self):
        self.calls = 0

    def place(self, request):
        self.calls += 1
        if self.calls == 1:
            raise OSError
        return json.loads(request)["name"]


def test_orders_are_tried_again(spark):
    chunks = spark.createDataFrame([("s", f"id{i}", i % 2) for i in range(4)], "site string, id string, chunk long")
    out = catalog.place_all(spark, catalog.order_requests(chunks, [(0, 0), (1, 0), (1, 1)]), c := Client())
    assert sorted(r.order_id for r in out.collect()) == ["s_0", "s_1"] and c.calls == 3


class Service(catalog.OrderClient):
    """An order is its site and chunk; ids that end with 3 can't be had, chunk 1 fails."""

    def __init__(self):
        self.asked, self.fetched = {}, []

    def place(self, request):
        body = json.loads(request)
        bad = catalog.refused_ids("".join(f'{{"message":"No access to assets: PSScene/{i}/ortho"}}' for p in body["products"] for i in p["item_ids"] if i.endswith("3")))
        if bad:
            raise catalog.NoAccess(bad)
        return body["name"]

    def state(self, order_id):
        self.asked[order_id] = n = self.asked.get(order_id, 0) + 1
        return "running" if n < 3 else "failed" if order_id.endswith("_1") else "success"

    def results(self, order_id):
        return {f"x/{order_id}.tif": "a", f"x/{order_id}_metadata.json": "b", "x/readme.txt": "c"}

    def fetch(self, location):
        self.fetched.append(location)
        return location.encode()


def test_orders_from_request_to_files(spark, tmp_path):
    rows = [("s", "id0", 0), ("s", "id3", 0), ("s", "id1", 1), ("t", "id3", 0), ("t", "id13", 0)]
    requests = catalog.order_requests(spark.createDataFrame(rows, "site string, id string, chunk long"), [(0, 0), (1, 0), (1, 1)])
    for turn in range(2):
        out = catalog.run_orders(spark, requests, c := Service(), str(tmp_path), wait=0.0)
        assert sorted((r.site, r.chunk, r.order_id, r.state, r.n_files) for r in out.collect()) == [("s", 0, "s_0", "success", 2), ("s", 1, "s_1", "failed", 0), ("t", 0, None, None, 0)]
        assert c.asked == {"s_0": 3, "s_1": 3} and sorted(c.fetched) == ([] if turn else ["a", "b"])
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["s_0.tif", "s_0_metadata.json"]


def test_order_still_running():
    assert catalog.await_order(c := Service(), "s_0", 0.0, most=2) == "running" and c.asked == {"s_0": 2}


def test_upsert(spark):
    a, b = (spark.createDataFrame(x, "site string, v int") for x in ([("p", 1), ("q", 1)], [("q", 2), ("r", 2)]))
    assert {r.site: r.v for r in catalog.upsert_sites(a, b).collect()} == {"p": 1, "q": 2, "r": 2}


# --- rasters and models


def grid(spark, a, name="v", image="i"):
    return spark.createDataFrame([(image, r, c, None if a[r, c] is None or a[r, c] != a[r, c] else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], f"image_id string, r int, c int, {name} double")


@pytest.mark.parametrize("tile", [3, 256])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_std_against_numpy(spark, radius, tile):
    a = np.random.default_rng(radius).random((9, 7)) * 100
    a[4, 4] = np.nan
    p = np.pad(a, radius, mode="reflect")
    for r in raster.image_std(grid(spark, a), ["v"], radius, tile=tile).collect():
        if (r.r, r.c) == (4, 4):
            assert r.std_v is None
        else:
            w = p[r.r : r.r + 2 * radius + 1, r.c : r.c + 2 * radius + 1]
            assert abs(r.std_v - np.nanstd(w)) < 1e-9


def test_wrapped_and_signed_indices(spark):
    assert abs(row(spark, raster.ndi(F.lit(100), F.lit(300)))[0] - 65336 / 400) < 1e-9 and row(spark, raster.ndi(F.lit(100), F.lit(300), "signed"))[0] == -0.5
    assert row(spark, raster.ndi(F.lit(0), F.lit(0)))[0] == 0.0


def test_feature_swap(spark):
    px = spark.range(36).select(F.lit("i").alias("image_id"), (F.col("id") / 6).cast("int").alias("r"), (F.col("id") % 6).cast("int").alias("c"), (F.col("id") * 3 % 17).cast("int").alias("b"), F.lit(5).alias("g"), F.lit(7).alias("red"), F.lit(9).alias("nir"))
    assert one(raster.features18(px).agg(F.max("f_stdR"))) > 0 and one(raster.features18(px, compat=False).agg(F.max("f_stdR"))) == 0


def test_buffer_grows_with_radius(spark):
    p = spark.createDataFrame([("a", 10.0, 10.0), ("a", 0.0, 5.0), ("a", 99.0, 1.0)], "line string, r double, c double")
    size = spark.createDataFrame([("a", 20, 20)], "line string, h int, w int")
    small, large = ({(r.r, r.c) for r in raster.buffer(p, size, k).collect()} for k in (2, 4))
    assert small < large and len(small) == 13


def test_classifiers(spark):
    df = spark.createDataFrame([(1.0, None, False), (-1.0, 2.0, True)], "a double, b double, m boolean")
    cls = ml.classify(df, lambda v: F.when(ml.linear_score(v, [1.0, 1.0]) > 0.5, 1).otherwise(0), ["a", "b"])
    assert [r.cls for r in cls.collect()] == [1, 1]
    assert [r.cls for r in ml.classify(df, lambda v: F.lit(1), ["a", "b"], F.col("m")).collect()] == [1, None]
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    train = spark.createDataFrame([(float(i), float(i % 3), int(i > 5)) for i in range(12)], "a double, b double, label int")
    model = LogisticRegression(featuresCol="_features").fit(VectorAssembler(inputCols=["a", "b"], outputCol="_features").transform(train))
    assert {r.cls for r in ml.classify(train, model, ["a", "b"]).collect()} == {0, 1}


def test_metrics_and_training_set(spark):
    pairs = spark.createDataFrame([(True, True), (True, False), (False, False)], "truth boolean, pred boolean")
    a, b = ml.dice(pairs).first().dice, ml.dice(pairs.select(F.col("pred").alias("truth"), F.col("truth").alias("pred"))).first().dice
    assert a == b == 2 / 3
    assert ml.prf1(pairs.where("NOT truth")).first().precision is None
    frame = spark.createDataFrame([("s", "f1", "water", 1.0), ("s", "f2", "land", 3.0), ("t", "f3", "land", None)], "sitename string, filename string, class string, x double")
    got = ml.training_set(frame, ["x"], scale=True).orderBy("filename").collect()
    assert [(r.code, r.x) for r in got] == [(1, -1.0), (0, 1.0)]
    assert ml.training_set(frame, ["x"], not_file="f1").count() == 1
    assert {r.column: r.subset for r in ml.is_subset(frame.select("x"), frame.select("x", "class")).collect()} == {"x": True}
    with pytest.raises(KeyError):
        ml.is_subset(frame.select("x"), frame.select("class"))


# --- sources, sinks, plans


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32"])
def test_tiff_round_trip(dtype):
    a = (np.arange(5 * 7 * 4).reshape(5, 7, 4) % 250).astype(dtype)
    b, georef, epsg = geotiff.decode(geotiff.encode(a, (10.0, 3.0, 0.0, 20.0, 0.0, -3.0), 32604))
    assert (a == b).all() and georef == (10.0, 3.0, 0.0, 20.0, 0.0, -3.0) and epsg == 32604
    assert geotiff.decode(geotiff.encode(a, (1.0, 3.0, 0.5, 2.0, 0.25, -3.0)))[1] == (1.0, 3.0, 0.5, 2.0, 0.25, -3.0)


def test_lzw_and_packbits():
    codes, bits, n = [256, 65, 66, 258, 260, 257], 0, 0
    for c in codes:
        bits, n = (bits << 9) | c, n + 9
    bits <<= -n % 8
    assert geotiff._lzw(bits.to_bytes((n + 7) // 8, "big")) == b"ABABABA"
    assert geotiff._packbits(bytes([2, 1, 2, 3, 254, 7, 128, 0, 9])) == bytes([1, 2, 3, 7, 7, 7, 9])


def test_rasters_to_pixels(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 9000, (6, 5, 4)).astype(np.uint16)
    (tmp_path / "20240101_000000_11_aa_3B_AnalyticMS_toar_clip.tif").write_bytes(geotiff.encode(a, (0.0, 3.0, 0.0, 0.0, 0.0, -3.0), 32604))
    (tmp_path / "bad_3B_AnalyticMS_toar_clip.tif").write_bytes(b"no tiff")
    r = geotiff.read_rasters(spark, str(tmp_path))
    assert r.count() == 2 and r.where("bands IS NULL").count() == 1
    px = geotiff.pixels_of(r, ["b", "g", "red", "nir"]).collect()
    assert len(px) == 30 and all((p.b, p.nir) == (a[p.r, p.c, 0], a[p.r, p.c, 3]) for p in px)
    m = np.zeros((2, 2, 8), np.uint8)
    m[0, 1, 7] = 2
    (tmp_path / "x_3B_udm2_clip.tif").write_bytes(geotiff.encode(m))
    assert [(q.r, q.c) for q in geotiff.masks_of(geotiff.read_rasters(spark, str(tmp_path), "_3B_udm2_clip.tif")).where("masked").collect()] == [(0, 1)]
    out = geotiff.encoded(spark.createDataFrame([("i", 0, 0, 1), ("i", 1, 1, 1)], "image_id string, r int, c int, cls int")).first()
    assert geotiff.decode(bytes(out.tif))[0][:, :, 0].tolist() == [[1, 0], [0, 1]]


def feature(kind, coordinates, **props):
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coordinates}}


def collection(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "name": "t", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32604"}}, "features": features}, indent=1))
    return str(path)


def test_geojson(spark, tmp_path):
    p = collection(tmp_path / "t.geojson", [feature("LineString", [[0, 1], [2, 3]], name="n0", id="i0"), feature("MultiLineString", [[[4, 5], [6, 7]]], name="n1", id="i1")])
    got = geojson.read_transects(spark, p).orderBy("ord").collect()
    assert [(r["name"], r.x0, r.y1) for r in got] == [("n0", 0, 3), ("i1", 4, 7)]
    with pytest.raises(Exception, match="not a transect"):
        geojson.read_transects(spark, collection(tmp_path / "u.geojson", [feature("Point", [0, 1])])).collect()
    line = geojson.read_reference_line(spark, collection(tmp_path / "r.geojson", [feature("MultiLineString", [[[0, 1], [2, 3], [4, 5]]])]))
    assert [(r.seq, r.x) for r in line.orderBy("seq").collect()] == [(0, 0), (1, 2), (2, 4)]
    v = spark.createDataFrame([("20240101_000000_1", k, float(k), 0.0) for k in range(3)], "image_id string, seq int, x double, y double")
    out = json.loads(geojson.line_features(v, 32604).first().geojson)
    assert out["features"][0]["geometry"]["coordinates"] == [[0, 0], [1, 0], [2, 0]]
    meta = spark.createDataFrame([("20240101_000000_77_a", dt.datetime(2024, 1, 1), "s", 0.1), ("20240101_000000_88_b", dt.datetime(2024, 1, 1), "s", 0.2)], "image_id string, ts timestamp_ntz, satname string, cloud_cover double")
    both = geojson.site_features(v.withColumn("site", F.lit("k")), meta).first()
    assert both.n == 1 and json.loads(both.geojson)["features"][0]["properties"]["cloud_cover"] == 0.1


def write_metadata(folder, name, body):
    (folder / f"{name}_metadata.json").write_text(body)


def test_metadata_and_listing(spark, tmp_path):
    write_metadata(tmp_path, "20240101_000000_1_a", '{"id": "a",\n "properties": {"pixel_resolution": 3.1, "cloud_cover": 0.2}}')
    write_metadata(tmp_path, "20240102_000000_1_b", "{broken")
    got = {r.image_id: (r.pixel_resolution, r.cloud_cover) for r in metadata.read_metadata(spark, str(tmp_path)).collect()}
    assert got == {"20240101_000000_1_a": (3.1, 0.2), "20240102_000000_1_b": (3.0, None)}
    assert metadata.list_scenes(spark, str(tmp_path)).count() == 2
    assert metadata.list_files(spark, str(tmp_path), ["20240102", "json"]).count() == 1


def test_gauge_cache_and_merge(spark, tmp_path):
    (tmp_path / "g.csv").write_text("time,sl\n2024-01-01 00:00:00,0.5\n2024-01-01 01:00:00,\n")
    g = metadata.read_gauge(spark, str(tmp_path / "g.csv")).orderBy("ts").collect()
    assert [r.sl for r in g] == [0.5, None] and g[0].ts == dt.datetime(2024, 1, 1)
    built = []
    for _ in range(2):
        assert metadata.cached(spark, str(tmp_path / "c"), lambda: built.append(1) or spark.range(3)).count() == 3
    assert built == [1]
    m = row(spark, metadata.merged_json(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))))[0]
    assert m == {"a": "1", "b": "2"}


def test_stream_of_scenes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_metadata(folder, "20240101_000000_1_a", '{"id": "a", "properties": {"cloud_cover": 0.2}}')
    seen = []
    for k in range(2):
        scenes.run_site(scenes.new_scenes(spark, str(folder)), lambda df, i: seen.extend(r.image_id for r in df.collect()), str(tmp_path / "ck")).awaitTermination(120)
        write_metadata(folder, "20240102_000000_1_b", '{"id": "b", "properties": {"cloud_cover": 0.1}}')
    assert seen == ["20240101_000000_1_a", "20240102_000000_1_b"]


def scene_pixels(spark):
    """Land on the left of a straight coast, one more column of it in each image."""
    rows = []
    for k, name in enumerate(["20240101_000000_10_a", "20240102_000000_10_b", "20240103_000000_10_c"]):
        for r in range(40):
            for c in range(60):
                water = c >= 30 + k
                rows.append((name, r, c, 900 if water else 400, 800 if water else 500, 300 if water else 900, 100 if water else 2000, k == 2))
    return spark.createDataFrame(rows, "image_id string, r int, c int, b int, g int, red int, nir int, masked boolean")


def test_whole_site(spark):
    s = site.Settings(georef=(0.0, 3.0, 0.0, 120.0, 0.0, -3.0), least_land=10, least_water=10, erosion=False, dilation=False, max_dist_from_ref=30.0, reference=[(90.0, 117.0), (90.0, 3.0)])
    t = spark.createDataFrame([("t0", 0.0, 60.0, 170.0, 60.0)], "name string, x0 double, y0 double, x1 double, y1 double")
    g = spark.createDataFrame([("gauge", dt.datetime(2024, 1, 1), 0.12), ("gauge", dt.datetime(2024, 1, 4), 0.12)], "series string, ts timestamp_ntz, sl double")
    out = site.site(scene_pixels(spark), lambda v: F.when(F.element_at(v, 4) < 1000, 1).otherwise(0), t, s, g)
    obs = {str(r.ts)[:10]: r.dist for r in out["observations"].collect()}
    assert abs(obs["2024-01-01"] - 88.5) < 0.6 and abs(obs["2024-01-02"] - 91.5) < 0.6 and "2024-01-03" not in obs
    assert all(abs(r.dist - obs[str(r.ts)[:10]] - 1.0) < 1e-9 for r in out["corrected"].collect())
    assert out["filtered"].count() == 2
    e = site.evaluate(out["shorelines"], out["shorelines"], t, s).collect()
    assert all(r.error == 0 for r in e)


def test_pad_never_crops(spark):
    pixels = spark.createDataFrame([("a", r, c, 7) for r in range(9) for c in (0, 4)] + [("b", 0, 0, 5)], "image_id string, r int, c int, b int")
    got = raster.pad(pixels, ["b"], 3, 2, 6, 8).collect()
    cells = {(x.image_id, x.r, x.c): x.b for x in got}
    assert len(got) == len(cells) == 12 * 8 + 6 * 8
    assert {k for k, v in cells.items() if v} == {("a", r + 3, c + 2) for r in range(9) for c in (0, 4)} | {("b", 3, 2)}


def test_crossing_against_plain_search(spark):
    """Long segments, vertices far along the line but near the crossing, transects that only meet behind their origins, crossing ones."""
    import math
    import random

    from tidemark.operators import vector

    rng = random.Random(6)
    transects = [(f"t{i}", x, y, x + rng.uniform(-300, 300), y + rng.uniform(-300, 300)) for i in range(40) for x, y in [(rng.uniform(0, 2500), rng.uniform(0, 2500))]]
    transects += [("v1", 3000.0, 0.0, 3000.0, 500.0), ("v2", 3010.0, -5.0, 2990.0, -15.0), ("p", 0.0, 9000.0, 900.0, 9000.0)]  # v2 runs behind v1's origin
    rows = []
    for image in ("a", "b"):
        line = [(rng.uniform(0, 2500), rng.uniform(0, 2500))]
        for _ in range(60):
            line.append((line[-1][0] + rng.uniform(-220, 220), line[-1][1] + rng.uniform(-220, 220)))
        rows += [(image, k, x, y) for k, (x, y) in enumerate(line)]
    rows += [("b", 61, 450.0, 8000.0), ("b", 62, 450.0, 9900.0), ("b", 63, 470.0, 9010.0)]  # crosses p far from both ends, near a later vertex
    vertices = spark.createDataFrame(rows, "image_id string, seq int, x double, y double")

    def cross(ax, ay, bx, by, cx, cy, dx, dy):
        den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        if den == 0:
            return None
        t, s = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
        return t if 0 <= t <= 1 and 0 <= s <= 1 else None

    want = {}
    for name, x0, y0, x1, y1 in transects:
        bad = any(o[0] != name and cross(x0, y0, x1, y1, *o[1:]) is not None for o in transects)
        n = math.hypot(x1 - x0, y1 - y0)
        ex, ey = x0 - 20 * (x1 - x0) / n, y0 - 20 * (y1 - y0) / n
        for image in ("a", "b"):
            line = [(x, y) for i, _, x, y in rows if i == image]
            at = [t for p, q in zip(line, line[1:]) if (t := cross(ex, ey, x1, y1, *p, *q)) is not None]
            spots = [(ex + t * (x1 - ex), ey + t * (y1 - ey)) for t in at]
            near = min((math.hypot(px - x, py - y) for px, py in spots for x, y in line), default=math.inf)
            want[image, name] = None if bad or near > 35 else min(at) * (n + 20) - 20
    got = {(r.image_id, r.name): r.dist for r in vector.transect_crossing(vertices, spark.createDataFrame(transects, "name string, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert got.keys() == want.keys() and want["b", "p"] is not None and any(v is not None for k, v in want.items() if k[1] != "p")
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-6), k


def test_a_day_of_seconds_is_interpolated_quickly(spark):
    import time

    from tidemark.operators import series

    gauge = spark.range(86_400).selectExpr("'h' AS series", "CAST(timestamp_seconds(1704067200 + id) AS TIMESTAMP_NTZ) AS ts", "CAST(id AS DOUBLE) AS sl")
    obs = spark.range(500).selectExpr("'h' AS series", "CAST(timestamp_millis(1704067200000 + id * 150000 + 500) AS TIMESTAMP_NTZ) AS ts", "id")
    began = time.perf_counter()
    got = {r.id: r.sl for r in series.interpolate(obs, gauge).collect()}
    assert time.perf_counter() - began < 60
    assert all(abs(got[i] - (i * 150 + 0.5)) < 1e-6 for i in range(500))


def test_small_regions_against_the_array_version(spark):
    import plain_site as kernels
    from tidemark.operators import raster

    rng = np.random.default_rng(4)
    images = {name: rng.random((30, 40)) < share for name, share in (("a", 0.55), ("b", 0.2), ("c", 1.0))}
    rows = [(n, r, c, int(m[r, c])) for n, m in images.items() for r in range(30) for c in range(40)]
    df = spark.createDataFrame(rows, "image_id string, r int, c int, cls int")
    for erosion in (False, True):
        got = {n: np.zeros((30, 40), bool) for n in images}
        for x in raster.clean(df, 9, 12, erosion, erosion).collect():
            got[x.image_id][x.r, x.c] = x.cls == 1
        for n, m in images.items():
            assert (got[n] == kernels.clean_classes(m, 9, 12, erosion, erosion)).all()
    assert raster.clean(df.limit(0)).count() == 0


def test_images_masks_shifts_and_status(spark, tmp_path):
    from tidemark.operators import raster
    from tidemark.plans import site

    pixels = spark.createDataFrame([(i, r, c, r * 3 + c) for i in ("x", "y") for r in range(2) for c in range(3)], "image_id string, r int, c int, b int")
    masks = spark.createDataFrame([("x", 0, 1, True), ("x", 1, 1, False)], "image_id string, r int, c int, masked boolean")
    both = raster.with_masks(pixels, masks, ["b"])
    assert {(p.image_id, p.r, p.c) for p in both.where("masked").collect()} == {("x", 0, 1), ("y", 0, 0)}  # y has no mask: its zero pixel
    assert raster.with_masks(pixels, masks).where("masked").count() == 1
    moved = raster.apply_shift(both, spark.createDataFrame([("x", 1, -1)], "image_id string, dr int, dc int"), ["b"])
    got = {(p.r, p.c): (p.b, p.masked) for p in moved.where("image_id = 'x'").collect()}
    assert got == {(0, 0): (0, True), (0, 1): (0, True), (0, 2): (0, True), (1, 0): (1, True), (1, 1): (2, False), (1, 2): (0, True)}
    assert moved.where("image_id = 'y'").count() == 6
    done = spark.createDataFrame([("x", 1), ("y", 2)], "image_id string, level int")
    site.write_status(done, f"{tmp_path}/status")
    site.write_status(done.where("image_id = 'y'"), f"{tmp_path}/status")
    status = spark.read.parquet(f"{tmp_path}/status")
    assert [r.image_id for r in site.failed_images(status).collect()] == ["x"]
    assert site.still_to_do(pixels.select("image_id").distinct(), status).count() == 0
    site.write_wide(spark.createDataFrame([("2024-01-01", 1.5, None)], "ts string, t0 double, t1 double"), f"{tmp_path}/wide")
    assert spark.read.option("header", True).csv(f"{tmp_path}/wide").first().asDict() == {"ts": "2024-01-01", "t0": "1.5", "t1": None}
    s = site.Settings((0.0, 3.0, 0.0, 0.0, 0.0, -3.0))
    assert (s.erosion, s.dilation, s.buffer_radius) == (True, True, 34)
    assert s.overridden({"max_dist_from_sl_ref": 50, "pixel_size": 4.0, "minBeachArea": 7, "beach_type": "x"}).buffer_radius == 13


@pytest.mark.parametrize("diagonal", [False, True])
def test_flood_fill(spark, diagonal):
    a = np.random.default_rng(5).integers(0, 10, (12, 15)).astype(float)
    a[0, 0] = np.nan
    seeds = [(2, 3), (11, 14), (0, 0), (40, 1)]
    out = {}
    for r in regions.flood_fill(grid(spark, a), spark.createDataFrame([("i", *s) for s in seeds], "image_id string, r int, c int"), "v", 3.0, diagonal).collect():
        out.setdefault((r.seed_r, r.seed_c), []).append((r.r, r.c))
    for s in seeds[:2]:
        seen, todo = {s}, [s]
        while todo:
            r, c = todo.pop()
            for i, j in itertools.product((-1, 0, 1), repeat=2):
                q = (r + i, c + j)
                if (diagonal or not i * j) and q not in seen and 0 <= q[0] < 12 and 0 <= q[1] < 15 and abs(a[q] - a[s]) <= 3:
                    seen.add(q)
                    todo.append(q)
        assert sorted(out[s]) == sorted(seen)
    assert set(out) == set(seeds[:2])


def test_reprojection(spark):
    df = spark.createDataFrame([(-157.8, 21.3), (-159.5, 22.0)], "x double, y double")
    m = geo.reproject(F.col("x"), F.col("y"), 4326, 3857)
    u = geo.reproject(m.x, m.y, 3857, 32604)
    back = geo.reproject(u.x, u.y, 32604, 4326)
    for r in df.select("x", "y", m.alias("m"), back.alias("b")).collect():
        assert r.m.x == pytest.approx(r.x * 111319.49079327358, abs=1e-3)
        assert (r.b.x, r.b.y) == pytest.approx((r.x, r.y), abs=1e-8)
    for pair in ((4326, 2193), (32661, 4326)):
        with pytest.raises(ValueError):
            geo.reproject(F.col("x"), F.col("y"), *pair)


def test_regions_over_tile_borders(spark):
    rng = np.random.default_rng(12)
    images = {"a": rng.random((31, 40)) < 0.59, "b": rng.random((9, 64)) < 0.5, "c": np.ones((20, 20), bool)}
    rows = [(n, r, c, int(m[r, c])) for n, m in images.items() for r in range(m.shape[0]) for c in range(m.shape[1])]
    df = spark.createDataFrame(rows, "image_id string, r int, c int, cls int")
    for diagonal in (False, True):
        labels = []
        for tile in (1000, 8, 3):
            got = {}
            for x in regions.regions(df, diagonal, tile).collect():
                for c in range(x.c0, x.c1 + 1):
                    got[x.image_id, x.r, c] = (x.region, x["size"])
            assert len(got) == len(rows)
            names = {}
            labels.append([(names.setdefault(got[q[:3]][0], q[:3]), got[q[:3]][1]) for q in rows])
        assert labels[0] == labels[1] == labels[2]
