"""Scene catalogue: search, exclusions, windows of dates, chunks of orders."""

from __future__ import annotations

import json
import os
import re
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.ids import contains_any, month_in_range, reference_period

#: Ids that mark test satellites.
TEST_SATELLITES = ("0f02", "0f06", "0f4c", "1055")
MOST_IDS, MOST_DAYS, MOST_CLOUD = 500, 200, 0.3


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test of a point against a closed ring of literal points."""
    inside = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if ay != by:
            over = (F.lit(ay) > y) != (F.lit(by) > y)
            inside = inside + F.when(over & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax), 1).otherwise(0)
    return inside % 2 == 1


def closed(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def search(scenes: DataFrame, ring: list[tuple[float, float]], start: str, stop: str, most_cloud: float = MOST_CLOUD) -> DataFrame:
    """scenes (id, acquired, cloud_cover, x, y) in the ring, from start to stop, with little cloud. The bounding box comes first so that it
    can be pushed to the scan."""
    ring = closed(ring)
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))
    when = (F.col("acquired") >= F.lit(start).cast("timestamp_ntz")) & (F.col("acquired") <= F.lit(stop).cast("timestamp_ntz"))
    return scenes.where(when & (F.col("cloud_cover") <= most_cloud) & box & in_ring(F.col("x"), F.col("y"), ring))


def exclude_test_satellites(scenes: DataFrame) -> DataFrame:
    return scenes.where(~contains_any(F.col("id"), list(TEST_SATELLITES)))


def not_downloaded(scenes: DataFrame, have: DataFrame) -> DataFrame:
    return scenes.join(have.select("id"), "id", "left_anti")


def date_windows(spans: DataFrame, most: int = MOST_DAYS) -> DataFrame:
    """spans (site, start, stop) cut into windows of at most `most` whole days that share their borders: (site, n, start, stop)."""
    days = F.floor((F.unix_timestamp(F.col("stop").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))) / 86400)
    count = F.greatest(F.ceil(days / most), F.lit(1)).cast("int")
    cut = spans.withColumn("n", F.explode(F.sequence(F.lit(0), count - 1)))

    def at(i: Column) -> Column:
        return F.least(F.col("start") + F.make_dt_interval(i * most), F.col("stop"))

    last = F.when(F.col("n") == count - 1, F.col("stop")).otherwise(at(F.col("n") + 1))
    return cut.select("site", F.col("n").cast("bigint").alias("n"), at(F.col("n")).alias("win_start"), last.alias("win_stop"))


def order_chunks(scenes: DataFrame, key: str = "site", most: int = MOST_IDS, compat: bool = True) -> DataFrame:
    """(key, id, chunk): each site's ids in order, in ceil(n / most) groups of equal size. compat: a site with a single id is never
    ordered."""
    n = F.count("*").over(W.partitionBy(key))
    groups = F.ceil(n / most)
    size = F.ceil(n / groups)
    place = F.row_number().over(W.partitionBy(key).orderBy("id")) - 1
    out = scenes.select(key, "id", n.alias("_n"), F.floor(place / size).cast("bigint").alias("chunk"))
    return out.where(F.col("_n") > (1 if compat else 0)).drop("_n")


def order_requests(chunks: DataFrame, ring: list[tuple[float, float]], item_type: str = "PSScene", bundle: str = "analytic_8b_udm2,analytic_udm2", key: str = "site") -> DataFrame:
    """(key, chunk, n_ids, request): the JSON body of each order, with a clip and a scaling to surface units of 10000."""
    points = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in closed(ring)])
    product = F.struct(F.sort_array(F.collect_list("id")).alias("item_ids"), F.lit(item_type).alias("item_type"), F.lit(bundle).alias("product_bundle"))
    grouped = chunks.groupBy(key, "chunk").agg(F.count("*").alias("n_ids"), product.alias("_p"))
    clip = F.struct(F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")).alias("aoi")).alias("clip"))
    scale = F.struct(F.struct(F.lit(10000).alias("scale_factor")).alias("toar"))
    body = F.struct(F.concat_ws("_", F.col(key), F.col("chunk").cast("string")).alias("name"), F.array(F.col("_p")).alias("products"), F.array(F.to_json(clip), F.to_json(scale)).alias("tools"))
    return grouped.select(key, "chunk", "n_ids", F.to_json(body).alias("request"))


#: Reference lines that are looked up as one array of the plan; more meet the scenes in a join.
FEW_REFERENCES = 1_000


def reference_for(scenes: DataFrame, references: DataFrame) -> DataFrame:
    """scenes (id, ts) with file: the reference line whose years and months hold the scene's, the first by name; else the default (a
    file without a period), else null. A row a scene, repeated ones included.

    References are counted. Up to FEW_REFERENCES of them, in order, are one array, and a scene takes the first that fits: no shuffle. More meet the scenes by the years that their periods hold, defaults apart."""
    p = F.col("p")
    dated = references.select("file", reference_period(F.col("file")).alias("p")).where("file IS NOT NULL").select("file", *[p[k].alias(k) for k in ("year_from", "year_to", "month_from", "month_to")])
    few = dated.orderBy(F.col("year_from").isNull(), "file").limit(FEW_REFERENCES + 1).collect()
    own = scenes.select("id", "ts")
    if len(few) > FEW_REFERENCES:
        default = dated.where("year_from IS NULL").agg(F.min("file").alias("_default"))
        years = dated.where("year_from IS NOT NULL").withColumn("_y", F.explode(F.sequence("year_from", "year_to")))
        fits = F.when(F.col("file").isNotNull(), F.when(month_in_range(F.month("ts"), F.col("month_from"), F.col("month_to")), F.col("file")))
        numbered = own.withColumns({"_n": F.monotonically_increasing_id(), "_y": F.year("ts")})
        found = numbered.join(years, "_y", "left").groupBy("_n", "id", "ts").agg(F.min(fits).alias("_f"))
        return found.crossJoin(F.broadcast(default)).select("id", "ts", F.coalesce("_f", "_default").alias("file"))
    every = F.from_json(F.lit(json.dumps([r.asDict() for r in few])), "array<struct<file: string, year_from: int, year_to: int, month_from: int, month_to: int>>")

    def holds(r: Column) -> Column:
        inside = F.when(F.year("ts").between(r.year_from, r.year_to), month_in_range(F.month("ts"), r.month_from, r.month_to))  # null without a time
        return r.year_from.isNull() | F.coalesce(inside, F.lit(False))

    return own.withColumn("file", F.get(F.filter(every, holds), 0).getField("file"))


def by_period(scenes: DataFrame, references: DataFrame) -> DataFrame:
    """(file, n): scenes of each reference line, lines without scenes included. A scene without an id doesn't count."""
    counts = reference_for(scenes, references).groupBy("file").agg(F.count("id").alias("n"))
    return references.select("file").join(counts, "file", "left").select("file", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def site_entries(sites: DataFrame, item_type: str = "PSScene", most_cloud: float = MOST_CLOUD) -> DataFrame:
    """(site, entry) of sites (site, ring: array<array<double>>, start: date, stop: date): the JSON that a search takes, with filters of geometry, dates and
    clouds; an open ring is closed. Sites without a ring or with an empty one have a null entry."""
    ring = F.col("ring")
    shut = F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(ring[0])))

    def day(x: str) -> Column:
        return F.concat(F.date_format(x, "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))

    def rule(kind: str, name: str, config: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(name).alias("field_name"), config.alias("config"))

    place = rule("GeometryFilter", "geometry", F.struct(F.lit("Polygon").alias("type"), F.array(shut).alias("coordinates")))
    dates = rule("DateRangeFilter", "acquired", F.struct(day("start").alias("gte"), day("stop").alias("lte")))
    clouds = rule("RangeFilter", "cloud_cover", F.struct(F.lit(float(most_cloud)).alias("lte")))
    entry = F.struct(F.lit(item_type).alias("item_type"), place.alias("geometry_filter"), dates.alias("date_range_filter"), clouds.alias("cloud_cover_filter"))
    return sites.select("site", F.when(F.size(F.coalesce(ring, F.array())) > 0, F.to_json(entry)).alias("entry"))


def upsert_sites(old: DataFrame, new: DataFrame) -> DataFrame:
    """Site dictionaries merged: for each site the newest row."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy("site").orderBy(F.desc("_v")))).where("_r = 1").drop("_v", "_r")


class NoAccess(Exception):
    """A service's refusal of a request because of some of its ids."""

    def __init__(self, ids):
        super().__init__(", ".join(ids))
        self.ids = set(ids)


class OrderClient:
    """What the engine needs of an imagery service; networks stay behind it."""

    def search(self, request: str) -> list[dict]:
        raise NotImplementedError

    def place(self, request: str) -> str:
        """The order's id; NoAccess names ids that can't be had, OSError may pass."""
        raise NotImplementedError

    def state(self, order_id: str) -> str:
        raise NotImplementedError

    def results(self, order_id: str) -> dict[str, str]:
        """Names of an order's files with their locations."""
        raise NotImplementedError

    def fetch(self, location: str) -> bytes:
        raise NotImplementedError


def refused_ids(message: str) -> list[str]:
    """The ids in a service's text on assets without access, each named as type/id/asset."""
    return re.findall(r"No access to assets:\s*[^/\s]+/([^/\s\"]+)", message)


def place_one(client: OrderClient, request: str, tries: int = 3) -> str | None:
    """The id of the order; ids without access are taken out of it. None where no id is left or every try failed."""
    body, failed = json.loads(request), 0
    while body["products"]:
        try:
            return client.place(json.dumps(body))
        except NoAccess as e:
            if not any(e.ids.intersection(p["item_ids"]) for p in body["products"]):
                raise
            kept = [{**p, "item_ids": [i for i in p["item_ids"] if i not in e.ids]} for p in body["products"]]
            body["products"] = [p for p in kept if p["item_ids"]]
        except OSError:
            failed += 1
            if failed == tries:
                return None
    return None


def await_order(client: OrderClient, order_id: str, wait: float = 10.0, most: int = 8640) -> str:
    """The order's last state, asked for every wait seconds: success, partial, failed, or the state in which it still is after most times."""
    state = client.state(order_id)
    for _ in range(most - 1):
        if state in ("success", "partial", "failed"):
            break
        time.sleep(wait)
        state = client.state(order_id)
    return state


def download_order(client: OrderClient, order_id: str, folder: str, overwrite: bool = False) -> dict[str, str]:
    """Paths in folder by name of the order's tif, json and xml files. A file that is there stays unless overwrite; a file is there only when whole."""
    out = {}
    os.makedirs(folder, exist_ok=True)
    for name, location in client.results(order_id).items():
        if not any(kind in name for kind in (".tif", ".json", ".xml")):
            continue
        out[name] = path = os.path.join(folder, name.rsplit("/", 1)[-1])
        if overwrite or not os.path.exists(path):
            with open(f"{path}.part", "wb") as f:
                f.write(client.fetch(location))
            os.replace(f"{path}.part", path)
    return out


#: Requests come to the driver, which waits for the network; more than these are an error.
MOST_REQUESTS = 10_000


def _requests(requests: DataFrame) -> list:
    rows = requests.limit(MOST_REQUESTS + 1).collect()
    if len(rows) > MOST_REQUESTS:
        raise ValueError(f"more than {MOST_REQUESTS} requests")
    return rows


def place_all(spark: SparkSession, requests: DataFrame, client: OrderClient, tries: int = 3) -> DataFrame:
    """(site, chunk, order_id) of requests (site, chunk, request), each tried again on failure."""
    rows = [(r[0], r.chunk, place_one(client, r.request, tries)) for r in _requests(requests)]
    return spark.createDataFrame(rows, "site string, chunk bigint, order_id string")


def run_orders(spark: SparkSession, requests: DataFrame, client: OrderClient, folder: str, at_once: int = 4, wait: float = 10.0, overwrite: bool = False) -> DataFrame:
    """(site, chunk, order_id, state, n_files): each request placed, awaited and downloaded to its site's folder, at_once at a time. state is null for
    what could not be placed."""

    def one(r) -> tuple:
        order = place_one(client, r.request)
        state = await_order(client, order, wait) if order is not None else None
        files = download_order(client, order, os.path.join(folder, r[0]), overwrite) if state in ("success", "partial") else {}
        return r[0], r.chunk, order, state, len(files)

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(one, _requests(requests)))
    return spark.createDataFrame(rows, "site string, chunk bigint, order_id string, state string, n_files int")
