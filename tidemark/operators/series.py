"""Observation matrices, tides and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_per_time(obs: DataFrame) -> DataFrame:
    """(ts, transect, dist): of several images at one time, the first non-null distance by image_id; all-null times go."""
    return obs.where("dist IS NOT NULL").groupBy("ts", "transect").agg(F.min_by("dist", "image_id").alias("dist"))


def matrix(obs: DataFrame, names: list[str]) -> DataFrame:
    """A row a time, a column a transect, by time. names fixes the columns and spares a pass."""
    return first_per_time(obs).groupBy("ts").pivot("transect", names).agg(F.first("dist")).orderBy("ts")


def interpolate(obs: DataFrame, gauge: DataFrame, key: str = "series", bucket: str = "day") -> DataFrame:
    """obs (key, ts, ...) with sl: the gauge's value at ts, on the line between the readings before and after; null outside its range.

    Readings and observations are put in order within a bucket of time, so no task holds a whole series; the last reading before a bucket
    and the first after it come from a table with one row a bucket. All windows grow from their first row, so a bucket costs what its rows cost, not
    their square."""
    cols = [c for c in obs.columns if c not in (key, "ts")]
    g = gauge.select(key, "ts", F.lit(True).alias("_g"), "sl", *[F.lit(None).cast(obs.schema[c].dataType).alias(c) for c in cols])
    rows = obs.select(key, "ts", F.lit(False).alias("_g"), F.lit(None).cast("double").alias("sl"), *cols).unionByName(g).withColumn("_b", F.date_trunc(bucket, "ts"))
    point = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "sl")
    reading = F.when(F.col("_g") & F.col("sl").isNotNull(), point)
    edges = rows.groupBy(key, "_b").agg(F.min(reading).alias("_lo"), F.max(reading).alias("_hi"))
    by, back = W.partitionBy(key).orderBy("_b"), W.partitionBy(key).orderBy(F.col("_b").desc())
    earlier = W.unboundedPreceding
    edges = edges.select(key, "_b", F.last("_hi", True).over(by.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.last("_lo", True).over(back.rowsBetween(earlier, -1)).alias("_after"))
    inside, downward = W.partitionBy(key, "_b").orderBy("ts"), W.partitionBy(key, "_b").orderBy(F.col("ts").desc())
    found = rows.withColumns({
        "_p": F.last(reading, True).over(inside.rangeBetween(earlier, W.currentRow)),
        "_n": F.last(reading, True).over(downward.rangeBetween(earlier, W.currentRow)),
    }).where(~F.col("_g")).join(edges, [key, "_b"])
    p, n = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    line = F.when(p.t == n.t, p.sl).otherwise(p.sl + (n.sl - p.sl) * (t - p.t) / (n.t - p.t))
    return found.select(key, "ts", *cols, line.alias("sl"))


def correction(tide: Column, ref: float = 0.0, slope: float = 0.12) -> Column:
    return (tide - ref) / slope


def tide_correct(obs: DataFrame, gauge: DataFrame, ref: float = 0.0, slope: float = 0.12, key: str = "series") -> DataFrame:
    """obs with dist corrected to the reference level, and tide_status; outside the gauge's range dist stays as it is."""
    with_tide = interpolate(obs, gauge, key)
    return with_tide.withColumns({"dist": F.coalesce(F.col("dist") + correction(F.col("sl"), ref, slope), "dist"), "tide_status": F.when(F.col("sl").isNull(), "uncorrected").otherwise("corrected")})


def harmonic_tide(times: DataFrame, constituents: DataFrame) -> DataFrame:
    """times (ts) with tide: the sum over constituents (amplitude, speed in degrees an hour, phase in degrees) of amplitude * cos(speed * hours
    - phase), hours since 2024-01-01 to the second. Constituents are tens of rows."""
    hours = (F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 3600.0
    stated = constituents.agg(F.collect_list(F.struct("name", "amplitude", "speed", "phase")).alias("_c"))
    wave = F.aggregate(F.sort_array("_c"), F.lit(0.0), lambda a, c: a + c.amplitude * F.cos(F.radians(c.speed * hours - c.phase)))
    return times.crossJoin(F.broadcast(stated)).withColumn("tide", wave).drop("_c")


def tide_range(bounds: DataFrame, step: str) -> DataFrame:
    """bounds (..., start, stop) as regular series (..., ts) from start to stop, both included where the step meets them; none where start is after
    stop or either is null. step is an interval like 30 MINUTES."""
    own = [c for c in bounds.columns if c not in ("start", "stop")]
    times = F.when(F.col("start") <= F.col("stop"), F.sequence(F.col("start").cast("timestamp_ntz"), F.col("stop").cast("timestamp_ntz"), F.expr(f"INTERVAL {step}")))
    return bounds.select(*own, F.explode(times).alias("ts"))


def qaqc(obs: DataFrame, limit: float = 30.0, compat: bool = True) -> DataFrame:
    """obs (ts, transect, dist) with distances farther than limit from their transect's median set to null. compat: the first transect in
    column order isn't filtered."""
    medians = obs.groupBy("transect").agg(F.percentile("dist", F.lit(0.5)).alias("_m"))
    if compat:
        medians = medians.crossJoin(F.broadcast(obs.agg(F.min("transect").alias("_first")))).withColumn("_free", F.col("transect") == F.col("_first")).drop("_first")
    else:
        medians = medians.withColumn("_free", F.lit(False))
    keep = F.col("_free") | F.col("dist").between(F.col("_m") - limit, F.col("_m") + limit)
    return obs.join(medians, "transect").withColumn("dist", F.when(keep, F.col("dist"))).drop("_m", "_free")


def mad(obs: DataFrame, as_std: bool = False) -> DataFrame:
    """(transect, mad): the median distance from the median, times 1.482 as an estimate of the standard deviation."""
    m = obs.groupBy("transect").agg(F.percentile("dist", F.lit(0.5)).alias("_m"))
    return obs.join(m, "transect").groupBy("transect").agg((F.percentile(F.abs(F.col("dist") - F.col("_m")), F.lit(0.5)) * (1.482 if as_std else 1.0)).alias("mad"))
