"""Tides from gridded atlases: complex amplitudes of constituents on a longitude-latitude grid, ocean and load, with nodal corrections."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Speed in degrees an hour, and the nodal factor's mean and cosine part and phase's sine part in degrees, by the common approximations in the longitude of the moon's node.
CONSTITUENTS = {"M2": (28.9841042, 1.0, -0.037, -2.1), "S2": (30.0, 1.0, 0.0, 0.0), "K1": (15.0410686, 1.006, 0.115, -8.9), "O1": (13.9430356, 1.009, 0.187, 10.8)}
#: The node's longitude at noon of 2000-01-01, and its change a day, in degrees.
NODE, NODE_A_DAY = 125.0445, -0.0529538
#: Seconds since 1970 at noon of 2000-01-01.
EPOCH = 946728000


class TideModel(Protocol):
    """Anything that adds a tide to points in time and place."""

    def tide(self, points: DataFrame) -> DataFrame:
        """points (lon, lat, ts, ...) with tide, in the model's unit; null where the model has no water."""


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp")) - F.lit(EPOCH)


def wave(ts: Column, name: Column) -> tuple[Column, Column]:
    """(cosine, sine) part of a constituent at a time, to the second, nodal corrections included."""
    s = seconds(ts)
    node = F.radians(F.lit(NODE) + F.lit(NODE_A_DAY) * s / 86400.0)

    def of(i: int) -> Column:
        case = F.lit(None).cast("double")
        for n, v in CONSTITUENTS.items():
            case = F.when(name == n, F.lit(v[i])).otherwise(case)
        return case

    factor = of(1) + of(2) * F.cos(node)
    angle = F.radians(of(0) * s / 3600.0 + of(3) * F.sin(node))
    return factor * F.cos(angle), factor * F.sin(angle)


class GridAtlas:
    """An atlas of grids (part, name, i, j, re, im): constituent name's complex amplitude of a part, such as ocean or load, at lon = west + i * step, lat = south + j * step. A place without water has no row."""

    def __init__(self, grids: DataFrame, west: float, south: float, step: float) -> None:
        self.grids, self.west, self.south, self.step = grids, west, south, step

    def tide(self, points: DataFrame) -> DataFrame:
        """points with tide: the sum over all parts and constituents of the amplitudes at the point, bilinear between the four grid places around it; the weights of places with water are shared out to 1, and a point without any in a part and
        constituent gets nothing of it; with none at all its tide is null.

        A point meets its four places in an equi-join, whatever the size of the atlas; constituents without known speed are an error."""
        known = self.grids.withColumn("name", F.when(F.col("name").isin(list(CONSTITUENTS)), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("unknown constituent "), "name")).cast("string")))
        x, y = (F.col("lon") - self.west) / self.step, (F.col("lat") - self.south) / self.step
        near = points.withColumns({"_p": F.struct(*points.columns), "_i": F.floor(x), "_j": F.floor(y), "_n": F.monotonically_increasing_id()}).withColumns({"_u": x - F.col("_i"), "_v": y - F.col("_j")})
        corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
        near = near.select("_p", "_n", "ts", "_i", "_j", "_u", "_v", F.explode(corners).alias("_c"))
        share = F.when(F.col("_c.a") == 1, F.col("_u")).otherwise(1 - F.col("_u")) * F.when(F.col("_c.b") == 1, F.col("_v")).otherwise(1 - F.col("_v"))
        near = near.select("_p", "_n", "ts", (F.col("_i") + F.col("_c.a")).alias("i"), (F.col("_j") + F.col("_c.b")).alias("j"), share.alias("_w")).where("_w > 0")
        cell = known.groupBy("i", "j").agg(F.collect_list(F.struct("part", "name", "re", "im")).alias("_g"))
        met = near.join(cell, ["i", "j"], "left").select("_p", "_n", "ts", "_w", F.explode_outer("_g").alias("g"))
        each = met.groupBy("_p", "_n", "ts", "g.part", "g.name").agg(*[(F.sum(F.col("_w") * F.col(f"g.{k}")) / F.sum(F.when(F.col("g.re").isNotNull(), F.col("_w")))).alias(k) for k in ("re", "im")])
        cos, sin = wave(F.col("ts"), F.col("name"))
        return each.withColumn("_t", F.col("re") * cos + F.col("im") * sin).groupBy("_p", "_n").agg(F.sum("_t").alias("tide")).select("_p.*", "tide")
