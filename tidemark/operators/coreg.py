"""Co-registration by a lattice of tie points: matches in tiles, joins to a smooth shift of every pixel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_package
from tidemark.operators import kernels
from tidemark.operators.raster import TILE

#: Rows and columns of a task's tile in units of the window, so the margin is a small part of a tile.
TILES_A_WINDOW = 4
TIES = "image_id string, r int, c int, dr double, dc double, reliability double, better boolean"


def _floor_div(x: Column, by: int) -> Column:
    return F.floor(x / by).cast("int")


def tie_points(pairs: DataFrame, grid_res: int = 50, window: int = TILE, max_shift: int = 5) -> DataFrame:
    """(image_id, r, c, dr, dc, reliability, better) at every clear lattice pixel of pairs (image_id, r, c, ref, img, masked): by how much img must
    move around it to lie on ref, from the phase of a window, to fractions of a pixel.

    Lattice pixels are those in the middle of cells of grid_res pixels. reliability (0 to 100) sets the correlation's peak against the rest of
    its window; better says that the moved window is more alike than the given one. Windows without any clear texture and shifts beyond max_shift give
    no row; masked and unknown pixels count as their window's mean. One shuffle: a pixel goes to its tile and, near a border, to those beside it, so a
    task holds a tile with its margin however large an image is."""
    tile, half = window * TILES_A_WINDOW, window // 2
    spec = (grid_res, window, max_shift, tile)

    def run(group: pa.Table) -> pa.Table:
        down, right = (group.column(k)[0].as_py() for k in ("_down", "_right"))
        r, c = (group.column(k).to_numpy().astype(np.int64) for k in ("r", "c"))
        values = [group.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("ref", "img")]
        masked = group.column("masked").fill_null(True).to_numpy(zero_copy_only=False).astype(bool)
        rows = kernels.lattice_shifts(r, c, *values, masked, (down * tile, right * tile), *spec)
        name = [group.column("image_id")[0].as_py()] * len(rows)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
        names = [f.split()[0] for f in TIES.split(", ")]
        return pa.table([pa.array(name, pa.string()), *[pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)]], names=names)

    def beside(x: str) -> Column:
        return F.explode(F.array_distinct(F.array(*[_floor_div(F.col(x) + d, tile) for d in (-half, 0, half)])))

    ship_package(pairs.sparkSession)
    own = pairs.select(F.col("image_id").cast("string").alias("image_id"), "r", "c", F.col("ref").cast("double").alias("ref"), F.col("img").cast("double").alias("img"), "masked")
    dealt = own.where("r IS NOT NULL AND c IS NOT NULL").withColumn("_down", beside("r")).withColumn("_right", beside("c")).where("_down >= 0 AND _right >= 0")
    return dealt.groupBy("image_id", "_down", "_right").applyInArrow(run, TIES)


def good_ties(ties: DataFrame, min_reliability: float = 50.0) -> DataFrame:
    """Tie points that are reliable and better the match."""
    return ties.where((F.col("reliability") >= min_reliability) & F.col("better"))


def levels(pairs: DataFrame, good: DataFrame, grid_res: int = 50) -> DataFrame:
    """(image_id, level, dr, dc, points) of every image of pairs: level 0 for fewer than 5 grid_res^2 clear pixels, 1 without a tie point in good, else 2;
    dr and dc are the medians over its tie points, 0 below level 2."""
    clear = pairs.groupBy(F.col("image_id").cast("string").alias("image_id")).agg(F.count_if(~F.coalesce("masked", F.lit(True))).alias("_clear"))
    found = good.groupBy("image_id").agg(F.count("*").alias("_n"), F.percentile("dr", F.lit(0.5)).alias("_dr"), F.percentile("dc", F.lit(0.5)).alias("_dc"))
    level = F.when(F.col("_clear") < 5 * grid_res**2, 0).when(F.col("_n").isNull(), 1).otherwise(2)
    both = clear.join(found, "image_id", "left").withColumn("level", level)

    def sure(x: str, other) -> Column:
        return F.when(F.col("level") == 2, F.col(x)).otherwise(other)

    return both.select("image_id", "level", sure("_dr", 0.0).alias("dr"), sure("_dc", 0.0).alias("dc"), sure("_n", 0).cast("bigint").alias("points"))


def local_shifts(pixels: DataFrame, good: DataFrame, shifts: DataFrame, grid_res: int = 50, least_points: int = 3) -> DataFrame:
    """pixels (image_id, r, c, ...) with dr and dc at each: bilinear between the four lattice pixels around it, where the lattice holds a tie point of
    good, else the image's own shift of shifts (image_id, level, dr, dc, points), which also is all that images with fewer than least_points get.

    Images below level 2 stay where they are. Cells hold the sums of their four corners, so a pixel meets one row."""
    at = good.select("image_id", _floor_div(F.col("r"), grid_res).alias("_i"), _floor_div(F.col("c"), grid_res).alias("_j"), F.col("dr").alias("_tr"), F.col("dc").alias("_tc"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    whole = shifts.where("level = 2").select("image_id", F.col("dr").alias("_gr"), F.col("dc").alias("_gc"), "points")
    cells = at.join(whole.where(F.col("points") >= least_points), "image_id").select("*", corner.alias("_k"))
    off = [F.max(F.when((F.col("_k.a") == a) & (F.col("_k.b") == b), F.col(t) - F.col(g))).alias(f"_{t}{a}{b}") for t, g in (("_tr", "_gr"), ("_tc", "_gc")) for a in (0, 1) for b in (0, 1)]
    cells = cells.groupBy("image_id", (F.col("_i") - F.col("_k.a")).alias("_ci"), (F.col("_j") - F.col("_k.b")).alias("_cj")).agg(*off)
    mid = grid_res // 2
    keyed = pixels.withColumn("_ci", _floor_div(F.col("r") - mid, grid_res)).withColumn("_cj", _floor_div(F.col("c") - mid, grid_res))
    met = keyed.join(whole.drop("points"), "image_id", "left").join(cells, ["image_id", "_ci", "_cj"], "left")
    u, v = ((F.col(x) - mid) / grid_res - F.col(k) for x, k in (("r", "_ci"), ("c", "_cj")))

    def blend(t: str, g: str) -> Column:
        def part(a: int, b: int) -> Column:
            return F.coalesce(F.col(f"_{t}{a}{b}"), F.lit(0.0)) * (u if a else 1 - u) * (v if b else 1 - v)

        return F.coalesce(F.col(g), F.lit(0.0)) + part(0, 0) + part(0, 1) + part(1, 0) + part(1, 1)

    return met.select(*pixels.columns, blend("_tr", "_gr").alias("dr"), blend("_tc", "_gc").alias("dc"))


def warp(pixels: DataFrame, good: DataFrame, shifts: DataFrame, columns: list[str], grid_res: int = 50, least_points: int = 3) -> DataFrame:
    """pixels (image_id, r, c, columns) moved onto the reference, bands and mask alike: a pixel takes the values of the nearest one at its place less
    its shift, null where the image has none."""
    plan = local_shifts(pixels.select("image_id", "r", "c"), good, shifts, grid_res, least_points)
    source = plan.select("image_id", "r", "c", F.floor(F.col("r") - F.col("dr") + 0.5).cast("int").alias("_r"), F.floor(F.col("c") - F.col("dc") + 0.5).cast("int").alias("_c"))
    values = pixels.select("image_id", F.col("r").alias("_r"), F.col("c").alias("_c"), *columns)
    return source.join(values, ["image_id", "_r", "_c"], "left").select("image_id", "r", "c", *columns)
