"""Pixel tables: spectral indices, neighbourhood statistics, morphology, contour segments, buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.functions.shipping import ship_package
from tidemark.operators import kernels
from tidemark.operators.regions import drop_small


def wrap16(x: Column) -> Column:
    return F.pmod(x, F.lit(65536))


def ndi(b1: Column, b2: Column, arith: str = "wrap16") -> Column:
    """(b1 - b2) / (b1 + b2) with 1 for a sum of 0. arith: wrap16 as of unsigned 16-bit bands, or signed."""
    num, den = (wrap16(b1 - b2), wrap16(b1 + b2)) if arith == "wrap16" else (b1 - b2, b1 + b2)
    return num.cast("double") / F.when(den == 0, F.lit(1)).otherwise(den)


def nd_index(b1: Column, b2: Column, masked: Column) -> Column:
    """The index of clear pixels; null where masked or undefined."""
    return F.when(~masked, F.try_divide((b1 - b2).cast("double"), (b1 + b2).cast("double")))


#: Rows and columns of the tiles that windows over pixels are counted in.
TILE = 256


def image_std(pixels: DataFrame, columns: list[str], radius: int = 2, prefix: str = "std_", tile: int = TILE) -> DataFrame:
    """pixels (image_id, r, c, ...) with the population deviation of each column over (2 radius + 1) squared pixels around each; the image is
    mirrored at its edge pixels, null neighbours don't count, null centres stay null.

    One shuffle: a pixel goes to its tile and, near a border, to the tiles beside it, so a task holds a tile with its margin however large the
    image is. Images must have more than radius rows and columns, and radius is at most tile."""
    names = [f"{prefix}{c}" for c in columns]
    own = pixels.columns

    def mirrored(first: int, n: int, size: int) -> np.ndarray:
        at = np.abs(first + np.arange(size))
        return np.clip(np.where(at > n - 1, 2 * (n - 1) - at, at) - first, 0, size - 1)

    def run(group: pa.Table) -> pa.Table:
        h, w, down, right = (group.column(k)[0].as_py() for k in ("_h", "_w", "_down", "_right"))
        r, c = (group.column(k).to_numpy() for k in ("r", "c"))
        top, left = down * tile, right * tile
        shape = (min(tile, h - top) + 2 * radius, min(tile, w - left) + 2 * radius)
        fit = (r - top + radius < shape[0]) & (c - left + radius < shape[1])
        spots = np.ix_(mirrored(top - radius, h, shape[0]), mirrored(left - radius, w, shape[1]))
        mine = (r // tile == down) & (c // tile == right)
        out = (group if mine.all() else group.filter(pa.array(mine))).select(own)
        a = np.full((len(columns), *shape), np.nan)
        for k, column in enumerate(columns):
            a[k, (r - top + radius)[fit], (c - left + radius)[fit]] = group.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False)[fit]
        deviations = kernels.box_deviation(a[:, spots[0], spots[1]], radius)[:, (r - top)[mine], (c - left)[mine]]
        for name, v in zip(names, deviations, strict=True):
            out = out.append_column(name, pa.array(v, mask=np.isnan(v)))
        return out

    ship_package(pixels.sparkSession)
    size = pixels.groupBy("image_id").agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))

    def beside(x: str) -> Column:
        return F.explode(F.array_distinct(F.array(*[F.floor((F.col(x) + d) / tile).cast("int") for d in (-radius, 0, radius)])))

    dealt = pixels.join(size, "image_id").withColumn("_down", beside("r")).withColumn("_right", beside("c"))
    dealt = dealt.where((F.col("_down") >= 0) & (F.col("_right") >= 0) & (F.col("_down") * tile < F.col("_h")) & (F.col("_right") * tile < F.col("_w")))
    schema = T.StructType([*pixels.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return dealt.groupBy("image_id", "_down", "_right").applyInArrow(run, schema)


#: The order of the 18 features of a pixel.
FEATURES18 = ("R", "G", "B", "NIR", "NDI_NIR_B", "NDI_NIR_G", "NDI_B_R", "NDWI", "NDVI", "stdR", "stdG", "stdB", "stdNIR", "stdNDI_NIR_B", "stdNDI_NIR_G", "stdNDI_B_R", "stdNDWI", "stdNDVI")


def features18(pixels: DataFrame, radius: int = 2, arith: str = "wrap16", compat: bool = True) -> DataFrame:
    """(image_id, r, c, 18 features) of pixels (image_id, r, c, b, g, red, nir). compat: stdR holds the deviation of blue and stdB that of
    red, as models expect."""
    b, g, red, nir = (F.col(x) for x in ("b", "g", "red", "nir"))
    base = pixels.select("image_id", "r", "c", red.alias("R_"), g.alias("G_"), b.alias("B_"), nir.alias("NIR_"), ndi(nir, b, arith).alias("NDI_NIR_B"), ndi(nir, g, arith).alias("NDI_NIR_G"), ndi(b, red, arith).alias("NDI_B_R"), ndi(g, nir, arith).alias("NDWI"), ndi(nir, red, arith).alias("NDVI"))
    base = base.select("image_id", F.col("r"), F.col("c"), F.col("R_").alias("fR"), F.col("G_").alias("fG"), F.col("B_").alias("fB"), F.col("NIR_").alias("fNIR"), *FEATURES18[4:9])
    std = image_std(base, ["fR", "fG", "fB", "fNIR", *FEATURES18[4:9]], radius, "std")
    first, third = ("stdfB", "stdfR") if compat else ("stdfR", "stdfB")
    names = {"R": "fR", "G": "fG", "B": "fB", "NIR": "fNIR", "stdR": first, "stdG": "stdfG", "stdB": third, "stdNIR": "stdfNIR"}
    return std.select("image_id", F.col("r").alias("row"), F.col("c").alias("col"), *[F.col(names.get(f, f)).cast("double").alias(f"f_{f}") for f in FEATURES18])


FEATURES16 = ("b", "g", "red", "nir", "nir_g", "nir_b", "nir_r", "b_r", "std_b", "std_g", "std_red", "std_nir", "std_nir_g", "std_nir_b", "std_nir_r", "std_b_r")


def features16(pixels: DataFrame, radius: int = 2) -> DataFrame:
    """(image_id, r, c, masked, 16 features) of pixels with masked; indices are null where masked."""
    b, g, red, nir, m = (F.col(x) for x in ("b", "g", "red", "nir", "masked"))
    base = pixels.withColumns({"nir_g": nd_index(nir, g, m), "nir_b": nd_index(nir, b, m), "nir_r": nd_index(nir, red, m), "b_r": nd_index(b, red, m)})
    return image_std(base, list(FEATURES16[:8]), radius).select("image_id", "r", "c", "masked", *FEATURES16)


def erode_cross(classes: DataFrame) -> DataFrame:
    """cls (1 or 0) eroded by the 3 x 3 cross; outside the image counts as 1."""
    across, down = W.partitionBy("image_id", "r").orderBy("c"), W.partitionBy("image_id", "c").orderBy("r")
    one = F.lit(1)
    both = classes.withColumn("_h", F.least("cls", F.coalesce(F.lag("cls").over(across), one), F.coalesce(F.lead("cls").over(across), one)))
    return both.withColumn("cls", F.least("_h", F.coalesce(F.lag("cls").over(down), one), F.coalesce(F.lead("cls").over(down), one))).drop("_h")


def dilate_square(classes: DataFrame, radius: int = 2) -> DataFrame:
    """cls dilated by the (2 radius + 1) square; outside counts as 0."""
    across = W.partitionBy("image_id", "r").orderBy("c").rowsBetween(-radius, radius)
    down = W.partitionBy("image_id", "c").orderBy("r").rowsBetween(-radius, radius)
    return classes.withColumn("cls", F.max("cls").over(across)).withColumn("cls", F.max("cls").over(down))


#: For the code 8 * top left + 4 * top right + 2 * bottom right + bottom left of a 2 x 2 cell, the sides that its contour
#: segments join (T, R, B, L); on saddles the high corners stay apart.
SEGMENT_CASES = {
    1: ("LB",), 2: ("BR",), 3: ("LR",), 4: ("RT",), 5: ("RT", "LB"), 6: ("BT",), 7: ("LT",),
    8: ("TL",), 9: ("TB",), 10: ("TL", "BR"), 11: ("TR",), 12: ("RL",), 13: ("RB",), 14: ("BL",),
}


def segments(classes: DataFrame) -> DataFrame:
    """(image_id, r0, c0, r1, c1): contour segments at 0.5 of the 0/1 raster cls, one or two in each 2 x 2 cell that has both values."""
    across = W.partitionBy("image_id", "r").orderBy("c")
    down = W.partitionBy("image_id", "c").orderBy("r")
    two = classes.select("image_id", "r", "c", F.col("cls").alias("a"), F.lead("cls").over(across).alias("b"))
    four = two.select("*", F.lead("a").over(down).alias("d"), F.lead("b").over(down).alias("e")).where("b IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL")
    code = 8 * F.col("a") + 4 * F.col("b") + 2 * F.col("e") + F.col("d")
    spots = {"T": (0.0, 0.5), "R": (0.5, 1.0), "B": (1.0, 0.5), "L": (0.5, 0.0)}
    cases = F.create_map(*[x for k, sides in SEGMENT_CASES.items() for x in (F.lit(k), F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("y0", "x0", "y1", "x1"), (*spots[s[0]], *spots[s[1]]), strict=True)]) for s in sides]))])
    found = four.select("image_id", "r", "c", F.explode(F.element_at(cases, code.cast("int"))).alias("s"))
    return found.select("image_id", (F.col("r") + F.col("s.y0")).alias("r0"), (F.col("c") + F.col("s.x0")).alias("c0"), (F.col("r") + F.col("s.y1")).alias("r1"), (F.col("c") + F.col("s.x1")).alias("c1"))


def densify(points: DataFrame, min_distance: float) -> DataFrame:
    """points (line, seq, r, c) with whole, evenly spaced points put in wherever neighbours are over min_distance / 2 apart: (line, seq, k, r, c)."""
    w = W.partitionBy("line").orderBy("seq")
    p = points.withColumns({"_r": F.lead("r").over(w), "_c": F.lead("c").over(w)})
    d = F.sqrt((F.col("_r") - F.col("r")) * (F.col("_r") - F.col("r")) + (F.col("_c") - F.col("c")) * (F.col("_c") - F.col("c")))
    n = F.when(F.col("_r").isNull() | (d <= min_distance / 2), 1).otherwise(F.ceil(d / (min_distance / 2)).cast("int"))
    k = p.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(a: str, b: str) -> Column:
        moved = F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("_n")
        return F.when(F.col("k") == 0, F.col(a).cast("double")).otherwise(F.rint(moved))

    return k.select("line", "seq", "k", at("r", "_r").alias("r"), at("c", "_c").alias("c"))


def buffer(points: DataFrame, size: DataFrame, radius: int) -> DataFrame:
    """(line, r, c): pixels of the h x w grid of the points' line within radius of one of them. Points (line, r, c) in row or column 0 or outside the grid don't count. size: line, h, w, a row a line."""
    h, w = F.col("h"), F.col("w")
    whole = points.select("line", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).distinct()
    inside = whole.join(size.select("line", "h", "w"), "line").where((F.col("r") > 0) & (F.col("c") > 0) & (F.col("r") < h) & (F.col("c") < w))
    spread = F.sequence(F.lit(-radius), F.lit(radius))
    disk = inside.withColumn("dr", F.explode(spread)).withColumn("dc", F.explode(spread)).where(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc") <= radius * radius)
    out = disk.select("line", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "h", "w").where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < h) & (F.col("c") < w))
    return out.select("line", "r", "c").distinct()


def enough_clear(masks: DataFrame, inside: DataFrame, least: int = 20) -> DataFrame:
    """(image_id, n_clear, valid): clear pixels within the buffer, and whether there are least of them."""
    clear = masks.join(inside, ["r", "c"], "left_semi").groupBy("image_id").agg(F.count_if(~F.col("masked")).alias("n_clear"))
    return clear.withColumn("valid", F.col("n_clear") >= least)


def rescale(pixels: DataFrame, columns: list[str], prob: float = 0.999) -> DataFrame:
    """Each band clipped to 0..1 of its percentile over the image's clear pixels."""
    tops = pixels.where(~F.col("masked")).groupBy("image_id").agg(*[F.percentile(c, F.lit(prob)).alias(f"_p{c}") for c in columns])
    out = pixels.join(tops, "image_id")
    return out.withColumns({c: F.least(F.greatest(F.col(c) / F.col(f"_p{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}).drop(*[f"_p{c}" for c in columns])


def pad(pixels: DataFrame, columns: list[str], top: int, left: int, h: int, w: int) -> DataFrame:
    """The image moved by (top, left) into an h x w grid, 0 where it has no pixel. The grid is larger where the moved image needs it: nothing is
    cropped."""
    size = pixels.groupBy("image_id").agg(F.greatest(F.lit(h), F.max("r") + 1 + top).alias("_h"), F.greatest(F.lit(w), F.max("c") + 1 + left).alias("_w"))
    grid = size.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("_h") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("_w") - 1))).drop("_h", "_w")
    moved = pixels.select("image_id", (F.col("r") + top).alias("r"), (F.col("c") + left).alias("c"), *columns)
    return grid.join(moved, ["image_id", "r", "c"], "left").fillna(0, columns)


def clean(classes: DataFrame, least_land: int = 1000, least_water: int = 1000, erosion: bool = True, dilation: bool = True) -> DataFrame:
    """Water (cls 1) eroded and dilated, then without land regions of fewer than least_land pixels, then without small water regions."""
    if erosion:
        classes = erode_cross(classes)
    if dilation:
        classes = dilate_square(classes)
    return drop_small(drop_small(classes, 0, least_land), 1, least_water)


def with_masks(pixels: DataFrame, masks: DataFrame, zero_bands: list[str] | None = None) -> DataFrame:
    """pixels (image_id, r, c, ...) with masked from masks (image_id, r, c, masked). An image without a mask has no masked pixel, or, with zero_bands, those
    where one of these bands is 0. image_id is the stem that image and mask files share."""
    known = masks.select("image_id").distinct().withColumn("_has", F.lit(True))
    joined = pixels.drop("masked").join(masks.select("image_id", "r", "c", "masked"), ["image_id", "r", "c"], "left").join(F.broadcast(known), "image_id", "left")
    zero = F.lit(False)
    for b in zero_bands or ():
        zero = zero | (F.col(b) == 0)
    return joined.withColumn("masked", F.when(F.col("_has"), F.coalesce("masked", F.lit(False))).otherwise(zero)).drop("_has")


def apply_shift(pixels: DataFrame, shifts: DataFrame, columns: list[str]) -> DataFrame:
    """pixels moved by their image's (dr, dc) of shifts (image_id, dr, dc) on their own grid: what leaves it is gone, cells that nothing moves to are 0 and
    masked. Images without a shift stay."""
    dr, dc = F.coalesce("dr", F.lit(0)), F.coalesce("dc", F.lit(0))
    moved = pixels.join(shifts.select("image_id", "dr", "dc"), "image_id", "left").select("image_id", (F.col("r") + dr).cast("int").alias("r"), (F.col("c") + dc).cast("int").alias("c"), *columns, "masked")
    grid = pixels.select("image_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    joined = grid.join(moved, ["image_id", "r", "c"], "left")
    return joined.select("image_id", "r", "c", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns], F.coalesce("masked", F.lit(True)).alias("masked"))
