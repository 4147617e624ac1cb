"""A whole site as one lazy plan: pixels to classes to shorelines to a corrected, filtered matrix."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.ids import item_time
from tidemark.functions.lineage import cut
from tidemark.operators import contours, coreg, ml, raster, series, vector


@dataclass
class Settings:
    """A site's choices; georef is (xtr, xscale, xshear, ytr, yshear, yscale)."""

    georef: tuple
    least_land: int = 1000
    least_water: int = 1000
    erosion: bool = True
    dilation: bool = True
    max_dist_from_ref: float = 100.0
    pixel_size: float = 3.0
    min_length: float = 30.0
    max_gap: float = 10.0
    sigma: float | None = 0.1
    window: int | None = None
    along_dist: float = 35.0
    compat: bool = True
    reference: list[tuple[float, float]] = field(default_factory=list)

    @property
    def buffer_radius(self) -> int:
        """Pixels of the buffer around the reference line."""
        return math.ceil(self.max_dist_from_ref / self.pixel_size)

    def overridden(self, info: dict) -> Settings:
        """These settings with what a site's own information states: max_dist_from_sl_ref, minBeachArea, minWaterSize, pixel_size."""
        names = {"max_dist_from_sl_ref": "max_dist_from_ref", "minBeachArea": "least_land", "minWaterSize": "least_water", "pixel_size": "pixel_size"}
        return replace(self, **{names[k]: v for k, v in info.items() if k in names and v is not None})


def reference_pixels(s: Settings) -> list[tuple[int, int]]:
    """The whole pixels (r, c) of the reference line, points a pixel apart put in between its vertices; a few for each metre of a line that the settings state."""
    xtr, xscale, xshear, ytr, yshear, yscale = s.georef
    det = xscale * yscale - xshear * yshear
    p = np.asarray(s.reference, float) - (xtr, ytr)
    at = np.stack(((xscale * p[:, 1] - yshear * p[:, 0]) / det, (yscale * p[:, 0] - xshear * p[:, 1]) / det), 1)
    dense = [at[:1]]
    for a, b in zip(at, at[1:], strict=False):
        n = max(1, int(np.ceil(np.hypot(*(b - a)))))
        dense.append(a + (b - a) * np.arange(1, n + 1)[:, None] / n)
    return [(int(r), int(c)) for r, c in np.unique(np.rint(np.concatenate(dense)).astype(int), axis=0)]


def near_reference(points: DataFrame, size: DataFrame, s: Settings) -> DataFrame:
    """points (image_id, seq, r, c) inside the polygon around the reference line's buffer on their image's grid; all points of images whose grid the line doesn't meet. Images of one size share their polygon."""
    if not s.reference:
        return points.select("image_id", "seq", "r", "c")
    shaped = size.withColumn("line", F.concat_ws("x", "h", "w"))
    shapes = shaped.select("line", "h", "w").distinct()
    path = F.from_json(F.lit(json.dumps(reference_pixels(s))), "array<array<int>>")  # as long as the settings' line
    at = shapes.select("line", F.explode(path).alias("p")).select("line", F.col("p")[0].alias("r"), F.col("p")[1].alias("c"))
    edges = cut(vector.polygon_edges(raster.buffer(at, shapes, s.buffer_radius), "line")).select("line", F.col("c0").alias("x0"), F.col("r0").alias("y0"), F.col("c1").alias("x1"), F.col("r1").alias("y1"))
    placed = points.join(shaped.select("image_id", "line"), "image_id").select("line", "image_id", "seq", F.col("c").alias("x"), F.col("r").alias("y"))
    met = edges.select("line").distinct()
    inside = vector.inside_polygons(placed, edges, "line", 1.0).unionByName(placed.join(met, "line", "left_anti"))
    return inside.select("image_id", "seq", F.col("y").alias("r"), F.col("x").alias("c"))


def shorelines(classes: DataFrame, s: Settings) -> DataFrame:
    """(image_id, seq, x, y) of class rasters (image_id, r, c, cls, masked): contours of land in order, mask crop, buffer of the reference line, georeference, sections, smoothing. All steps are joins and
    windows; no group holds an image, and tiles are what Python sees."""
    clean = raster.clean(classes.withColumn("cls", (F.col("cls") == 1).cast("int")), s.least_land, s.least_water, s.erosion, s.dilation)
    return traced(cut(clean.select(F.col("image_id").cast("string").alias("image_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "cls", "masked")), s)


def traced(clean: DataFrame, s: Settings) -> DataFrame:
    """shorelines of class rasters that are clean already: (image_id, r, c, cls of 0 or 1, masked)."""
    clean = clean.withColumn("cls", 1 - F.col("cls"))
    size = cut(clean.groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")))
    lines = contours.ordered(raster.segments(clean))
    clear = vector.crop_by_mask(lines.select("image_id", "seq", "r", "c"), clean, size)
    kept = near_reference(clear, size, s)
    xtr, xscale, xshear, ytr, yshear, yscale = s.georef
    world = kept.select("image_id", "seq", (F.lit(xscale) * F.col("c") + F.lit(xshear) * F.col("r") + F.lit(xtr)).alias("x"), (F.lit(yshear) * F.col("c") + F.lit(yscale) * F.col("r") + F.lit(ytr)).alias("y"))
    sections = cut(vector.kept_sections(cut(world), s.min_length, s.max_gap, s.compat))
    smooth = sections if s.sigma is None else vector.smooth_sections(sections, s.sigma, s.window)
    return cut(smooth.select("image_id", (F.row_number().over(W.partitionBy("image_id").orderBy("section", "i")) - 1).alias("seq"), "x", "y"))


def classified(pixels: DataFrame, model, s: Settings) -> DataFrame:
    """(image_id, r, c, cls, masked) of pixels (image_id, r, c, b, g, red, nir, masked) under a model of the 18 features."""
    names = [f"f_{n}" for n in raster.FEATURES18]
    scored = ml.classify(raster.features18(pixels, compat=s.compat), model, names)
    return scored.select("image_id", F.col("row").alias("r"), F.col("col").alias("c"), "cls").join(pixels.select("image_id", "r", "c", "masked"), ["image_id", "r", "c"])


def observations(lines: DataFrame, transects: DataFrame, images: DataFrame, s: Settings) -> DataFrame:
    """(ts, image_id, transect, dist): every image of images (image_id), also those without a shoreline, with every transect."""
    found = vector.transect_intersect(lines, transects, s.along_dist, s.compat)
    every = images.select(F.col("image_id").cast("string").alias("image_id")).crossJoin(transects.select("name"))
    return every.join(found, ["image_id", "name"], "left").select(item_time(F.col("image_id")).alias("ts"), "image_id", F.col("name").alias("transect"), "dist")


def site(pixels: DataFrame, model, transects: DataFrame, s: Settings, gauge: DataFrame | None = None, ref: float = 0.0, slope: float = 0.12, limit: float = 30.0) -> dict[str, DataFrame]:
    """Every product of a site, lazily: classes, shorelines, observations, corrected, filtered. compat: the filter reads the uncorrected
    observations."""
    classes = classified(pixels, model, s)
    lines = shorelines(classes, s)
    obs = series.first_per_time(observations(lines, transects, pixels.select("image_id").distinct(), s))
    out = {"classes": classes, "shorelines": lines, "observations": obs}
    if gauge is not None:
        out["corrected"] = series.tide_correct(obs.withColumn("series", F.lit("gauge")), gauge, ref, slope)
    base = obs if s.compat or gauge is None else out["corrected"].select("ts", "transect", "dist")
    out["filtered"] = series.qaqc(base, limit, s.compat)
    return out


def coregister(pairs: DataFrame, grid_res: int = 50, window: int = raster.TILE, max_shift: int = 5, min_reliability: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """(shifts, ties) of pixels (image_id, r, c, ref, img, masked): shifts has (image_id, level, dr, dc, points) of every image, level 0 for too few
    clear pixels, 1 for no tie point, 2 with the shift that lays img on ref; ties are the tie points that count. coreg.warp moves pixels by both."""
    good = cut(coreg.good_ties(coreg.tie_points(pairs, grid_res, window, max_shift), min_reliability))
    return coreg.levels(pairs, good, grid_res), good


def reference_image(scenes: DataFrame, explicit: DataFrame | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """(site, reference): a site's reference image for co-registration; the stated one (site, image_id), else one among its inputs, else its first by id."""
    out = scenes.groupBy("site").agg(F.min("image_id").alias("_first"))
    picks = []
    for k, df in enumerate((explicit, inputs)):
        if df is not None:
            out = out.join(df.groupBy("site").agg(F.min("image_id").alias(f"_pick{k}")), "site", "left")
            picks.append(f"_pick{k}")
    return out.select("site", F.coalesce(*picks, "_first").alias("reference"))


def resume_from(scenes: DataFrame, start: int) -> DataFrame:
    """Scenes in order of image_id without the first start of them. They are sorted by ranges into many partitions, kept, and counted there, so what goes is known by partition; an offset has one task for all rows."""
    ordered = cut(scenes.orderBy("image_id").withColumn("_at", F.monotonically_increasing_id()))
    first, gone = 1 << 62, start  # the highest bits of _at are the partition, the others a row's place there
    for part, n in sorted(tuple(r) for r in ordered.groupBy(F.shiftright("_at", 33)).count().collect()):
        if n > gone:
            first = (part << 33) + gone
            break
        gone -= n
    return ordered.where(F.col("_at") >= first).drop("_at")


def write_status(done: DataFrame, folder: str) -> None:
    """Appends (image_id, level, failed) of co-registered images, which still_to_do reads. A row is written once the work it stands for is."""
    done.select("image_id", F.col("level").cast("int").alias("level"), (F.col("level") < 2).alias("failed")).write.mode("append").parquet(folder)


def failed_images(status: DataFrame) -> DataFrame:
    """(image_id) whose newest row says that it failed; of several rows the best level counts."""
    return status.groupBy("image_id").agg(F.max("level").alias("level")).where("level < 2").select("image_id")


def write_wide(matrix: DataFrame, folder: str) -> None:
    """A matrix, a row a time and a column a transect, as CSV with a header; empty cells are nulls. A matrix has one row a scene, so it is one file."""
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def still_to_do(images: DataFrame, status: DataFrame) -> DataFrame:
    """Images without a status row: a run goes on where an earlier one stopped."""
    return images.join(status.select("image_id"), "image_id", "left_anti")


def evaluate(truth: DataFrame, pred: DataFrame, transects: DataFrame, s: Settings) -> DataFrame:
    """(image_id, name, error): distance of the true shoreline less that of the predicted one, within 25 m of the transect."""
    t = vector.transect_intersect(truth, transects, 25.0, s.compat).withColumnRenamed("dist", "t")
    p = vector.transect_intersect(pred, transects, 25.0, s.compat).withColumnRenamed("dist", "p")
    return t.join(p, ["image_id", "name"], "left").select("image_id", "name", (F.col("t") - F.col("p")).alias("error"))


def performance(truth: DataFrame, pred: DataFrame, transects: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """What a classification is worth, of many images at once: scores, dice and the other measures of each class near the reference line on clear pixels, and
    errors, the distance along each transect between the true shoreline and the predicted one.

    truth is (image_id, r, c, cls), pred (image_id, r, c, cls, masked); the prediction is cleaned first, classes are 1 and, for all others, 0. The true shoreline isn't
    smoothed."""
    land = (F.col("cls") == 1).cast("int")
    named = F.col("image_id").cast("string").alias("image_id")
    t = truth.select(named, "r", "c", land.alias("truth"))
    p = pred.select(named, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), land.alias("cls"), "masked")
    clean = cut(raster.clean(p, s.least_land, s.least_water, s.erosion, s.dilation).select("image_id", "r", "c", F.col("cls").alias("pred"), "masked"))
    size = cut(clean.groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")))
    clear = clean.where(~F.col("masked")).select("image_id", F.struct("r", "c").alias("seq"), "r", "c")
    near = near_reference(clear, size, s).select("image_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    pairs = clean.join(near, ["image_id", "r", "c"]).join(t, ["image_id", "r", "c"]).withColumn("inside", F.lit(True))
    true_lines = shorelines(t.join(p.select("image_id", "r", "c", "masked"), ["image_id", "r", "c"]).withColumnRenamed("truth", "cls"), replace(s, sigma=None))
    return {"scores": ml.class_scores(pairs), "errors": evaluate(true_lines, traced(clean.withColumnRenamed("pred", "cls"), s), transects, s)}
