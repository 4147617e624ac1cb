"""Labelling by drawn shapes: polygons and rectangles become row intervals, which meet pixels in a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def row_intervals(shapes: DataFrame) -> DataFrame:
    """(image_id, shape, r, c0, c1): the pixels, from c0 to c1 in row r, whose centres lie in each shape by the even-odd rule. shapes (image_id, shape, seq, r, c) are the vertices of closed outlines in order; a centre on
    an outline's left side counts, on its right side it doesn't.

    Each edge gives one crossing for every row between its ends; a row's crossings in order bound its intervals in pairs. A shape's rows are sorted apart, so a tall shape is many tasks."""
    key = ["image_id", "shape"]
    by, all_of = W.partitionBy(*key).orderBy("seq"), W.partitionBy(*key).orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = shapes.select(*key, "seq", F.col("r").cast("double").alias("r0"), F.col("c").cast("double").alias("c0"))
    edges = v.withColumns({f"{x}1": F.coalesce(F.lead(f"{x}0").over(by), F.first(f"{x}0").over(all_of)) for x in "rc"}).where("r0 <> r1")
    low, high = F.least("r0", "r1"), F.greatest("r0", "r1")
    rows = edges.withColumns({"_a": F.ceil(low).cast("bigint"), "_b": F.ceil(high).cast("bigint") - 1}).where("_a <= _b").withColumn("r", F.explode(F.sequence("_a", "_b")))
    met = rows.select(*key, "r", (F.col("c0") + (F.col("c1") - F.col("c0")) * (F.col("r") - F.col("r0")) / (F.col("r1") - F.col("r0"))).alias("x"))
    across = W.partitionBy(*key, "r").orderBy("x")
    pairs = met.withColumns({"_k": F.row_number().over(across), "_to": F.lead("x").over(across)}).where("_k % 2 = 1 AND _to IS NOT NULL")
    return pairs.select(*key, F.col("r").cast("int").alias("r"), F.ceil("x").cast("int").alias("c0"), (F.ceil("_to") - 1).cast("int").alias("c1")).where("c0 <= c1")


def rectangle(shapes: DataFrame) -> DataFrame:
    """The outlines, for row_intervals, of rectangles (image_id, shape, r0, c0, r1, c1), both corners' pixels included."""
    a, b, c, d = F.least("r0", "r1"), F.greatest("r0", "r1") + 1, F.least("c0", "c1"), F.greatest("c0", "c1") + 1
    corners = F.array(*[F.struct(x.cast("double").alias("r"), y.cast("double").alias("c")) for x, y in ((a, c), (a, d), (b, d), (b, c))])
    return shapes.select("image_id", "shape", F.posexplode(corners).alias("seq", "p")).select("image_id", "shape", "seq", "p.r", "p.c")


def label_pixels(pixels: DataFrame, intervals: DataFrame, classes: DataFrame, labelled: DataFrame | None = None, width: int = 256) -> DataFrame:
    """(image_id, r, c, shape, cls): pixels (image_id, r, c) inside a shape, with the class of classes (image_id, shape, cls). A pixel belongs to the first shape by name that it is in; pixels of labelled (image_id, r, c), which
    have a class already, are left out.

    Intervals are cut at every width columns, and pixels meet those of their own stretch of their row: an equi-join whose keys are small however wide an image is."""
    cut_up = intervals.withColumn("_k", F.explode(F.sequence(F.floor(F.col("c0") / width), F.floor(F.col("c1") / width))))
    met = pixels.select("image_id", "r", "c", F.floor(F.col("c") / width).alias("_k")).join(cut_up, ["image_id", "r", "_k"]).where("c BETWEEN c0 AND c1")
    first = met.groupBy("image_id", "r", "c").agg(F.min("shape").alias("shape"))
    free = first if labelled is None else first.join(labelled.select("image_id", "r", "c"), ["image_id", "r", "c"], "left_anti")
    return free.join(classes.select("image_id", "shape", "cls"), ["image_id", "shape"]).select("image_id", "r", "c", "shape", "cls")
