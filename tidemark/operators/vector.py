"""Vertices, contours and transects: DataFrame -> DataFrame."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.geometry import distance, extend_start
from tidemark.functions.lineage import cut
from tidemark.functions.shipping import ship_package

#: Up to so many transects are broadcast to the vertices; more meet them on a grid.
BROADCAST_TRANSECTS = 200
#: No vertex farther than this from a transect's origin counts, and the side of a grid cell.
REACH = 1000.0


def _near(phi: Column, other: Column, compat: bool) -> Column:
    turn = F.abs(phi - other)
    return (turn if compat else F.least(turn, F.lit(2 * 3.141592653589793) - turn)) < F.pi() / 2


def transect_hits(vertices: DataFrame, transects: DataFrame, along_dist: float = 35.0, compat: bool = True) -> DataFrame:
    """(image_id, name, u) for each vertex within along_dist of a transect's line, REACH of its origin, and seaward of it; u is the distance along the
    transect. compat: angles are compared without wrap at pi.

    Few transects are broadcast. Many are put into the grid cells around their origin, and vertices meet those of their own cell: an equi-join
    that needs no size limit."""
    v, t = vertices.select("image_id", "x", "y"), transects.select("name", "x0", "y0", "x1", "y1")
    few = t.limit(BROADCAST_TRANSECTS + 1).count() <= BROADCAST_TRANSECTS
    n = distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    off = F.abs((F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0"))) / n
    phi = F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    hit = (off <= along_dist) & (distance(F.col("x0"), F.col("y0"), F.col("x"), F.col("y")) <= REACH) & _near(phi, F.atan2(F.col("y") - F.col("y0"), F.col("x") - F.col("x0")), compat)
    if few:
        met = v.join(F.broadcast(t), hit)
    else:
        steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        cells = t.withColumn("gx", F.explode(F.transform(steps, lambda i: F.floor(F.col("x0") / REACH) + i))).withColumn("gy", F.explode(F.transform(steps, lambda i: F.floor(F.col("y0") / REACH) + i)))
        met = v.withColumns({"gx": F.floor(F.col("x") / REACH), "gy": F.floor(F.col("y") / REACH)}).join(cells, ["gx", "gy"]).where(hit)
    u = (F.col("x") - F.col("x0")) * F.cos(phi) + (F.col("y") - F.col("y0")) * F.sin(phi)
    return met.select("image_id", "name", u.alias("u"))


def transect_intersect(vertices: DataFrame, transects: DataFrame, along_dist: float = 35.0, compat: bool = True) -> DataFrame:
    """(image_id, name, dist): the exact median of transect_hits for every image and transect, null without a hit."""
    medians = transect_hits(vertices, transects, along_dist, compat).groupBy("image_id", "name").agg(F.percentile("u", F.lit(0.5)).alias("dist"))
    every = vertices.select("image_id").distinct().crossJoin(transects.select("name"))
    return every.join(medians, ["image_id", "name"], "left")


def crossing(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Parameter of the point on segment ab where segment cd crosses it, else null."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), den)
    s = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), den)
    return F.when(t.between(0, 1) & s.between(0, 1), t)


def _cells(side: float, xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    """The grid cells (gx, gy) of the box around a segment, as an array: few, unless the segment is many sides long."""
    def span(a: Column, b: Column) -> Column:
        return F.sequence(F.floor(F.least(a, b) / side), F.floor(F.greatest(a, b) / side))

    return F.flatten(F.transform(span(xa, xb), lambda gx: F.transform(span(ya, yb), lambda gy: F.struct(gx.alias("gx"), gy.alias("gy")))))


def transect_crossing(vertices: DataFrame, transects: DataFrame, landward: float = 20.0, along_dist: float = 35.0) -> DataFrame:
    """(image_id, name, dist): distance along each transect, extended landward, to the first crossing with the line through an image's vertices in
    order; null where there is none, where no vertex of the image is within along_dist of any of the crossings, or where the transect, as it
    is given, crosses or touches another one.

    Transects meet each other and the segments on grid cells of REACH, crossings the vertices on cells of along_dist: equi-joins throughout. A crossing
    whose own segment's ends are near needs no search."""
    w = W.partitionBy("image_id").orderBy("seq")
    given = transects.select("name", "x0", "y0", "x1", "y1")
    celled = given.withColumn("g", F.explode(_cells(REACH, *(F.col(k) for k in ("x0", "y0", "x1", "y1")))))
    a, b = celled.alias("a"), celled.alias("b")
    over = crossing(*(F.col(f"a.{k}") for k in ("x0", "y0", "x1", "y1")), *(F.col(f"b.{k}") for k in ("x0", "y0", "x1", "y1")))
    tangled = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.name") != F.col("b.name")) & over.isNotNull(), "left_semi").select("name").distinct()
    start = extend_start(landward, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    t = given.join(tangled, "name", "left_anti").select("name", start.x.alias("ex"), start.y.alias("ey"), "x1", "y1", distance(start.x, start.y, F.col("x1"), F.col("y1")).alias("n"))
    t = t.withColumn("g", F.explode(_cells(REACH, *(F.col(k) for k in ("ex", "ey", "x1", "y1")))))
    segments = vertices.withColumns({"xn": F.lead("x").over(w), "yn": F.lead("y").over(w)}).where("xn IS NOT NULL").select("image_id", "x", "y", "xn", "yn")
    segments = segments.withColumn("g", F.explode(_cells(REACH, *(F.col(k) for k in ("x", "y", "xn", "yn")))))
    at = crossing(*(F.col(k) for k in ("ex", "ey", "x1", "y1", "x", "y", "xn", "yn")))
    met = segments.join(t, "g").withColumn("at", at).where("at IS NOT NULL")
    met = met.withColumns({"px": F.col("ex") + F.col("at") * (F.col("x1") - F.col("ex")), "py": F.col("ey") + F.col("at") * (F.col("y1") - F.col("ey"))})
    ends = F.least(distance(F.col("px"), F.col("py"), F.col("x"), F.col("y")), distance(F.col("px"), F.col("py"), F.col("xn"), F.col("yn")))
    points = met.select("image_id", "name", (F.col("at") * F.col("n") - landward).alias("dist"), "px", "py", (ends <= along_dist).alias("near"))
    hits = points.groupBy("image_id", "name").agg(F.min("dist").alias("dist"), F.bool_or("near").alias("near"))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    far = points.join(hits.where(~F.col("near")).select("image_id", "name"), ["image_id", "name"], "left_semi")
    far = far.withColumn("gx", F.explode(F.transform(steps, lambda i: F.floor(F.col("px") / along_dist) + i))).withColumn("gy", F.explode(F.transform(steps, lambda i: F.floor(F.col("py") / along_dist) + i)))
    spots = vertices.select("image_id", "x", "y", F.floor(F.col("x") / along_dist).alias("gx"), F.floor(F.col("y") / along_dist).alias("gy"))
    found = far.join(spots, ["image_id", "gx", "gy"]).where(distance(F.col("px"), F.col("py"), F.col("x"), F.col("y")) <= along_dist).select("image_id", "name").distinct().withColumn("seen", F.lit(True))
    dists = hits.join(found, ["image_id", "name"], "left").where(F.col("near") | F.col("seen")).select("image_id", "name", "dist")
    return vertices.select("image_id").distinct().crossJoin(transects.select("name")).join(dists, ["image_id", "name"], "left")


def crop_by_mask(vertices: DataFrame, masks: DataFrame, size: DataFrame, buffer: int = 3) -> DataFrame:
    """Vertices (image_id, seq, r, c) whose surrounding mask pixels, buffer - 1 to each side, are all clear. r and c are cut to whole pixels;
    vertices closer than that to the first row or column go, past the far edge only pixels that exist count. size: image_id, h, w."""
    k = buffer - 1
    v = vertices.withColumns({"ri": F.col("r").cast("int"), "ci": F.col("c").cast("int")}).join(size, "image_id").where((F.col("ri") >= k) & (F.col("ci") >= k) & (F.col("ri") - k < F.col("h")) & (F.col("ci") - k < F.col("w")))
    around = F.explode(F.sequence(F.lit(-k), F.lit(k)))
    bad = masks.where("masked").select("image_id", F.col("r").alias("mr"), F.col("c").alias("mc"))
    touched = v.select("image_id", "seq", "ri", "ci", around.alias("dr")).select("image_id", "seq", (F.col("ri") + F.col("dr")).alias("mr"), "ci", around.alias("dc")).select("image_id", "seq", "mr", (F.col("ci") + F.col("dc")).alias("mc"))
    hit = touched.join(bad, ["image_id", "mr", "mc"], "left_semi").select("image_id", "seq").distinct()
    return v.join(hit, ["image_id", "seq"], "left_anti").select(vertices.columns)


def contour_length(vertices: DataFrame) -> DataFrame:
    """(image_id, length): the sum of the distances between consecutive vertices; 0 for a single one."""
    w = W.partitionBy("image_id").orderBy("seq")
    step = distance(F.col("x"), F.col("y"), F.lead("x").over(w), F.lead("y").over(w))
    return vertices.withColumn("step", step).groupBy("image_id").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def split_sections(vertices: DataFrame, max_gap: float = 10.0) -> DataFrame:
    """vertices with section: a new one after every gap over max_gap."""
    w = W.partitionBy("image_id").orderBy("seq")
    gap = F.when(distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")) > max_gap, 1).otherwise(0)
    return vertices.withColumn("_gap", gap).withColumn("section", F.sum("_gap").over(w)).drop("_gap")


def polygon_edges(pixels: DataFrame, key: str) -> DataFrame:
    """(key, r0, c0, r1, c1): the edges of the polygon around pixels (key, r, c): each row's first pixel downwards, then each row's last upwards; a row of one pixel gives it once, and a row's gaps are filled by this."""
    rows = pixels.groupBy(key, "r").agg(F.min("c").alias("first"), F.max("c").alias("last"))
    down = W.partitionBy(key).orderBy("r")
    wide = rows.where("first <> last")

    def steps(df: DataFrame, c: str) -> DataFrame:
        return df.select(key, F.col("r").alias("r0"), F.col(c).alias("c0"), F.lead("r").over(down).alias("r1"), F.lead(c).over(down).alias("c1")).where("r1 IS NOT NULL")

    ends = rows.groupBy(key).agg(F.min(F.struct("r", "first")).alias("top"), F.max(F.struct("r", "first")).alias("low"), F.min(F.when(F.col("first") != F.col("last"), F.struct("r", "last"))).alias("wide_top"), F.max(F.when(F.col("first") != F.col("last"), F.struct("r", "last"))).alias("wide_low"))
    bottom = ends.select(key, F.col("low.r").alias("r0"), F.col("low.first").alias("c0"), F.coalesce("wide_low.r", "top.r").alias("r1"), F.coalesce("wide_low.last", "top.first").alias("c1"))
    top = ends.where("wide_top IS NOT NULL").select(key, F.col("wide_top.r").alias("r0"), F.col("wide_top.last").alias("c0"), F.col("top.r").alias("r1"), F.col("top.first").alias("c1"))
    return steps(rows, "first").unionByName(steps(wide, "last")).unionByName(bottom).unionByName(top)


def inside_polygons(points: DataFrame, edges: DataFrame, key: str, side: float) -> DataFrame:
    """The points (key, image_id, seq, x, y) strictly inside their key's polygon, by the even-odd rule; points on the outline are outside. edges: (key, x0, y0, x1, y1).

    An edge is put into every band of side height that it reaches, a point into its own, so a point meets only the edges of its band, in an equi-join; crossings to the right are counted on the map
    side first. The bands should be about as high as edges are."""
    y = F.col("y")
    bands = edges.withColumn("_band", F.explode(F.sequence(F.floor(F.least("y0", "y1") / side), F.floor(F.greatest("y0", "y1") / side))))
    met = points.withColumn("_band", F.floor(y / side)).join(bands, [key, "_band"])
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    crosses = (y0 > y) != (y1 > y)
    right = crosses & (F.col("x") < F.try_divide((x1 - x0) * (y - y0), y1 - y0) + x0)
    turn = (x1 - x0) * (y - y0) - (y1 - y0) * (F.col("x") - x0)
    on = (F.abs(turn) < 1e-9) & F.col("x").between(F.least(x0, x1), F.greatest(x0, x1)) & y.between(F.least(y0, y1), F.greatest(y0, y1))
    counted = met.groupBy(key, "image_id", "seq", "x", "y").agg(F.count_if(right).alias("_n"), F.bool_or(on).alias("_on"))
    return counted.where((F.col("_n") % 2 == 1) & ~F.col("_on")).drop("_n", "_on")


def kept_sections(vertices: DataFrame, min_length: float = 30.0, max_gap: float = 10.0, compat: bool = True) -> DataFrame:
    """(image_id, section, i, n, x, y): vertices (image_id, seq, x, y) cut at gaps over max_gap into sections of min_length or more; i counts a section's n vertices from 0.

    compat: a section lacks its last vertex, a line without a gap or without a section before its last gap is one section, and what follows the last section of two or more vertices is one more; else
    sections are the runs of two or more vertices."""
    by, runs_by = W.partitionBy("image_id").orderBy("seq"), W.partitionBy("image_id")
    v = split_sections(vertices.select("image_id", "seq", "x", "y"), max_gap).withColumn("at", F.row_number().over(by) - 1)
    runs = v.groupBy("image_id", "section").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    runs = runs.withColumns({"end": F.max("b").over(runs_by), "only": F.col("section") == F.max("section").over(runs_by)})
    if not compat:
        found = runs.where("b > a").select("image_id", "a", "b")
    else:
        inner = runs.where("b > a AND NOT only").select("image_id", "a", (F.col("b") - 1).alias("b"))
        tail = runs.groupBy("image_id").agg(F.max("end").alias("end"), F.max(F.when((F.col("b") > F.col("a")) & ~F.col("only"), F.col("b"))).alias("gone"))
        rest = tail.select("image_id", F.coalesce(F.col("gone") + 1, F.lit(0)).alias("a"), (F.col("end") - 1).alias("b"), "gone")
        found = inner.unionByName(rest.where("gone IS NULL OR a <= b").drop("gone"))
    # runs and sections are few to a vertex; each vertex meets the one it is in by the block of its place
    block = 4096
    spans = found.where("b > a").withColumn("section", F.row_number().over(W.partitionBy("image_id").orderBy("a")) - 1).withColumn("_k", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))))
    met = v.drop("section").withColumn("_k", F.floor(F.col("at") / block)).join(spans, ["image_id", "_k"]).where("at BETWEEN a AND b")
    step = distance(F.col("x"), F.col("y"), F.lead("x").over(W.partitionBy("image_id", "section").orderBy("at")), F.lead("y").over(W.partitionBy("image_id", "section").orderBy("at")))
    stepped = met.withColumn("_step", step)
    long = stepped.groupBy("image_id", "section").agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("_length")).where(F.col("_length") >= min_length).drop("_length")
    return stepped.join(long, ["image_id", "section"]).select("image_id", "section", (F.col("at") - F.col("a")).alias("i"), (F.col("b") - F.col("a") + 1).alias("n"), "x", "y")


def _between(rows: DataFrame, index: str, spots: DataFrame, keys: list[str], place: str) -> DataFrame:
    """spots with x and y of rows, linearly between the rows at floor(place) and the next: two equi-joins, so a long line is many tasks."""
    low = F.floor(F.col(place) + 1e-12).cast("bigint")
    s = spots.withColumns({"_lo": low, "_f": F.greatest(F.col(place) - low, F.lit(0.0))})
    a = rows.select(*keys, F.col(index).cast("bigint").alias("_lo"), F.col("x").alias("_x0"), F.col("y").alias("_y0"))
    b = rows.select(*keys, (F.col(index) - 1).cast("bigint").alias("_lo"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    met = s.join(a, [*keys, "_lo"]).join(b, [*keys, "_lo"], "left")
    return met.withColumns({c: F.col(f"_{c}0") + F.when(F.col("_f") > 0, F.coalesce(F.col(f"_{c}1") - F.col(f"_{c}0"), F.lit(0.0)) * F.col("_f")).otherwise(0.0) for c in "xy"}).drop("_lo", "_f", "_x0", "_y0", "_x1", "_y1")


def gaussian(sigma: float) -> list[float]:
    """Weights of the neighbours from -radius to radius, radius int(4 sigma + 0.5)."""
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _mirrored(i: int, n: int) -> int:
    """Place i of a line of n that is mirrored at its ends, the end itself twice."""
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def smooth_sections(sections: DataFrame, sigma: float, window: int | None = None, samples: int = 100) -> DataFrame:
    """(image_id, section, i, x, y) of sections (image_id, section, i, n, x, y), smoothed: a section is sampled at so many even parameters, the samples are averaged with Gaussian weights over the section
    mirrored at its ends, and read again at the vertices' parameters.

    window: instead, three samples around every window-th one are averaged among themselves, three by three, and these are the result. Samples meet vertices by equi-joins on (section, place), and
    the averages are sums over (section, sample), so neither a long section nor one of many is a task of its own."""
    keys, weights = ["image_id", "section"], gaussian(sigma)
    radius, sections = len(weights) // 2, sections.withColumn("i", F.col("i").cast("bigint"))
    heads = sections.where("i = 0").select(*keys, "n")
    spots = heads.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("_at", F.col("j") * (F.col("n") - 1) / F.lit(float(samples - 1)))
    dense = _between(sections, "i", spots, keys, "_at").select(*keys, "n", "j", "x", "y")
    # (from, to, weight): the share that a sample has in each result
    if window is None:
        shares = [(_mirrored(t + k - radius, samples), t, w) for t in range(samples) for k, w in enumerate(weights)]
    else:
        places = [(c - 1 + o, 3 * g + o, c) for g, c in enumerate(range(1, samples - (window - 1), window)) for o in range(3) if c + 1 < samples]
        shares = [(c - 1 + _mirrored(o - (c - 1) + k - radius, 3), to, w) for o, to, c in places for k, w in enumerate(weights)]
    given: dict[int, list] = {}
    for a, b, w in shares:
        given.setdefault(a, []).append((b, w))
    listed = json.dumps([[{"to": b, "w": w} for b, w in given.get(j, [])] for j in range(samples)])
    table = F.from_json(F.lit(listed), "array<array<struct<to: bigint, w: double>>>")
    spread = dense.withColumn("_s", F.explode(F.get(table, F.col("j")))) if radius or window else dense.withColumn("_s", F.struct(F.col("j").cast("bigint").alias("to"), F.lit(1.0).alias("w")))
    mean = cut(spread.groupBy(*keys, F.col("_s.to").alias("i")).agg(*[F.sum(F.col(c) * F.col("_s.w")).alias(c) for c in "xy"]))
    if window is not None:
        return mean.select(*keys, "i", "x", "y")
    back = sections.select(*keys, "i", (F.col("i") * F.lit(float(samples - 1)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("_at"))
    return _between(mean, "i", back, keys, "_at").select(*keys, "i", "x", "y")


#: A square of the tree over an image's places has SPLIT x SPLIT parts. Parts of at most LEAF places, and those of the last of DEEPEST levels, aren't split again.
SPLIT, LEAF, DEEPEST = 4, 16, 15


def _place_tree(places: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes, leaves) by level of places (image_id, idx, x, y), no two of an image in one spot. nodes: (image_id, node, kids), a split square with its parts that hold places and the tight boxes around
    these; leaves: (image_id, node, idx, x, y), the places of parts that aren't split. The next level splits a part's tight box, so empty room takes no levels, and deals only the places of such parts."""
    edges = [f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))]
    rest, nodes, leaves, cell = places.join(places.groupBy("image_id").agg(*edges), "image_id").withColumn("node", F.lit(0).cast("bigint")), [], [], ["image_id", "node"]
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    at = [F.least(F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}0"), side), F.lit(0.0)) * SPLIT), F.lit(SPLIT - 1)) for c in "xy"]
    while True:
        dealt = cut(rest.select("image_id", (F.col("node") * SPLIT * SPLIT + at[0] * SPLIT + at[1]).alias("node"), "idx", "x", "y"))
        parts = cut(dealt.groupBy(cell).agg((F.count("*") > LEAF).alias("split"), *edges))
        last = len(nodes) + 1 == DEEPEST or parts.where("split").isEmpty()
        kid = F.struct("node", (F.lit(False) if last else F.col("split")).alias("split"), "x0", "x1", "y0", "y1")
        nodes.append(cut(parts.groupBy("image_id", F.floor(F.col("node") / (SPLIT * SPLIT)).alias("_n")).agg(F.collect_list(kid).alias("kids")).withColumnRenamed("_n", "node")))
        if last:
            return nodes, [*leaves, dealt]
        rest = dealt.join(parts.where("split"), cell)
        leaves.append(dealt.join(parts.where("NOT split").select(cell), cell, "left_semi"))


def nearest_point(points: DataFrame, refs: DataFrame) -> DataFrame:
    """For each reference (image_id, ref, rx, ry) the nearest point (image_id, idx, x, y) of its image, the smallest idx on ties; references of images without points have none. Where no distance is
    known, for want of coordinates, idx is the image's smallest.

    An image's places are a tree of squares. A reference goes down from the top: of a square's parts it keeps those whose box begins no farther than the nearest box is sure to hold a point, by all squares
    that it is still in. So one far from a dense crowd meets the crowd's near edge alone. Rounds are the tree's levels; squares and references meet in equi-joins."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    images = points.groupBy("image_id").agg(F.min("idx").alias("_first"), F.count_if(both).alias("_n"))
    nodes, leaves = _place_tree(cut(points.where(both).groupBy("image_id", "x", "y").agg(F.min("idx").alias("idx"))))
    own = refs.select("image_id", "ref", F.col("rx").cast("double").alias("rx"), F.col("ry").cast("double").alias("ry"))
    blind = own.join(images, "image_id").where("rx IS NULL OR ry IS NULL OR _n = 0").select("image_id", "ref", F.lit(float("inf")).alias("d"), F.col("_first").alias("idx"))
    who, cell = ["image_id", "ref", "rx", "ry"], ["image_id", "node"]

    def bounded(batches):
        """The parts, a row each, that may hold the nearest point. least is the squared distance of a part's box, and as each side of a box has a point, none of them is farther than most."""
        for b in batches:
            kids, n = b.column("kids").flatten(), b.column("kids").value_lengths().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            k = {f.name: kids.field(f.name).to_numpy(zero_copy_only=False) for f in kids.type}
            near, side, far = {}, {}, {}
            for c in "xy":
                at = b.column(f"r{c}").to_numpy()[row]
                low, high = k[f"{c}0"] - at, at - k[f"{c}1"]
                near[c], side[c], far[c] = (v * v for v in (np.maximum(np.maximum(low, high), 0), np.minimum(np.abs(low), np.abs(high)), np.maximum(np.abs(low), np.abs(high))))
            least, most = near["x"] + near["y"], np.minimum(side["x"] + far["y"], far["x"] + side["y"])
            best = b.column("most").to_numpy().copy()
            np.minimum.at(best, row, most)
            keep = np.flatnonzero(least * (1 - 1e-12) <= best[row])  # roots of unequal squares may be equal
            columns = [b.column(w).take(pa.array(row[keep])) for w in who] + [pa.array(v[keep]) for v in (best[row], least, k["node"], k["split"])]
            yield pa.RecordBatch.from_arrays(columns, names=[*who, "most", "least", "node", "split"])

    ship_package(points.sparkSession)
    kinds = ", ".join(f"`{w}` {own.schema[w].dataType.simpleString()}" for w in who) + ", most double, least double, node bigint, split boolean"
    left, met = own.where("rx IS NOT NULL AND ry IS NOT NULL").withColumns({"node": F.lit(0).cast("bigint"), "most": F.lit(float("inf"))}), [blind]
    for level, (node, leaf) in enumerate(zip(nodes, leaves, strict=True)):
        seen = left.join(node, cell).select(*who, "most", "kids").mapInArrow(bounded, kinds)
        if level:  # by all squares that a reference is in; few parts are left of each
            parts = F.collect_list(F.struct("least", "node", "split"))
            seen = seen.groupBy(who).agg(F.min("most").alias("most"), parts.alias("k")).select(*who, "most", F.inline("k")).where(F.col("least") * (1 - 1e-12) <= F.col("most"))
        if level + 1 < len(nodes):
            seen = cut(seen)
            left = seen.where("split").drop("split", "least")
        met.append(seen.where("NOT split").join(leaf, cell).select("image_id", "ref", distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry")).alias("d"), "idx"))
    every = met[0]
    for m in met[1:]:
        every = every.unionByName(m)
    found = every.groupBy("image_id", "ref").agg(F.min(F.struct("d", "idx")).alias("m"))
    return found.select("image_id", "ref", F.col("m.idx").alias("idx"), F.when(F.col("m.d") < float("inf"), F.col("m.d")).alias("d"))


def prune(points: DataFrame, fraction: float, nearest: bool) -> DataFrame:
    """points (image_id, idx, x, y) with their place by distance from the origin. nearest: without the nearest fraction; else only the farthest
    fraction, descending."""
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    order = W.partitionBy("image_id").orderBy(d.asc() if nearest else d.desc(), "idx")
    ranked = points.withColumns({"place": F.row_number().over(order), "cut": F.floor(F.lit(fraction) * F.count("*").over(W.partitionBy("image_id")))})
    return ranked.where(F.col("place") > F.col("cut") if nearest else F.col("place") <= F.col("cut")).withColumn("place", F.col("place").cast("bigint")).drop("cut")
