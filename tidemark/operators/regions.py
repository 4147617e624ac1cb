"""Connected regions of rasters on two levels: inside tiles in NumPy, across tile borders as components of joined runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.functions.shipping import ship_package


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b: bigint), root being the smallest node reachable.

    Each round hangs the larger neighbours of every node on its smallest, then each node's smaller ones likewise, until all is
    stars: about log(nodes) rounds. A hub's neighbours only meet its minimum, one row each; rounds are cut in the shared folder, and a
    count and a checksum, observed while a round is written, are all that comes to the driver."""

    def written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        rows = cut(pairs.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("sum")))
        return rows, (seen.get["n"], seen.get["sum"])

    e, now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    before = None
    while now != before and now[0]:
        before = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # a join of its own, whose hubs Spark can split
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        e, now = written(large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(small.select("hi", F.col("m").alias("lo"))))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


#: Rows and columns of the tiles that are labelled apart.
TILE = 256
_RUNS = "image_id string, r int, c0 int, c1 int, cls int, rr int, rc int"


def _labelled(r: np.ndarray, c: np.ndarray, cls: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """(r, c0, c1, cls, rr, rc) of the runs of one tile's pixels: rows' longest stretches of one class, and the first pixel of the connected region each is in. Runs are found and matched with those of the row below
    in NumPy; only matches are followed one by one."""
    top, left = int(r.min()), int(c.min())
    w = int(c.max()) - left + 1
    grid = np.full((int(r.max()) - top + 1, w + 1), np.iinfo(np.int64).min)
    grid[r - top, c - left] = cls
    flat = grid.ravel()  # a column that belongs to no run ends each row
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    end, value = np.append(start[1:], len(flat)), flat[start]
    real = value != np.iinfo(np.int64).min
    row, c0, c1, value = start[real] // (w + 1), start[real] % (w + 1), (end[real] - 1) % (w + 1), value[real]
    wide = w + 4  # room beside a row, so that reaching out of it meets no other row
    lo = np.searchsorted(row * wide + c1 + 2, (row + 1) * wide + c0 + 2 - reach)
    hi = np.searchsorted(row * wide + c0 + 2, (row + 1) * wide + c1 + 2 + reach, "right")
    n = np.maximum(hi - lo, 0)
    above = np.repeat(np.arange(len(row)), n)
    below = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    same = value[above] == value[below]
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(above[same].tolist(), below[same].tolist(), strict=True):
        p, q = find(i), find(j)
        root[max(p, q)] = min(p, q)
    first = np.array([find(i) for i in range(len(row))], np.int64)
    return row + top, c0 + left, c1 + left, value, row[first] + top, c0[first] + left


def runs(classes: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """(image_id, r, c0, c1, cls, node): the stretches of one class in the rows of each tile of the raster; node numbers the connected region of its tile that a run is in."""

    def label(group: pa.Table) -> pa.Table:
        r, c, v = (group.column(k).to_numpy().astype(np.int64) for k in ("r", "c", "cls"))
        found = _labelled(r, c, v, int(diagonal))
        return pa.Table.from_arrays([pa.array([group.column("image_id")[0].as_py()] * len(found[0]), pa.string()), *[pa.array(x.astype(np.int32)) for x in found]], names=[f.split()[0] for f in _RUNS.split(", ")])

    ship_package(classes.sparkSession)
    kind = classes.schema["image_id"].dataType.simpleString()
    own = classes.select(F.col("image_id").cast("string").alias("image_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("cls").cast("int").alias("cls"))
    found = own.groupBy("image_id", F.floor(F.col("r") / tile).alias("_tr"), F.floor(F.col("c") / tile).alias("_tc")).applyInArrow(label, _RUNS)
    return found.select(F.col("image_id").cast(kind).alias("image_id"), "r", "c0", "c1", "cls", F.xxhash64("image_id", "rr", "rc").alias("node"))


def regions(classes: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """runs with region, which is the same in all runs of a 4-connected region of one class, and the region's size in pixels. diagonal: corners connect, too.

    Two levels: each tile is labelled by itself, then only runs at tile borders meet those across, and components are over the tiles' regions there. Rounds depend on the tiles a region crosses, not on
    its pixels; an image of one tile needs none."""
    reach = int(diagonal)
    found = cut(runs(classes, diagonal, tile))

    def meet(a: DataFrame, b: DataFrame, touch: Column) -> DataFrame:
        x, y = a.alias("a"), b.alias("b")
        return x.join(y, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.cls") == F.col("b.cls")) & touch).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))

    low, high = found.where(F.pmod(F.col("r"), F.lit(tile)) == tile - 1), found.where(F.pmod(F.col("r"), F.lit(tile)) == 0)
    right, left = found.where(F.pmod(F.col("c1"), F.lit(tile)) == tile - 1), found.where(F.pmod(F.col("c0"), F.lit(tile)) == 0)
    down = meet(low, high, (F.col("a.r") + 1 == F.col("b.r")) & (F.col("a.c0") <= F.col("b.c1") + reach) & (F.col("b.c0") <= F.col("a.c1") + reach))
    steps = (-1, 0, 1) if diagonal else (0,)
    across = meet(right.withColumn("_to", F.explode(F.array(*[F.col("r") + d for d in steps]))), left, (F.col("a._to") == F.col("b.r")) & (F.col("a.c1") + 1 == F.col("b.c0")))
    edges = cut(down.unionByName(across).where("a <> b").distinct())
    named = found.withColumn("region", F.col("node"))
    if not edges.isEmpty():
        named = found.join(components(edges), "node", "left").withColumn("region", F.coalesce("root", "node")).drop("root")
    sizes = named.groupBy("region").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("size"))
    return named.join(sizes, "region")


def drop_small(classes: DataFrame, cls: int, least: int) -> DataFrame:
    """classes (image_id, r, c, cls of 0 or 1, ...) in which regions of cls with fewer than least pixels have the other class. Only the runs of
    such regions, not pixels, are joined. The rows given are kept, as regions and join both read them."""
    classes = cut(classes)
    small = regions(classes).where((F.col("cls") == cls) & (F.col("size") < least)).select("image_id", "r", F.explode(F.sequence("c0", "c1")).alias("c"), F.lit(True).alias("_small"))
    joined = classes.join(small, ["image_id", "r", "c"], "left")
    return joined.withColumn("cls", F.when(F.col("_small"), 1 - F.col("cls")).otherwise(F.col("cls"))).select(classes.columns)


def flood_fill(pixels: DataFrame, seeds: DataFrame, column: str, tolerance: float = 0.0, diagonal: bool = True) -> DataFrame:
    """(image_id, seed_r, seed_c, r, c): for each seed (image_id, r, c) the pixels connected to it whose column is within tolerance of the seed's.
    A seed outside its image or on a null fills nothing."""
    at = seeds.select("image_id", F.col("r").alias("seed_r"), F.col("c").alias("seed_c")).distinct()
    spot = pixels.select("image_id", F.col("r").alias("seed_r"), F.col("c").alias("seed_c"), F.col(column).alias("_v"))
    start = at.join(spot, ["image_id", "seed_r", "seed_c"]).withColumn("_fill", F.concat_ws(":", "image_id", "seed_r", "seed_c"))
    near = pixels.join(start.select("image_id", "_fill", "_v"), "image_id").where(F.abs(F.col(column) - F.col("_v")) <= tolerance)
    found = regions(near.select(F.col("_fill").alias("image_id"), "r", "c", F.lit(1).alias("cls")), diagonal).withColumnRenamed("image_id", "_fill")
    hit = found.join(start, "_fill").where((F.col("r") == F.col("seed_r")) & F.col("seed_c").between(F.col("c0"), F.col("c1"))).select("region", "image_id", "seed_r", "seed_c")
    return found.select("region", "r", "c0", "c1").join(hit, "region").select("image_id", "seed_r", "seed_c", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
