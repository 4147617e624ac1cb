"""Contours in order without a group an image: chains inside tiles, then list ranking by pointer doubling over the chains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.lineage import cut
from tidemark.functions.shipping import ship_package

#: Rows and columns of the tiles whose segments one task chains.
TILE = 256
_CHAINED = "image_id string, head bigint, pos bigint, vertex bigint, tail bigint, least bigint, least_pos bigint"


def vertex_key(r: Column, c: Column) -> Column:
    """A vertex, whose coordinates are multiples of a half, as one number in the order of (r, c)."""
    return F.shiftleft((2 * r).cast("bigint"), 32) + (2 * c).cast("bigint")


def chains(start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """The segments start -> end as chains of their indices, each from where nothing leads to it; closed ones from their smallest start. Starts are distinct, ends too."""
    order = np.argsort(start)
    at = np.minimum(np.searchsorted(start, end, sorter=order), len(start) - 1)
    after = np.where(start[order[at]] == end, order[at], -1).tolist()
    led = np.zeros(len(start), bool)
    led[[a for a in after if a >= 0]] = True
    used, out = np.zeros(len(start), bool).tolist(), []
    for i in [*order[~led[order]].tolist(), *order[led[order]].tolist()]:
        line = []
        while i >= 0 and not used[i]:
            used[i] = True
            line.append(i)
            i = after[i]
        if line:
            out.append(np.array(line))
    return out


def tile_chains(segments: DataFrame, tile: int = TILE) -> DataFrame:
    """A row a segment of segments (image_id, r0, c0, r1, c1): its chain inside its tile, named by the chain's first vertex (head), its place there (pos), its start (vertex), and on a chain's last segment
    where it ends (tail), the chain's smallest vertex and that one's place. A group is a tile, however large the image is."""

    def run(group: pa.Table) -> pa.Table:
        start, end = group.column("a").to_numpy(), group.column("b").to_numpy()
        parts = []
        for line in chains(start, end):
            n, low = len(line), int(start[line].argmin())
            last = np.arange(n) == n - 1
            parts.append((np.full(n, start[line[0]]), np.arange(n), start[line], np.where(last, end[line[-1]], -1), np.where(last, start[line[low]], -1), np.where(last, low, -1)))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.Table.from_arrays([pa.array([group.column("image_id")[0].as_py()] * len(start), pa.string()), *map(pa.array, columns)], names=[f.split()[0] for f in _CHAINED.split(", ")])

    ship_package(segments.sparkSession)
    ends = segments.select(F.col("image_id").cast("string").alias("image_id"), vertex_key(F.col("r0"), F.col("c0")).alias("a"), vertex_key(F.col("r1"), F.col("c1")).alias("b"), *[F.floor(F.least(F.col(f"{x}0"), F.col(f"{x}1")) / tile).alias(f"_t{x}") for x in "rc"])
    return ends.groupBy("image_id", "_tr", "_tc").applyInArrow(run, _CHAINED)


def _doubled(nodes: DataFrame) -> DataFrame:
    """nodes (image_id, head, prev, root, before, low) after pointer doubling: root is the first node of a list, before the length of what comes before a node; nodes whose prev is left are on
    circles, and low is the smallest head there. Each round doubles how far a node has looked; a count and a checksum tell when nothing changes any more."""
    nodes, state = cut(nodes), None
    while True:
        now = tuple(nodes.where("prev IS NOT NULL").agg(F.count("*"), F.sum(F.xxhash64("image_id", "head", "low").cast("decimal(38,0)"))).first())
        if not now[0] or now == state:
            return nodes
        state = now
        back = nodes.select(F.col("image_id").alias("_i"), F.col("head").alias("_h"), F.col("prev").alias("_prev"), F.col("root").alias("_root"), F.col("before").alias("_before"), F.col("low").alias("_low"))
        met = nodes.join(back, (F.col("image_id") == F.col("_i")) & (F.col("prev") == F.col("_h")), "left")
        nodes = cut(met.select("image_id", "head", F.col("_prev").alias("prev"), F.coalesce("_root", "root").alias("root"), (F.col("before") + F.coalesce("_before", F.lit(0))).alias("before"), F.least("low", F.coalesce("_low", "low")).alias("low")))


def ranked_chains(last: DataFrame) -> DataFrame:
    """(image_id, head, root, before) of chains (image_id, head, tail, n): the first chain of a chain's contour, and the segments before it there."""
    tails = last.select(F.col("image_id").alias("_i"), F.col("tail").alias("_tail"), F.col("head").alias("_prev"), F.col("n").alias("_n"))
    linked = last.where("head <> tail").join(tails.where("_tail <> _prev"), (F.col("image_id") == F.col("_i")) & (F.col("head") == F.col("_tail")), "left")
    nodes = linked.select("image_id", "head", F.col("_prev").alias("prev"), F.coalesce("_prev", "head").alias("root"), F.coalesce("_n", F.lit(0)).alias("before"), F.col("head").alias("low"))
    nodes = cut(nodes)
    done = _doubled(nodes)
    round_ = done.where("prev IS NOT NULL").select("image_id", "head", "low")
    if not round_.isEmpty():  # circles are cut at their smallest head and ranked as lists
        opened = nodes.drop("low").join(round_, ["image_id", "head"])
        first = F.col("head") == F.col("low")
        opened = opened.select("image_id", "head", F.when(~first, F.col("prev")).alias("prev"), F.when(first, F.col("head")).otherwise(F.col("root")).alias("root"), F.when(first, 0).otherwise(F.col("before")).alias("before"), "low")
        done = done.where("prev IS NULL").unionByName(_doubled(opened))
    alone = last.where("head = tail").select("image_id", "head", F.col("head").alias("root"), F.lit(0).cast("bigint").alias("before"))
    return done.select("image_id", "head", "root", F.col("before").cast("bigint").alias("before")).unionByName(alone)


def ordered(segments: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, line, seq, r, c): the vertices of the contours of directed segments (image_id, r0, c0, r1, c1) in order, as raster.segments gives them: a vertex has at most one segment that
    leaves it and one that reaches it.

    A line begins where nothing leads to it; a closed one begins, and ends again, at its smallest vertex. Lines are numbered by their smallest vertex, seq goes through all lines of an image. Tiles
    are chained apart; what joins and pointer doubling then handle are chains, some hundred times fewer than vertices, so rounds grow with the logarithm of the tiles a contour crosses. Repeated segments are an
    error of the caller's; an image without segments has no rows."""
    parts = cut(tile_chains(segments, tile))
    last = parts.where("tail >= 0").select("image_id", "head", "tail", (F.col("pos") + 1).alias("n"), "least", "least_pos")
    chained = cut(last.join(ranked_chains(last), ["image_id", "head"]))
    lines = chained.groupBy("image_id", "root").agg(
        F.sum("n").alias("total"), F.bool_or(F.col("tail") == F.col("root")).alias("closed"), F.max_by("tail", "before").alias("end"),
        F.min(F.struct("least", (F.col("before") + F.col("least_pos")).alias("at"))).alias("low"),
    )
    by = W.partitionBy("image_id").orderBy(F.least("low.least", "end"))
    count = F.col("total") + 1
    lines = cut(lines.withColumns({"line": F.row_number().over(by) - 1, "start": F.sum(count).over(by) - count}))
    spot = F.col("before") + F.col("pos")
    placed = parts.join(chained.select("image_id", "head", "root", "before").join(lines, ["image_id", "root"]), ["image_id", "head"])
    own = placed.select("image_id", "line", (F.col("start") + F.when(F.col("closed"), F.pmod(spot - F.col("low.at"), F.col("total"))).otherwise(spot)).alias("seq"), "vertex")
    ends = lines.select("image_id", "line", (F.col("start") + F.col("total")).alias("seq"), F.when(F.col("closed"), F.col("low.least")).otherwise(F.col("end")).alias("vertex"))
    return own.unionByName(ends).select("image_id", "line", "seq", (F.shiftright("vertex", 32) / 2.0).alias("r"), (F.col("vertex").bitwiseAND(F.lit((1 << 32) - 1)) / 2.0).alias("c"))
