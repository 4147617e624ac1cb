"""Mixing sources to target weights: whole copies from the rate, the rest by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.columns import cut, table, words

#: No document is taken more often than this.
MOST_COPIES = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Units that one node of the reduction tree rounds, on average.
FAN_IN = 64
#: Units that the last node of a group rounds at most, besides the spare ones.
LAST = 256
#: Units of a group, on average, that no level rounds before the last: of all sizes, they make up for what the residuals leave.
SPARE = 192


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS) -> DataFrame:
    """A row a source: source, source_size, target. All sizes are shared by weight; no target exceeds MOST_COPIES times its source's
    size, and the excess goes to the others by weight, again and again, until none is above.

    That fixed point is read off directly: with the sources in order of cap / weight, a prefix of them is capped, and the others share
    what is left by weight. Works on one row a source. Sources of size 0 get 0."""
    by = sizes.groupBy(source).agg(F.sum(size).cast("bigint").alias("source_size"))
    order = W.orderBy(F.col(source).asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by.withColumn("_w", F.get(pattern, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int"))).withColumn("_cap", (F.col("source_size") * MOST_COPIES).cast("double"))
    every = W.partitionBy()
    steps = W.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last())
    before = steps.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_total", F.sum("source_size").over(every).cast("double"))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weight_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_open", F.col("_cap") * F.col("_weight_left") > F.col("_left") * F.col("_w"))
        .withColumn("_level", F.min_by(F.col("_left") / F.col("_weight_left"), F.when(F.col("_open"), F.col("_cap") / F.col("_w"))).over(every))
    )
    share = F.least(F.col("_cap"), F.col("_w") * F.coalesce(F.col("_level"), F.lit(float("inf"))))
    return ranked.select(source, "source_size", share.alias("target"))


def _fight(a: Column, b: Column, draw: Column) -> Column:
    """One pivotal step between units a and b (structs with size and p): words move from one to the other, either way and fairly in
    expectation, until one of the two probabilities is 0 or 1; p times size summed over both stays. Returns (done, rest)."""
    a_room, a_mass = (1.0 - a.p) * a["size"], a.p * a["size"]
    b_room, b_mass = (1.0 - b.p) * b["size"], b.p * b["size"]
    up, down = F.least(a_room, b_mass), F.least(a_mass, b_room)
    rises = draw * (up + down) < down
    a_done = F.when(rises, a_room <= b_mass).otherwise(a_mass <= b_room)
    one, none = F.lit(1.0), F.lit(0.0)
    a_p = F.when(rises, a.p + up / a["size"]).otherwise(a.p - down / a["size"])
    b_p = F.when(rises, b.p - up / b["size"]).otherwise(b.p + down / b["size"])
    done = F.when(a_done, a.withField("p", F.when(rises, one).otherwise(none))).otherwise(b.withField("p", F.when(rises, none).otherwise(one)))
    rest = F.when(a_done, b.withField("p", b_p)).otherwise(a.withField("p", a_p))
    return F.struct(done.alias("done"), rest.alias("rest"))


def _round_node(units: Column, seed: int) -> Column:
    """Sequential pivotal rounding of one node's units: all but at most one become 0 or 1; that one goes on to the next level."""
    start = F.struct(F.get(units, 0).alias("rest"), F.slice(units, 1, 0).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        settled = (acc.rest.p < 1e-9) | (acc.rest.p > 1.0 - 1e-9)
        draw = (F.pmod(F.xxhash64(F.lit(seed), acc.rest.id, acc.rest.twin, acc.rest["size"], x.id, x.twin, x["size"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        duel = _fight(acc.rest, x, draw)
        sure = acc.rest.withField("p", F.round(acc.rest.p))
        return F.when(settled, F.struct(x.alias("rest"), F.concat(acc.done, F.array(sure)).alias("done"))).otherwise(F.struct(duel.rest.alias("rest"), F.concat(acc.done, F.array(duel.done)).alias("done")))

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def _last_node(r: Column) -> Column:
    """The units of a group's last node, all decided: the residual goes to the nearer end, and from the largest to the smallest, each
    other unit of this node changes sides where that brings the words nearer to their due."""
    end = F.when(r.rest.p >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))

    def mend(acc: Column, d: Column) -> Column:
        change = F.when(d.p > 0.5, -d["size"]).otherwise(d["size"]).cast("double")
        flips = F.abs(acc.err + change) < F.abs(acc.err)
        unit = d.withField("p", F.when(flips, 1.0 - d.p).otherwise(d.p))
        return F.struct(F.when(flips, acc.err + change).otherwise(acc.err).alias("err"), F.concat(acc.done, F.array(unit)).alias("done"))

    start = F.struct(((end - r.rest.p) * r.rest["size"]).alias("err"), F.array(r.rest.withField("p", end)).alias("done"))
    return F.aggregate(F.sort_array(r.done, asc=False), start, mend, lambda acc: acc.done)


def pivotal(units: DataFrame, group: str, seed: int) -> DataFrame:
    """units (group, id, twin, size, p with 0 < p < 1) with p rounded to 0 or 1: (group, id, twin, size, copies). Id, twin and size tell the units of a group apart.

    Each level deals the units of a group, those of like size together, into nodes of about FAN_IN units by a hash of their id; a node
    rounds all but one. Those residuals, 1 / FAN_IN of the units, form the next level until a group has one node; see _last_node. Each
    group ends at the level where one node holds all its units, LAST or fewer, whatever the others have; at the first level too. About
    SPARE units, half at most, of a group of more than LAST, drawn by a hash, wait for that last node.
    No node grows with the data, the levels with its logarithm; a hot group only has more nodes. The words taken in a group differ from the
    sum of p times size by less than one document, the last. Draws are hashes of seed and ids, so reruns agree."""
    sizes = units.groupBy(group).agg(F.count("*").alias("_n"))
    share = F.when(F.col("_n") > LAST, F.least(F.lit(0.5), F.lit(float(SPARE)) / F.col("_n"))).otherwise(F.lit(0.0))
    draw = (F.pmod(F.xxhash64(F.lit(seed - 1), "id", "twin", "size"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    marked = units.join(sizes.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).withColumn("_wait", draw < share).select(*units.columns, "_wait")
    spare = cut(marked.where("_wait").drop("_wait"))
    out, level, now = None, 0, marked.where(~F.col("_wait")).drop("_wait")
    while True:
        band = F.floor(F.log2(F.col("size") + 1) * 2).cast("int") if level == 0 else F.lit(0)
        now = now.withColumn("_band", band)
        nodes = now.groupBy(group, "_band").agg(F.count("*").alias("_units"))
        nodes = nodes.withColumn("_last", F.sum("_units").over(W.partitionBy(group)) <= LAST).withColumn("_nodes", F.ceil(F.col("_units") / F.lit(FAN_IN))).drop("_units")
        key = F.pmod(F.xxhash64(F.lit(seed + level), "id", "twin", "size"), F.col("_nodes"))
        joined = now.join(nodes.withColumnRenamed(group, "_g").withColumnRenamed("_band", "_b"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_band") == F.col("_b"))).drop("_g", "_b")
        ending = nodes.where("_last").select(F.col(group).alias("_g")).distinct()
        late = spare.join(ending, F.col(group).eqNullSafe(F.col("_g")), "left_semi")
        joined = joined.unionByName(late.withColumns({"_band": F.lit(0), "_last": F.lit(True), "_nodes": F.lit(1).cast("bigint")}))
        dealt = joined.groupBy(group, F.when(~F.col("_last"), F.col("_band")).alias("_band"), "_last", F.when(~F.col("_last"), key).alias("_node")).agg(F.sort_array(F.collect_list(F.struct("size", "id", "twin", "p"))).alias("u"))
        rounded = cut(dealt.select(group, "_last", _round_node(F.col("u"), seed + level).alias("r")))
        settled = rounded.select(group, F.explode(F.when(F.col("_last"), _last_node(F.col("r"))).otherwise(F.col("r.done"))).alias("d")).select(group, "d.id", "d.twin", "d.size", F.col("d.p").cast("int").alias("copies"))
        out = settled if out is None else out.unionByName(settled)
        now = rounded.where(~F.col("_last")).select(group, "r.rest.id", "r.rest.twin", "r.rest.size", "r.rest.p")
        if now.isEmpty():
            return out
        level += 1


#: Equal rows that one task numbers.
REPEATS = 10_000


def told_apart(rows: DataFrame) -> DataFrame:
    """rows with _twin, a number from 1 among equal rows. Equal rows are counted, on the map side first, and written out anew, REPEATS a task, so a row that is
    there very often, such as rows without an id, isn't one task."""
    counted = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("_m")))
    few, many = counted.where(F.col("_m") <= REPEATS), counted.where(F.col("_m") > REPEATS)
    first = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_m") - 1) / F.lit(REPEATS)).cast("bigint"))
    few = few.withColumn("_twin", F.explode(F.sequence(F.lit(1).cast("bigint"), "_m")))
    pieces = many.withColumn("_piece", F.explode(first)).repartition("_piece").withColumn("_from", F.col("_piece") * REPEATS + 1)
    many = pieces.withColumn("_twin", F.explode(F.sequence("_from", F.least(F.col("_m"), F.col("_from") + REPEATS - 1)))).drop("_piece", "_from")
    return few.unionByName(many).drop("_m")


def mix(sizes: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", seed: int = 7) -> DataFrame:
    """(key, source, size) with source_size, target, copies and taken (copies times size).

    A source's rate is target / source_size. Every document gets the whole part of its rate; the fraction is decided by pivotal
    rounding. Rows that agree in key, source and size are told apart by a number among them. Empty documents are taken 0 times their
    size. An empty table gives an empty one. Other columns, of types that can be grouped by, stay; those of sizes with the new names are replaced."""
    others = [c for c in sizes.columns if c not in (key, source, size, "source_size", "target", "copies", "taken")]
    unit = F.struct(key, *others) if others else F.col(key)
    sizes = sizes.select(unit.alias("_key"), F.col(source).alias("_src"), F.col(size).alias("_size"))
    goals = targets(sizes, "_src", "_size").withColumnRenamed("_src", "_of")
    rows = told_apart(sizes).join(goals, F.col("_src").eqNullSafe(F.col("_of"))).drop("_of")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rows = rows.withColumn("_whole", F.floor(rate + 1e-9).cast("int")).withColumn("_p", F.greatest(rate - F.col("_whole"), F.lit(0.0)))
    rows = cut(rows)
    units = rows.where((F.col("_p") > 1e-9) & (F.col("_size") > 0)).select(F.col("_src").alias("_grp"), F.col("_key").alias("id"), F.col("_twin").alias("twin"), F.col("_size").alias("size"), F.col("_p").alias("p"))
    more = pivotal(units, "_grp", seed).select("_grp", F.col("id").alias("_id"), F.col("twin").alias("_tw"), F.col("size").alias("_sz"), F.col("copies").alias("_more"))
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_twin") == F.col("_tw")) & (F.col("_size") == F.col("_sz")) & F.col("_src").eqNullSafe(F.col("_grp"))
    copies = F.col("_whole") + F.coalesce("_more", F.lit(0))
    done = rows.join(more, same, "left").withColumn("copies", copies)
    named = [F.col("_key")[c].alias(c) for c in (key, *others)] if others else [F.col("_key").alias(key)]
    return done.select(*named, F.col("_src").alias(source), F.col("_size").alias(size), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).cast("bigint").alias("taken"))


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """A row a source of the whole table: its words and the words that the mix should take from it."""
    sizes = table(spark, sf_dir, "documents").select("source", F.size(words(F.col("text"))).cast("bigint").alias("size"))
    return targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """A row a document. Documents of equal size are told apart by id, repeated rows by a number among them; null texts have size 0 and are taken 0 times
    their size."""
    sizes = cut(table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size")))
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
