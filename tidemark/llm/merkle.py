"""Merkle dataset manifest: one tree a language and one over their roots, built bottom-up into persisted tables, proofs pushed top-down through joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.columns import cut, run_folder, table

#: Children of a node, and levels of the tree that one persisted table holds: a row is a subtree of FAN_OUT ** SPAN bottom nodes at most.
FAN_OUT, SPAN = 2, 8
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The one tree over the roots of the others.
TOP = "top"


def field(value: Column) -> Column:
    """A field as a leaf hashes it: - for null, else its length in UTF-8 bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of texts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(row: dict[str, Column]) -> Column:
    return digest(*[field(row[f]) for f in FIELDS])


def parent(children: Column) -> Column:
    """The digest over an array of digests."""
    return F.sha2(F.array_join(children, "").cast("binary"), 256)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (tree, ...) with pos, their place in their tree from 0 in the given order, and n, the tree's size.

    Rows are sorted by range, so a hot tree spreads over tasks; a task's rows of a tree are numbered as they lie, and the counts of the tasks before are
    added: one narrow row a task and tree, joined, whatever their number."""
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col("tree"), *order, F.col("_tie")]
    lie = cut(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumns({"_at": F.monotonically_increasing_id(), "_task": F.spark_partition_id()}))
    tasks = lie.groupBy("tree", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy("tree").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    tasks = tasks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("n", F.sum("_rows").over(W.partitionBy("tree")))
    out = lie.join(tasks, ["tree", "_task"])
    return out.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before", "_rows", "_task")


def levels(bottom: Column, whole: Column, fan_out: int, span: int) -> Column:
    """The span levels above an array of digests as an array of arrays, bottom first. whole: the array is all of its tree, which then ends with the level of
    one node; levels above that are empty."""

    def above(x: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / fan_out).cast("int"))
        return F.when((F.size(x) == 0) | (whole & (F.size(x) == 1)), F.array().cast("array<string>")).otherwise(F.transform(runs, lambda i: parent(F.slice(x, i * fan_out + 1, fan_out))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(span)), F.array(bottom), lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))


@dataclass
class Manifest:
    """A built dataset manifest: its tables, from the leaves up, of the languages' trees and of the tree over these, and the fan-out and span they have.

    A table is (tree, block, n, whole, levels, top, items): levels are the digests of one subtree, top the digest that stands for it above, n the number of
    its level's nodes in the tree. items, in the lowest table, are the leaves' own data, in order."""

    spark: SparkSession
    folder: str
    steps: int
    top_steps: int
    fan_out: int = FAN_OUT
    span: int = SPAN

    def table(self, kind: str, step: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}-{step}")

    def root(self) -> str | None:
        """The root; None for an empty table."""
        row = self.table("top", self.top_steps - 1).select("top").first() if self.top_steps else None
        return row and row.top


def _grow(spark: SparkSession, nodes: DataFrame, folder: str, kind: str, fan_out: int, span: int) -> int:
    """Writes the tables over nodes (tree, pos, n, digest, item), each from the one below, until every tree is one subtree; returns how many."""
    width, step = fan_out**span, 0
    block = F.floor(F.col("pos") / F.lit(width)).cast("bigint")
    while True:
        held = nodes.groupBy("tree", block.alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", "item"))).alias("_c"))
        held = held.withColumn("whole", F.col("n") <= width).withColumn("levels", levels(F.col("_c.digest"), F.col("whole"), fan_out, span))
        last = F.element_at(F.filter("levels", lambda x: F.size(x) > 0), -1)
        held.select("tree", "block", "n", "whole", "levels", last[0].alias("top"), F.col("_c.item").alias("items")).write.parquet(f"{folder}/{kind}-{step}")
        done = spark.read.parquet(f"{folder}/{kind}-{step}")
        step += 1
        above = done.where(~F.col("whole"))
        if above.isEmpty():
            return step
        fewer = F.ceil(F.col("n") / F.lit(width)).cast("bigint")
        nodes = above.select("tree", F.col("block").alias("pos"), fewer.alias("n"), F.col("top").alias("digest"), F.lit(None).cast(done.schema["items"].dataType.elementType).alias("item"))


def build(docs: DataFrame, items: dict[str, Column], folder: str, fan_out: int = FAN_OUT, span: int = SPAN) -> Manifest:
    """The manifest of docs (doc_id, source, lang, n_chars, text), written to folder; items name further columns of docs that leaves carry.

    Texts are hashed where they are read and never shuffled: from then on a leaf is its digest, its language and its items. Leaves of a language ascend by doc_id, null ones first, those of
    one id by their digests; rows equal in all fields are equal leaves, each with its own place and proof. A table above holds 1 / FAN_OUT ** SPAN of the rows of the one below, so 10^10 leaves take five
    tables and as many joins, and no task holds more than one subtree a row. A null language is a tree of its own, before all others. An empty table has no trees."""
    spark = docs.sparkSession
    tree = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit(""))
    leaves = cut(docs.select(tree.alias("tree"), F.col("doc_id").alias("_id"), leaf({f: F.col(f) for f in FIELDS}).alias("digest"), F.struct(*[v.alias(k) for k, v in items.items()]).alias("item")))
    placed = numbered(leaves, [F.col("_id").asc_nulls_first(), F.col("digest").asc()]).drop("_id")
    steps = _grow(spark, placed, folder, "leaves", fan_out, span)
    made = Manifest(spark, folder, steps, 0, fan_out, span)
    # one row a language: numbered as the leaves are
    roots = subroots(made).select(F.lit(TOP).alias("tree"), F.col("tree").alias("_of"), F.col("top").alias("digest"), F.struct(F.col("tree").alias("of")).alias("item"))
    top = numbered(cut(roots), [F.col("_of").asc()]).drop("_of")
    made.top_steps = _grow(spark, top, folder, "top", fan_out, span)
    return made


def subroots(m: Manifest) -> DataFrame:
    """(tree, top): the root of each language's tree."""
    out = None
    for s in range(m.steps):
        whole = m.table("leaves", s).where("whole").select("tree", "top")
        out = whole if out is None else out.unionByName(whole)
    return out


def _pushed(blocks: DataFrame, fan_out: int, span: int, kept: list[str]) -> DataFrame:
    """blocks with suffix, the proof that their top has, as one row a bottom node: (tree, pos, digest, item, proof, kept...). A node prepends its siblings of each level of
    the block to that suffix; a proof is an array of (place, siblings), place being how many siblings stand to the left."""
    at = F.sequence(F.lit(0), F.size(F.element_at("levels", 1)) - 1)
    each = blocks.select("tree", "block", "levels", "items", "suffix", *kept, F.explode(at).alias("_i"))

    def siblings(k: Column) -> Column:
        mine = F.floor(F.col("_i") / F.pow(F.lit(float(fan_out)), k)).cast("int")
        first = F.floor(mine / fan_out).cast("int") * fan_out
        run = F.slice(F.element_at("levels", k + 1), first + 1, fan_out)
        others = F.filter(run, lambda _, j: j != mine - first)
        return F.struct((mine - first).alias("place"), others.alias("siblings"))

    levels_met = F.transform(F.filter(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.size(F.element_at("levels", k + 2)) > 0), siblings)
    pos = F.col("block") * F.lit(fan_out**span) + F.col("_i")
    return each.select("tree", pos.alias("pos"), F.get(F.element_at("levels", 1), F.col("_i")).alias("digest"), F.get("items", F.col("_i")).alias("item"), F.concat(levels_met, "suffix").alias("proof"), *kept)


def _descend(m: Manifest, kind: str, steps: int, ends: DataFrame, kept: list[str]) -> DataFrame:
    """The bottom nodes of all trees with their proofs. ends: (tree, suffix, kept...), what the root of a tree inherits."""
    down = None
    for s in reversed(range(steps)):
        blocks = m.table(kind, s)
        met = blocks.where("whole").join(ends.withColumnRenamed("tree", "_t"), F.col("tree") == F.col("_t")).drop("_t")
        if down is not None:
            above = down.select(F.col("tree").alias("_t"), F.col("pos").alias("_p"), F.col("proof").alias("suffix"), *kept)
            met = met.unionByName(blocks.where(~F.col("whole")).join(above, (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_p"))).drop("_t", "_p"))
        down = _pushed(met, m.fan_out, m.span, kept)
    return down


PROOF = "array<struct<place: int, siblings: array<string>>>"


def proofs(m: Manifest) -> DataFrame:
    """(tree, pos, digest, item, proof, subroot, root) of every leaf: one join of each persisted table with the proofs of the one above. The proof leads from the leaf
    through its language's root to the root."""
    none = F.array().cast(PROOF)
    start = m.spark.range(1).select(F.lit(TOP).alias("tree"), none.alias("suffix"), F.lit(m.root()).alias("root"))
    langs = _descend(m, "top", m.top_steps, start, ["root"])
    ends = langs.select(F.col("item.of").alias("tree"), F.col("proof").alias("suffix"), F.col("digest").alias("subroot"), "root")
    return _descend(m, "leaves", m.steps, ends, ["subroot", "root"])


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return parent(F.flatten(F.transform(proof, lambda p: p.siblings)))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""

    def up(acc: Column, p: Column) -> Column:
        left, right = F.slice(p.siblings, 1, p.place), F.filter(p.siblings, lambda _, j: j >= p.place)
        return digest(F.array_join(left, ""), acc, F.array_join(right, ""))

    return F.aggregate(proof, start, up)


def changed(old: Manifest, new: Manifest) -> DataFrame:
    """(tree, pos, old, new): the leaves whose digests differ by place between two manifests, null where a side has none. From the top table down, only
    subtrees whose digests differ are opened; a tree of another size is compared from where the smaller one ends."""
    if (old.fan_out, old.span) != (new.fan_out, new.span):
        raise ValueError("manifests of different shapes")
    want, both, width = None, None, old.fan_out**old.span
    none = F.array().cast("array<string>")
    for s in reversed(range(max(old.steps, new.steps))):
        sides = []
        for side, m in (("old", old), ("new", new)):
            t = m.table("leaves", min(s, m.steps - 1)).where(F.lit(s < m.steps)).select("tree", "block", "whole", F.element_at("levels", 1).alias(side))
            opened = t if want is None else t.where("whole").unionByName(t.where(~F.col("whole")).join(want, ["tree", "block"], "left_semi"))
            sides.append(opened.drop("whole"))
        met = sides[0].join(sides[1], ["tree", "block"], "full").select("tree", "block", F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
        each = met.select("tree", "block", F.posexplode(F.arrays_zip("old", "new")).alias("_i", "z"))
        both = cut(each.select("tree", (F.col("block") * width + F.col("_i")).alias("pos"), "z.old", "z.new").where(~F.col("old").eqNullSafe(F.col("new"))))
        want = both.select("tree", F.col("pos").alias("block"))
    return both


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """A row a document. Where 7 divides the unsigned CRC-32 of the decimal doc_id, the tampered leaf has one more in n_chars; a null n_chars stays, a null doc_id is
    never tampered with. Repeated rows are leaves of their own. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    altered = F.when(hit, leaf({f: F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS}))
    made = build(docs, {"doc_id": F.col("doc_id"), "tampered": altered}, run_folder(spark, "merkle"))
    out = proofs(made).withColumn("folded_root", folded(F.coalesce("item.tampered", "digest"), F.col("proof")))
    return out.select("item.doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
