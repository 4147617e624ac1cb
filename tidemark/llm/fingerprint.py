"""Document fingerprints: bottom-k sketches of word shingles, mergeable, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.columns import cut, let, parted, shingle_hashes, table, words

#: Words of a shingle, and hashes that a sketch keeps: the standard error of a resemblance r is sqrt(r (1 - r) / K).
SHINGLE, K = 5, 128
#: Documents that one block of neighbours holds on average, and the most blocks, which bounds the table of block heads.
BLOCK, MOST_BLOCKS = 128, 65_536
#: Sampled places a block, and characters of a text that its place looks at.
SAMPLE, PREFIX = 16, 16
#: Repeats of a row that one task writes out.
REPEATS = 10_000


def sketch(text: Column, n: int = SHINGLE, k: int = K) -> Column:
    """The k smallest distinct shingle hashes, ascending; all of them below k. Null and empty texts have the empty sketch."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(words(text), n))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both documents' shingles together, the same as that of one document with all of them."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the merged sketch that both have. Exact while both sets fit their sketches. Two empty
    sketches resemble each other fully, an empty and another not at all."""
    both = F.array_intersect(a, b)
    return let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, both)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: the size below k, else (k - 1) / (part of the hash range up to the kth)."""
    part = (F.get(a, k - 1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Hashes as 16 hexadecimal digits each, one after another."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merge_by(df: DataFrame, key: str, sketch_column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch a key of any number of parts' sketches. The k smallest of a key are taken on the map side before the shuffle and again
    after it, so a hot key costs k rows a task."""
    hashes = df.select(key, F.explode(sketch_column).alias("h"))
    ranked = hashes.groupBy(key, "h").agg(F.lit(1).alias("_")).withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("h")))
    return ranked.where(F.col("_r") <= k).groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch_column))


def place_key(doc_id: Column, text: Column) -> Column:
    """A hexadecimal string in the order of documents: null ids below all others, then ids, then the first characters of the text, then its digest."""
    text = F.coalesce(text, F.lit(""))
    number = F.lpad(F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(doc_id.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), number)), F.hex(F.substring(text, 1, PREFIX).cast("binary")), F.lit("."), F.sha2(text.cast("binary"), 256))


def block_bounds(docs: DataFrame) -> list[str]:
    """Place keys that cut docs into blocks of about BLOCK documents: quantiles of a sample of SAMPLE keys a block, at most MOST_BLOCKS of them."""
    n = docs.count()
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK))
    if blocks == 1:
        return []
    keys = docs.select(place_key(F.col("doc_id"), F.col("text")).alias("k"))
    short = F.concat(F.substring_index("k", ".", 1), F.lit("."), F.substring(F.substring_index("k", ".", -1), 1, 8))
    keys = sorted(r.k for r in keys.sample(False, min(1.0, SAMPLE * blocks / n), 17).select(short.alias("k")).collect())
    return sorted({keys[i * len(keys) // blocks] for i in range(1, blocks)}) if keys else []


def block_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at or below key, by halving; bounds are one constant of the plan."""
    if not bounds:
        return F.lit(0)
    every = F.split(F.lit(",".join(bounds)), ",")
    # the key goes through the accumulator: a lambda that reads a column from outside leaves a constraint that outlives that column
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"), key.alias("key"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc.lo + acc.hi, 1)
        above = F.coalesce(F.get(every, middle) <= acc.key, F.lit(False)) & (acc.lo < acc.hi)
        return F.struct(F.when(above, middle + 1).otherwise(acc.lo).alias("lo"), F.when(above, acc.hi).otherwise(F.least(middle, acc.hi)).alias("hi"), acc.key.alias("key"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, halve, lambda acc: acc.lo)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with sketch, next_text and next_sketch of the document after it in descending doc_id, the first after the last, and times, how many rows a row stands for; and
    a number that no times exceeds. Other columns are left out.

    Documents are cut into blocks of about BLOCK at quantiles of their places, so ids may lie anywhere in the range of bigint. A block also gets a copy
    of the next block's first document, so the neighbour is always found in the block, by one shuffle of the texts. Bounds and heads of blocks
    are at most MOST_BLOCKS short rows, which pass the driver and are broadcast. Equal doc_ids are in descending order of their place keys, which end in a
    digest of the text; null ones come last. Rows that agree in id and text follow one another: one of them, with their number, is placed, so repeats
    never make a block large."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    bounds = block_bounds(docs)
    rows, most = once(docs.withColumn("key", place_key(F.col("doc_id"), F.col("text"))))
    rows = rows.withColumn("block", block_of(F.col("key"), bounds))
    heads = rows.groupBy("block").agg(F.max("key").alias("head"))
    after = W.partitionBy().orderBy(F.col("block").desc())
    chain = heads.select(F.col("block").alias("into"), F.coalesce(F.lead("head").over(after), F.first("head").over(after)).alias("head"))
    ghosts = rows.join(F.broadcast(cut(chain)), F.col("key") == F.col("head")).select("doc_id", "text", "key", "times", F.col("into").alias("block"), F.lit(True).alias("ghost"))
    near = rows.select("doc_id", "text", "key", "times", "block", F.lit(False).alias("ghost")).unionByName(ghosts).repartition("block").withColumn("sketch", sketch(F.col("text")))
    order = W.partitionBy("block").orderBy("ghost", F.col("key").desc())
    found = near.withColumns({"next_text": F.lead(F.coalesce("text", F.lit(""))).over(order), "next_sketch": F.lead("sketch").over(order)}).where(~F.col("ghost"))
    last = found.withColumn("kind", F.explode(F.when(F.col("times") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    inner = F.col("kind") == 1  # all repeats but the last are followed by themselves
    last = last.withColumns({"next_text": F.when(inner, F.coalesce("text", F.lit(""))).otherwise(F.col("next_text")), "next_sketch": F.when(inner, F.col("sketch")).otherwise(F.col("next_sketch"))})
    return last.select("doc_id", "text", "sketch", "next_text", "next_sketch", F.when(inner, F.col("times") - 1).otherwise(F.lit(1)).cast("bigint").alias("times")), most


def once(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (doc_id, text, key) with times, and a number that no times exceeds; of rows that agree in key one stays. Repeats are looked for in hashes of the keys, and only rows that may be
    repeated are grouped, on the map side first."""
    hashed = rows.withColumn("_tm_key", F.xxhash64("key"))
    again = cut(hashed.groupBy("_tm_key").agg(F.count("*").alias("m")).where("m > 1"))
    most = again.agg(F.max("m")).first()[0]
    if most is None:
        return rows.withColumn("times", F.lit(1).cast("bigint")), 1
    again = again.select("_tm_key")
    maybe, sure = parted(hashed, "_tm_key", again, "_tm_key")
    one = maybe.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("times")).select("doc_id", "text", "key", "times")
    return (one if sure is None else one.unionByName(sure.select("doc_id", "text", "key", F.lit(1).cast("bigint").alias("times")))), most


def expanded(rows: DataFrame, most: int) -> DataFrame:
    """rows as often as their times, most at most, says. Only where some exceed REPEATS are rows dealt out anew, in pieces of so many, so that no task writes more of a row."""
    rows = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / F.lit(REPEATS)).cast("bigint"))))
    rows = rows.repartition("doc_id", "_piece") if most > REPEATS else rows
    n = F.least(F.lit(REPEATS).cast("bigint"), F.col("times") - F.col("_piece") * REPEATS)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), n))).drop("_copy", "_piece", "times")


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by as many first ones (or all) of other."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """A row a document. Null texts are empty ones; empty texts have empty sketches, which resemble each other fully. Repeated rows follow one another. Other
    columns are left out; a single document is followed by itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near, most = with_next(docs)
    near = near.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    near = near.select("doc_id", "times", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    a, e, b = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    out = near.select("doc_id", "times", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(e).alias("edited_fingerprint"), resemblance(a, e).alias("near_edited"), resemblance(a, b).alias("near_next"), distinct_shingles(a).alias("n_shingles_estimate"), containment(a, e).alias("contained_in_edited"))
    return expanded(out, most)
