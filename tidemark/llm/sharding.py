"""Sharding by fixed virtual slots: records hash into slots, a versioned map sends slots to shards, rebalancing edits the map."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.columns import cut, run_folder, table

#: Virtual slots; fixed for the life of a data set.
SLOTS = 16384
#: Rows that one task numbers in a row, and how many parts slots are cut into beyond one each.
PIECE, MOST_PIECES = 100_000, 1 << 18


def slot_of(*keys: Column) -> Column:
    """The virtual slot of a key; records whose keys are all null share one."""
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def first_map(shards: int) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [s % shards for s in range(SLOTS)]


def rebalanced(owner: list[int], load: dict[int, int], shards: int) -> list[int]:
    """An edit of owner after which the shards' loads are near equal; slots that needn't move stay.

    Again and again the fullest shard gives the emptiest the slot, or swaps with it the pair of slots, that comes nearest to half
    their difference, until no such move narrows the gap. Reads one number a slot."""
    own = list(owner)
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    for s, k in enumerate(own):
        if load.get(s, 0):
            held[k][s] = load[s]
    total = [sum(h.values()) for h in held]
    for _ in range(4 * SLOTS):
        top, low = max(range(shards), key=lambda k: (total[k], -k)), min(range(shards), key=lambda k: (total[k], k))
        half = (total[top] - total[low]) / 2
        if half < 1 or half * 20_000 * shards < sum(total):
            break
        best = min(held[top], key=lambda s: (abs(held[top][s] - half), s))
        move, back = held[top][best], None
        if abs(move - half) > half / 8:
            small = sorted((v, s) for s, v in held[low].items())
            for s, v in held[top].items():
                want = v - half
                i = next_at(small, want)
                for j in (i - 1, i):
                    if 0 <= j < len(small) and abs(v - small[j][0] - half) < abs(move - half):
                        best, back, move = s, small[j][1], v - small[j][0]
        if not 0 < move < 2 * half:
            break
        held[low][best] = held[top].pop(best)
        own[best] = low
        if back is not None:
            held[top][back] = held[low].pop(back)
            own[back] = top
        total[top], total[low] = total[top] - move, total[low] + move
    return own


def next_at(pairs: list, value: float) -> int:
    from bisect import bisect_left

    return bisect_left(pairs, (value,))


def grown(owner: list[int], shards: int) -> list[int]:
    """An edit for one shard more: every shard gives its last slots, an equal share, to the new one; no slot moves elsewhere."""
    give, own = SLOTS // (shards + 1), list(owner)
    mine: dict[int, list[int]] = {}
    for s, k in enumerate(owner):
        mine.setdefault(k, []).append(s)
    for i in range(give):
        k = i % shards
        if mine.get(k):
            own[mine[k].pop()] = shards
    return own


def resized(owner: list[int], shards: int) -> list[int]:
    """An edit of owner for another number of shards: new ones take an equal share each, slots of shards that go are dealt to those that stay."""
    own, have = list(owner), max(owner) + 1
    for k in range(have, shards):
        own = grown(own, k)
    return [k if k < shards else s % shards for s, k in enumerate(own)]


def store(folder: str, version: int, owner: list[int], spark: SparkSession) -> None:
    """Writes a version of the map, SLOTS rows; written again after a failure, it is replaced."""
    spark.createDataFrame(list(enumerate(owner)), "slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")


def versions(spark: SparkSession, folder: str) -> DataFrame | None:
    """(version, slot, shard) of all whole versions in folder; None if there is none."""
    try:
        stored = spark.read.parquet(folder).select(F.col("version").cast("int").alias("version"), "slot", "shard")
    except AnalysisException:  # no such folder, or nothing in it
        return None
    whole = stored.groupBy("version").agg(F.count_distinct("slot").alias("n")).where(F.col("n") == SLOTS).drop("n")
    return None if whole.isEmpty() else stored.join(F.broadcast(whole), "version")


def newest(spark: SparkSession, folder: str) -> tuple[int, list[int]] | None:
    """(version, shard of each slot) of the newest whole version."""
    stored = versions(spark, folder)
    if stored is None:
        return None
    rows = stored.join(stored.agg(F.max("version").alias("version")), "version").orderBy("slot").collect()
    return rows[0].version, [r.shard for r in rows]


def bytes_by_slot(df: DataFrame, keys, size: str) -> dict[int, int]:
    """At most SLOTS sums, whatever the rows."""
    got = df.groupBy(slot_of(*keys).alias("s")).agg(F.sum(size).alias("b")).collect()
    return {r.s: r.b for r in got}


def place(df: DataFrame, owner: DataFrame, keys) -> DataFrame:
    """df with vslot, shard and slot: the row's place in its shard, without gaps from 0.

    Rows are numbered in pieces: a virtual slot, of which there are thousands, or a hashed part of one that holds many rows, so no task sorts a
    shard or a hot key. The pieces' row counts, summed over those before in the shard, are added. The map has SLOTS rows, the
    table of pieces at most MOST_PIECES more, whatever the rows; both are broadcast. df should be a table whose rows come out in one order, such as a checkpoint: equal rows
    are dealt to pieces by their position. Columns of df with these names are replaced."""
    df = df.drop("vslot", "shard", "slot")
    rows = df.withColumn("vslot", slot_of(*keys))
    n = df.count()
    held = rows.groupBy("vslot").agg(F.count("*").alias("_rows"))
    owner = held.join(F.broadcast(owner.select(F.col("slot").alias("vslot"), "shard")), "vslot")
    cuts = cut(owner.select("vslot", "shard", F.ceil(F.col("_rows") / F.lit(float(max(PIECE, n // MOST_PIECES)))).cast("int").alias("_cuts")))
    dealt = rows.join(F.broadcast(cuts), "vslot").withColumn("_piece", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_cuts")).cast("int")).drop("_cuts")
    counts = dealt.groupBy("shard", "vslot", "_piece").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(W.partitionBy("shard").orderBy("vslot", "_piece")) - F.col("_n")
    starts = counts.select(F.col("vslot").alias("_v"), F.col("_piece").alias("_p"), start.alias("_start"))
    order = [*keys, *[F.col(c) for c in df.columns]]
    number = F.row_number().over(W.partitionBy("vslot", "_piece").orderBy(*order))
    out = dealt.withColumn("_i", number).join(F.broadcast(starts), (F.col("vslot") == F.col("_v")) & (F.col("_piece") == F.col("_p")))
    return out.withColumn("slot", F.col("_start") + F.col("_i") - 1).drop("_i", "_start", "_v", "_p", "_piece")


def spread(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df with _again: 0 in the first row that a task has of a key, else a number that tells the others apart. With it as one more key, rows that are there very
    often go to many slots, which is what lets their bytes be dealt evenly. df must be a checkpoint: rows are told apart by their position, a task's rows of one key at a time."""
    at = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33))
    rank = F.row_number().over(W.partitionBy("_task", *keys).orderBy("_at"))
    return at.withColumn("_again", F.when(rank == 1, F.lit(0).cast("bigint")).otherwise(F.xxhash64("_task", rank))).drop("_at", "_task")


def shard_records(df: DataFrame, key, size: str, shards: int, folder: str | None = None) -> DataFrame:
    """df with vslot, shard and slot under the law of near-equal bytes. key is a column or several; the first record that an input split holds of a key goes to the
    key's slot, further ones spread over all slots, so the law holds for repeated rows too.

    The map is read from folder, or begins as version 0, which deals the slots in turn. Its newest version is edited for the bytes that the slots
    hold now, and for another number of shards; if that changes it, the edit is stored as the next version. Rows are placed by the version as it is
    stored. Calling again with the same rows changes nothing. Equal rows are numbered one after another, null keys hash like others."""
    spark = df.sparkSession
    folder = folder or run_folder(spark, "slot-maps")
    keys = [F.col(k) for k in ([key] if isinstance(key, str) else key)]
    if "_again" in df.columns:
        raise ValueError("the column name _again is taken")
    df = cut(spread(cut(df), keys))
    keys = [*keys, F.col("_again")]
    found = newest(spark, folder)
    if found is None:
        found = 0, first_map(shards)
        store(folder, 0, found[1], spark)
    version, owner = found
    edit = rebalanced(resized(owner, shards), bytes_by_slot(df, keys, size), shards)
    if edit != owner:
        version += 1
        store(folder, version, edit, spark)
    return place(df, versions(spark, folder).where(F.col("version") == version), keys).drop("_again")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Null texts have no bytes; their rows still take 8. Rows are hashed by id and text digest; repeats of both spread, see spread."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard_records(docs, ("doc_id", "text_crc32"), "size", 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


def shard_totals(spark, sf_dir: str) -> DataFrame:
    """One row that sums op9 up: rows, bytes, shards, whether slots have no gaps, and whether shards differ by no more than 1 % of their mean and the largest
    virtual slot, the least that can move."""
    rows = cut(op9_sharding(spark, sf_dir).select("shard", "size", "slot", "virtual_slot"))
    largest = rows.groupBy("virtual_slot").agg(F.sum("size").alias("v")).agg(F.coalesce(F.max("v"), F.lit(0))).first()[0]
    by = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d"))
    gapless = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))
    near = F.max("b") - F.min("b") <= 0.01 * F.avg("b") + largest
    return by.agg(F.sum("n").alias("n_rows"), F.sum("b").alias("bytes"), F.count("*").alias("shards"), F.bool_and(gapless).alias("gapless"), near.alias("near_equal"))
