"""Text expressions shared by the operators: every helper is Column -> Column and stays in the JVM."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words, as a Java character class.
SPACE = "\\x20\\x09-\\x0D"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where body names it often or inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The maximal runs of characters other than white space; null counts as the empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def window_hashes(word_list: Column, n: int) -> Column:
    """64-bit hashes of all n-word windows in text order; an empty array below n words."""
    return let(
        F.transform(word_list, lambda w: F.xxhash64(w)),
        lambda h: F.when(
            F.size(h) >= n,
            F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def shingle_hashes(word_list: Column, n: int) -> Column:
    """Hashes of the n-word shingles in text order; with fewer words (but one), the whole sequence is the shingle."""
    return let(
        F.transform(word_list, lambda w: F.xxhash64(w)),
        lambda h: F.when(
            F.size(h) >= n,
            F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])),
        )
        .when(F.size(h) > 0, F.array(F.xxhash64(h, F.size(h))))
        .otherwise(F.array().cast("array<bigint>")),
    )


def prepare(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says; a folder of our own only where it says nothing and driver and executors are one process."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoints-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    prepare(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder for tables that live as long as the application; see forget."""
    return f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}/{what}/{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder, checkpoints included. Call it when no result is read any more; caches and
    maps in folders that callers name stay."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    for folder in {f"{shared_folder(spark)}/tidemark-{context.applicationId}", context.getCheckpointDir()} - {None}:
        where = path(folder)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared checkpoint folder; what follows doesn't compute them again."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Slots of the largest filter (a bigint holds 64 of them, so 2^20 rows are broadcast at most), slots a wanted key, and
#: the wanted keys beyond which a filter lets most rows through and isn't worth its broadcast.
MOST_SLOTS, SLOTS_A_KEY, MOST_WANTED = 1 << 26, 8, 1 << 26


def parted(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows of df whose key may be in wanted, rows whose key surely isn't), told without a shuffle of df by a bitmap over hashes of the keys.

    The bitmap has SLOTS_A_KEY slots for each wanted row, which are counted, at most MOST_SLOTS: what is broadcast never exceeds 2^20 rows
    of two numbers. Above MOST_WANTED wanted rows there is no bitmap: all of df may be in wanted, and the second part is None. The
    join that follows is the same in either case. A null key is never wanted."""
    many = wanted.count()
    if many > MOST_WANTED:
        return df, None
    slots = 64
    while slots < min(MOST_SLOTS, many * SLOTS_A_KEY):
        slots *= 2

    def slot(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(slots))

    def bit_of(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), slot(c).bitwiseAND(F.lit(63)).cast("int"))

    bit = bit_of(F.col(wanted_key))
    bits = wanted.where(F.col(wanted_key).isNotNull()).groupBy(F.shiftright(slot(F.col(wanted_key)), 6).alias("_tm_word")).agg(F.bit_or(bit).alias("_tm_bits"))
    mine = bit_of(F.col(key))
    joined = df.join(F.broadcast(bits), F.shiftright(slot(F.col(key)), 6) == F.col("_tm_word"), "left")
    hit = F.coalesce(F.col("_tm_bits").bitwiseAND(mine) != 0, F.lit(False)) & F.col(key).isNotNull()
    return joined.where(hit).select(df.columns), joined.where(~hit).select(df.columns)


def numbered(rows: DataFrame, key: str, number: str) -> DataFrame:
    """rows with a bigint number in the order of doc_id, null ones last, and of key within an id; rows that agree in both share it. key tells rows of one id, or of
    none, apart. Where ids are neither null nor shared by several keys, they are the numbers; else narrow rows are sorted by range and numbered, and
    meet their texts again."""
    names = rows.select(key, "doc_id").distinct()
    if names.where("doc_id IS NULL").isEmpty() and names.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.withColumn(number, F.col("doc_id").cast("bigint"))
    order = [F.col("doc_id").asc_nulls_last(), F.col(key).asc()]
    numbers = cut(names.repartitionByRange(*order).sortWithinPartitions(*order).select(key, F.monotonically_increasing_id().alias(number)))
    return cut(rows.join(numbers.hint("shuffle_hash"), key))
