"""A corpus from raw documents: quality rules, near-duplicate removal, repeated passages, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.columns import cut, numbered, parted, run_folder, table, words
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import ngram_components
from tidemark.llm.pieces import encode_documents
from tidemark.llm.quality import ledger, verdict
from tidemark.llm.substring import dedup_substrings


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _tm_row, what names a row in all stages: a 64-bit hash of its id, which may be null or repeated, and its text. Names that begin with
    _tm_ are the stages' own: a column of docs with such a name is an error."""
    if any(c.startswith("_tm_") for c in docs.columns):
        raise ValueError("column names that begin with _tm_ are taken")
    return docs.withColumn("_tm_row", F.xxhash64("doc_id", "text"))


def _both(sure: DataFrame | None, rest: DataFrame) -> DataFrame:
    return rest if sure is None else sure.unionByName(rest)


def _once(docs: DataFrame, least: int) -> DataFrame:
    """docs with _tm_row; of rows that repeat id and text, the first in the order of their columns if they have least words or more, else all.
    Repeats are told within each task before a shuffle, so one row that is there very often isn't one task."""
    keyed = _keyed(docs)
    again = cut(keyed.groupBy("_tm_row").agg(F.count("*").alias("m")).where("m > 1").select("_tm_row"))
    if again.isEmpty():
        return keyed
    maybe, sure = parted(keyed, "_tm_row", again, "_tm_row")
    long = F.size(words(F.col("text"))) >= least
    one = maybe.where(long).groupBy("_tm_row").agg(F.min(F.struct(*docs.columns)).alias("_tm_first")).select("_tm_first.*", "_tm_row")
    return cut(_both(sure, maybe.where(~long)).unionByName(one))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest policy keeps. Null and empty texts go."""
    kept = ledger(docs.select(F.struct(*docs.columns).alias("_row"), "text")).where(verdict(F.col("fail_bits")))
    return kept.select("_row.*")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group linked by five-word shingle similarities of 0.8 or more. Rows without an id come
    after those with one, rows of one id in the order of their hashes; repeated rows are one. Texts without words stay as they are."""
    keyed = _once(docs, 1)
    sets = ngram_components(keyed.select(F.col("_tm_row").alias("doc_id"), "text"), n=5, num=80, den=100).where("n_shingles > 0")
    sets = cut(sets.select(F.col("doc_id").alias("_tm_row"), "component_id"))
    named = sets.join(keyed.select("_tm_row", F.col("doc_id").alias("_tm_id")), "_tm_row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("_tm_id").isNull(), "_tm_id", "_tm_row")).alias("f")).select("f._tm_row")
    gone = cut(sets.join(first, "_tm_row", "left_anti").select("_tm_row"))
    maybe, sure = parted(keyed, "_tm_row", gone, "_tm_row")
    return _both(sure, maybe.join(gone.hint("shuffle_hash"), "_tm_row", "left_anti")).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of twenty words or more that stand earlier; n_chars follows. A document that loses all words
    goes. Unchanged texts keep their white space. Rows without an id come after those with one, rows of one id in the order of their
    hashes; of repeated rows of twenty words or more one stays."""
    keyed = numbered(_once(docs, 20), "_tm_row", "_tm_number").drop("_tm_row")
    out = dedup_substrings(keyed.select(F.col("_tm_number").alias("doc_id"), "text"), n=20).where("n_removed > 0")
    changed = cut(out.select(F.col("doc_id").alias("_tm_row"), F.col("kept_text").alias("_tm_kept")))
    maybe, sure = parted(keyed.withColumnRenamed("_tm_number", "_tm_row"), "_tm_row", changed, "_tm_row")
    new = maybe.join(changed.hint("shuffle_hash"), "_tm_row", "left").where("_tm_kept IS NULL OR _tm_kept <> ''")
    text = F.coalesce("_tm_kept", "text")
    new = new.withColumn("n_chars", F.when(F.col("_tm_kept").isNull(), F.col("n_chars")).otherwise(F.length("_tm_kept").cast("bigint"))).withColumn("text", text)
    return _both(None if sure is None else sure.select(docs.columns), new.select(docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Rows that share id, text and source are one unit."""
    keyed = _keyed(docs)
    sizes = keyed.select(F.col("_tm_row").alias("doc_id"), "source", F.size(words(F.col("text"))).cast("bigint").alias("size"))
    copies = cut(mix(cut(sizes.groupBy("doc_id", "source").agg(F.sum("size").alias("size")))).where("copies > 0").select(F.col("copies").alias("_tm_copies"), F.col("doc_id").alias("_tm_id"), F.col("source").alias("_tm_source")))
    taken = keyed.join(copies.hint("shuffle_hash"), (F.col("_tm_row") == F.col("_tm_id")) & F.col("source").eqNullSafe(F.col("_tm_source")))
    return taken.withColumn("_tm_copy", F.explode(F.sequence(F.lit(1), "_tm_copies"))).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256), a row a copy; ids are little-endian unsigned 32-bit integers."""
    import public_tokenizers

    out = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_join), ("substring dedup", substring_dedup), ("mixing", mixing), ("SentencePiece", sentencepiece)]

#: SQL has no near-duplicate components, dependent rounding or piece encoding; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
