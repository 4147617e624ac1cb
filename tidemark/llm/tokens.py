"""Token counts behind a digest cache: only contents that no earlier run has counted with this tokenizer are encoded."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_package
from tidemark.llm.columns import cut, run_folder, table

CACHE = "digest string, n_tokens bigint, tokenizer string, run string"
#: Contents of more tokens than this are over the limit.
LIMIT = 1024


@lru_cache(maxsize=2)
def encoder(ranks_file: str, pattern: str, special: str):
    """The vocabulary's encoder, one a worker process; special is taken as one token wherever it stands in a text."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: len(ranks)} if special else {})


#: A run of white space, or of anything else, longer than this isn't given to the encoder's regular expression in one piece.
LONG_RUN = 10_000
#: Unicode's white space, as the pattern's engine takes it.
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def encoded_length(e, text: str, special: str, memo: dict) -> int:
    """Tokens of text. The pattern's white space alternative backtracks over the whole run, which its engine gives up on at some 10^6 characters; long
    runs are therefore cut out. A run of white space before anything but the end or the special token gives its last character away to what follows; all before it is a piece of its own
    under the pattern, so the text falls apart there exactly. Such a piece is one word to the merge rules, counted by merging from the bottom in NumPy."""
    total, at = 0, 0
    for m in _LONG.finditer(text):
        a, b = m.span()
        b = b if b == len(text) or (special and text.startswith(special, b)) else b - 1
        total += len(e.encode(text[at:a], allowed_special="all")) + piece_length(e, text[a:b], memo)
        at = b
    return total + len(e.encode(text[at:], allowed_special="all"))


def piece_length(e, piece: str, memo: dict) -> int:
    """Tokens of one piece under the merge rules: while any neighbours merge, all those of the lowest rank do, from left to right."""
    found = memo.get(piece)
    if found is None:
        ranks, ids = e._mergeable_ranks, np.frombuffer(piece.encode(), np.uint8)
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        bytes_of = {v: k for k, v in ranks.items()}
        ids = single[ids]
        while len(ids) > 1:
            pairs, where = np.unique(ids[:-1] * (1 << 32) + ids[1:], return_inverse=True)
            rank = np.array([ranks.get(bytes_of[int(p) >> 32] + bytes_of[int(p) & 0xFFFFFFFF], -1) for p in pairs])
            if (rank < 0).all():
                break
            least = np.where(rank < 0, np.iinfo(np.int64).max, rank).argmin()
            at = np.flatnonzero(where == least)
            if pairs[least] >> 32 == pairs[least] & 0xFFFFFFFF:  # runs of one id: every second place of each run
                fresh = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                begin = np.repeat(at[fresh], np.diff(np.append(fresh, len(at))))
                at = at[(at - begin) % 2 == 0]
            ids = ids.copy()
            ids[at] = rank[least]
            ids = np.delete(ids, at + 1)
        found = memo[piece] = len(ids)
        if len(memo) > 64:
            memo.clear()
    return found


def version(ranks_file: str, pattern: str, special: str) -> str:
    """Digest of all that decides a count."""
    with open(ranks_file, "rb") as f:
        return hashlib.sha256(f.read() + pattern.encode() + b"\0" + special.encode()).hexdigest()


def read_cache(spark, folder: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer's part of the cache, the only part that is read; empty where there is none yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(folder).where(F.col("tokenizer") == tokenizer)
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], "digest string, n_tokens bigint")
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, folder: str, ranks_file: str, pattern: str, special: str = "") -> DataFrame:
    """docs' doc_id with n_bytes, digest and n_tokens.

    Content is normalised in so far as a null text is the empty one; anything more would change counts. The digests, one short row a document,
    are joined to the cache in folder, which is partitioned by tokenizer and run and read once; of the contents it lacks, the row of the smallest doc_id of
    each is encoded and appended as this run's part. The text is
    shuffled once, by doc_id and digest, so that copies of one text, however many, spread; the missing side is hashed in the join, texts are
    not sorted, and a task encodes a content once, however many rows without an id or of one id have it. Appends of other runs that were lost cost
    another encoding; should this run's own be incomplete, reading the result fails rather than leave a document out. Extra columns are
    left out; repeated rows come out as often as they are there, null ids too."""
    spark, name = docs.sparkSession, version(ranks_file, pattern, special)
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    digests = cut(rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest"))
    each = cut(digests.groupBy("digest").agg(F.min("doc_id").alias("_doc")).join(read_cache(spark, folder, name), "digest", "left"))
    missing = each.where("n_tokens IS NULL").select(F.col("digest").alias("_digest"), "_doc")

    def encode(batches):
        e, seen, memo = encoder(ranks_file, pattern, special), set(), {}
        for b in batches:
            fresh = []
            for i, d in enumerate(b.column("digest").to_pylist()):
                if d not in seen:
                    seen.add(d)
                    fresh.append(i)
            b = b.take(pa.array(fresh, pa.int64()))
            n = [encoded_length(e, x, special, memo) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    first = rows.join(missing.hint("shuffle_hash"), (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    mine = f"{folder}/tokenizer={name}/run={uuid.uuid4().hex}"
    first.select("digest", "text").mapInArrow(encode, "digest string, n_tokens bigint").write.parquet(mine)
    fresh = spark.read.schema("digest string, n_tokens bigint").parquet(mine).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = each.where("n_tokens IS NOT NULL").select("digest", "n_tokens").unionByName(fresh)
    whole = F.coalesce("n_tokens", F.raise_error(F.concat(F.lit("no token count for "), "digest")).cast("bigint"))
    return digests.join(counts, "digest", "left").select("doc_id", "n_bytes", "digest", whole.alias("n_tokens"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Starts from a new cache, so that each call counts every distinct text of the table. Null and empty texts have no tokens."""
    import public_tokenizers

    got = count_tokens(table(spark, sf_dir, "documents"), run_folder(spark, "token-counts"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "<|endoftext|>")
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
