"""Ranked lexical search: shards of the documents indexed as dual-sorted wavelet trees, searched best node first for the exact top k.

A shard's postings lie term after term, each term's by falling impact; their documents form a sequence over which a wavelet tree stands. A node of the tree is a range of
documents, and a term's list is an interval in each node, still by falling impact: its first entry bounds all of the term's impacts below the node, and going down the tree
steers by document."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.shipping import ship_package
from tidemark.llm.columns import cut, run_folder, table

#: What parts terms, as a Java character class: ASCII but digits and letters.
BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_FOLD = bytes(32 if not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(128)) + bytes(range(128, 256))
#: A shard ends with the document that brings its postings to this number, or its documents to the other.
POSTINGS, DOCUMENTS = 1 << 19, 1 << 15
#: Bytes of a text that are split into terms at a time.
SLICE = 1 << 22
#: Hits of a query, queries that go through the index together, and distinct terms of such a block: what is broadcast is bounded by these.
TOP, QUERIES, TERMS = 50, 2_000, 200_000
#: Tree nodes that are opened at a time.
OPENED = 256
INDEX = "ids binary, nulls binary, n_docs int, levels int, bits binary, impacts binary, words binary, starts binary"


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a text in UTF-8."""
    if len(text) <= SLICE:
        return Counter(text.translate(_FOLD).split())
    found, at = Counter(), 0
    while at < len(text):
        piece = text[at : at + SLICE].translate(_FOLD)
        while at + len(piece) < len(text) and b" " not in piece:  # one term fills the slice: take as much more as it needs
            piece += text[at + len(piece) : at + len(piece) + SLICE].translate(_FOLD)
        whole = len(piece) if at + len(piece) == len(text) else piece.rfind(b" ") + 1
        found.update(piece[:whole].split())
        at += whole
    return found


def collection(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, their terms with repeats)."""
    n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BREAK), ""))
    row = docs.select(n.cast("bigint").alias("n")).where("n > 0").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    return row.n_docs, row.n_terms


class Shard:
    """The postings of some documents while they are gathered."""

    def __init__(self) -> None:
        self.number: defaultdict = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.damping: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, counts: Counter, n_docs: int, n_terms: int) -> None:
        self.ids.append(doc_id)
        self.damping.append(50 + 50 * counts.total() * n_docs // n_terms)
        self.terms.append(np.fromiter(map(self.number.__getitem__, counts), np.int64, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.size += len(counts)

    def row(self) -> dict:
        """The shard as a row of the index. Documents are numbered by id, null ones last, so the tree is over doc_id."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, [len(t) for t in self.terms])
        tf = np.concatenate(self.tfs)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(np.array(self.damping, np.int64), [len(t) for t in self.terms]))
        words = sorted(self.number, key=self.number.__getitem__)
        at = np.lexsort((doc, -impact, np.concatenate(self.terms)))
        starts = np.searchsorted(np.concatenate(self.terms)[at], np.arange(len(words) + 1))
        doc, levels = doc[at], max(1, (len(order) - 1).bit_length())
        return {
            "ids": np.array([self.ids[i] or 0 for i in order], np.int64).tobytes(), "nulls": np.packbits([self.ids[i] is None for i in order]).tobytes(), "n_docs": len(order), "levels": levels,
            "bits": b"".join(np.packbits(b).tobytes() for b in level_bits(doc, levels)), "impacts": impact[at].astype(np.int32).tobytes(), "words": b" ".join(words), "starts": starts.astype(np.int32).tobytes(),
        }


def level_bits(doc: np.ndarray, levels: int) -> Iterator[np.ndarray]:
    """The bits of each level of the tree over doc: highest first; a level's zeros go before its ones on the next."""
    for k in reversed(range(levels)):
        bit = (doc >> k) & 1
        yield bit.astype(bool)
        doc = np.concatenate((doc[bit == 0], doc[bit == 1]))


class Tree:
    """A shard's wavelet tree in memory: for each level how many ones stand before each place, where ones begin on the next level, and the impacts in the level's order."""

    def __init__(self, levels: int, bits: bytes, impacts: bytes) -> None:
        root = np.frombuffer(impacts, np.int32).astype(np.float32)  # below 2^20, so exact; one 0 after the last
        self.impacts, self.ones, self.zeros = [np.append(root, np.float32(0))], [], []
        n = len(root)
        wide = (n + 7) // 8
        for k in range(levels):
            bit = np.unpackbits(np.frombuffer(bits, np.uint8, wide, k * wide), count=n).astype(bool)
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(np.int32(n - int(self.ones[-1][-1])))
            above = self.impacts[-1][:-1]
            self.impacts.append(np.concatenate((above[~bit], above[bit], np.zeros(1, np.float32))))

    def search(self, start: np.ndarray, end: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at least the k best documents with scores of least or more, for the lists start to end with weights, all above 0.

        Nodes wait by their bound, the sum of weight times first impact of the lists that reach them. The OPENED best, of any levels, are replaced by their children; a node on the last level is a
        document, whose bound is its score. Nodes below the kth score found so far, or below least, are dropped: no document under them can count."""
        depth = len(self.ones)
        s, e = start[None, :].astype(np.int32), end[None, :].astype(np.int32)
        weight = weight.astype(np.float64) if int(weight.sum()) < 1 << 32 else weight  # below 2^53 doubles are exact, and faster
        level, name = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self._bounds(0, s, e, weight)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            best = np.argpartition(-bound, OPENED)[:OPENED] if len(bound) > OPENED else np.arange(len(bound))
            parts = [[np.delete(x, best, 0)] for x in (s, e, level, name, bound)]
            for lv in np.unique(level[best]):
                at = best[level[best] == lv]
                ones = self.ones[lv]
                s1, e1 = ones[s[at]], ones[e[at]]
                for a, b, bit in ((s[at] - s1, e[at] - e1, 0), (s1 + self.zeros[lv], e1 + self.zeros[lv], 1)):
                    limit = self._bounds(lv + 1, a, b, weight)
                    here, names = limit >= max(least, 1), 2 * name[at] + bit
                    if lv + 1 == depth:
                        docs, scores = np.concatenate((docs, names[here])), np.concatenate((scores, limit[here]))
                    else:
                        for part, x in zip(parts, (a, b, np.full(len(at), lv + 1), names, limit), strict=True):
                            part.append(x[here])
            s, e, level, name, bound = (np.concatenate(p) for p in parts)
            if len(scores) > k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                docs, scores = docs[scores >= least], scores[scores >= least]
            open_ = bound >= least
            s, e, level, name, bound = s[open_], e[open_], level[open_], name[open_], bound[open_]
        return docs, scores

    def _bounds(self, level: int, s: np.ndarray, e: np.ndarray, weight: np.ndarray) -> np.ndarray:
        some = self.impacts[level][s]
        some[e <= s] = 0
        return (some.astype(weight.dtype) @ weight).astype(np.int64)


def write_index(docs: DataFrame, folder: str) -> tuple[int, int]:
    """Writes the index of docs (doc_id, text) to folder and returns (documents with a term, their terms with repeats), on which impacts depend.

    A task cuts the documents it reads into shards as they come, so texts aren't shuffled; a shard is bounded by its postings, but for one document of more. Null texts and texts without terms
    aren't indexed; repeated rows are documents of their own."""
    n_docs, n_terms = collection(docs)

    def run(batches):
        shard = Shard()
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
                counts = term_counts(t.as_py() or b"")
                if counts:
                    shard.add(i, counts, n_docs, n_terms)
                    if shard.size >= POSTINGS or len(shard.ids) >= DOCUMENTS:
                        yield pa.RecordBatch.from_pylist([shard.row()], schema=kinds)
                        shard = Shard()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], schema=kinds)

    kinds = pa.schema([(n, {"binary": pa.binary(), "int": pa.int32()}[k]) for n, k in (f.split() for f in INDEX.split(", "))])
    ship_package(docs.sparkSession)
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, INDEX).write.parquet(folder)
    return n_docs, n_terms


def weight_of(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block(index: DataFrame, queries: dict[int, list[bytes]], n_docs: int, k: int) -> DataFrame:
    """The k best hits of each shard's task for numbered queries: (query, doc_id, score)."""
    spark = index.sparkSession
    wanted = spark.sparkContext.broadcast({t for terms in queries.values() for t in terms})

    def lengths(batches):
        for b in batches:
            for words, starts in zip(b.column("words").to_pylist(), b.column("starts").to_pylist(), strict=True):
                n = np.diff(np.frombuffer(starts, np.int32))
                mine = [(w, int(n[i])) for i, w in enumerate(words.split()) if w in wanted.value]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in mine], pa.binary()), pa.array([d for _, d in mine], pa.int64())], names=["word", "df"])

    df = {bytes(r.word): r.df for r in index.select("words", "starts").mapInArrow(lengths, "word binary, df bigint").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    weights = {w: weight_of(d, n_docs) for w, d in df.items()}
    asked = spark.sparkContext.broadcast({q: [(t, weights[t]) for t in terms if weights.get(t, 0) > 0] for q, terms in queries.items()})

    def hits(batches):
        best: dict[int, list[tuple[int, bool, int]]] = {}
        for b in batches:
            for x in b.to_pylist():
                at = {w: i for i, w in enumerate(x["words"].split()) if w in wanted.value}
                starts, ids = np.frombuffer(x["starts"], np.int32), np.frombuffer(x["ids"], np.int64)
                nulls = np.unpackbits(np.frombuffer(x["nulls"], np.uint8), count=x["n_docs"]).astype(bool)
                tree = Tree(x["levels"], x["bits"], x["impacts"])
                for q, terms in asked.value.items():
                    have = [(at[t], w) for t, w in terms if t in at]
                    if have:
                        n, w = np.array([i for i, _ in have]), np.array([w for _, w in have], np.int64)
                        held = best.setdefault(q, [])
                        docs, scores = tree.search(starts[n], starts[n + 1], w, k, held[-1][0] if len(held) >= k else 1)
                        held.extend(zip(scores.tolist(), nulls[docs].tolist(), ids[docs].tolist(), strict=True))
                        held.sort(key=lambda h: (-h[0], h[1], h[2]))
                        del held[k:]
        rows = [(q, None if null else i, s) for q, held in best.items() for s, null, i in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["query", "doc_id", "score"])

    return index.mapInArrow(hits, "query bigint, doc_id bigint, score bigint")


def search(spark: SparkSession, folder: str, stats: tuple[int, int], queries: DataFrame, key: str, text: str = "text", k: int = TOP) -> DataFrame:
    """(key, rank, doc_id, score): the k highest-scoring documents of the index in folder for each row of queries, fewer where fewer score above 0; equal scores by doc_id, null ones last.

    Queries go through the index in blocks of QUERIES rows and TERMS distinct terms at most, so what is broadcast is bounded and any number of queries is answered. A task keeps k hits a
    query over all its shards, and what it holds already prunes the trees of its next shards. Rows of one key are queries of their own; null texts find nothing."""
    ship_package(spark)
    rows = queries.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    index, out, block, terms = spark.read.schema(INDEX).parquet(folder), None, {}, set()
    keys: dict[int, object] = {}

    def answered() -> None:
        nonlocal out, block, terms
        found = _block(index, block, stats[0], k)
        out = found if out is None else out.unionByName(found)
        block, terms = {}, set()

    for q, r in enumerate(rows.toLocalIterator()):
        mine = sorted(term_counts(r.text.encode()))
        if block and (len(block) >= QUERIES or len(terms.union(mine)) > TERMS):
            answered()
        block[q], keys[q] = mine, r.key
        terms.update(mine)
    if block:
        answered()
    if out is None:
        return rows.limit(0).select(F.col("key").alias(key), F.lit(1).alias("rank"), F.lit(1).cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("score"))
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(keys.items()), f"query bigint, key {rows.schema['key'].dataType.simpleString()}")
    return ranked.join(names, "query").select(F.col("key").alias(key), "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """A row an item and hit, the items of benchmark over all documents. Repeated documents are hits of their own, repeated items queries of their own; items without a term that is
    found give no rows."""
    folder = run_folder(spark, "lexical")
    stats = write_index(table(spark, sf_dir, "documents"), folder)
    return search(spark, folder, stats, table(spark, sf_dir, "benchmark"), "item_id")
