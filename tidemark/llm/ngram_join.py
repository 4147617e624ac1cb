"""N-gram Jaccard join: the product of the document by n-gram incidence matrix with itself, in blocks.

Rows are the different shingle sets, columns the shingles. A pair of rows with similarity t or more differs in at most
(1 - t) / (1 + t) times its sizes' sum of columns. So columns are dealt by hash into one block more than that bound for the rows' size
band, and rows of such a pair agree on a whole block; a row's parts in the blocks are its signatures. Rows that share no
signature are discarded by this bound and never multiplied. The others form clusters, whose products are summed up over dense column blocks."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.shipping import ship_package
from tidemark.llm.columns import cut, parted, table
from tidemark.llm.graph import components
from tidemark.llm.textscan import PACKED, U, mix, packed, parts_for, scan, set_key, shingle_sets, stream, unpacked

#: Signatures of a row and band where not all are shown. Rows with more blocks show the first of them, rows with fewer deal their columns anew until they
#: have as many. A block stays untouched with a chance of 1 / e at least, so a pair at the very threshold is missed with a chance
#: below 0.64 ** 64, 4e-13: that of equal hashes of different shingles somewhere in a table of this kind.
SIGNATURES = 64
#: Signatures of a row and band at least, where all blocks are shown.
LEAST_SHOWN = 24
#: Where the bound leaves a block fewer shingles than this (thresholds below 0.88), texts that only share a common sentence would agree on some
#: block. Then a signature is the content of two neighbouring blocks, and there are three times as many: two neighbours both stay untouched among
#: 129 but for a chance of 4e-7 at the very threshold, among half as many again but for 3e-10. Rows of few blocks keep single ones.
LEAST_GRAMS, FEW_BLOCKS = 8, 6
#: Rows of a product's block, and columns.
ROWS, COLUMNS = 256, 8192

ENTRY = np.dtype([("sig", "<u8"), ("row", "<i8"), ("size", "<i4")])
_SALT = stream(71, 4 * SIGNATURES)


@lru_cache(maxsize=8)
def bands(num: int, den: int, upto: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the size bands, each reaching num / den of the next, and each band's number of column blocks."""
    low = [1]
    while low[-1] < upto:
        low.append(max(low[-1] + 1, -(-low[-1] * den // num)))
    high = np.array(low[1:]) - 1
    return np.array(low[:-1]), (den - num) * 2 * high // (den + num) + 1


def neighbours(num: int, den: int) -> int:
    """Blocks that one signature covers."""
    return 1 if (den + num) >= 2 * LEAST_GRAMS * (den - num) else 2


def signatures(s: np.ndarray, num: int, den: int, exact: bool = False) -> np.ndarray:
    """The signatures of a shingle set in its own band and, where a larger partner can be in the next band, there too; exact: all single
    blocks, of which a linked pair always shares one. That one shows nothing if both have no shingle in it; rows of few blocks, where that can
    happen, deal their columns anew until they have LEAST_SHOWN, which leaves a chance of 1e-12 at most."""
    low, blocks = bands(num, den)
    n = len(s)
    own = int(np.searchsorted(low, n, side="right")) - 1
    out = []
    for band in (own, own + 1) if n * den // num >= low[own + 1] else (own,):
        count = int(blocks[band])
        if count == 1:
            continue  # no room for a difference: only equal sets, which are one row already
        wide = neighbours(num, den) if count >= FEW_BLOCKS and not exact else 1
        most = max(count, LEAST_SHOWN) if exact else SIGNATURES * (1 if wide == 1 else 3)
        rounds = -(-most // count)
        value = mix(s[None, :] ^ _SALT[:rounds, None])
        key = ((value >> U(32)) * U(count) >> U(32)).astype(np.int64)
        shown = min(count, most + wide - 1) if rounds == 1 else count
        key = (key + np.arange(rounds)[:, None] * count)[key < shown]
        value = mix(value[((value >> U(32)) * U(count) >> U(32)) < U(shown)])
        if not len(key):
            continue
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        content = np.zeros(rounds * count, U)
        content[key[at]] = np.add.reduceat(value, at)
        content = content.reshape(rounds, count)[:, :shown]
        joined = mix(content)
        for k in range(1, wide):
            joined = mix(joined + np.roll(content, -k, 1))
        filled = np.logical_or.reduce([np.roll(content, -k, 1) != 0 for k in range(wide)])
        place = np.arange(rounds)[:, None] * count + np.arange(shown)
        out.append(mix(joined + mix(place.astype(U) + U(band << 32)))[filled][:most])
    return np.concatenate(out) if out else s[:0]


def row_keys(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, row): row names the text's shingle set; null for an empty set or a null doc_id, which link with nothing."""

    def run(batches):
        for b in batches:
            ids, size, key = b.column("doc_id"), [], []
            known = ids.is_valid().to_pylist()
            for a, _, w in scan(b.column("text"), lower=True):
                for i, s in enumerate(shingle_sets(w, n)):
                    size.append(len(s))
                    key.append(set_key(s) if len(s) and known[a + i] else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(key, pa.int64())], names=["doc_id", "n_shingles", "row"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, row bigint")


def shown(docs: DataFrame, n: int, num: int, den: int, parts: int, exact: bool) -> DataFrame:
    """(part, block): packed signatures of the texts' sets, with each set's row and size. They go straight into a shuffle: a second scan of the texts costs
    less than to store them. A task shows a set once, however many copies it reads, and for that keeps the names of its sets, eight bytes each."""

    def run(batches):
        seen: set[int] = set()
        held: list = []
        count = 0
        for b in batches:
            for _, _, w in scan(b.column("text"), lower=True):
                for s in shingle_sets(w, n):
                    if len(s) and (name := set_key(s)) not in seen:
                        seen.add(name)
                        sig = signatures(s, num, den, exact)
                        held.append((sig, name, len(s)))
                        count += len(sig)
                if count > 400_000:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    def flush(held):
        sig = np.concatenate([x for x, _, _ in held])
        many = [len(x) for x, _, _ in held]
        rows = np.empty(len(sig), ENTRY)
        rows["sig"] = sig
        rows["row"] = np.repeat(np.array([k for _, k, _ in held], np.int64), many)
        rows["size"] = np.repeat(np.array([m for _, _, m in held], np.int32), many)
        return packed(((sig >> U(32)) * U(parts) >> U(32)).astype(np.int32), rows)

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, PACKED)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) as stars: each node but the smallest of its connected part, and that smallest. In a round every part's root that has a smaller one beside it is hung on
    that, and paths are cut short, so rounds grow with the logarithm of the nodes."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while len(i):
        p, q = root[i], root[j]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, further := root[root]):
            root = further
        left = root[i] != root[j]
        i, j = i[left], j[left]
    leaf = root != np.arange(len(names))
    return names[leaf], names[root[leaf]]


def candidate_edges(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): rows that share a signature and whose sizes don't rule the similarity out. Among the rows of a signature, in order of size, each
    meets the one before it: if that is too small, so are all others below, and no edge is made. So a signature costs one edge a row, not one
    a pair, and these edges connect what all pairs within the bound would. What a part's signatures connect leaves it as stars, one edge a row at most."""

    def meet(group: pa.Table) -> pa.Table:
        e = unpacked(group.column("block"), ENTRY)
        e = e[np.lexsort((e["row"], e["size"], e["sig"]))]
        a, b = e[1:], e[:-1]
        hit = (a["sig"] == b["sig"]) & (a["row"] != b["row"]) & (b["size"].astype(np.int64) * den >= a["size"].astype(np.int64) * num)
        rows, roots = stars(a["row"][hit], b["row"][hit])
        return pa.table({"a": pa.array(rows, pa.int64()), "b": pa.array(roots, pa.int64())})

    return blocks.groupBy("part").applyInArrow(meet, "a bigint, b bigint")


def overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """len(sets_a) x len(sets_b) overlap counts of the pairs that can be linked, -1 for the others.

    Only columns that both sides have take part. The counts are accumulated over blocks of columns; after each, pairs that can't
    reach the overlap which their sizes demand, even if all their columns yet to come agree, are discarded, and rows without a pair
    left are no longer multiplied."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    need = -(-num * (size_a[:, None] + size_b[None, :]) // (den + num))
    alive = need <= np.minimum(size_a[:, None], size_b[None, :])
    col_a, col_b = np.concatenate(sets_a), np.concatenate(sets_b)
    both = np.intersect1d(col_a, col_b)
    out = np.zeros((len(sets_a), len(sets_b)), np.float64)

    def placed(col, size):
        at = np.minimum(np.searchsorted(both, col), max(len(both) - 1, 0))
        hit = both[at] == col if len(both) else np.zeros(len(col), bool)
        at, row = at[hit], np.repeat(np.arange(len(size)), size)[hit]
        order = np.argsort(at, kind="stable")
        return at[order], row[order], np.bincount(row, minlength=len(size))

    (at_a, row_a, left_a), (at_b, row_b, left_b) = placed(col_a, size_a), placed(col_b, size_b)
    for c in range(0, len(both), COLUMNS):
        alive &= out + np.minimum(left_a[:, None], left_b[None, :]) >= need
        live_a, live_b = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(live_a):
            break
        width = min(COLUMNS, len(both) - c)
        dense = []
        for at, row, live, left in ((at_a, row_a, live_a, left_a), (at_b, row_b, live_b, left_b)):
            x, y = np.searchsorted(at, (c, c + width))
            place = np.full(len(left), -1)
            place[live] = np.arange(len(live))
            mine, col = place[row[x:y]], at[x:y] - c
            m = np.zeros((len(live), width), np.float32)
            m[mine[mine >= 0], col[mine >= 0]] = 1
            dense.append(m)
            left -= np.bincount(row[x:y], minlength=len(left))
        out[np.ix_(live_a, live_b)] += dense[0] @ dense[1].T
    return np.where(alive & (out >= need), out, -1)


def linked(keys: np.ndarray, sets: list[np.ndarray], other: tuple | None, num: int, den: int) -> list[tuple[int, int]]:
    """The links of a block of rows among themselves, or with another block's, as stars on the smallest row of each connected part."""
    k2, s2 = other or (keys, sets)
    i, j = np.nonzero(overlaps(sets, s2, num, den) > 0)
    rows, roots = stars(keys[i], k2[j])
    return list(zip(rows.tolist(), roots.tolist(), strict=True))


def cluster_links(docs: DataFrame, keys: DataFrame, clusters: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): the links within clusters (node, root), exact, as stars.

    One document of each row gives its text: a bitmap lets it through before the shuffle. A cluster of more than ROWS rows is cut
    by size into bands as wide as the similarity allows, and these by hash into blocks; a block meets those of its own band and the next, each pair
    in a task of its own, so no task holds a large cluster, and blocks that size rules out never meet. Small clusters share tasks.
    What large clusters of different texts cost beyond their input are block pairs, not pairs."""
    spark = docs.sparkSession
    # copies are one row before the join, by an aggregation with a map side
    ids = cut(keys.where("row IS NOT NULL").groupBy("row").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n")))
    wanted = ids.join(clusters.withColumnRenamed("node", "row"), "row")
    # a hair wider than the bound, so that rounding can't put a linked pair two bands apart
    wanted = cut(wanted.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(1.001 * math.log(den / num))).cast("int")).drop("n"))
    by_root = W.partitionBy("root").orderBy("band")
    pieces = F.ceil(F.col("m") / ROWS).cast("int")
    sizes = wanted.groupBy("root", "band").agg(F.count("*").alias("m")).select(
        "root", "band", F.sum("m").over(W.partitionBy("root")).alias("m"), pieces.alias("pieces"),
        F.when(F.lag("band").over(by_root) == F.col("band") - 1, F.lag(pieces).over(by_root)).otherwise(0).alias("below"),
        F.when(F.lead("band").over(by_root) == F.col("band") + 1, F.lead(pieces).over(by_root)).otherwise(0).alias("above"),
    )
    wanted = cut(wanted.join(sizes, ["root", "band"]))
    tasks = parts_for(wanted.count(), 2000, spark)
    near, _ = parted(docs, "doc_id", wanted, "id")
    fields = ("row", "root", "band", "m", "pieces", "below", "above")
    texts = near.join(wanted.hint("shuffle_hash"), near["doc_id"] == wanted["id"]).select(*fields, "text")

    def read(batches):
        for b in batches:
            keep, out = [], []
            rows = b.column("row").to_numpy()
            for a, _, w in scan(b.column("text"), lower=True):
                for i, s in enumerate(shingle_sets(w, n)):
                    if len(s) and set_key(s) == rows[a + i]:
                        keep.append(a + i)
                        out.append(s.tobytes())
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(keep) for c in fields), pa.array(out, pa.binary())], names=[*fields, "grams"])

    sets = texts.mapInArrow(read, "row bigint, root bigint, band int, m bigint, pieces int, below int, above int, grams binary")
    small = sets.where(F.col("m") <= ROWS).select(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("c"), F.lit(-1).alias("lower"), F.lit(-1).alias("p"), F.lit(-1).alias("q"), F.lit(False).alias("up"), F.lit(0).alias("side"), "row", "root", "grams")
    mine = F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")

    def meets(band, p, q, up, side):
        return F.struct(band.cast("int").alias("lower"), p.alias("p"), q.alias("q"), F.lit(up).alias("up"), side.alias("side"))

    def others(count):
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    band = F.col("band")
    own = F.transform(others(F.col("pieces")), lambda o: meets(band, F.least(mine, o), F.greatest(mine, o), False, F.when(mine <= o, 0).otherwise(1)))
    over = F.transform(others(F.col("above")), lambda o: meets(band, mine, o, True, F.lit(0)))
    under = F.transform(others(F.col("below")), lambda o: meets(band - 1, o, mine, True, F.lit(1)))
    large = sets.where(F.col("m") > ROWS).select(F.col("root").alias("c"), F.explode(F.concat(own, over, under)).alias("x"), "row", "root", "grams").select("c", "x.*", "row", "root", "grams")

    def product(group: pa.Table) -> pa.Table:
        rows, root, side = (group.column(c).to_numpy() for c in ("row", "root", "side"))
        grams = [np.frombuffer(x, U) for x in group.column("grams").to_pylist()]
        pair = group.column("up")[0].as_py() or group.column("p")[0].as_py() != group.column("q")[0].as_py()
        out: list[tuple[int, int]] = []
        order = np.argsort(root, kind="stable")
        ends = np.flatnonzero(np.append(root[order][1:] != root[order][:-1], True)) + 1
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            at = order[a:b]
            if pair:
                x, y = at[side[at] == 0], at[side[at] == 1]
                if len(x) and len(y):
                    out += linked(rows[x], [grams[i] for i in x], (rows[y], [grams[i] for i in y]), num, den)
            else:
                _, one = np.unique(rows[at], return_index=True)
                at = at[one]
                if len(at) > 1:
                    out += linked(rows[at], [grams[i] for i in at], None, num, den)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return small.unionByName(large.select(small.columns)).groupBy("c", "lower", "p", "q", "up").applyInArrow(product, "a bigint, b bigint")


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, exact: bool | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text): n_shingles is the number of distinct n-word shingles of the text with A-Z
    lower-cased (its whole word sequence if shorter), component_id the smallest doc_id reachable over links of texts
    whose sets have a Jaccard similarity of num / den or more.

    exact shows all column blocks of a row as signatures, so no linked pair is missed but by chances below those of equal hashes; that is the default where blocks hold LEAST_GRAMS shingles or more
    (thresholds of 0.88 and up). Otherwise rows show so many signatures that a pair is missed with a chance of 3e-10 at most, see SIGNATURES.
    Sets are named by 64-bit hashes: among 10^8 different ones two share a name with a chance of 3e-4, and would count as equal.

    Equal sets are one row of the matrix, so copies cost nothing after the first. Empty texts and null doc_ids link with nothing.
    Repeated rows come out as often as they are there; other columns are left out."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    exact = neighbours(num, den) == 1 if exact is None else exact
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    entries = size / 6 * 4 * (den - num) / (den + num) if exact else rows * 2 * SIGNATURES * (1 if neighbours(num, den) == 1 else 3)
    keys = cut(row_keys(docs, n))
    clusters = components(candidate_edges(shown(docs, n, num, den, parts_for(entries, 250_000, spark), exact), num, den))
    links = components(cluster_links(docs, keys, clusters, n, num, den))
    labelled = keys.join(links.select(F.col("node").alias("row"), "root"), "row", "left").select("doc_id", "n_shingles", F.coalesce("root", "row").alias("label"))
    labelled = cut(labelled)
    least = cut(labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least")))  # a join of its own, whose hot labels Spark can split
    return labelled.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """A row a document; those of null and empty texts, and of null ids, are their own component."""
    return ngram_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
