"""Substring dedup: word sequences that an earlier document, or the same one earlier, already has, are removed.

The reference of a document is everything before it, so the shards of the reference are cut by content: a window of n words belongs to
the shard of its least k-word hash (its minimizer). Windows in a row with the same minimizer form a run, the unit that shards hold.
Only minimizers that stand in the table twice can mark repeated windows; all others are left out first. A shard's runs, in
document order, pass through a suffix automaton of the runs before them, whose matching statistics give the spans that are repeated."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_package
from tidemark.llm.columns import cut, numbered, parted, table
from tidemark.llm.textscan import PACKED, U, Words, mix, packed, parts_for, scan, unpacked, windows

#: Rows that a task gathers before it looks for repetitions among them and sends the rest on.
CHUNK = 400_000
#: Slots of the bitmap of crowded minimizers.
SLOTS = 1 << 20
#: Words of a reference shard whose automaton is broadcast.
SHARD_WORDS = 200_000
#: A minimizer with more different runs than this in one task's chunk is crowded: a common passage whose surroundings differ.
CROWD = 32
#: Stands among places for: the row's doc is the slot of a crowded minimizer.
CROWDED = -(1 << 31)

SEEN = np.dtype([("key", "<u4"), ("at", "<i4"), ("doc", "<i8")])
RUN = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("count", "<i4")])
SPANS = "doc bigint, start int, stop int"


class SuffixAutomaton:
    """Of any number of sequences: the substrings of all, with shared states."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.twin_of: tuple[int, int] | None = None  # the state that the last step made from another, and that one

    def add(self, symbols) -> None:
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, c) -> int:
        self.twin_of = None
        to = self.next[last].get(c)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, c, to)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            to = self.next[p][c]
            self.link[new] = to if self.length[to] == self.length[p] + 1 else self._split(p, c, to)
        return new

    def _split(self, p: int, c, to: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = twin
        self.twin_of = twin, to
        while p >= 0 and self.next[p].get(c) == to:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def end(self, state: int, n: int) -> int:
        """The state of the last n symbols of what state was reached by, if n of them matched."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def statistics(self, symbols) -> list[int]:
        """For each place, the length of the longest substring ending there that some added sequence has."""
        state, length, out = 0, 0, []
        for c in symbols:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(c)
            state, length = (to, length + 1) if to is not None else (0, 0)
            out.append(length)
        return out


def minimizer_parts(n: int) -> tuple[int, int]:
    """Words of a minimizer, and of how many places in an n-word window it is the least."""
    k = max(1, 2 * n // 5)
    return k, n - k + 1


def minimizers(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all n-word windows that lie in one text, the place of each one's minimizer, all k-word hashes)."""
    k, places = minimizer_parts(n)
    g = windows(w.hash, k)
    size = np.diff(w.first)
    long = np.flatnonzero(size >= n)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, g
    count = size[long] - n + 1
    start = np.arange(count.sum()) + np.repeat(w.first[long] - np.append(0, np.cumsum(count)[:-1]), count)
    least = np.lib.stride_tricks.sliding_window_view(g, places)[start].argmin(1) if len(start) < len(g) // 2 else np.lib.stride_tricks.sliding_window_view(g, places).argmin(1)[start]
    return start, start + least, g


def slots_of(keys: np.ndarray) -> np.ndarray:
    """Slots of minimizers in the bitmap of crowded ones, whose size is fixed."""
    return (mix(keys ^ U(0x5DEECE66D)) >> U(44)).astype(np.int64)


def whole_texts(docs: DataFrame) -> DataFrame:
    """(doc, n_words, whole): the number of words and the digest of the words joined by a space."""

    def run(batches):
        for b in batches:
            size, digest = [], []
            for x in b.column("text").to_pylist():
                words = x.encode().split() if x else []
                size.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(size, pa.int64()), pa.array(digest, pa.string())], names=["doc", "n_words", "whole"])

    return docs.mapInArrow(run, "doc bigint, n_words bigint, whole string")


def repeated_minimizers(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """(doc, at): places of minimizers whose hash the table has more than once, and (slot, CROWDED) for crowded ones. A task tells repetitions within its chunks by itself and
    sends on two places of a hash at most to the part that knows the other tasks'; the rest only passes through, evenly spread. Of texts with the
    same words a task sends the first it reads and those of smaller ids."""

    def show(batches):
        copies: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        for b in batches:
            ids = b.column("doc").to_numpy()
            for a, _, w in scan(b.column("text")):
                start, place, g = minimizers(w, n)
                if not len(start):
                    continue
                fresh = np.ones(len(w.first) - 1, bool)
                for i in np.flatnonzero(np.diff(w.first) >= n):
                    name = hashlib.blake2b(w.hash[w.first[i] : w.first[i + 1]].tobytes(), digest_size=12).digest()
                    before = copies.get(name)
                    fresh[i] = before is None or ids[a + i] < before
                    if fresh[i]:
                        copies[name] = ids[a + i]
                head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))
                last = np.append(head[1:], len(place)) - 1
                edge = windows(w.hash, n)
                content = edge[start[head]] * U(0x9E3779B97F4A7C15) ^ mix(edge[start[last]])
                place = place[head]
                text = np.searchsorted(w.first, place, side="right") - 1
                content, place, text = content[fresh[text]], place[fresh[text]], text[fresh[text]]
                e = np.empty(len(place), [("hash", U), ("content", U), ("doc", np.int64), ("at", np.int64)])
                e["hash"], e["content"], e["doc"], e["at"] = g[place], content, ids[a + text], place - w.first[text]
                held.append(e)
            if sum(map(len, held)) > CHUNK:
                yield flush(np.concatenate(held))
                held = []
        if held:
            yield flush(np.concatenate(held))

    def flush(e):
        e = e[np.lexsort((e["content"], e["hash"]))]
        differs = np.append(True, (e["hash"][1:] != e["hash"][:-1]) | (e["content"][1:] != e["content"][:-1]))[: len(e)]
        keys, runs = np.unique(e["hash"][differs], return_counts=True)
        crowded = np.unique(slots_of(keys[runs > CROWD]))
        place = np.arange(len(e))
        rank = place - np.maximum.accumulate(np.where(np.append(True, e["hash"][1:] != e["hash"][:-1])[: len(e)], place, 0))
        rows = np.empty(len(e), SEEN)
        rows["key"], rows["doc"] = (e["hash"] & U(0xFFFFFFFF)).astype(np.uint32), e["doc"]
        rows["at"] = np.where(rank > 1, -1 - e["at"], e["at"])  # below 0: known to be repeated
        extra = np.zeros(len(crowded), SEEN)
        extra["doc"], extra["at"] = crowded, CROWDED
        # least hashes are small numbers: stirred again, they spread over the parts
        part = np.where(rank > 1, place % parts, (mix(e["hash"]) >> U(32)) * U(parts) >> U(32))
        return packed(np.append(part, crowded % parts).astype(np.int32), np.append(rows, extra))

    def meet(group: pa.Table) -> pa.Table:
        e = unpacked(group.column("block"), SEEN)
        known, e = e[e["at"] < 0], e[e["at"] >= 0]
        _, back, count = np.unique(e["key"], return_inverse=True, return_counts=True)
        e = e[count[back] > 1]
        at = np.where(known["at"] == CROWDED, CROWDED, -1 - known["at"])
        return pa.table({"doc": pa.array(np.append(e["doc"], known["doc"]), pa.int64()), "at": pa.array(np.append(e["at"], at), pa.int32())})

    return docs.mapInArrow(show, PACKED).groupBy("part").applyInArrow(meet, "doc bigint, at int")


def repeated_runs(marked: DataFrame, n: int, parts: int, crowded: bytes) -> DataFrame:
    """(doc, start, stop): spans of words in windows that also start earlier; marked is (doc, text, at) with at the marked minimizers' places,
    crowded a bitmap of slots.

    Each window of a crowded minimizer is a run and a shard of its own, so that no shard gathers all surroundings of a passage. A run sends its window hashes to its minimizer's shard. Of equal runs in a chunk only the first does; the later ones are repeated in
    any case, and pass through evenly spread, neighbours as one."""

    def show(batches):
        held: list = []
        count = 0
        for b in batches:
            ids, at = b.column("doc").to_numpy(), b.column("at")
            for a, c, w in scan(b.column("text")):
                start, place, g = minimizers(w, n)
                if not len(start):
                    continue
                mark = np.zeros(len(w.hash) + 1, bool)
                slice_at = at.slice(a, c - a)
                mark[np.minimum(slice_at.flatten().to_numpy() + np.repeat(w.first[:-1], np.diff(slice_at.offsets.to_numpy())), len(w.hash))] = True
                take = mark[place]
                start, place = start[take], place[take]
                if not len(start):
                    continue
                symbol, slot = windows(w.hash, n)[start], slots_of(g[place])
                alone = (np.frombuffer(crowded, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | alone[1:]))
                size = np.diff(np.append(head, len(start)))
                text = np.searchsorted(w.first, start[head], side="right") - 1
                r = np.empty(len(head), RUN)
                r["key"], r["doc"], r["start"], r["count"] = np.where(alone, symbol, g[place])[head], ids[a + text], start[head] - w.first[text], size
                # equal runs have equal windows in a row, so the first window, the last and the count name the content
                r["content"] = mix(symbol[head] * U(0x9E3779B97F4A7C15) ^ mix(symbol[head + size - 1] + size.astype(U)))
                held.append((r, symbol))
                count += len(r)
            if count > CHUNK:
                yield flush(held)
                held, count = [], 0
        if held:
            yield flush(held)

    def flush(held):
        r = np.concatenate([x for x, _ in held])
        symbols = np.concatenate([y for _, y in held])
        begin = np.append(0, np.cumsum(r["count"])[:-1])
        order = np.lexsort((r["start"], r["doc"], r["content"]))
        r, begin = r[order], begin[order]
        part = ((mix(r["key"]) >> U(32)) * U(parts) >> U(32)).astype(np.int64)
        later = np.append(False, r["content"][1:] == r["content"][:-1])[: len(r)]
        same = np.zeros(len(r), bool)
        same[1:] = later[1:] & (r["doc"][1:] == r["doc"][:-1]) & (r["start"][1:] == r["start"][:-1])
        # a run that stands in repeated rows of one document at one place isn't later than itself
        firsts = np.maximum.accumulate(np.where(~later, np.arange(len(r)), 0))
        later &= ~((r["doc"] == r["doc"][firsts]) & (r["start"] == r["start"][firsts]))
        known, fresh = r[later & ~same], ~later & ~same
        known = known[np.lexsort((known["start"], known["doc"]))]
        joins = (known["doc"][1:] == known["doc"][:-1]) & (known["start"][1:] == known["start"][:-1] + known["count"][:-1])
        head = np.flatnonzero(np.append(True, ~joins)[: len(known)])  # neighbours that are repeated anyway are one run
        joined = known[head]
        joined["count"] = -np.diff(np.append(0, np.cumsum(known["count"], dtype=np.int64))[np.append(head, len(known))])
        r, begin = np.concatenate((r[fresh], joined)), np.append(begin[fresh], np.zeros(len(joined), np.int64))
        part = np.append(part[fresh], np.arange(len(joined)) % parts)
        size = np.maximum(r["count"].astype(np.int64), 0)
        move = np.argsort(part, kind="stable")
        r, begin, part, size = r[move], begin[move], part[move], size[move]
        take = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        body, bound = symbols[take], np.append(0, np.cumsum(size))
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(cuts[1:], len(part))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cuts], pa.int32()), pa.array([r[x:y].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary()), pa.array([body[bound[x] : bound[y]].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary())],
            names=["part", "runs", "body"],
        )

    def meet(group: pa.Table) -> pa.Table:
        r, symbols = unpacked(group.column("runs"), RUN), unpacked(group.column("body"), np.dtype("<u8"))
        known, r = r[r["count"] < 0], r[r["count"] > 0]
        out = [(known["doc"], known["start"], known["start"] - known["count"] + n - 1)]
        begin = np.append(0, np.cumsum(r["count"], dtype=np.int64))
        order = np.lexsort((r["start"], r["doc"], r["content"], r["key"]))
        q = r[order]
        new = np.append(True, (q["content"][1:] != q["content"][:-1]) | (q["key"][1:] != q["key"][:-1]))[: len(q)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        later = (q["doc"] != q["doc"][first]) | (q["start"] != q["start"][first])
        out.append((q["doc"][later], q["start"][later], q["start"][later] + q["count"][later] + n - 1))
        # different contents of one shard: those with a window that another has too go through the automaton, in document order
        different = order[new]
        size = r["count"][different].astype(np.int64)
        owner = np.repeat(np.arange(len(different)), size)
        taken = symbols[np.repeat(begin[different] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())] if len(different) else symbols[:0]
        _, back, times = np.unique(taken, return_inverse=True, return_counts=True)
        shared = np.unique(owner[times[back] > 1]) if len(taken) else owner
        rest = different[shared]
        rest = rest[np.lexsort((r["start"][rest], r["doc"][rest], r["key"][rest]))]
        spans, key, automaton = [], None, None
        for i in rest.tolist():
            if automaton is None or r["key"][i] != key:
                key, automaton = r["key"][i], SuffixAutomaton()
            run = symbols[begin[i] : begin[i + 1]].tolist()
            doc, start = int(r["doc"][i]), int(r["start"][i])
            found = automaton.statistics(run)
            # a match of m windows that ends at window j covers the words of all m
            spans += [(doc, start + j - m + 1, start + j + n) for j, m in enumerate(found) if m and (j + 1 == len(found) or found[j + 1] != m + 1)]
            if not all(found):
                automaton.add(run)
        if spans:
            out.append(tuple(np.array(x) for x in zip(*spans, strict=True)))
        doc, start, stop = (np.concatenate([np.asarray(o[k]) for o in out]) for k in range(3))
        return pa.table({"doc": pa.array(doc.astype(np.int64)), "start": pa.array(start.astype(np.int32)), "stop": pa.array(stop.astype(np.int32))})

    return marked.mapInArrow(show, "part int, runs binary, body binary").groupBy("part").applyInArrow(meet, SPANS)


class Reference:
    """One shard of the reference: a suffix automaton over the ids of its words, and of every state the place where what leads to it ends first.
    Passages (doc, start, words) come in the order of their places."""

    def __init__(self, passages):
        self.ids: dict[bytes, int] = {}
        self.automaton, self.first = SuffixAutomaton(), [(-1, -1)]
        for doc, start, words in passages:
            last = 0
            for k, w in enumerate(words):
                before = len(self.automaton.next)
                last = self.automaton._extend(last, self.ids.setdefault(w, len(self.ids)))
                for state in range(before, len(self.automaton.next)):  # a new state ends here first, its twin where the state ended that it came from
                    self.first.append((doc, start + k))
                if len(self.automaton.next) > before and self.automaton.twin_of is not None:
                    twin, of = self.automaton.twin_of
                    self.first[twin] = self.first[of]

    def repeated(self, doc: int, words, n: int) -> list[tuple[int, int]]:
        """Maximal spans (start, stop) of n words or more that stand here earlier, from the matching statistics of the words."""
        a, state, length, out = self.automaton, 0, 0, []
        step, link, size, known = a.next, a.link, a.length, self.ids.get
        for j, w in enumerate(words):
            c = known(w, -1)
            while state and c not in step[state]:
                state = link[state]
                length = size[state]
            to = step[state].get(c)
            state, length = (to, length + 1) if to is not None else (0, 0)
            if length >= n and self.first[a.end(state, n)] < (doc, j):
                if out and out[-1][1] > j - n:
                    out[-1] = (out[-1][0], j + 1)
                else:
                    out.append((j - n + 1, j + 1))
        return out


def broadcast_spans(marked: DataFrame, n: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, start, stop) of words in windows that also start earlier; marked is (doc, text, at) with at the places of repeated minimizers.

    The passages of marked windows, each content once at its earliest place, are the reference. They are dealt into shards of about shard_words words by
    hash, a bound that is checked; executors build the shards' suffix automata. One after another these are broadcast, and all marked documents
    are streamed through each for their matching statistics: shards times documents, which grows as the square of a corpus."""
    spark = marked.sparkSession
    k, places = minimizer_parts(n)

    def passages(batches):
        for b in batches:
            out = []
            for doc, text, at in zip(*(b.column(c).to_pylist() for c in ("doc", "text", "at")), strict=True):
                words, inside = text.encode().split(), []
                for p in sorted(set(at)):
                    lo, hi = max(0, p - places + 1), min(len(words), p + k + places - 1)
                    if inside and lo <= inside[-1][1] - n:
                        inside[-1][1] = max(hi, inside[-1][1])
                    else:
                        inside.append([lo, hi])
                out += [(doc, lo, b" ".join(words[lo:hi])) for lo, hi in inside if hi - lo >= n]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["doc", "start", "words"])

    marked = cut(marked)
    found = marked.mapInArrow(passages, "doc bigint, start int, words binary").groupBy("words").agg(F.min(F.struct("doc", "start")).alias("p"))
    found = cut(found.select("p.*", "words", F.size(F.split(F.col("words").cast("string"), " ")).cast("bigint").alias("size")))
    shards = max(1, -(-(found.agg(F.sum("size")).first()[0] or 0) // shard_words))
    found = found.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)))
    largest = found.groupBy("shard").agg(F.sum("size").alias("m")).agg(F.max("m")).first()[0] or 0
    if largest > 8 * shard_words:
        raise ValueError(f"a shard of {largest} words is too large to be broadcast")

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("doc", "start", "words")), strict=True))
        return pa.table({"shard": group.column("shard")[:1], "automaton": pa.array([pickle.dumps(Reference((d, s, w.split()) for d, s, w in rows))], pa.binary())})

    built = cut(found.groupBy("shard").applyInArrow(build, "shard bigint, automaton binary"))
    out = None
    for shard in range(shards):
        blob = built.where(F.col("shard") == shard).select("automaton").first()
        if blob is None:
            continue
        value = spark.sparkContext.broadcast(bytes(blob[0]))

        def stream(batches, value=value):
            reference = pickle.loads(value.value)
            for b in batches:
                rows = [(doc, *span) for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True) for span in reference.repeated(doc, text.encode().split(), n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2))], names=["doc", "start", "stop"])

        one = cut(marked.select("doc", "text").mapInArrow(stream, SPANS))
        value.destroy()
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], SPANS) if out is None else out


def dedup_substrings(docs: DataFrame, n: int = 20, way: str = "shards meet") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of docs (doc_id, text): every word in an n-word window whose words also start earlier (in
    a document of a smaller id, or earlier in the same) is removed, judged on the input; kept words are joined by one space.
    kept_text is null where nothing is removed: the text stays as it is.

    Texts with the same words as one of a smaller id lose all words, or none below n; only the first of them goes on. Null
    texts have no words. Rows without an id are documents after those with one. Rows of one id, or of none, with different texts are different documents, in
    the order of hashes of id and text; repeated rows aren't earlier than each other. Other columns are left out.

    way: "shards meet" brings the runs of a shard to its automaton by a shuffle; "broadcast" takes the shards to the documents, see
    broadcast_spans. Both give the same rows."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    docs = numbered(docs, "key", "doc")
    ids, docs = docs.select("doc", "doc_id").distinct(), docs.select("doc", "text")
    plain_ids = ids.where(~F.col("doc").eqNullSafe(F.col("doc_id"))).isEmpty()
    k, places = minimizer_parts(n)
    whole = cut(whole_texts(docs))
    total = whole.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    parts = parts_for(total[0] * 2 / (places + 1), 400_000, spark)
    marks = repeated_minimizers(docs.select("doc", "text"), n, parts).distinct().groupBy("doc").agg(F.collect_list("at").alias("at"))
    marks = cut(marks)
    crowded = np.zeros(SLOTS, bool)  # at most SLOTS slots come to the driver
    crowded[marks.where(F.array_contains("at", F.lit(CROWDED))).select("doc").toArrow().column("doc").to_numpy()] = True
    bitmap = np.packbits(crowded, bitorder="little").tobytes()
    marks = marks.withColumn("at", F.filter("at", lambda x: x != CROWDED)).where(F.size("at") > 0)
    texts = parted(docs, "doc", marks, "doc")[0].join(marks.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), F.col("doc") == F.col("_doc")).select("doc", "text", "at")
    found = broadcast_spans(texts, n) if way == "broadcast" else repeated_runs(texts, n, parts, bitmap)
    spans = cut(found.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))

    firsts = cut(whole.groupBy("whole").agg(F.min("doc").alias("first")))  # a join of its own, whose hot texts Spark can split
    state = whole.join(firsts.withColumnRenamed("whole", "_whole"), F.col("whole") == F.col("_whole")).select("doc", "n_words", "whole", (F.col("first") < F.col("doc")).alias("copy"))
    state = cut(state)

    def remove(batches):
        for b in batches:
            rows = []
            for text, spans in zip(*(b.column(c).to_pylist() for c in ("text", "spans")), strict=True):
                words = (text or "").encode().split()
                keep = np.ones(len(words), bool)
                for s in spans:
                    keep[s["start"] : s["stop"]] = False
                kept = b" ".join([words[j] for j in np.flatnonzero(keep)])
                rows.append((len(words), len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds))], names=["doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    empty = hashlib.sha256(b"").hexdigest()
    gone = F.col("copy") & (F.col("n_words") >= n)
    plain = state.join(spans.select(F.col("doc").alias("_d")), (F.col("doc") == F.col("_d")) & ~F.col("copy"), "left_anti").select(
        "doc", "n_words", F.when(gone, F.col("n_words")).otherwise(F.lit(0)).cast("bigint").alias("n_removed"), F.when(gone, F.lit(empty)).otherwise(F.col("whole")).alias("kept_sha256"), F.when(gone, F.lit("")).alias("kept_text")
    )
    changes = cut(state.where(~F.col("copy")).select("doc").distinct().join(spans, "doc"))
    changed = parted(docs, "doc", changes, "doc")[0].join(changes.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), F.col("doc") == F.col("_doc"))
    changed = changed.select("doc", "text", "spans").mapInArrow(remove, "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    out = plain.unionByName(changed)
    out = out.withColumn("doc_id", F.col("doc")) if plain_ids else out.join(cut(ids), "doc")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """A row a document, copies included, in the general case of dedup_substrings."""
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept_text")
