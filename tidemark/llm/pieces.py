"""SentencePiece BPE by a prefix table: for each prefix of a word the one token that its encoding ends with, then ids recovered backwards."""

from __future__ import annotations

import heapq
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.functions.shipping import ship_package

#: The visible space of the vocabulary.
META = "▁"
#: Distinct units that a task keeps the ids of, until they push out those kept before.
CACHE_UNITS = 200_000
#: Bytes of the longest unit that is kept, and of texts that are worked on at a time; a longer text is a slice of its own.
LONGEST, SLICE = 256, 2_000_000
#: Token pairs whose compatibility a task keeps.
CACHE_PAIRS = 400_000

SCHEMA = "doc_id bigint, ids binary, decoded string"


class PieceTable:
    """The merges of one model. encode and decode agree with the library for BPE models with byte fallback and no text normalisation
    beyond the visible space, which is checked when the model is read."""

    def __init__(self, model_file: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for probe in ("a  b ", " ﬁ é\n中", "▁x\t"):
            if lib.decode(lib.encode(probe)) != probe.replace(META, " "):
                raise ValueError(f"{model_file} normalises texts; only identity models are handled")
        size = lib.get_piece_size()
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.piece = [lib.id_to_piece(i) for i in range(size)]
        self.byte = [0] * 256
        self.special = set()
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i, p in enumerate(self.piece):
            if lib.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.special.add(i)
            else:
                self.rank[p], self.id[p] = -lib.get_score(i), i
        if any(META in p[1:] and p.strip(META) for p in self.rank):
            raise ValueError("a piece goes over a space; words can't be encoded one by one")
        byte_of = {i: b for b, i in enumerate(self.byte)}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else b"" if i in self.special else p.replace(META, " ").encode() for i, p in enumerate(self.piece)]
        self.halves: dict[str, tuple[str, str]] = {}
        self.rough: set[str] = set()  # tokens whose halves were merged later than they: the walk over ranks doesn't hold
        words = [p for p in self.rank if META not in p[1:]]
        self.chars = {p for p in words if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p in sorted(words, key=len):
            if len(p) > 1:
                out, last = self.merge(p)
                if len(out) > 1:
                    continue  # never the outcome of merging
                self.halves[p] = last
                if any(h in self.rough or (len(h) > 1 and self.rank[h] >= self.rank[p]) for h in last):
                    self.rough.add(p)
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        # what is used stays, what isn't goes with its generation
        self.recent: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array([len(r) for r in self.raw], np.int32)
        self.raw_start = np.cumsum(self.raw_size, dtype=np.int32) - self.raw_size

    def merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """BPE from characters, the best and then leftmost pair first: the symbols, and the halves of the last merge."""
        sym, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(text) and (r := self.rank.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (r, i, j, sym[i], sym[j]))

        for i in range(len(text) - 1):
            offer(i)
        last = ("", "")
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or nxt[i] != j:
                continue
            sym[i], sym[j], last = a + b, "", (a, b)
            nxt[i] = nxt[j]
            if nxt[i] < len(text):
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [s for s in sym if s], last

    def compatible(self, a: str, b: str) -> bool:
        """Whether the encoding of a + b is a, b: going back through the merges on both sides of the seam, no merge over the seam comes
        before the merge that ended its chance. The left one of equal merges comes first."""
        if a in self.rough or b in self.rough:
            good = self.merge(a + b)[0] == [a, b]
        else:
            x, y, good, rank = a, b, True, self.rank
            limit, strict = float("inf"), True
            while True:
                over = rank.get(x + y)
                if over is not None and (over < limit or (not strict and over == limit)):
                    good = False
                    break
                rx, ry = (rank[x] if len(x) > 1 else -1.0), (rank[y] if len(y) > 1 else -1.0)
                if rx < 0 and ry < 0:
                    break
                if rx > ry:
                    limit, strict, x = rx, True, self.halves[x][1]
                else:
                    limit, strict, y = ry, False, self.halves[y][0]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = good
        return good

    def known(self, text: str) -> list[str]:
        """Tokens of a text of known characters: last[i] is the one token that ends the encoding of text[:i]."""
        last: list[str] = [""] * (len(text) + 1)
        pairs, compatible = self.pairs.get, self.compatible
        done = -1
        for end, token in self.automaton.iter(text):  # at each end the longest comes first
            if end == done:
                continue
            at = end + 1 - len(token)
            if at:
                before = last[at]
                good = pairs((before, token))
                if good is None:
                    good = compatible(before, token)
                if not good:
                    continue
            done = end
            last[end + 1] = token
        out, i = [], len(text)
        while i:
            out.append(last[i])
            i -= len(last[i])
        out.reverse()
        return out

    def tokens(self, text: str) -> list[int]:
        """Ids of a word without inner spaces; characters outside the vocabulary become their bytes."""
        if self.chars.issuperset(text):
            return [self.id[t] for t in self.known(text)]
        out: list[int] = []
        start = 0
        for i, ch in enumerate(text):
            if ch not in self.chars:
                out += [self.id[t] for t in self.known(text[start:i])]
                out += [self.byte[b] for b in ch.encode("utf-8", "replace")]
                start = i + 1
        return out + [self.id[t] for t in self.known(text[start:])]

    @lru_cache(maxsize=4096)  # noqa: B019
    def spaces(self, n: int) -> tuple[int, ...]:
        """Ids of n spaces in a row that no word takes part in. All their merges have one rank, so the leftmost always goes on."""
        return tuple(self.id[t] for t in self.merge(META * n)[0])

    def text_of(self, ids) -> bytes:
        """UTF-8 of the pieces one after another, spaces visible no more."""
        return b"".join([self.raw[i] for i in ids])

    def unit_ids(self, unit: bytes) -> list[int]:
        """Ids of a unit: a line end and the word after it, or spaces and the word after them, of which the last belongs to the word unless the
        word's own space stays alone and so joins the others. Either may lack its word."""
        if unit[:1] == b"\n":
            return [self.byte[10], *self.tokens(unit[1:].decode())]
        word = unit.lstrip(b" ")
        n = len(unit) - len(word)
        if not word:
            return list(self.spaces(n))
        ids = self.tokens(META + word.decode())
        if n == 1:
            return ids
        return [*self.spaces(n), *ids[1:]] if ids[0] == self.id[META] else [*self.spaces(n - 1), *ids]

    def forget(self) -> None:
        """Drops all that is kept of a task's texts, so that a worker between tasks holds the model alone."""
        self.pairs.clear()
        self.recent, self.earlier = {}, {}
        pa.default_memory_pool().release_unused()

    def kept_ids(self, units: list[bytes]) -> list[bytes]:
        """Ids of units, four bytes each."""
        out, recent = [], self.recent
        get, earlier, encode = recent.get, self.earlier.get, self.unit_ids
        for unit in units:
            got = get(unit)
            if got is None:
                got = earlier(unit)
                if got is None:
                    got = array("i", encode(unit)).tobytes()
                if len(unit) <= LONGEST:
                    if len(recent) >= CACHE_UNITS:
                        self.earlier, self.recent = recent, {}
                        recent, earlier = self.recent, self.earlier.get
                        get = recent.get
                    recent[unit] = got
            out.append(got)
        return out

    def encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, begin and end included; where each text's ids end).

        The texts, each with the space that stands before a text, are cut into units at line ends and where spaces begin; each distinct unit of the
        slice is encoded once, and its ids are gathered to wherever it stands."""
        joined = " " + " ".join(texts)
        size = np.array([len(x) for x in texts], np.int64)
        raw = joined.encode()
        if len(raw) != len(joined):
            size = np.array([len(x.encode()) for x in texts], np.int64)
        data = np.frombuffer(raw, np.uint8)
        first = np.cumsum(size + 1) - size - 1
        space = data == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens |= data == 10
        opens[first] = size > 0
        start = np.flatnonzero(opens)
        owner = np.searchsorted(first, start, side="right") - 1
        offsets = np.append(start, len(data)).astype(np.int64)
        # an empty text has no unit, but its space would lengthen the unit before it
        ends = np.minimum(offsets[1:], first[owner] + size[owner] + 1)
        if np.any(ends != offsets[1:]):
            keep = np.repeat(True, len(data))
            keep[first[size == 0]] = False
            offsets = np.append(0, np.cumsum(ends - start))
            data = data[keep]
        units = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids = self.kept_ids(units.dictionary.to_pylist())
        count = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), np.int32)
        which = units.indices.to_numpy()
        many = count[which]
        per_text = np.bincount(owner, many, len(texts)).astype(np.int64) + 2
        stop = np.cumsum(per_text)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        out[stop - per_text], out[stop - 1] = self.bos, self.eos
        at = np.ones(len(out), bool)
        at[stop - per_text] = at[stop - 1] = False
        out[at] = flat[gathered((np.cumsum(count) - count)[which], many)]
        return out, stop

    def decode_slice(self, ids: np.ndarray, stop: np.ndarray) -> pa.Array:
        """The texts of ids, which end at stop: pieces one after another, control ids vanish, and the space put before the first word too."""
        size = self.raw_size[ids]
        data = self.raw_bytes[gathered(self.raw_start[ids], size)]
        ends = np.append(0, np.cumsum(size, dtype=np.int64))[np.append(0, stop)]
        starts = ends[:-1]
        full = np.flatnonzero(ends[1:] > starts)
        drop = starts[full][data[starts[full]] == 32]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        ends = ends - np.searchsorted(drop, ends)
        return pa.Array.from_buffers(pa.large_string(), len(stop), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))])

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers with begin and end, decoded UTF-8) of one text."""
        ids, stop = self.encode_slice([text.replace(META, " ")])
        return ids.astype("<u4").tobytes(), self.decode_slice(ids, stop)[0].as_py().encode()

    def decode(self, ids) -> str:
        """The text of any ids that encode gave: control ids vanish, and the space put before the first word with them."""
        raw = self.text_of(ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def gathered(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[i] to start[i] + count[i], for all i one after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat((start - (ends - count)).astype(np.int32 if total < 1 << 31 else np.int64), count) + np.arange(total, dtype=np.int32 if total < 1 << 31 else np.int64)


@lru_cache(maxsize=2)
def piece_table(model_file: str) -> PieceTable:
    """One a worker process."""
    return PieceTable(model_file)


def slices(texts: pa.Array):
    """Lists of texts, null ones empty and visible spaces plain, of SLICE bytes at most or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
        yield pc.replace_substring(texts.slice(a, b - a).fill_null(""), META, " ").to_pylist()
        a = b


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, decoded) of docs' doc_id and text: ids is a binary of little-endian unsigned 32-bit integers, begin and end included.

    A pass over the partitions without a shuffle. A batch is worked on a few megabytes at a time, and a task keeps the ids of a bounded number of
    distinct units, so memory depends on neither the table nor a source or group of copies. A null text counts as empty: begin and end only, decoded to the
    empty text. Null and repeated doc_ids and repeated rows come out as they are there; other columns are left out."""

    def encode(batches):
        t = piece_table(model_file)
        try:
            yield from encoded(t, batches)
        finally:
            t.forget()  # an idle worker's memory counts while later stages run

    def encoded(t, batches):
        for b in batches:
            done = 0
            for texts in slices(b.column("text")):
                ids, stop = t.encode_slice(texts)
                ends = pa.py_buffer(np.append(0, stop * 4).astype(np.int64))
                raw = pa.Array.from_buffers(pa.large_binary(), len(stop), [None, ends, pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(texts)), raw.cast(pa.binary()), t.decode_slice(ids, stop).cast(pa.string())], names=["doc_id", "ids", "decoded"])
                done += len(texts)

    ship_package(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(encode, SCHEMA)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """A row a document, null and empty texts included."""
    import public_tokenizers
    from pyspark.sql import functions as F

    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
