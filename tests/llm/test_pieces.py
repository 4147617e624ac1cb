import random
import struct

import brute
import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from tidemark.llm import pieces  # noqa: E402


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), pieces.piece_table(path)


def same(lib, table, text):
    want = [lib.bos_id(), *lib.encode(text), lib.eos_id()]
    ids, dec = table.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text
    assert dec.decode() == lib.decode(want) == table.decode(want)


def test_random_texts(both):
    rng = random.Random(3)
    for _ in range(4000):
        same(*both, "".join(rng.choice("ab \n\t▁eéth中😀  iionr<s>") for _ in range(rng.randint(0, 40))))


def test_spaces_and_long_words(both):
    for n in range(40):
        for text in (" " * n, " " * n + "a", " " * n + "中", "b" + " " * n):
            same(*both, text)
    same(*both, "a" * 3000)
    same(*both, "ab" * 2000 + "\n" * 50)


def test_given_documents(spark, sf, both):
    lib, _ = both
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pieces.op5_sentencepiece(spark, sf).collect():
        ids = [lib.bos_id(), *lib.encode(texts[r.doc_id]), lib.eos_id()]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha(lib.decode(ids)))


def test_odd_and_empty(spark, odd, both):
    rows, folder = odd
    lib, _ = both
    got = {r.doc_id: r for r in pieces.op5_sentencepiece(spark, folder).collect()}
    for i, text, _ in rows:
        assert got[i].n_tokens == len(lib.encode(text or "")) + 2


def test_repeats_null_ids_and_extra_columns(spark):
    rows = [(1, "a b", 9), (1, "a b", 9), (1, "other\n text", 8), (None, " ", 7), (None, None, 7), (3, "x" * 300_000 + " y" * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = pieces.encode_documents(df, P.path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in got) == sorted((i or -1, t or "") for i, t, _ in rows)


def test_slices_do_not_matter(spark, sf, monkeypatch, both):
    lib, table = both
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + ["", " ", "a  ", "", "\n\n b"]
    ids, stop = table.encode_slice(texts)
    got = [list(x) for x in np.split(ids, stop[:-1])]
    assert got == [[lib.bos_id(), *lib.encode(x), lib.eos_id()] for x in texts]
    monkeypatch.setattr(pieces, "SLICE", 100)
    assert sum(len(x) for x in pieces.slices(pa.array(texts))) == len(texts)


def test_empty_table(spark, empty):
    assert pieces.op5_sentencepiece(spark, empty).count() == 0


def test_compatible_agrees_with_merging(both):
    _, t = both
    rng, words = random.Random(1), sorted(t.halves)
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words).lstrip(pieces.META)
        if b in t.rank and (len(b) == 1 or b in t.halves):
            assert t.compatible(a, b) == (t.merge(a + b)[0] == [a, b])
