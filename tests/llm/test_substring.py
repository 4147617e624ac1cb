import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import substring


def agree(got, docs, n=20):
    want = brute.repeats(docs, n)
    assert len(got) == len(docs)
    for r in got:
        size, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (size, size - len(kept), brute.sha(" ".join(kept))), r.doc_id
    return want


def test_odd(spark, odd):
    rows, folder = odd
    want = agree(substring.op4_substring_dedup(spark, folder).collect(), {i: t for i, t, _ in rows})
    assert sum(n - len(k) for n, k in want.values()) > 1000


def test_given(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    agree(substring.op4_substring_dedup(spark, sf).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_few_words_much_repetition(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 50)
    rng, docs = random.Random(4), {}
    passages = [rng.choices("abcdefgh", k=rng.randrange(5, 60)) for _ in range(15)]
    for i in range(150):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(passages)[rng.randrange(0, 8) :] if rng.random() < 0.7 else rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, 30))
        docs[i * 7 - 20] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    agree(substring.dedup_substrings(df, 20).collect(), docs)
    agree(substring.dedup_substrings(df, 8).collect(), docs, 8)
    agree(substring.dedup_substrings(df, 20, "broadcast").collect(), docs)


def test_broadcast_shards(spark, odd, monkeypatch):
    """Many small shards; the same rows by the other way."""
    real = substring.broadcast_spans
    monkeypatch.setattr(substring, "broadcast_spans", lambda marked, n: real(marked, n, 300))
    df = spark.read.parquet(f"{odd[1]}/documents.parquet").where("doc_id <> 5")
    agree(substring.dedup_substrings(df, 20, "broadcast").collect(), {i: t for i, t, _ in odd[0] if i != 5})


@pytest.mark.parametrize("way", ["shards meet", "broadcast"])
def test_rows_of_one_id_with_different_texts(spark, way):
    """By row, in the order of ids and of hashes of id and text; a row that only shares an id keeps its words."""
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(30))

    def text(n):
        return " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))

    rows = [(0, f"{text(9)} {passage}"), (1, f"{passage} {text(12)}"), (1, text(40)), (1, f"{text(30)} {passage} {text(5)}"), (1, text(3)), (None, f"{passage} {text(2)}"), (None, text(50)), (2, text(33))]
    rows += [rows[2], rows[6], (3, rows[2][1]), (3, f"{text(4)} {rows[6][1]}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    hashed = df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS h", "doc_id IS NULL AS last").distinct().orderBy("last", "doc_id", "h")
    order = [(r.doc_id, r.text) for r in hashed.collect()]
    kept = brute.repeats({k: t for k, (_, t) in enumerate(order)})
    want = sorted((i or -1, kept[order.index((i, t))][0], brute.sha(" ".join(kept[order.index((i, t))][1]))) for i, t in rows)
    got = sorted((r.doc_id or -1, r.n_words, r.kept_sha256) for r in substring.dedup_substrings(df, 20, way).collect())
    assert got == want


def test_nulls_repeats_and_empty(spark, empty):
    assert substring.op4_substring_dedup(spark, empty).count() == 0
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (None, "y " + text), (4, "x " + text), (5, None), (6, "a a"), (7, "a a")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.dedup_substrings(df).collect())
    assert got == [(-1, 25, 25), (-1, 26, 25), (3, 25, 0), (3, 25, 0), (4, 26, 25), (5, 0, 0), (6, 2, 0), (7, 2, 0)]


@given(st.lists(st.text(alphabet="abc", max_size=9), max_size=4), st.text(alphabet="abcd", max_size=9))
@settings(max_examples=400, deadline=None)
def test_automaton(added, text):
    a = substring.SuffixAutomaton()
    for x in added:
        a.add(x)
    want = [max(m for m in range(j + 2) if any(text[j + 1 - m : j + 1] in x for x in added) or m == 0) for j in range(len(text))]
    assert a.statistics(text) == want


def test_crowded_passage(spark, monkeypatch):
    """One passage in many surroundings, some of which are shared too: no shard gathers them, and nothing changes."""
    monkeypatch.setattr(substring, "CROWD", 3)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(24)]
    around = [[f"s{rng.randrange(40)}" for _ in range(25)] for _ in range(30)]
    docs = {i: " ".join(rng.choice(around)[rng.randrange(25) :] + passage[rng.randrange(6) :] + rng.choice(around)[: rng.randrange(25)]) for i in range(200)}
    bitmaps, real = [], substring.repeated_runs
    monkeypatch.setattr(substring, "repeated_runs", lambda marked, n, parts, crowded: bitmaps.append(crowded) or real(marked, n, parts, crowded))
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)
    agree(substring.dedup_substrings(df, 20).collect(), docs)
    assert any(bitmaps[0])
