import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import graph, ngram_join, textscan


def agree(got, docs, **how):
    want = brute.components(docs, **how)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    return want


def test_odd(spark, odd):
    rows, folder = odd
    want = agree(ngram_join.op3_ngram_jaccard(spark, folder).collect(), {i: t for i, t, _ in rows})
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_given(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    agree(ngram_join.op3_ngram_jaccard(spark, sf).collect(), {r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize(("n", "num", "exact"), [(5, 80, None), (3, 90, None), (1, 50, True)])
def test_near_copies_around_the_threshold(spark, monkeypatch, n, num, exact):
    """Clusters cut into many blocks; sizes and differences of every kind."""
    monkeypatch.setattr(ngram_join, "ROWS", 7)
    rng, docs = random.Random(n), {}
    for k in range(12):
        base = rng.choices([f"w{i}" for i in range(4000)], k=rng.choice([6, 9, 12, 20, 40, 90, 300, 900]))
        for _ in range(10):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 12))):
                if rng.random() < 0.4:
                    del words[rng.randrange(len(words)) :][:1]
                else:
                    words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            docs[len(docs)] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    agree(ngram_join.ngram_components(df, n, num, exact=exact).collect(), docs, n=n, num=num)


def test_nulls_repeats_and_empty(spark, empty):
    assert ngram_join.op3_ngram_jaccard(spark, empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (4, "A B C D"), (6, None), (5, "other words are here")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.ngram_components(df, 3, 90).collect())
    assert got == [(-1, 2, -1), (4, 2, 4), (5, 2, 4), (5, 2, 4), (5, 2, 5), (6, 0, 6)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)]
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and all(k in got for a, b in edges if a != b for k in (a, b))


def test_words_and_shingles(odd):
    texts = [t for _, t, _ in odd[0]]
    at = 0
    names = {}
    for _, _, w in textscan.scan(pa.array(texts, pa.string()), lower=True):
        for i, s in enumerate(textscan.shingle_sets(w, 3)):
            want = brute.shingles(texts[at + i])
            assert len(s) == len(want) and np.all(s[1:] > s[:-1])
            a, b = w.first[i], w.first[i + 1]
            for word, h in zip(brute.words(brute.lower(texts[at + i])), w.hash[a:b], strict=True):
                assert names.setdefault(word, h) == h
        at += len(w.first) - 1
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize(("num", "exact"), [(90, True), (80, True), (80, False)])
def test_no_link_is_lost_at_the_threshold(num, exact):
    """Pairs that only just are linked share a signature, those of sets far larger than SIGNATURES blocks too."""
    rng = np.random.default_rng(num)
    for size in (5, 9, 30, 100, 700, 5000):
        for _ in range(40 if size < 5000 else 8):
            base = np.unique(rng.integers(0, 2**63, size, np.uint64))
            own = len(base) * (100 - num) // (100 + num)  # shingles that only one side has, on each side
            other = np.unique(np.concatenate((base[own:], rng.integers(0, 2**63, own, np.uint64))))
            over = len(np.intersect1d(base, other))
            assert 100 * over >= num * (len(base) + len(other) - over)
            a, b = ngram_join.signatures(base, num, 100, exact), ngram_join.signatures(other, num, 100, exact)
            assert own == 0 or len(np.intersect1d(a, b)), size


def test_random_rows_have_no_chance_edges(spark):
    docs = spark.range(100_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 24), x -> cast(pmod(xxhash64(id, x), 1000000) AS string))) AS text")
    found = ngram_join.shown(docs, 3, 90, 100, 8, True)
    assert ngram_join.candidate_edges(found, 90, 100).count() == 0


def test_overlaps_discard_only_what_cannot_be_linked(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 13)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 90, np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(90) < rng.choice([0.5, 0.9, 0.99])], rng.integers(0, 2**63, rng.integers(0, 9), np.uint64)))) for _ in range(60)]
    got = ngram_join.overlaps(sets, sets, 80, 100)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            over = len(np.intersect1d(a, b))
            assert got[i, j] == (over if 100 * over >= 80 * (len(a) + len(b) - over) else -1)


def test_stars_are_the_connected_parts():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (40, 30), (3000, 2500)):
        a, b = rng.integers(-n, n, m), rng.integers(-n, n, m)
        a, b = np.append(a, np.arange(10 * n, 12 * n)), np.append(b, np.arange(10 * n + 1, 12 * n + 1))  # and a path
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
        rows, roots = ngram_join.stars(a, b)
        assert dict(zip(rows.tolist(), roots.tolist())) == {x: find(x) for x in root if find(x) != x} and len(set(rows.tolist())) == len(rows)
    assert [len(x) for x in ngram_join.stars(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]
