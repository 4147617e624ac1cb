import collections
import math
import random
import re

import conftest
import numpy as np

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=50):
    """[(item, rank, doc_id, score)] of docs [(doc_id, text)] and items [(item_id, text)]."""
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 50 + 50 * c.total() * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def items_table(spark, folder, items):
    spark.createDataFrame(items, "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")


def agree(spark, folder, docs, items):
    items_table(spark, folder, items)
    got = [tuple(r) for r in lexical.op12_ranked_search(spark, folder).collect()]
    assert sorted(got, key=str) == plain(docs, items)


def test_odd(spark, odd):
    rows = [(i, t) for i, t, _ in odd[0]]
    agree(spark, odd[1], rows, [(1, "w1 w2 w3 É中 |"), (2, None), (3, ""), (4, "nowhere"), (5, rows[9][1]), (5, "w7"), (6, "W1, w1; ONE b"), (7, "x")])


def test_small_shards_and_blocks_of_queries(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    vocab = [f"v{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(rng.choice([None, i, 7]), " ".join(rng.choices(vocab, k=rng.randrange(1, 90))), "s") for i in range(900)]
    docs += [(5000 + i, docs[0][1], "s") for i in range(120)]  # more equal scores than hits
    folder = conftest.write(spark, tmp_path, docs)
    items = [(i, " ".join(rng.choices(vocab, k=12))) for i in range(15)] + [(99, docs[0][1])]
    for name, value in (("POSTINGS", 700), ("OPENED", 5), ("QUERIES", 4)):
        monkeypatch.setattr(lexical, name, value)
    agree(spark, folder, [r[:2] for r in docs], items)


def test_tree_against_all_documents(monkeypatch):
    rng = np.random.default_rng(4)
    for opened in (1, 3, 256):
        monkeypatch.setattr(lexical, "OPENED", opened)
        for n_docs in (1, 2, 37, 300):
            lists = [np.sort(rng.choice(n_docs, rng.integers(1, n_docs + 1), replace=False)) for _ in range(9)]
            impacts = [rng.integers(1, 40, len(x)) for x in lists]
            order = [np.lexsort((d, -u)) for d, u in zip(lists, impacts)]
            doc, u = np.concatenate([d[o] for d, o in zip(lists, order)]), np.concatenate([x[o] for x, o in zip(impacts, order)]).astype(np.int32)
            levels = max(1, (n_docs - 1).bit_length())
            tree = lexical.Tree(levels, b"".join(np.packbits(b).tobytes() for b in lexical.level_bits(doc, levels)), u.tobytes())
            ends = np.cumsum([len(x) for x in lists])
            w = rng.integers(1, 9, 9)
            score = np.zeros(n_docs, np.int64)
            for d, x, k in zip(lists, impacts, w):
                score[d] += k * x
            got = dict(zip(*map(np.ndarray.tolist, tree.search(ends - [len(x) for x in lists], ends, w, 10, 1))))
            least = sorted(score)[-10] if n_docs >= 10 else 1
            assert got == {i: int(s) for i, s in enumerate(score) if s >= max(least, 1)}


def test_long_texts_are_counted_in_slices(monkeypatch):
    rng = random.Random(1)
    for size in (7, 50, 1000):
        monkeypatch.setattr(lexical, "SLICE", size)
        for _ in range(30):
            text = "".join(rng.choice(["Ab", "é", " ", "-", "x" * 40, "\n"]) for _ in range(rng.randrange(400)))
            assert lexical.term_counts(text.encode()) == collections.Counter(t.encode() for t in terms(text))


def test_empty(spark, empty):
    items_table(spark, empty, [(1, "a b")])
    assert lexical.op12_ranked_search(spark, empty).collect() == []
    items_table(spark, empty, [])
    assert lexical.op12_ranked_search(spark, empty).collect() == []
