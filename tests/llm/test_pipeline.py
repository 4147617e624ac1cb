import collections
import struct

import brute
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp  # noqa: E402
import public_tokenizers  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import quality, queries  # noqa: E402


def kept_by_rules(text):
    n, chars, symbols, dup, repeat, base = brute.quality(text)
    lines = len([x for x in (text or "").split("\n") if brute.words(x)])
    rows, w = [x for x in (text or "").split("\n") if brute.words(x)], brute.words(text)
    form = 10 * sum(x.strip(" \t\v\f\r")[0] in "-*•‣◦" for x in rows) > 9 * lines or 10 * sum(x.rstrip(" \t\v\f\r").endswith(("...", "…")) for x in rows) > 3 * lines
    odd = 10 * sum(any(c.isalpha() for c in x) for x in w) < 5 * n or max(map(len, w), default=0) > 1000
    odd = odd or 10 * sum(c in "\x7f\ufffd" or (c < " " and c not in "\t\n\v\f\r") for c in text or "") > n
    return not (base or form or odd or symbols > n or 100 * dup > 50 * lines or 10 * chars < 15 * n or chars > 25 * n)


def stages(spark, folder, tmp_path):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, folder).write.parquet(f"{tmp_path}/s{k}")
        docs = spark.read.parquet(f"{tmp_path}/s{k}")
        assert k == 4 or docs.columns == columns
        out.append(docs.collect())
    return out


def check(spark, folder, tmp_path):
    import sentencepiece

    before = spark.read.parquet(f"{folder}/documents.parquet").collect()
    quality_out, joined, deduped, mixed, tokens = stages(spark, folder, tmp_path)
    assert sorted(r.doc_id for r in quality_out) == sorted(r.doc_id for r in before if kept_by_rules(r.text))
    group = brute.components({r.doc_id: r.text for r in quality_out}, n=5, num=80)
    assert sorted(r.doc_id for r in joined) == sorted(i for i, (_, c) in group.items() if c == i)
    kept = brute.repeats({r.doc_id: r.text for r in joined})
    texts = {r.doc_id: r.text for r in joined}
    want = {i: texts[i] if len(k) == n else " ".join(k) for i, (n, k) in kept.items() if k}
    assert {r.doc_id: r.text for r in deduped} == want and all(r.n_chars == len(r.text) for r in deduped)
    times = collections.Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 3 and all(r.text == want[r.doc_id] for r in mixed)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert collections.Counter(r.doc_id for r in tokens) == times
    for r in tokens:
        ids = [1, *lib.encode(want[r.doc_id]), 2]
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
    return before, quality_out, mixed


def test_odd(spark, odd, tmp_path):
    check(spark, odd[1], tmp_path)


def test_given(spark, sf, tmp_path):
    _, kept, mixed = check(spark, sf, tmp_path)
    size = sum(len(brute.words(r.text)) for r in mixed)
    assert size > 1000 and quality.POLICIES[quality.NEWEST]


def test_extra_columns_with_clashing_names(spark, odd, tmp_path):
    names = ("copies", "size", "n_words", "spans", "whole", "row", "_row", "slot", "fail_bits", "component_id", "ids", "sketch", "named")
    docs = spark.read.parquet(f"{odd[1]}/documents.parquet")
    docs.withColumns({n: F.lit(k) for k, n in enumerate(names)}).write.parquet(f"{tmp_path}/x/documents.parquet")
    out = stages(spark, f"{tmp_path}/x", tmp_path)
    assert all(out) and all(r[n] == k for r in out[3] for k, n in enumerate(names))
    for name, f in queries.QUERIES.items():
        if name.startswith("op") and name not in ("op2_url_filters", "op8_chat_format", "op12_ranked_search", "op13_toxicity"):
            assert f(spark, f"{tmp_path}/x").count() == len(odd[0])
    assert queries.QUERIES["quality_ablation"](spark, f"{tmp_path}/x").count() == 11
    assert queries.QUERIES["mixing_targets"](spark, f"{tmp_path}/x").count() == len({r[2] for r in odd[0]})
    assert queries.QUERIES["shard_totals"](spark, f"{tmp_path}/x").count() == 1


def test_rows_of_one_id_and_without_id(spark, tmp_path):
    import random

    import conftest

    rng = random.Random(3)
    fresh = iter(range(10**6))

    def text(n):
        return " ".join(f"v{next(fresh)}" for _ in range(n))

    near, other, shared, copy, bare, once, short = text(90), text(50), text(30), text(60), text(70), text(40), "a few short words"
    late, own, tail = text(25), text(25), text(25)
    rows = [(1, near, "a"), (2, near + " x", "a"), (2, other, "a")]  # a near copy and an unrelated row of one id
    rows += [(3, shared, "a"), (4, f"{late} {shared}", "a"), (4, own, "a"), (4, f"{shared} {tail}", "b")]  # spans of rows of one id
    rows += [(5, copy, "a"), (5, copy, "a"), (None, copy, "b")]  # repeats of one id, a copy without an id
    rows += [(None, bare, "a")] * 30 + [(None, f"{once} {shared}", "c"), (None, f"{bare} y", "a"), (None, short, "a"), (None, short, "a")]
    rng.shuffle(rows)
    folder = conftest.write(spark, f"{tmp_path}/rows", rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(5)
    cp.ngram_join(spark, docs, folder).write.parquet(f"{tmp_path}/joined")
    joined = spark.read.parquet(f"{tmp_path}/joined").collect()
    one = [r for r in joined if r.text in (bare, f"{bare} y")]
    assert len(one) == 1 and one[0].doc_id is None
    rest = sorted((r.doc_id or 0, r.text) for r in joined if r is not one[0])
    assert rest == sorted([(1, near), (2, other), (3, shared), (4, f"{late} {shared}"), (4, own), (4, f"{shared} {tail}"), (5, copy), (0, f"{once} {shared}"), (0, short)])
    got = cp.substring_dedup(spark, spark.read.parquet(f"{tmp_path}/joined"), folder).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    want = [(1, near), (2, other), (3, shared), (4, late), (4, own), (4, tail), (5, copy), (0, one[0].text), (0, once), (0, short)]
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted(want)
    alone = cp.substring_dedup(spark, docs, folder).collect()  # repeats and rows without an id, as they are
    assert collections.Counter(r.text for r in alone) == collections.Counter([near, "x", other, shared, late, own, tail, copy, bare, "y", once, short, short])
    mixed = cp.mixing(spark, docs, folder).collect()
    assert max(collections.Counter((r.doc_id, r.text, r.source) for r in mixed if r.text != bare).values()) <= 6


def test_empty(spark, empty, tmp_path):
    assert [len(x) for x in stages(spark, empty, tmp_path)] == [0] * 5


def test_run(spark, sf):
    got = cp.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and got.count() > 0
