import pytest

P = pytest.importorskip("public_tokenizers")
from tidemark.llm import tokens  # noqa: E402


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def agree(spark, folder, rows):
    lib, got = library(), {r.doc_id: r for r in tokens.op6_token_counts(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        n = len(lib.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_given_documents(spark, sf):
    agree(spark, sf, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_odd(spark, odd):
    agree(spark, odd[1], [(i, t) for i, t, _ in odd[0]])


def test_cache_is_used_and_grows(spark, tmp_path):
    args = (str(tmp_path / "cache"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    one = spark.createDataFrame([(1, "a b"), (2, "a b"), (2, "a b"), (3, None), (None, "c")], "doc_id bigint, text string")
    assert tokens.count_tokens(one, *args).count() == 5
    assert spark.read.parquet(args[0]).select("digest").distinct().count() == 3
    before = spark.read.parquet(args[0]).count()
    two = spark.createDataFrame([(7, "a b"), (8, "new one")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(two, *args).collect()} == {7: 2, 8: 2}
    assert spark.read.parquet(args[0]).count() == before + 1
    tokens.count_tokens(two, args[0], args[1], P.PATTERN, "<|endoftext|>").collect()
    assert spark.read.parquet(args[0]).count() == before + 3  # another version counts anew


def test_hot_rows_without_id_and_lost_parts(spark, tmp_path):
    args = (str(tmp_path / "cache"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    df = spark.createDataFrame([(None, "one and the same")] * 500 + [(4, "other", ), (None, "third")], "doc_id bigint, text string").repartition(3)
    assert tokens.count_tokens(df, *args).count() == 502
    assert spark.read.parquet(args[0]).count() <= 5  # one encoding a task and content
    out = tokens.count_tokens(spark.createDataFrame([(1, "never seen")], "doc_id bigint, text string"), *args)
    for f in (tmp_path / "cache").glob("tokenizer=*/run=*/*.parquet"):
        f.unlink()
    with pytest.raises(Exception):  # a result is never short of documents
        out.collect()
    assert tokens.count_tokens(df, *args).count() == 502


def test_empty(spark, empty):
    assert tokens.op6_token_counts(spark, empty).count() == 0


def test_white_space_runs(monkeypatch):
    import random
    import re

    lib, e, rng = library(), tokens.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "<|endoftext|>"), random.Random(1)
    for c in (" ", "\n", "\t", " \n", "a", "\u3000"):
        x = c * (10**6 // len(c))
        assert tokens.encoded_length(e, x, "<|endoftext|>", {}) == len(lib.encode(x, add_special_tokens=False).ids)
    assert tokens.encoded_length(e, "\n" * 10**7, "<|endoftext|>", {}) == 5 * 10**6
    monkeypatch.setattr(tokens, "_LONG", re.compile(tokens._LONG.pattern.replace("10000", "10")))
    parts = ["a", " ", "\t", "\x1c" * 12, "é", "1", "!", "<|endoftext|>", "\r\n" * 9]
    for _ in range(800):
        x = "".join(rng.choice([*parts, *(c * rng.randrange(1, 60) for c in (" ", "\n", "\xa0", " \n"))]) for _ in range(rng.randrange(1, 12)))
        assert tokens.encoded_length(e, x, "<|endoftext|>", {}) == len(lib.encode(x, add_special_tokens=False).ids), x


def test_long_white_space_in_a_table(spark, tmp_path):
    import conftest

    rows = [(1, "a" + "\n" * 1_000_000 + "b", "s"), (2, " " * 2_000_000, "s"), (3, "plain", "s")]
    agree(spark, conftest.write(spark, tmp_path, rows), [r[:2] for r in rows])
