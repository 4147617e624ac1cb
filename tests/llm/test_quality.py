import brute
from pyspark.sql import functions as F

from tidemark.llm import quality


def test_measurements_and_base(spark, odd):
    rows, folder = odd
    got = {r.doc_id: r for r in quality.op10_quality_rules(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text), i
        assert not (r.base_failed and r.kept)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in quality.op10_quality_rules(spark, sf).collect()}
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(d.text)


def test_policies_and_ablation(spark, odd):
    _, folder = odd
    led = quality.ledger(spark.read.parquet(f"{folder}/documents.parquet")).cache()
    rows = led.select("fail_bits").collect()
    table = {r.rule: r for r in quality.ablation(led).collect()}
    full = quality.mask(quality.POLICIES[quality.NEWEST])
    for rule in quality.RULES:
        assert table[rule.name].failed == sum(bool(r.fail_bits & (1 << rule.bit)) for r in rows)
        assert table[rule.name].failed_alone == sum(r.fail_bits == 1 << rule.bit for r in rows)
        assert table[rule.name].kept_without == sum(not r.fail_bits & full & ~(1 << rule.bit) for r in rows)
    kept = [led.where(quality.verdict(F.col("fail_bits"), v)).count() for v in (1, 2, 3)]
    assert kept[0] >= kept[1] >= kept[2] > 0


def test_empty_and_clashing_names(spark, empty):
    assert quality.op10_quality_rules(spark, empty).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id int, text string, n_words string, n_symbols int")
    assert quality.ledger(df).first().n_words == 2
    assert {(r.failed, r.failed_alone, r.kept_without) for r in quality.ablation(quality.ledger(df.limit(0))).collect()} == {(0, 0, 0)}


def test_repetition_in_long_texts(spark):
    """Windows that repeat far apart, among a quarter of a million others."""
    w = [f"w{i}" for i in range(250_000)]
    w[100_000:100_007] = w[3:10]
    w[249_000:249_005] = w[50:55]
    df = spark.createDataFrame([(" ".join(w),), (" ".join(["a"] * 300),), (" ".join(w[:5] * 60_000),)], "text string")
    assert [r.n_repeat_words for r in quality.ledger(df).select("n_repeat_words").collect()] == [24, 300, 300_000]


def test_rules_of_the_ledger(spark):
    text = "Some plain words that make a line of prose here"
    cases = {
        "bullet_lines": "\n".join(f"- item {i} with several plain words" for i in range(5)),
        "ellipsis_lines": "\n".join(f"{text} {i}..." for i in range(3)) + f"\n{text}",
        "few_alphabetic": " ".join(f"{i} {i * 7}" for i in range(1, 40)) + " word",
        "unbroken": text + " " + "x" * 1001,
        "control_characters": text + " \ufffd\ufffd\x07",
        "symbols": text + "#" * 40,
    }
    df = spark.createDataFrame(list(cases.items()), "name string, text string")
    for r in quality.ledger(df).collect():
        assert r.fail_bits & quality.mask([r.name]), r.name
    clean = quality.ledger(spark.createDataFrame([(f"{text}. And a second line\n- with one item, and more…\nthe end of it\nis here",)], "text string")).first()
    assert clean.fail_bits == 0
