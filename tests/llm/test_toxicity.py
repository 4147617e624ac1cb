import random
import zlib

import conftest
import numpy as np

from tidemark.llm import toxicity


def labels(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")


def plain_ngrams(text):
    t = f" {text.lower()} "
    return {t[i : i + n] for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1) for i in range(len(t) - n + 1)}


def test_distinct_ngrams(monkeypatch):
    texts, d = ["", "a", "Abc", "aaaa aaaa", "Ünïcode ist so eine Sache 中文字 " * 5], toxicity.Distinct()
    for size in (1 << 20, 5, 13):
        monkeypatch.setattr(toxicity, "SLICE", size)
        for t in texts:
            got = np.concatenate([*d.parts(t)])
            assert len(got) == len(set(got.tolist())) == len(plain_ngrams(t))  # no collisions among so few


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in toxicity.op13_toxicity(spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r.doc_id], r.toxic) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(r.predicted and t for r, t in held)
    assert right >= 0.8 * sum(t for _, t in held) and right >= 0.9 * sum(r.predicted for r, _ in held)
    clean, bad = sorted(r.score for r, t in held if not t), [r.score for r, t in held if t]
    assert np.mean(np.searchsorted(clean, bad) / len(clean)) > 0.97


def planted(spark, folder, n=400):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=40) + ["wretchling"] * (i % 5 == 0)), "s") for i in range(n)]
    rows += [(None, "wretchling " * 3, "s"), (9000, None, "s"), (9001, "", "s"), (9002, "plain words " * 200_000, "s"), (9003, "You WRETCHLING of old", "s"), (9003, "You WRETCHLING of old", "s")]
    return conftest.write(spark, folder, rows), rows


def test_planted_word_nulls_and_repeats(spark, tmp_path):
    folder, rows = planted(spark, tmp_path)
    labels(spark, folder, [(i, 1, int(i % 5 == 0)) for i in range(400)] + [(3, 1, None), (None, 1, 1), (12345, 0, 1), (4, 1, 0)])
    got = toxicity.op13_toxicity(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        bad = r.doc_id is None or r.doc_id == 9003 or (r.doc_id < 400 and r.doc_id % 5 == 0)
        assert r.predicted == int(bad), r
    again = toxicity.op13_toxicity(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_labels_of_one_class_or_none(spark, tmp_path, empty):
    folder, rows = planted(spark, f"{tmp_path}/x", 20)
    for given in ([], [(i, 1, 0) for i in range(20)], [(i, 1, None) for i in range(20)]):
        labels(spark, folder, given)
        assert {r.predicted for r in toxicity.op13_toxicity(spark, folder).collect()} == {0}
    labels(spark, empty, [(1, 1, 1)])
    assert toxicity.op13_toxicity(spark, empty).collect() == []


def test_extra_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0)], "text string, _tm int, score double")
    got = toxicity.score(df, toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.0)).collect()
    assert [tuple(r) for r in got] == [(1, 0.5)]
