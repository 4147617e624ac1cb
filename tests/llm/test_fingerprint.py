import brute
from pyspark.sql import functions as F

from tidemark.llm import fingerprint as fp


def sets(text):
    w = brute.words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, folder, rows):
    got = {r.doc_id: r for r in fp.op1_fingerprints(spark, folder).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    prints = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(new)), i
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        for value, other in ((r.near_edited, new), (r.near_next, after)):
            a, b = sets(text), sets(other)
            assert abs(value - alike(a, b)) < (1e-9 if len(a | b) <= fp.K else 0.2), i
        if text == new:
            assert r.fingerprint == r.edited_fingerprint


def test_odd(spark, odd):
    check(spark, odd[1], [(i, t) for i, t, _ in odd[0]])


def test_given(spark, sf):
    check(spark, sf, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_sparse_ids_repeats_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 2)
    ids = [-(10**15), 3, 4, 5, 10**17, 10**17 + 1, None, 7, 7]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id bigint, text string")
    got = {r.text: r.next_text for r in fp.with_next(df)[0].collect()}
    order = ["t5", "t4", "t8", "t7", "t3", "t2", "t1", "t0", "t6"]
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}


def test_blocks_are_even_wherever_ids_lie(spark):
    """Ids 0 to n with one far off, ids over the whole range of bigint, offset ids, one hot id and rows without an id."""
    low, high = -(2**63), 2**63 - 1
    tables = (
        "IF(id = 0, 4000000000000000000, id)", f"CAST(({low} + CAST(id AS DECIMAL(38, 0)) * {(2**64 - 1) // 20_000}) AS BIGINT)",
        "4611686018427387904 + id", "IF(id % 3 = 0, 7, id)", "IF(id % 3 = 0, NULL, id)",
    )
    for ids in tables:
        df = spark.range(20_000).selectExpr(f"{ids} AS doc_id", "concat('t', pmod(xxhash64(id), 100000000), ' ', id) AS text")
        bounds = fp.block_bounds(df)
        sizes = [r["count"] for r in df.groupBy(fp.block_of(fp.place_key(F.col("doc_id"), F.col("text")), bounds).alias("b")).count().collect()]
        assert len(sizes) > 100 and max(sizes) <= 3 * sum(sizes) / len(sizes), ids
    edge = spark.createDataFrame([(low, "a"), (high, "b"), (0, "c"), (-1, "d")], "doc_id bigint, text string")
    assert {r.text: r.next_text for r in fp.with_next(edge)[0].collect()} == {"b": "c", "c": "d", "d": "a", "a": "b"}


def test_neighbours_over_many_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 5)
    ids = [(i * 7919) % 1000 - 500 for i in range(1000)]
    df = spark.createDataFrame([(i, f"t{i}" if i % 100 else f"t{i} " + "word " * 30_000) for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.next_text.split(" ")[0] for r in fp.with_next(df)[0].collect()}
    assert got == {i: f"t{i - 1}" if i > -500 else "t499" for i in ids}


def test_merge_estimates(spark):
    a = " ".join(f"a{i}" for i in range(2000))
    b = " ".join(f"a{i}" for i in range(1000)) + " " + " ".join(f"b{i}" for i in range(1000))
    df = spark.createDataFrame([("k", a), ("k", b)], "k string, text string").withColumn("sketch", fp.sketch(F.col("text")))
    one = fp.merge_by(df, "k").first().sketch
    s = [r.sketch for r in df.collect()]
    assert one == sorted(set(s[0]) | set(s[1]))[: fp.K]
    x, y = F.array(*map(F.lit, s[0])), F.array(*map(F.lit, s[1]))
    r = df.select(fp.distinct_shingles(x).alias("n"), fp.containment(x, y).alias("c"), fp.resemblance(x, y).alias("j")).first()
    assert abs(r.n - 1996) < 600 and abs(r.c - 0.5) < 0.2 and abs(r.j - 1 / 3) < 0.15


def test_empty(spark, empty):
    assert fp.op1_fingerprints(spark, empty).count() == 0


def test_equal_rows_are_no_block(spark):
    df = spark.range(100_000).selectExpr("IF(id % 3 = 0, id, NULL) AS doc_id", "IF(id % 3 = 0, concat('t', id), 'one and the same text of more than sixteen characters') AS text")
    placed, most = fp.with_next(df)
    assert most == 66_666
    assert placed.count() == 33_334 + 2
    out = fp.expanded(placed.select("doc_id", "text", "next_text", "times"), most)
    assert out.count() == 100_000
    assert out.where("doc_id IS NULL AND next_text <> text").count() == 1  # the last is followed by the first document
    assert out.where("doc_id IS NULL AND next_text = 't99999'").count() == 1
