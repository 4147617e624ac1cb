import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """All levels, bottom first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    """[(left siblings, right siblings)] from node i up."""
    out = []
    for level in levels[:-1]:
        run = range(i - i % 2, min(i - i % 2 + 2, len(level)))
        out.append(([level[j] for j in run if j < i], [level[j] for j in run if j > i]))
        i //= 2
    return out


def plain(rows):
    """op11's rows of rows (doc_id, source, lang, n_chars, text) as tuples."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    sub = {}
    for lang in langs:
        sub[lang] = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    levels = {lang: tree([leaf(r) for r in sub[lang]]) for lang in langs}
    top = tree([levels[lang][-1][0] for lang in langs]) if langs else [[]]
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(sub[lang]):
            proof = path(levels[lang], i) + path(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            at = leaf((*r[:3], r[3] + 1, r[4]) if bad else r)
            for left, right in proof:
                at = h(*left, at, *right)
            root = top[-1][0]
            out.append((r[0], leaf(r), levels[lang][-1][0], root, h(*[x for a, b in proof for x in a + b]), at, at == root))
    return sorted(out, key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def rows_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]


def agree(spark, folder):
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, folder).collect()]
    assert sorted(got, key=str) == plain(rows_of(spark, folder))
    return got


def test_given(spark, sf):
    got = agree(spark, sf)
    assert {r[6] for r in got} == {True, False} and len({r[3] for r in got}) == 1


def test_odd(spark, odd):
    agree(spark, odd[1])


def test_nulls_repeats_languages_and_sizes(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 3 + [(i, "s", "en", i, f"t{i}") for i in range(600)] + [(5, "s", "en", 5, "t5")] * 2 + [(9, "é", "é", 1, "é")]
    rows += [(i, None, "de", None, "") for i in range(257)] + [(i, "s", "", 1, "x") for i in (2**62, -(2**62), 0)] + [(7, "s", "z", None, "y"), (8, "s", "z", 3, "y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("tree", "pos", "digest", "item", "block", "n", "top", "levels")})
    df.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    assert len(agree(spark, str(tmp_path))) == len(rows)


def test_hot_language_and_equal_rows(spark, tmp_path):
    df = spark.range(20_000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "'s' AS source", "IF(id % 10 = 0, 'b', 'a') AS lang", "1L AS n_chars", "IF(id % 3 = 0, 'same', concat('t', id)) AS text")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    agree(spark, str(tmp_path))


def test_spans_agree_and_wider_trees_fold(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = {"doc_id": F.col("doc_id")}
    roots = {merkle.build(docs, items, f"{tmp_path}/{k}", 2, k).root() for k in (1, 3, 8)}
    assert len(roots) == 1
    wide = merkle.build(docs, items, f"{tmp_path}/wide", 5, 2)
    out = merkle.proofs(wide).withColumn("back", merkle.folded(F.col("digest"), F.col("proof")))
    assert out.count() == docs.count() and out.where("back <> root").isEmpty() and {wide.root()} != roots


def test_changed_leaves(spark, tmp_path):
    df = spark.range(3000).selectExpr("id AS doc_id", "'s' AS source", "IF(id % 2 = 0, 'a', 'b') AS lang", "id AS n_chars", "concat('t', id) AS text")
    none = {"doc_id": F.col("doc_id")}
    old = merkle.build(df, none, f"{tmp_path}/old", 2, 3)
    new = merkle.build(df.withColumn("text", F.when(F.col("doc_id").isin(10, 2001), "other").otherwise(F.col("text"))), none, f"{tmp_path}/new", 2, 3)
    assert sorted((r.tree, r.pos) for r in merkle.changed(old, new).collect()) == [("+a", 5), ("+b", 1000)]
    more = merkle.build(df.unionByName(spark.range(9000, 9100).selectExpr("id AS doc_id", "'s' AS source", "'a' AS lang", "id AS n_chars", "'new' AS text")), none, f"{tmp_path}/more", 2, 3)
    got = merkle.changed(old, more).collect()
    assert len(got) == 100 and all(r.old is None and r.tree == "+a" and r.pos >= 1500 for r in got)
    with pytest.raises(ValueError):
        merkle.changed(old, merkle.build(df, none, f"{tmp_path}/x", 4, 2))


def test_empty(spark, empty):
    assert merkle.op11_merkle_manifest(spark, empty).collect() == []


def test_sql(spark, sf):
    import duckdb

    from tidemark.llm.oracles import OP11

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(db.sql(OP11).fetchall(), key=str) == plain(rows_of(spark, sf))
