import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, folder, rows):
    """A documents table with the given rows (doc_id, text, source)."""
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCUMENTS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture
def odd(spark, tmp_path):
    """Nulls, empty and long texts, ties, copies, near copies, shared passages, no ids lost; rows and folder."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["É中", "a|b", "###", "<|endoftext|>"]
    passage = " ".join(rng.choices(vocab, k=45))
    rows = [(0, None, None), (1, "", "a"), (2, " \n\t ", "a"), (3, "one", "b"), (4, "two words", "b"), (5, "x " * 3000, "c")]
    base = rng.choices(vocab, k=400)
    for i in range(12):
        near = list(base)
        for _ in range(i % 5):
            near[rng.randrange(400)] = rng.choice(vocab)
        rows.append((10 + i, " ".join(near), "a"))
    for i in range(8):
        rows.append((30 + i, " ".join(base[:200]).upper() if i % 2 else " ".join(base[:200]), None))
    for i in range(10):
        own = rng.choices(vocab, k=30)
        rows.append((50 + i, " ".join(own[:i]) + "\n" + passage + "\n" + " ".join(own[i:]), "b"))
    rows += [(70, "z" * 5000, "c"), (71, "  lead  and   trail  ", "c"), (72, "line\nline\n\nline\n \nother", "c"), (100, "tail words here now and then", "c")]
    for i in range(40):
        rows.append((200 + 3 * i, " ".join(rng.choices(vocab, k=rng.randrange(1, 60))), rng.choice(["a", "b", "c", None])))
    return rows, write(spark, tmp_path, rows)


@pytest.fixture
def empty(spark, tmp_path):
    return write(spark, tmp_path, [])
