"""Toxicity: a linear classifier of character n-grams that are scaled by naive Bayes log-count ratios, fitted on labelled documents and applied to whole texts in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_package
from tidemark.llm.columns import cut, table

#: Characters of an n-gram, from and to, and the bits of the table they hash into.
SHORTEST, LONGEST, BITS = 4, 7, 20
#: The bounded sample that the classifier is fitted on: labelled documents of each class, those of the smallest hashes of their ids, and the n-grams of all of them together.
TOXIC_ROWS, CLEAN_ROWS, ENTRIES = 1_536, 3_584, 1 << 25
#: Documents that an n-gram must stand in to count, added counts, weight of the penalty, and steps of the fit.
LEAST_DOCUMENTS, SMOOTHING, PENALTY, STEPS = 5, 1.0, 30.0, 40
#: Toxic documents that placing the intercept takes; below, it stays as fitted.
LEAST_TUNING = 8
#: Characters of a text that are hashed at a time.
SLICE = 1 << 20
U = np.uint64


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ngrams(text: str) -> Iterator[np.ndarray]:
    """The table places of all n-grams of a text in lower case with a space at both ends, slice by slice; repeats included."""
    text = f" {text.lower()} "
    for at in range(0, max(1, len(text) - LONGEST + 1), SLICE):
        codes = np.frombuffer(text[at : at + SLICE + LONGEST - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        h, out = codes, []
        for n in range(2, LONGEST + 1):
            if len(codes) < n:
                break
            h = h[:-1] * U(0x9E3779B97F4A7C15) + codes[n - 1 :]
            if n >= SHORTEST:
                out.append((_stirred(h + U(n)) >> U(64 - BITS)).astype(np.int32))
        yield np.concatenate(out) if out else np.zeros(0, np.int32)


class Distinct:
    """Tells the distinct n-grams of one text after another, with two tables of 2^BITS numbers instead of a sort."""

    def __init__(self) -> None:
        self.seen, self.place, self.text = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32), 0

    def parts(self, text: str) -> Iterator[np.ndarray]:
        self.text += 1
        for h in ngrams(text):
            fresh = h[self.seen[h] != self.text]
            self.place[fresh] = np.arange(len(fresh), dtype=np.int32)
            yield fresh[self.place[fresh] == np.arange(len(fresh))]
            self.seen[fresh] = self.text


@dataclass
class Model:
    """Weights of the table's places, each the fitted weight times the n-gram's log-count ratio, and the intercept."""

    weights: np.ndarray
    bias: float

    def score(self, distinct: Distinct, text: str) -> float:
        z = self.bias + sum(float(self.weights[part].sum(dtype=np.float64)) for part in distinct.parts(text))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _minimum(f, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent of f, which gives a value and its gradient, with halved steps."""
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    value, g = f(w)
    for _ in range(steps):
        q, shares = g.copy(), []
        for s, y in reversed(moves):
            shares.append((s @ q) / (y @ s))
            q -= shares[-1] * y
        q *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(moves, reversed(shares), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        t, slope = 1.0, -(g @ q)
        while True:
            there, gradient = f(w - t * q)
            if there <= value + 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, y = -t * q, gradient - g
        moves = [*moves, (s, y)][-memory:] if s @ y > 1e-12 else moves
        w, before, value, g = w + s, value, there, gradient
        if abs(before - value) <= 1e-6 * abs(before):
            break
    return w


def fit(rows: list[np.ndarray], toxic: np.ndarray, tuning: np.ndarray) -> Model:
    """The model of documents' distinct n-grams with their labels. tuning marks documents that only place the intercept: weights that were fitted to a document judge it too well."""
    learn = np.flatnonzero(~tuning)
    prior = np.log((toxic[learn].sum() + 0.5) / ((~toxic[learn]).sum() + 1.0))
    if not toxic[learn].any() or toxic[learn].all():
        return Model(np.zeros(1 << BITS, np.float32), float(prior))
    held = np.bincount(np.concatenate([rows[i] for i in learn]), minlength=1 << BITS) >= LEAST_DOCUMENTS
    number = np.cumsum(held, dtype=np.int32) - 1
    kept = [number[rows[i][held[rows[i]]]] for i in learn]
    y, size, n = toxic[learn], int(held.sum()), np.array([len(k) for k in kept])
    counts = [SMOOTHING + np.bincount(np.concatenate([k for k, t in zip(kept, y, strict=True) if t == side]), minlength=size) for side in (True, False)]
    ratio = np.log((counts[0] / (y.sum() + 2 * SMOOTHING)) / (counts[1] / ((~y).sum() + 2 * SMOOTHING)))
    cost = np.where(y, (~y).sum() / y.sum(), 1.0)
    pieces = np.array_split(np.arange(len(kept)), max(1, len(kept) // 256))

    def loss(wb: np.ndarray) -> tuple[float, np.ndarray]:
        w, value, g, shift = wb[:-1] * ratio, PENALTY / 2 * (wb[:-1] @ wb[:-1]), np.zeros(size), 0.0
        for piece in pieces:
            places, lengths = np.concatenate([kept[i] for i in piece]), n[piece]
            z = np.array([w[kept[i]].sum() for i in piece]) + wb[-1]
            value += (cost[piece] * np.logaddexp(0, np.where(y[piece], -z, z))).sum()
            e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[piece]) * cost[piece]
            g += np.bincount(places, weights=np.repeat(e, lengths), minlength=size)
            shift += e.sum()
        return value, np.append(g * ratio + PENALTY * wb[:-1], shift)

    wb = _minimum(loss, np.zeros(size + 1), STEPS)
    weights = np.zeros(1 << BITS, np.float32)
    weights[held] = wb[:-1] * ratio
    z = np.array([float(weights[rows[i]].sum(dtype=np.float64)) for i in np.flatnonzero(tuning)])
    return Model(weights, best_cut(z, toxic[tuning]) if toxic[tuning].sum() >= LEAST_TUNING else float(wb[-1]))


def best_cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """The intercept at which the harmonic mean of precision and recall is best: minus the middle between two neighbouring values; the highest such on ties."""
    order = np.argsort(-z)
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + toxic.sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = -1  # equal values aren't parted
    k = int(f1.argmax())
    return float(-(z[order[k]] + (z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 2)) / 2)


def training_rows(labels: DataFrame, held_out) -> DataFrame:
    """(doc_id, toxic, h): the bounded sample of labelled ids, without null labels and those of which held_out is true."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out).select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")).distinct().withColumn("h", F.xxhash64("doc_id", F.lit(13)))
    sides = [named.where(F.col("toxic") == side).orderBy("h", "doc_id").limit(n) for side, n in ((True, TOXIC_ROWS), (False, CLEAN_ROWS))]
    return cut(sides[0].unionByName(sides[1]))


def train(docs: DataFrame, labels: DataFrame, held_out) -> Model:
    """The classifier that labels (doc_id, toxic) of docs (doc_id, text) teach. The sample's ids are few and broadcast; texts are read where they lie, and their n-grams, ENTRIES at most,
    meet in one task, which fits. A quarter of the sample places the intercept."""
    chosen = training_rows(labels, held_out)

    def featured(batches):
        distinct = Distinct()
        for b in batches:
            found = [np.concatenate([*distinct.parts(t or "")]).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("toxic"), pa.array(found, pa.large_binary()).cast(pa.binary())], names=["h", "toxic", "places"])

    def fitted(batches):
        rows, total = [], 0
        for b in batches:  # in the order of h
            for h, toxic, places in zip(*(b.column(c).to_pylist() for c in ("h", "toxic", "places")), strict=True):
                if total + len(places) // 4 <= ENTRIES:
                    total += len(places) // 4
                    rows.append((np.frombuffer(places, np.int32), toxic, (h >> 7) % 4 == 0))
        model = fit([r[0] for r in rows], np.array([r[1] for r in rows], bool), np.array([r[2] for r in rows], bool))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    ship_package(docs.sparkSession)
    met = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("h", "toxic", "text")
    places = cut(met.mapInArrow(featured, "h bigint, toxic boolean, places binary"))
    row = places.repartition(1).sortWithinPartitions("h", F.length("places"), "places").mapInArrow(fitted, "weights binary, bias double").first()
    if row is None:
        return fit([], np.zeros(0, bool), np.zeros(0, bool))
    return Model(np.frombuffer(row.weights, np.float32), row.bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without text and with score, 0 to 1, in one pass without a shuffle. The model, 2^BITS numbers, is broadcast. Null texts are empty."""
    spark, kept = docs.sparkSession, [c for c in docs.columns if c not in (text, "score")]
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        mine, distinct = Model(*shared.value), Distinct()
        for b in batches:
            found = [mine.score(distinct, t or "") for t in b.column("_tm_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.float64())], names=[*kept, "score"])

    ship_package(spark)
    out = docs.select(*kept, F.col(text).alias("_tm_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return out.mapInArrow(run, f"{schema}{', ' if kept else ''}score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """A row a document. Null texts are empty ones, whose score is the intercept's; rows without an id are never held out. Without labels of both classes all scores are the prior's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
