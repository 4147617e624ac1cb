"""Scoring, training tables and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dot(vector: Column, weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def linear_score(vector: Column, weights: list[float], bias: float = 0.0) -> Column:
    return dot(vector, weights) + F.lit(float(bias))


def softmax_class(vector: Column, weights: list[list[float]], masked: Column | None = None) -> Column:
    """The class of the highest score, the smallest on ties; null where masked."""
    scores = F.array(*[dot(vector, w) for w in weights])
    best = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    return best if masked is None else F.when(~masked, best)


def classify(features: DataFrame, model, names: list[str], masked: Column | None = None) -> DataFrame:
    """features with cls. model: a Column function of the feature array, or an ML transformer of a features vector with prediction as its output.
    Null features count as 0, or as 1e-9 where the model asks for masked pixels to be left out."""
    fill = 0.0 if masked is None else 1e-9
    filled = features.fillna(fill, names)
    if hasattr(model, "transform"):
        from pyspark.ml.feature import VectorAssembler

        scored = model.transform(VectorAssembler(inputCols=list(names), outputCol="_features").transform(filled)).withColumn("cls", F.col("prediction").cast("int"))
        scored = scored.drop("_features", "rawPrediction", "probability", "prediction")
    else:
        scored = filled.withColumn("cls", model(F.array(*[F.col(n).cast("double") for n in names])).cast("int"))
    return scored if masked is None else scored.withColumn("cls", F.when(~masked, F.col("cls")))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def dice(pairs: DataFrame) -> DataFrame:
    """(dice) of rows (truth, pred: boolean)."""
    both, t, p = (F.count_if(c) for c in (F.col("truth") & F.col("pred"), F.col("truth"), F.col("pred")))
    return pairs.agg(_ratio(2 * both, t + p).alias("dice"))


def prf1(pairs: DataFrame) -> DataFrame:
    """(tp, fp, tn, fn, accuracy, precision, recall, f1) of rows (truth, pred: boolean); undefined ratios are null."""
    t, p = F.col("truth"), F.col("pred")
    c = pairs.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select("tp", "fp", "tn", "fn", _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_scores(pixels: DataFrame) -> DataFrame:
    """(image_id, class, tp, fp, tn, fn, dice, accuracy, precision, recall, f1) of pixels (image_id, truth, pred, inside): every class that an image's
    inside pixels show in truth or pred. Pixels are counted by truth and pred before anything else, so what is shuffled is a few counts an image and
    task; pixels whose truth or pred is null don't count."""
    counts = pixels.where("inside AND truth IS NOT NULL AND pred IS NOT NULL").groupBy("image_id", "truth", "pred").agg(F.count("*").alias("n"))
    sides = F.array_distinct(F.array(F.struct(F.col("truth").alias("class")), F.struct(F.col("pred").alias("class"))))
    by_class = counts.select("image_id", "truth", "pred", "n", F.explode(sides).alias("_s")).select("image_id", F.col("_s.class").alias("class"), "truth", "pred", "n")
    t, p = F.col("truth") == F.col("class"), F.col("pred") == F.col("class")

    def total(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    sums = by_class.groupBy("image_id", "class").agg(total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"))
    both = sums.join(counts.groupBy("image_id").agg(F.sum("n").alias("_all")), "image_id")
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = both.select("image_id", "class", "tp", "fp", (F.col("_all") - tp - fp - fn).alias("tn"), "fn")
    ratios = {"dice": _ratio(2 * tp, 2 * tp + fp + fn), "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}
    return out.withColumns(ratios)


def confusion(pairs: DataFrame, classes: list, normalize: bool = False) -> DataFrame:
    """(truth, pred_<class>...): counts, or shares of their row."""
    wide = pairs.groupBy("truth").pivot("pred", classes).count().fillna(0)
    wide = wide.select("truth", *[F.col(f"`{str(c).lower() if isinstance(c, bool) else c}`").cast("bigint").alias(f"pred_{c}".lower()) for c in classes])
    if not normalize:
        return wide
    names = [f"pred_{c}".lower() for c in classes]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return wide.select("truth", *[_ratio(F.col(n), total).alias(n) for n in names])


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """df with code: the labels' place in alphabetical order. Codes come from the distinct labels."""
    codes = df.select(column).distinct().withColumn("code", (F.row_number().over(W.orderBy(column)) - 1).cast("bigint"))
    return df.join(F.broadcast(codes) if codes.limit(10_001).count() <= 10_000 else codes, column)


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, by their population deviation (1 if that is 0). One row of statistics is joined back."""
    stats = df.agg(*[F.avg(c).alias(f"_m{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") == 0, 1.0).otherwise(F.col(f"_s{c}")) for c in columns}).drop(*[f"_{k}{c}" for k in "ms" for c in columns])


def is_subset(small: DataFrame, large: DataFrame) -> DataFrame:
    """(column, subset): whether every non-null value of each column of small is in the same column of large."""
    if missing := set(small.columns) - set(large.columns):
        raise KeyError(sorted(missing))
    parts = [small.select(F.col(c).alias("v")).where("v IS NOT NULL").join(large.select(F.col(c).alias("v")), "v", "left_anti").agg((F.count("*") == 0).alias("subset")).select(F.lit(c).alias("column"), "subset") for c in small.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def training_pixels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of labelled pixels (image_id, r, c, class)."""
    return features.join(labels, (features["image_id"] == labels["image_id"]) & (features["row"] == labels["r"]) & (features["col"] == labels["c"])).select(features["*"], labels["class"])


def training_set(frame: DataFrame, columns: list[str], site: str | None = None, not_site: str | None = None, file: str | None = None, not_file: str | None = None, scale: bool = False) -> DataFrame:
    """Rows without nulls, restricted to or without a site and file, labels encoded in alphabetical order, features scaled on demand."""
    rows = frame.na.drop()
    for column, value, same in (("sitename", site, True), ("sitename", not_site, False), ("filename", file, True), ("filename", not_file, False)):
        if value is not None:
            rows = rows.where((F.col(column) == value) if same else (F.col(column) != value))
    rows = label_encode(rows, "class")
    return standardize(rows, columns) if scale else rows


def augment(frame: DataFrame, columns: list[str], shift: float, compat: bool = True) -> DataFrame:
    """Three copies: as they are, positive values plus shift, positive values minus shift (compat: minus 300 whatever the shift)."""
    def moved(by: float) -> DataFrame:
        return frame.withColumns({c: F.when(F.col(c) > 0, F.col(c) + by).otherwise(F.col(c)) for c in columns})

    return frame.unionByName(moved(shift)).unionByName(moved(-300.0 if compat else -shift))


