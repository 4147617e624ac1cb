"""A registry of classifiers as data: versioned coefficients of logistic models and multi-layer perceptrons, several of them in one plan."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A model is its layers, each a matrix of weights, a row a unit, and a bias a unit; kind says what is between and after them.
MODELS = "model string, version int, kind string, layers array<struct<weights: array<array<double>>, bias: array<double>>>"
#: Models of a registry, which is broadcast.
MOST = 1_000


def publish(spark: SparkSession, folder: str, model: str, kind: str, layers: list[tuple[list[list[float]], list[float]]]) -> int:
    """Appends a version of a model to folder and returns its number. kind: logistic (one layer of one unit) or mlp (rectified layers, the last one's largest unit wins). Two writers at once may take one number: then the
    model can't be read, until one of them is published again."""
    if kind not in ("logistic", "mlp") or (kind == "logistic" and (len(layers) != 1 or len(layers[0][0]) != 1)) or any(len(w) != len(b) for w, b in layers):
        raise ValueError("layers don't fit the kind")
    try:
        version = 1 + (spark.read.schema(MODELS).parquet(folder).where(F.col("model") == model).agg(F.max("version")).first()[0] or 0)
    except AnalysisException:
        version = 1
    row = (model, version, kind, [([[float(x) for x in r] for r in w], [float(x) for x in b]) for w, b in layers])
    spark.createDataFrame([row], MODELS).coalesce(1).write.mode("append").parquet(folder)
    return version


def newest(models: DataFrame) -> DataFrame:
    """Each model's newest version."""
    return models.withColumn("_r", F.row_number().over(W.partitionBy("model").orderBy(F.col("version").desc()))).where("_r = 1").drop("_r")


def _layer(x: Column, layer: Column) -> Column:
    sums = F.transform(layer.weights, lambda row: F.aggregate(F.zip_with(row, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return F.zip_with(sums, layer.bias, lambda a, b: a + b)


def scores(features: Column, layers: Column) -> Column:
    """The last layer's sums; those of the layers before are rectified."""
    return F.aggregate(layers, F.struct(features.cast("array<double>").alias("x"), F.lit(0).alias("k")), lambda acc, layer: F.struct(F.transform(_layer(acc.x, layer), lambda v: F.when(acc.k + 1 < F.size(layers), F.greatest(v, F.lit(0.0))).otherwise(v)).alias("x"), (acc.k + 1).alias("k")), lambda acc: acc.x)


def classify(features: DataFrame, column: str, models: DataFrame, wanted: Column, default: str = "default") -> DataFrame:
    """features with model, version, cls and error: each row by the newest version of the model that wanted names, or by the default where there is none. A logistic model's class is whether its sum is above 0, a
    perceptron's its largest unit, the first on ties. Rows whose features are null, hold nulls or don't fit the model have no class, and error says so; a corrupt image is such rows, not a failed job.

    One join with the registry's rows, at most MOST, which are counted and broadcast; all kinds are expressions of one plan."""
    taken = {"model", "version", "cls", "error"} & set(features.columns)
    if taken:
        raise ValueError(f"column names {sorted(taken)} are taken")
    current = newest(models).select(F.col("model").alias("_m"), F.col("version").alias("_v"), F.col("kind").alias("_kind"), F.col("layers").alias("_layers"))
    if current.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} models")
    names = F.broadcast(current.select(F.col("_m").alias("_known")))
    asked = features.withColumn("_wanted", wanted).join(names, F.col("_wanted") == F.col("_known"), "left").withColumn("_wanted", F.coalesce("_known", F.lit(default))).drop("_known")
    met = asked.join(F.broadcast(current), F.col("_wanted") == F.col("_m"), "left")
    x = F.col(column).cast("array<double>")
    fits = F.when(F.col("_m").isNull(), F.lit("no model")).when(F.col(column).isNull() | F.exists(x, lambda v: v.isNull()), F.lit("no features")).when(F.size(x) != F.size(F.col("_layers")[0].weights[0]), F.lit("features don't fit"))
    out = scores(x, F.col("_layers"))
    best = F.when(F.col("_kind") == "logistic", (out[0] > 0).cast("int")).otherwise((F.array_position(out, F.array_max(out)) - 1).cast("int"))
    return met.withColumn("error", fits).withColumn("cls", F.when(F.col("error").isNull(), best)).select(*features.columns, F.col("_m").alias("model"), F.col("_v").alias("version"), "cls", "error")
