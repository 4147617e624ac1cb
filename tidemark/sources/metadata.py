"""Scene metadata, listings and site files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "id string, properties struct<pixel_resolution: double, cloud_cover: double>"
#: Where metadata gives no resolution.
RESOLUTION = 3.0


def scene_properties(df: DataFrame, column: str, resolution: str = "pixel_resolution", cloud: str = "cloud_cover") -> DataFrame:
    """df with pixel_resolution, RESOLUTION where absent or malformed, and cloud_cover, of JSON texts."""
    return df.withColumns({"pixel_resolution": F.coalesce(F.get_json_object(column, f"$.{resolution}").try_cast("double"), F.lit(RESOLUTION)), "cloud_cover": F.get_json_object(column, f"$.{cloud}").try_cast("double")})


def stem(path: Column) -> Column:
    """The scene id of .../<id>_metadata.json."""
    return F.regexp_extract(path, r"([^/]+)_metadata\.json$", 1)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, pixel_resolution, cloud_cover) of every *_metadata.json; malformed files give the default resolution and no cloud cover."""
    raw = spark.read.schema(f"{METADATA}, _corrupt_record string").option("multiLine", True).option("pathGlobFilter", "*_metadata.json").option("recursiveFileLookup", True).json(folder)
    p = F.col("properties")
    return raw.select(stem(F.input_file_name()).alias("image_id"), F.coalesce(p.pixel_resolution, F.lit(RESOLUTION)).alias("pixel_resolution"), p.cloud_cover.alias("cloud_cover"))


def list_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id) of the metadata files, once each; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_metadata.json").option("recursiveFileLookup", True).load(folder)
    return files.select(stem(F.col("path")).alias("image_id")).distinct()


def list_files(spark: SparkSession, folder: str, parts: list[str], every: bool = True) -> DataFrame:
    """(name) of files whose name holds all, or any, of the parts; always rows, also for a single hit."""
    from tidemark.functions.ids import contains_all, contains_any

    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(name.alias("name"))
    return files.where((contains_all if every else contains_any)(F.col("name"), parts))


SITE_INFO = "beach_type string, max_dist_from_sl_ref double, minBeachArea double, minWaterSize double, pixel_size double"


def read_site_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SITE_INFO).option("multiLine", True).json(path)


def read_class_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("labels map<string, int>, colors map<string, array<double>>").option("multiLine", True).json(path)


def read_class_infos(spark: SparkSession, folder: str) -> DataFrame:
    """(model, labels, colors) of all class_info*.json in folder; the default's model is null."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^class_info_?(.*)\.json$", 1)
    return read_class_info(spark, f"{folder}/class_info*.json").select(F.nullif(name, F.lit("")).alias("model"), "labels", "colors")


def with_class_info(rows: DataFrame, infos: DataFrame) -> DataFrame:
    """rows (model, ...) with labels and colors: their model's own, else the default's, which is one row."""
    own = infos.where("model IS NOT NULL")
    default = infos.where("model IS NULL").agg(F.first("labels").alias("_labels"), F.first("colors").alias("_colors"))
    both = rows.join(own, "model", "left").crossJoin(F.broadcast(default))
    has = F.col("labels").isNotNull()
    return both.select(*rows.columns, F.when(has, F.col("labels")).otherwise(F.col("_labels")).alias("labels"), F.when(has, F.col("colors")).otherwise(F.col("_colors")).alias("colors"))


def with_pixel_size(scenes: DataFrame, metadata: DataFrame, key: str = "id") -> DataFrame:
    """scenes with pixel_size, the pixel_resolution of the metadata (id, pixel_resolution) that shares the first 15 characters of the id; of several the
    first by id, null without any. The metadata are made one a time stamp before they meet the scenes."""
    one = metadata.groupBy(F.substring("id", 1, 15).alias("_t")).agg(F.min_by("pixel_resolution", "id").alias("pixel_size"))
    return scenes.withColumn("_t", F.substring(key, 1, 15)).join(one, "_t", "left").drop("_t")


def read_gauge(spark: SparkSession, path: str, series: str = "gauge") -> DataFrame:
    """(series, ts, sl) of a gauge CSV with a header."""
    return spark.read.schema("ts timestamp_ntz, sl double").option("header", True).csv(path).select(F.lit(series).alias("series"), "ts", "sl")


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path, built and written when it isn't there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.parquet(path)
        return spark.read.parquet(path)


def merged_json(old: Column, new: Column) -> Column:
    """Two flat string maps as one; new wins."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
