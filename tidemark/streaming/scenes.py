"""New scene metadata as a stream: each image once, each batch through a site plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import item_time
from tidemark.sources.metadata import METADATA, RESOLUTION, stem


def new_scenes(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    """(image_id, ts, pixel_resolution, cloud_cover) of metadata files as they come; an id that comes again within the watermark is dropped."""
    raw = spark.readStream.schema(METADATA).option("multiLine", True).option("pathGlobFilter", "*_metadata.json").json(folder)
    p = F.col("properties")
    rows = raw.select(stem(F.input_file_name()).alias("image_id"), F.coalesce(p.pixel_resolution, F.lit(RESOLUTION)).alias("pixel_resolution"), p.cloud_cover.alias("cloud_cover"))
    timed = rows.withColumn("ts", item_time(F.col("image_id")).cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["image_id"]).select("image_id", "ts", "pixel_resolution", "cloud_cover")


def run_site(scenes: DataFrame, plan, checkpoint: str):
    """Starts a query that hands each batch of scenes to plan(batch, batch_id); all that is there is worked off, then it ends."""
    return scenes.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
