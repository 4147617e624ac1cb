"""Map features: transects, reference lines, contours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_CRS = "crs struct<type: string, properties: struct<name: string>>"
LINES = f"type string, {_CRS}, features array<struct<type: string, properties: struct<name: string, id: string>, geometry: struct<type: string, coordinates: string>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, crs, ord, name, id, type, coordinates) a feature; coordinates as JSON text, as their nesting differs by type."""
    raw = spark.read.schema(LINES).option("multiLine", True).json(path)
    f = raw.select(F.input_file_name().alias("file"), F.col("crs.properties.name").alias("crs"), F.posexplode("features").alias("ord", "f"))
    return f.select("file", "crs", "ord", F.col("f.properties.name").alias("name"), F.col("f.properties.id").alias("id"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_transects(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, x0, y0, x1, y1): a line's name is its name; a multi-line of one two-point line goes by its id; anything else is an error."""
    f = read_features(spark, path)
    line = F.from_json("coordinates", "array<array<double>>")
    multi = F.from_json("coordinates", "array<array<array<double>>>")
    single = F.when((F.size(multi) == 1) & (F.size(multi[0]) == 2), multi[0])
    points = F.when(F.col("type") == "LineString", line).when((F.col("type") == "MultiLineString") & single.isNotNull(), single).otherwise(F.raise_error(F.lit("not a transect")).cast("array<array<double>>"))
    name = F.when(F.col("type") == "LineString", F.col("name")).otherwise(F.col("id"))
    return f.select("file", "ord", name.alias("name"), points.alias("p")).select("file", "ord", "name", *[F.col("p")[i][j].alias(n) for n, i, j in (("x0", 0, 0), ("y0", 0, 1), ("x1", 1, 0), ("y1", 1, 1))])


def read_reference_line(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, x, y) of each file's first feature; a multi-line of one line counts as that line."""
    f = read_features(spark, path).where("ord = 0")
    points = F.when(F.col("type") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>")[0]).otherwise(F.from_json("coordinates", "array<array<double>>"))
    return f.select("file", F.posexplode(points).alias("seq", "p")).select("file", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def line_features(vertices: DataFrame, epsg: int, key: str = "image_id") -> DataFrame:
    """(key, n, geojson): a collection with one line a contour, vertices in order."""
    at = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p.x, p.y))
    lines = vertices.groupBy(key).agg(F.count("*").alias("n"), at.alias("coordinates"))
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit(f"urn:ogc:def:crs:EPSG::{epsg}").alias("name")).alias("properties"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("coordinates")).alias("geometry"))
    return lines.select(key, "n", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col(key).cast("string").alias("name"), crs.alias("crs"), F.array(feature).alias("features"))).alias("geojson"))


def site_features(contours: DataFrame, metadata: DataFrame, accuracy: int = 999) -> DataFrame:
    """(site, n, geojson): all contours (site, image_id, seq, x, y) of a site with their metadata (image_id, ts, satname, cloud_cover), met by
    the first 15 characters of the id, the first metadata by id; contours without metadata are left out. A feature a contour keeps rows bounded by
    a site's images."""
    m = metadata.withColumn("_t", F.substring("image_id", 1, 15)).withColumn("_k", F.row_number().over(W.partitionBy("_t").orderBy("image_id"))).where("_k = 1")
    at = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p.x, p.y))
    lines = contours.groupBy("site", "image_id").agg(at.alias("coordinates")).withColumn("_t", F.substring("image_id", 1, 15))
    both = lines.join(m.select("_t", "ts", "satname", "cloud_cover"), "_t")
    props = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), "satname", F.lit(accuracy).alias("geoaccuracy"), "cloud_cover")
    feature = F.struct(F.col("image_id").alias("_o"), F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("coordinates")).alias("geometry"))
    listed = F.transform(F.sort_array(F.collect_list(feature)), lambda f: f.dropFields("_o"))
    return both.groupBy("site").agg(F.count("*").alias("n"), listed.alias("features")).select("site", "n", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("features"))).alias("geojson"))
