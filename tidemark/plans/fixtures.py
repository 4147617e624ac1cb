"""Rasters, vertices, transects, gauges and scenes made from the driver's tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RING = [(621450.0, 2352900.0), (621850.0, 2352950.0), (621800.0, 2353350.0), (621500.0, 2353300.0), (621450.0, 2352900.0)]

#: {table} stands for a driver table.
SQL = {
    "G": """SELECT 'G' AS image_id, CAST(floor(p_partkey / CAST(50 AS DOUBLE)) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, CAST(p_size * 20 AS INT) AS b, CAST(floor(p_retailprice) AS INT) AS g, CAST(p_size * 10 + 100 AS INT) AS red, CAST(floor((p_retailprice - 900) * 10 + CAST(0.5 AS DOUBLE)) AS INT) AS nir, (CASE WHEN (p_partkey * 7) % 23 = 0 THEN 2 WHEN p_partkey < 50 THEN 1 ELSE 0 END) <> 0 AS masked FROM {part}""",
    "L": """SELECT 'L' AS image_id, CAST(floor(p_partkey / CAST(50 AS DOUBLE)) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, CASE WHEN p_partkey % 50 >= 25 + (p_size - 25) / CAST(5 AS DOUBLE) THEN 1 ELSE 0 END AS cls FROM {part}""",
    "M": """SELECT concat('m', CAST(CAST(floor(event_id / CAST(400 AS DOUBLE)) AS INT) AS STRING)) AS image_id, CAST(floor(event_id % 400 / CAST(20 AS DOUBLE)) AS INT) AS r, CAST(event_id % 20 AS INT) AS c, CASE WHEN event_id % 20 >= 8 + (event_id * 7919 % 101) / CAST(25 AS DOUBLE) THEN 1 ELSE 0 END AS cls FROM {events}""",
    "V": """SELECT c_nationkey AS image_id, c_custkey AS seq, CAST(621400 + c_custkey % 500 AS DOUBLE) AS x, 2352900 + c_acctbal / 20 AS y FROM {customer}""",
    "T": """SELECT CAST(s_suppkey AS STRING) AS name, s_suppkey AS ord, CAST(621400 + 25 * s_suppkey AS DOUBLE) AS x0, CAST(2353300 AS DOUBLE) AS y0, CAST(621380 + 25 * s_suppkey + CASE WHEN s_suppkey % 10 = 3 THEN 30 ELSE 0 END AS DOUBLE) AS x1, CAST(2352950 AS DOUBLE) AS y1 FROM {supplier}""",
    "O": """SELECT ts, event_id AS image_id, event_type AS transect, value AS dist FROM {events}""",
    "H": """SELECT 'h' AS series, ts, value / 100 AS sl FROM {events} WHERE event_type = 'view'""",
    "P": """SELECT 'h' AS series, ts, event_id, value AS dist FROM {events} WHERE event_type = 'purchase'""",
    "B": """SELECT quality = 1 AS truth, toxic = 1 AS pred FROM {labels}""",
    "Q": """SELECT CAST(o_custkey % 9 AS STRING) AS site, {stamp} AS id, o_orderdate AS acquired, (o_custkey % 100) / CAST(100 AS DOUBLE) AS cloud_cover, CAST(621400 + o_custkey % 500 AS DOUBLE) AS x, CAST(2352900 + o_orderkey % 500 AS DOUBLE) AS y FROM {orders}""",
}
SQL["F"] = """SELECT DISTINCT CASE WHEN o_custkey % 5 = 0 THEN concat('bay', CAST(o_custkey % 9 AS STRING), '_shoreline.geojson') ELSE concat('bay', CAST(o_custkey % 9 AS STRING), '_shoreline_', substr(CAST(o_orderdate AS STRING), 1, 7), '_', CAST(year(o_orderdate) - o_custkey % 3 AS STRING), '-', CAST(year(o_orderdate) AS STRING), '_', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(1 + o_custkey % 12 AS STRING), 2, '0'), '.geojson') END AS file FROM {orders}"""
_STAMP = {
    "spark": "concat(date_format(o_orderdate, 'yyyyMMdd_HHmmss'), '_', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'), '_', lower(hex(o_custkey)))",
    "duckdb": "strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || '_' || lower(to_hex(o_custkey))",
}
TABLES = {"G": "part", "L": "part", "M": "events", "V": "customer", "T": "supplier", "O": "events", "H": "events", "P": "events", "B": "labels", "Q": "orders", "F": "orders"}

#: Reference lines, dated and default.
REFERENCES = ("bay_shoreline_1995-01_1992-1994_10-03.geojson", "bay_shoreline_1996-05_1992-1996_04-09.geojson", "bay_shoreline_1997-01_1997-1997_01-12.geojson", "bay_shoreline.geojson", "bay_shoreline_2001-01_2001-2002_01-06.geojson")

#: name, amplitude, speed in degrees an hour, phase in degrees.
CONSTITUENTS = (("K1", 0.148, 15.0410686, 230.5), ("M2", 0.182, 28.9841042, 64.2), ("O1", 0.083, 13.9430356, 224.1), ("S2", 0.058, 30.0, 60.7))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLES[name]
    text = SQL[name].replace("{stamp}", _STAMP["spark"])
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def duckdb(*names: str) -> str:
    """A WITH clause that defines the fixtures."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].replace('{stamp}', _STAMP['duckdb']).replace('{' + TABLES[n] + '}', TABLES[n])})" for n in names)
