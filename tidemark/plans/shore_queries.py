"""Queries over many images, atlases, drawn shapes and model registries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lineage import run_folder
from tidemark.operators import annotation, contours, raster, registry, tides, vector
from tidemark.plans.queries import _DENSE, ORACLE_SQL, QUERIES, _line, _segments_sql, query, r6

_SEG = _segments_sql().replace("SELECT CAST", "SELECT a.image_id, CAST", 1)
for _t in "abde":
    _SEG = _SEG.replace(f"L {_t} ", f"M {_t} ")
for _t in "bde":
    _SEG = _SEG.replace(f"M {_t} ON ", f"M {_t} ON {_t}.image_id = a.image_id AND ")


@query(
    "contour_order",
    f""", S AS ({_SEG}),
    W(image_id, sr, sc, r, c, k) AS (SELECT image_id, r0, c0, r0, c0, 0 FROM S WHERE NOT EXISTS (SELECT 1 FROM S p WHERE p.image_id = S.image_id AND p.r1 = S.r0 AND p.c1 = S.c0) UNION ALL SELECT W.image_id, sr, sc, r1, c1, k + 1 FROM W JOIN S ON S.image_id = W.image_id AND S.r0 = W.r AND S.c0 = W.c),
    X AS (SELECT * FROM S WHERE NOT EXISTS (SELECT 1 FROM W WHERE W.image_id = S.image_id AND W.r = S.r0 AND W.c = S.c0)),
    C(image_id, sr, sc, r, c, k) AS (SELECT image_id, r0, c0, r0, c0, 0 FROM X UNION ALL SELECT C.image_id, sr, sc, r1, c1, k + 1 FROM C JOIN X ON X.image_id = C.image_id AND X.r0 = C.r AND X.c0 = C.c WHERE k = 0 OR NOT (C.r = sr AND C.c = sc)),
    P AS (SELECT * FROM W UNION ALL SELECT * FROM C WHERE (image_id, sr, sc) IN (SELECT (image_id, sr, sc) FROM C GROUP BY image_id, sr, sc HAVING min(r * 100000 + c) = sr * 100000 + sc)),
    N AS (SELECT image_id, sr, sc, row_number() OVER (PARTITION BY image_id ORDER BY min(r * 100000 + c)) - 1 AS line, sum(count(*)) OVER (PARTITION BY image_id ORDER BY min(r * 100000 + c)) - count(*) AS start FROM P GROUP BY image_id, sr, sc)
    SELECT P.image_id, CAST(line AS INT) AS line, CAST(start + k AS BIGINT) AS seq, P.r, P.c FROM P JOIN N ON N.image_id = P.image_id AND N.sr = P.sr AND N.sc = P.sc""",
    "M",
)
def _(spark, m):
    return contours.ordered(raster.segments(m)).select("image_id", F.col("line").cast("int").alias("line"), F.col("seq").cast("bigint").alias("seq"), "r", "c")


@query(
    "inside_buffer",
    f"""{_DENSE}, Z AS (SELECT max(r)+1 AS h, max(c)+1 AS w FROM G), I AS (SELECT DISTINCT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM X, Z WHERE r > 0 AND c > 0 AND r < h AND c < w),
    B AS (SELECT G.r, min(G.c) AS c0, max(G.c) AS c1 FROM G JOIN I ON (G.r-I.r)*(G.r-I.r)+(G.c-I.c)*(G.c-I.c) <= 16 GROUP BY G.r),
    R AS (SELECT r, c0 AS c, r AS o, 0 AS side FROM B UNION ALL SELECT r, c1, -r, 1 FROM B WHERE c1 <> c0),
    U AS (SELECT r AS r0, c AS c0, coalesce(lead(r) OVER w, first_value(r) OVER w) AS r1, coalesce(lead(c) OVER w, first_value(c) OVER w) AS c1 FROM R WINDOW w AS (ORDER BY side, o)),
    Y AS (SELECT seq, (seq * 37 % 1000) / CAST(25 AS DOUBLE) AS r, (seq * 53 % 1300) / CAST(25 AS DOUBLE) AS c FROM V)
    SELECT seq, round(Y.r, 6) AS r, round(Y.c, 6) AS c FROM Y JOIN U ON true GROUP BY seq, Y.r, Y.c HAVING count(*) FILTER (WHERE (r0 > Y.r) <> (r1 > Y.r) AND Y.c < (c1-c0)*(Y.r-r0)/CAST(CASE WHEN r1 = r0 THEN 1 ELSE r1-r0 END AS DOUBLE)+c0) % 2 = 1 AND count(*) FILTER (WHERE abs((c1-c0)*(Y.r-r0)-(r1-r0)*(Y.c-c0)) < 1e-9 AND Y.c BETWEEN least(c0,c1) AND greatest(c0,c1) AND Y.r BETWEEN least(r0,r1) AND greatest(r0,r1)) = 0""",
    "T", "G", "V",
)
def _(spark, t, g, v):
    size = g.agg(F.lit("a").alias("line"), (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    edges = vector.polygon_edges(raster.buffer(raster.densify(_line(t), 4.0), size, 4), "line").select("line", F.col("c0").alias("x0"), F.col("r0").alias("y0"), F.col("c1").alias("x1"), F.col("r1").alias("y1"))
    points = v.select(F.lit("a").alias("line"), F.lit("G").alias("image_id"), "seq", ((F.col("seq") * 53 % 1300) / 25.0).alias("x"), ((F.col("seq") * 37 % 1000) / 25.0).alias("y"))
    return vector.inside_polygons(points, edges, "line", 1.0).select("seq", F.round("y", 6).alias("r"), F.round("x", 6).alias("c"))


def _sections(v):
    """Each image's vertices as one section."""
    from pyspark.sql import Window as W

    w = W.partitionBy("image_id")
    return v.select("image_id", F.lit(0).alias("section"), (F.row_number().over(w.orderBy("seq")) - 1).alias("i"), F.count("*").over(w).alias("n"), "x", "y")


_SAMPLES = """, I AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n, x, y FROM V),
    J AS (SELECT image_id, n, j, j*(n-1)/CAST(99 AS DOUBLE) AS pl FROM (SELECT DISTINCT image_id, n FROM I) q CROSS JOIN (SELECT unnest(range(100)) AS j) z),
    D AS (SELECT J.image_id, J.n, j, a.x + coalesce(b.x-a.x, 0)*greatest(pl-a.i, 0) AS x, a.y + coalesce(b.y-a.y, 0)*greatest(pl-a.i, 0) AS y FROM J JOIN I a ON a.image_id = J.image_id AND a.i = floor(pl + 1e-12) LEFT JOIN I b ON b.image_id = J.image_id AND b.i = a.i + 1),
    K AS (SELECT k, exp(CAST(-0.5 AS DOUBLE)*k*k/(0.8*0.8)) / sum(exp(CAST(-0.5 AS DOUBLE)*k*k/(0.8*0.8))) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS k) q)"""


@query(
    "smooth_sections",
    f"""{_SAMPLES}, E AS (SELECT o.image_id, o.j, sum(w*s.x) AS x, sum(w*s.y) AS y FROM D o CROSS JOIN K JOIN D s ON s.image_id = o.image_id AND s.j = CASE WHEN o.j + k < 0 THEN -(o.j+k)-1 WHEN o.j + k > 99 THEN 199-(o.j+k) ELSE o.j+k END GROUP BY 1, 2),
    F AS (SELECT image_id, i, CASE WHEN n > 1 THEN i*CAST(99 AS DOUBLE)/(n-1) ELSE 0 END AS pl FROM I)
    SELECT F.image_id, CAST(i AS BIGINT) AS i, round(a.x + coalesce(b.x-a.x, 0)*greatest(pl-a.j, 0), 4) AS x, round(a.y + coalesce(b.y-a.y, 0)*greatest(pl-a.j, 0), 4) AS y FROM F JOIN E a ON a.image_id = F.image_id AND a.j = floor(pl + 1e-12) LEFT JOIN E b ON b.image_id = F.image_id AND b.j = a.j + 1""",
    "V",
)
def _(spark, v):
    return vector.smooth_sections(_sections(v), 0.8).select("image_id", "i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    "smooth_window",
    f"""{_SAMPLES}, Q AS (SELECT (m-1)//3 AS g, m, o FROM (SELECT unnest(range(1, 98, 3)) AS m) a CROSS JOIN (SELECT unnest(range(3)) AS o) b)
    SELECT D.image_id, CAST(3*g+o AS BIGINT) AS i, round(sum(w*x), 4) AS x, round(sum(w*y), 4) AS y FROM Q CROSS JOIN K JOIN D ON D.j = m-1 + CASE ((o+k)%6+6)%6 WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 0 ELSE ((o+k)%6+6)%6 END GROUP BY 1, 2""",
    "V",
)
def _(spark, v):
    return vector.smooth_sections(_sections(v), 0.8, window=3).select("image_id", "i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("raster_round_trip", "SELECT image_id, r, c, CAST(cls + r % 3 AS INT) AS cls, CAST(7 * c AS INT) AS g FROM M", "M")
def _(spark, m):
    """Written as a GeoTIFF an image, and read again by strips; the pixels that a last, short image lacks aren't asked for."""
    from tidemark.sources.rasterfiles import read_pixels, write_rasters

    folder = run_folder(spark, "rasters")
    pixels = m.select("image_id", "r", "c", (F.col("cls") + F.col("r") % 3).alias("cls"), (7 * F.col("c")).alias("g"))
    write_rasters(pixels, folder, ["cls", "g"], "_q.tif", georef=(621000.0, 3.0, 0.0, 2354000.0, 0.0, -3.0), epsg=32604, compression="deflate")
    back = read_pixels(spark, folder, ["cls", "g"], ["cls", "g"], "_q.tif")
    return back.join(m.select("image_id", "r", "c"), ["image_id", "r", "c"], "left_semi").select("image_id", "r", "c", "cls", "g")


# --- drawn shapes: triangles and quadrilaterals around every customer's place in the raster

_CORNERS = "SELECT seq AS shape, unnest([0, 1, 2]) AS seq, unnest([seq % 37 + CAST(0.25 AS DOUBLE), seq % 37 + seq % 5 + CAST(1.5 AS DOUBLE), seq % 37 + CAST(3.75 AS DOUBLE)]) AS r, unnest([seq % 41 + CAST(0.5 AS DOUBLE), seq % 41 + CAST(3.25 AS DOUBLE), seq % 41 + seq % 7 + CAST(1.125 AS DOUBLE)]) AS c FROM V"


@query(
    "lasso_labels",
    f""", S AS ({_CORNERS}), E AS (SELECT shape, r AS r0, c AS c0, coalesce(lead(r) OVER w, first_value(r) OVER w) AS r1, coalesce(lead(c) OVER w, first_value(c) OVER w) AS c1 FROM S WINDOW w AS (PARTITION BY shape ORDER BY seq)),
    H AS (SELECT G.r, G.c, shape FROM G JOIN E ON G.r >= least(r0, r1) AND G.r < greatest(r0, r1) AND c0 + (c1-c0)*(G.r-r0)/(r1-r0) > G.c GROUP BY ALL HAVING count(*) % 2 = 1)
    SELECT H.r, H.c, min(shape) AS shape, CAST(min(shape) % 3 AS INT) AS cls FROM H JOIN G ON G.r = H.r AND G.c = H.c WHERE NOT masked GROUP BY 1, 2""",
    "G", "V",
)
def _(spark, g, v):
    s = F.col("seq")
    corners = F.array(*[F.struct(r.cast("double").alias("r"), c.cast("double").alias("c")) for r, c in ((s % 37 + 0.25, s % 41 + 0.5), (s % 37 + s % 5 + 1.5, s % 41 + 3.25), (s % 37 + 3.75, s % 41 + s % 7 + 1.125))])
    shapes = v.select(F.lit("G").alias("image_id"), s.alias("shape"), F.posexplode(corners).alias("k", "p")).select("image_id", "shape", F.col("k").alias("seq"), "p.r", "p.c")
    classes = v.select(F.lit("G").alias("image_id"), s.alias("shape"), (s % 3).cast("int").alias("cls"))
    return annotation.label_pixels(g, annotation.row_intervals(shapes), classes, g.where("masked")).select("r", "c", "shape", "cls")


# --- a tide atlas over the parts, read at the events

_PARTS = "SELECT part, name, CAST(p_partkey % 20 AS BIGINT) AS i, CAST(floor(p_partkey / CAST(20 AS DOUBLE)) % 10 AS BIGINT) AS j, p_size * amp AS re, (p_retailprice - 900) / 100 * amp AS im FROM part CROSS JOIN (VALUES ('ocean', 'M2', CAST(0.02 AS DOUBLE)), ('ocean', 'K1', CAST(0.01 AS DOUBLE)), ('ocean', 'O1', CAST(0.008 AS DOUBLE)), ('load', 'S2', CAST(-0.001 AS DOUBLE)), ('load', 'M2', CAST(-0.002 AS DOUBLE))) a(part, name, amp) WHERE p_partkey < 200 AND p_partkey % 11 <> 0"


def _tide_sql() -> str:
    known = ", ".join(f"('{n}', " + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in v) + ")" for n, v in tides.CONSTITUENTS.items())
    return f"""WITH A AS ({_PARTS}), Z(name, speed, f0, f1, u1) AS (VALUES {known}),
    P AS (SELECT event_id, floor(epoch_us(ts) / CAST(1000000 AS DOUBLE)) - {tides.EPOCH} AS s, (event_id % 210) / CAST(10 AS DOUBLE) AS x, (event_id % 97) / CAST(10 AS DOUBLE) AS y FROM events),
    C AS (SELECT event_id, s, CAST(floor(x) + a AS BIGINT) AS i, CAST(floor(y) + b AS BIGINT) AS j, CASE a WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END AS w FROM P CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b)),
    E AS (SELECT event_id, s, part, name, sum(w*re)/sum(w) AS re, sum(w*im)/sum(w) AS im FROM C JOIN A ON A.i = C.i AND A.j = C.j WHERE w > 0 GROUP BY ALL),
    T AS (SELECT event_id, sum((f0+f1*cos(radians({tides.NODE}+({tides.NODE_A_DAY})*s/86400)))*(re*cos(radians(speed*s/3600+u1*sin(radians({tides.NODE}+({tides.NODE_A_DAY})*s/86400))))+im*sin(radians(speed*s/3600+u1*sin(radians({tides.NODE}+({tides.NODE_A_DAY})*s/86400)))))) AS tide FROM E JOIN Z ON Z.name = E.name GROUP BY 1)
    SELECT P.event_id, round(tide, 6) AS tide FROM P LEFT JOIN T ON T.event_id = P.event_id"""


def _tide_atlas(spark, sf_dir):
    grids = spark.sql(_PARTS.replace("FROM part CROSS", "FROM {part} CROSS"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", (F.col("event_id") % 210 / 10.0 - 160).alias("lon"), (F.col("event_id") % 97 / 10.0 + 20).alias("lat"))
    return tides.GridAtlas(grids, -160.0, 20.0, 1.0).tide(points).select("event_id", *r6("tide"))


QUERIES["tide_atlas"], ORACLE_SQL["tide_atlas"] = _tide_atlas, _tide_sql()

# --- two kinds of models in one plan

_LOGISTIC = [((i * 7) % 13 - 6) / 10 for i in range(64)]
_HIDDEN = [[((i * (k + 2)) % 9 - 4) / 8 for i in range(64)] for k in range(5)]
_OUT = [[((i + 2 * k) % 5 - 2) / 4 for i in range(5)] for k in range(3)]


def _by_registry(spark, sf_dir):
    folder = run_folder(spark, "models")
    registry.publish(spark, folder, "default", "logistic", [([[1.0] * 64], [9.0])])
    registry.publish(spark, folder, "default", "logistic", [([_LOGISTIC], [0.05])])
    registry.publish(spark, folder, "steep", "mlp", [(_HIDDEN, [0.1, 0.2, 0.3, -0.1, 0.0]), (_OUT, [0.0, 0.01, 0.02])])
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("embedding", F.when(F.col("label") != 9, F.col("embedding")))
    kind = F.when(F.col("label") % 3 == 0, "steep").when(F.col("label") % 3 == 1, "unheard of")
    return registry.classify(e, "embedding", spark.read.schema(registry.MODELS).parquet(folder), kind).select("vec_id", "model", "version", "cls", "error")


def _dots(rows, vector_sql):
    return "[" + ", ".join(f"list_dot_product({vector_sql}, CAST([{', '.join(map(repr, map(float, r)))}] AS DOUBLE[]))" for r in rows) + "]"


def _registry_sql() -> str:
    hidden = ", ".join(f"greatest(h[{k + 1}] + CAST({b} AS DOUBLE), 0)" for k, b in enumerate((0.1, 0.2, 0.3, -0.1, 0.0)))
    outs = ", ".join(f"o[{k + 1}] + CAST({b} AS DOUBLE)" for k, b in enumerate((0.0, 0.01, 0.02)))
    return f"""SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'steep' ELSE 'default' END AS model, CASE WHEN label % 3 = 0 THEN 1 ELSE 2 END AS version, CAST(CASE WHEN label = 9 THEN NULL WHEN label % 3 = 0 THEN list_position(p, list_max(p)) - 1 WHEN z[1] + CAST(0.05 AS DOUBLE) > 0 THEN 1 ELSE 0 END AS INT) AS cls, CASE WHEN label = 9 THEN 'no features' END AS error
    FROM (SELECT *, [{outs}] AS p FROM (SELECT *, {_dots(_OUT, 'y')} AS o FROM (SELECT *, CAST([{hidden}] AS DOUBLE[]) AS y FROM (SELECT vec_id, label, {_dots(_HIDDEN, 'CAST(embedding AS DOUBLE[])')} AS h, {_dots([_LOGISTIC], 'CAST(embedding AS DOUBLE[])')} AS z FROM embeddings) a) b) c) d"""


QUERIES["model_registry"], ORACLE_SQL["model_registry"] = _by_registry, _registry_sql()
