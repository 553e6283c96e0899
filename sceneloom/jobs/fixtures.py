"""Scene tables as views over the test tables, in Spark and as DuckDB common table expressions (``SQL``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.appearance import C0, logit

GRAD_THRESHOLD = 0.0006
EXTENT = 5.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    model = F.when(k % 5 == 0, "SIMPLE_PINHOLE").when(k % 5 == 4, "OPENCV").otherwise("PINHOLE")
    return read(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("scene_id"),
        k.alias("camera_id"),
        model.alias("model"),
        (800 + 40 * k).cast("long").alias("width"),
        (600 + 20 * k).cast("long").alias("height"),
        F.array((700 + 10 * k).cast("double"), (690 + 11 * k).cast("double")).alias("params"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # Nations are 25 whatever the scale.
    return (
        read(spark, sf_dir, "supplier")
        .join(F.broadcast(nations), n == F.col("n_nationkey"))
        .select(
            F.col("n_regionkey").alias("scene_id"),
            k.alias("image_id"),
            n.alias("camera_id"),
            F.concat("s_name", F.lit(".jpg")).alias("name"),
            F.array(F.lit(1.0), k % 7 / 70.0, k % 5 / 50.0, n % 3 / 30.0).alias("qvec"),
            F.array(F.col("s_acctbal") / 5000.0, k % 13 / 13.0, F.when(k % 17 == 5, -50.0).otherwise(6.137 + k % 3)).alias("tvec"),
        )
    )


def points3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    scenes = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("scene_id"))
    parts = read(spark, sf_dir, "part").filter(k % 10 != 3)
    # Five scenes whatever the scale: each part stands once in each.
    return parts.crossJoin(F.broadcast(scenes)).select(
        "scene_id",
        k.alias("point3d_id"),
        (k % 97 / 10.0 - 4.8 + 0.1 * F.col("scene_id")).alias("x"),
        (F.col("p_size") / 10.0 - 2.5).alias("y"),
        (F.col("p_retailprice") % 7 * 2 - 7 + k % 31 / 10.0).alias("z"),
        (k % 256).cast("short").alias("r"),
        (3 * k % 256).cast("short").alias("g"),
        (7 * k % 256).cast("short").alias("b"),
        (F.col("p_size") / 50.0).alias("error"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    by = W.partitionBy("l_suppkey").orderBy(*[F.col(c) for c in sorted(lines.columns)])
    point = F.when(F.col("l_linenumber") == 7, F.lit(-1).cast("long")).when((F.col("l_linenumber") == 6) & (F.col("l_partkey") % 50 == 0), F.col("l_partkey") + 1_000_000).otherwise(F.col("l_partkey"))
    scenes = images(spark, sf_dir).select("scene_id", "image_id")
    seen = lines.select(
        F.col("l_suppkey").alias("image_id"),
        (F.row_number().over(by) - 1).alias("idx"),
        (F.col("l_extendedprice") % 1800 - 20).alias("x"),
        ((F.col("l_quantity") * 37.5 + F.col("l_orderkey") % 29) % 1300 - 10).alias("y"),
        point.alias("point3d_id"),
    )
    return seen.join(scenes, "image_id").select("scene_id", "image_id", "idx", "x", "y", "point3d_id")


def depth_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 maps, row-major."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: (e.cast("double") + 1) / 2).alias("depth"))
    of = images(spark, sf_dir).filter("image_id % 13 <> 0").select("scene_id", "image_id", (F.col("image_id") % 500).alias("vec_id"))
    return of.join(vectors, "vec_id").select("scene_id", "image_id", F.lit(8).alias("map_width"), F.lit(8).alias("map_height"), "depth")


def primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = F.col("o_totalprice") % 1000 / 1000.0 + 0.001
    colour = lambda m: (k * m % 256 / 255.0 - 0.5) / C0
    return read(spark, sf_dir, "orders").select(
        (k % 5).cast("int").alias("scene_id"),
        k.alias("prim_id"),
        (F.col("o_custkey") % 200 / 20.0 - 5).alias("x"),
        (k % 173 / 17.3 - 5).alias("y"),
        (F.col("o_totalprice") % 777 / 77.7 - 5).alias("z"),
        F.array(*[colour(m) for m in (1, 3, 7)]).alias("f_dc"),
        F.transform(F.sequence(F.lit(1), F.lit(45)), lambda i: (k * i % 11 - 5) / 50.0).alias("f_rest"),
        logit((37 * k % 1000 + 1) / 1002.0).alias("opacity"),
        F.array(F.ln(s), F.ln(s / 2), F.ln(s / 4)).alias("scale"),
        F.array(F.lit(1.0), k % 7 / 7.0, k % 5 / 5.0, k % 3 / 3.0).alias("rot"),
    )


def view_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).cast("int").alias("scene_id"),
        (501 + F.col("l_partkey") % 2000).alias("iteration"),
        F.col("l_suppkey").alias("view_id"),
        F.col("l_orderkey").alias("prim_id"),
        F.when(F.col("l_returnflag") == "N", F.lit(0)).otherwise(F.ceil(F.col("l_quantity") / 2)).cast("long").alias("radius"),
        (F.col("l_discount") / 100).alias("grad_x"),
        (F.col("l_tax") / 100).alias("grad_y"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each view and method: 64 grey values of ground truth (null: missing) and of the render.

    Names have five digits, so vectors from 100,000 on share theirs; ``vec_id`` tells them apart.
    """
    method = F.explode(F.array(F.struct(F.lit("iter_7000").alias("method"), F.lit(0.9).alias("gain"), F.lit(0.02).alias("bias")), F.struct(F.lit("iter_30000").alias("method"), F.lit(0.97).alias("gain"), F.lit(0.01).alias("bias"))))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda e: (e.cast("double") + 1) / 2).alias("gt"), method.alias("m"))
    render = F.when(F.col("vec_id") % 50 == 0, F.col("gt")).otherwise(F.transform("gt", lambda v: F.least(F.greatest(v * F.col("m.gain") + F.col("m.bias"), F.lit(0.0)), F.lit(1.0))))
    return rows.select(
        F.col("label").alias("scene_id"),
        "vec_id",
        "m.method",
        F.concat(F.lpad(F.col("vec_id").cast("string"), 5, "0"), F.lit(".png")).alias("name"),
        F.when(F.col("vec_id") % 97 != 1, F.col("gt")).alias("gt"),
        render.alias("render"),
    )


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") / 500).alias("loss"))


#: The same views for DuckDB. Each may use those before it.
SQL = {
    "cameras": """SELECT n_regionkey AS scene_id, n_nationkey AS camera_id,
      CASE n_nationkey % 5 WHEN 0 THEN 'SIMPLE_PINHOLE' WHEN 4 THEN 'OPENCV' ELSE 'PINHOLE' END AS model,
      800 + 40 * n_nationkey AS width, 600 + 20 * n_nationkey AS height, (700 + 10 * n_nationkey)::DOUBLE AS fx, (690 + 11 * n_nationkey)::DOUBLE AS fy FROM nation""",
    "images": """SELECT n_regionkey AS scene_id, s_suppkey AS image_id, s_nationkey AS camera_id, s_name || '.jpg' AS name,
      1e0 AS qw, s_suppkey % 7 / 70e0 AS qx, s_suppkey % 5 / 50e0 AS qy, s_nationkey % 3 / 30e0 AS qz,
      s_acctbal / 5000e0 AS tx, s_suppkey % 13 / 13e0 AS ty, CASE WHEN s_suppkey % 17 = 5 THEN -50e0 ELSE 6.137e0 + s_suppkey % 3 END AS tz
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "rots": """SELECT *, 1 - 2 * (qy * qy + qz * qz) AS r0, 2 * (qx * qy - qw * qz) AS r1, 2 * (qx * qz + qw * qy) AS r2,
      2 * (qx * qy + qw * qz) AS r3, 1 - 2 * (qx * qx + qz * qz) AS r4, 2 * (qy * qz - qw * qx) AS r5,
      2 * (qx * qz - qw * qy) AS r6, 2 * (qy * qz + qw * qx) AS r7, 1 - 2 * (qx * qx + qy * qy) AS r8 FROM images""",
    "points3d": """SELECT r_regionkey AS scene_id, p_partkey AS point3d_id, p_partkey % 97 / 10e0 - 4.8e0 + 0.1e0 * r_regionkey AS x, p_size / 10e0 - 2.5e0 AS y,
      p_retailprice % 7 * 2 - 7 + p_partkey % 31 / 10e0 AS z, p_partkey % 256 AS r, 3 * p_partkey % 256 AS g, 7 * p_partkey % 256 AS b, p_size / 50e0 AS error
      FROM part, region WHERE p_partkey % 10 <> 3""",
    "observations": """SELECT scene_id, l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {columns}) - 1 AS idx,
      l_extendedprice % 1800 - 20 AS x, (l_quantity * 37.5e0 + l_orderkey % 29) % 1300 - 10 AS y,
      CASE WHEN l_linenumber = 7 THEN -1 WHEN l_linenumber = 6 AND l_partkey % 50 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS point3d_id
      FROM lineitem JOIN images ON image_id = l_suppkey""",
    "depth_maps": """SELECT scene_id, image_id, list_transform(embedding::DOUBLE[], lambda e: (e + 1) / 2) AS depth FROM images JOIN embeddings ON vec_id = image_id % 500 WHERE image_id % 13 <> 0""",
    "primitives": f"""SELECT o_orderkey % 5 AS scene_id, o_orderkey AS prim_id, o_custkey % 200 / 20e0 - 5 AS x, o_orderkey % 173 / 17.3e0 - 5 AS y, o_totalprice % 777 / 77.7e0 - 5 AS z,
      (o_orderkey % 256 / 255e0 - 0.5e0) / {C0!r} AS dc0, (3 * o_orderkey % 256 / 255e0 - 0.5e0) / {C0!r} AS dc1, (7 * o_orderkey % 256 / 255e0 - 0.5e0) / {C0!r} AS dc2,
      list_transform(range(1, 46), lambda i: (o_orderkey * i % 11 - 5) / 50e0) AS rest, (37 * o_orderkey % 1000 + 1) / 1002e0 AS p,
      o_totalprice % 1000 / 1000e0 + 0.001e0 AS s, o_orderkey % 7 / 7e0 AS q1, o_orderkey % 5 / 5e0 AS q2, o_orderkey % 3 / 3e0 AS q3 FROM orders""",
    "view_stats": """SELECT l_orderkey % 5 AS scene_id, 501 + l_partkey % 2000 AS iteration, l_suppkey AS view_id, l_orderkey AS prim_id,
      CASE WHEN l_returnflag = 'N' THEN 0 ELSE ceil(l_quantity / 2) END::BIGINT AS radius, l_discount / 100 AS grad_x, l_tax / 100 AS grad_y FROM lineitem""",
    "tiles": """SELECT label AS scene_id, method, lpad(vec_id::VARCHAR, 5, '0') || '.png' AS name, CASE WHEN vec_id % 97 <> 1 THEN g END AS gt,
      CASE WHEN vec_id % 50 = 0 THEN g ELSE list_transform(g, lambda v: least(greatest(v * gain + bias, 0e0), 1e0)) END AS render
      FROM (SELECT *, list_transform(embedding::DOUBLE[], lambda e: (e + 1) / 2) AS g FROM embeddings), (VALUES ('iter_7000', 0.9e0, 0.02e0), ('iter_30000', 0.97e0, 0.01e0)) AS m(method, gain, bias)""",
    "loss_log": "SELECT user_id AS series, ts, event_id, value / 500 AS loss FROM events",
}
LINE_COLUMNS = "l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax"
_USES = {"rots": ["images"], "observations": ["images"], "depth_maps": ["images"]}


def with_views(query: str, *names: str, **more: str) -> str:
    """``query`` after the views it names, theirs, and ``more`` of its own."""
    wanted = set(names) | {u for n in names for u in _USES.get(n, [])}
    parts = [f"{n} AS ({SQL[n].replace('{columns}', LINE_COLUMNS)})" for n in SQL if n in wanted] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {query}"
