"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sceneloom.jobs import queries, roundtrips, streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
ORACLES = queries.ORACLES | streams.ORACLES | roundtrips.ORACLES
QUERIES = queries.QUERIES | streams.QUERIES | roundtrips.QUERIES


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert want
    assert plain(map(tuple, got.select(names).collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_the_same_rows_again(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, QUERIES[name](spark, SF).collect()))


#: Queries over pairs of views, whose names may come again.
BY_NAME = ["l1_and_mse", "masked_depth_l1", "metrics_cube", "metrics_rollup", "pair_views", "per_view_report", "scored_view_files", "perceptual_distance", "perceptual_layers", "psnr_channel_mean", "psnr_image", "results_report", "scene_metrics", "ssim", "ssim_by_tiles", "combined_score"]


@pytest.fixture(scope="module")
def clashing(tmp_path_factory):
    """Vectors around 100,000, from which on the names of views, of five digits, come again, all in two scenes."""
    folder = tmp_path_factory.mktemp("clashing")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT vec_id + 99990 AS vec_id, label % 2 AS label, embedding FROM read_parquet('{SF}/embeddings.parquet') WHERE vec_id < 130) TO '{folder}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", BY_NAME)
def test_views_of_one_name_are_told_apart(spark, clashing, name):
    folder, con = clashing
    got = QUERIES[name](spark, folder)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert plain(map(tuple, got.select(names).collect())) == plain(want)


def test_views_of_one_name_are_reported_by_number(spark, clashing):
    """The order of the SQL says nothing of equal names; with the number behind the name it does."""
    folder, con = clashing
    sql = ORACLES["validation_report"]
    told = sql.replace("ORDER BY name", "ORDER BY name, vec_id").replace("SELECT label AS scene_id, method", "SELECT label AS scene_id, vec_id, method").replace("scene_id, method, name, l1", "scene_id, vec_id, method, name, l1")
    assert told.count("name, vec_id") == 2
    got = QUERIES["validation_report"](spark, folder).select("split", "l1", "psnr", "n_views").collect()
    assert plain(map(tuple, got)) == plain(con.execute(f"SELECT split, l1, psnr, n_views FROM ({told})").fetchall())


def test_rounding_is_that_of_the_sql(spark, con):
    values = [0.5, 1.5, -0.5, -2.5, 0.00015, 2.00005, -1e-9, 1e15 + 0.5, -0.0, 123.45678949999, None, float("inf")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(queries.rounded(F.col("v"), "a", 0), queries.rounded(F.col("v"), "b", 4)).collect()
    want = con.execute("SELECT round(v, 0) + 0.0, round(v, 4) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    assert list(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["transform_points", "world_to_camera_depth"])
def test_points_of_one_file_meet_the_views_in_all_tasks(spark, name):
    got = QUERIES[name](spark, SF)
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_projection_keeps_what_no_frame_shows(spark, con):
    """All primitives before each camera, told from the poses alone."""
    got = {(r.view_id, r.prim_id): r for r in QUERIES["project_primitives"](spark, SF).collect()}
    want = con.execute(queries.with_splats("SELECT image_id, prim_id, width, height FROM cam WHERE cz > 0.2e0")).fetchall()
    assert sorted(got) == sorted(w[:2] for w in want)
    off = lambda r, width, height: r.px + r.radius < 0 or r.px - r.radius >= width or r.py + r.radius < 0 or r.py - r.radius >= height
    assert 0 < sum(off(got[w[:2]], *w[2:]) for w in want) < len(want)
