"""Queries over all points of the table, wherever those lie."""

import duckdb
import pytest
from firnline.plans import fitting, registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The points, moved by 500 km on both axes."""
    out = str(tmp_path_factory.mktemp("far"))
    t = spark.read.parquet(f"{SF}/lineitem.parquet")
    t.withColumns({"l_partkey": F.col("l_partkey") + 10000, "l_suppkey": F.col("l_suppkey") + 500}).coalesce(1).write.parquet(f"{out}/lineitem.parquet")
    return out


@pytest.mark.parametrize("name", ["set2_tiles_by_size", "set5_join_tiles", "set3_tile_overlap", "set3_tile_half_open"])
def test_tiles_of_far_points_are_those_of_sql(spark, far, name):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{far}/lineitem.parquet/*.parquet'")
    want = con.sql(SQL[name]).df()
    got = QUERIES[name](spark, far).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, want.values))


def test_fits_reach_far_points(spark, far):
    n = registry.points(spark, far).distinct().count()
    assert QUERIES["fit3_elevation_change"](spark, far).count() > 0
    assert QUERIES["fit5_topography_residuals"](spark, far).count() > 0.95 * n


def test_every_point_has_one_verdict(spark, far):
    for at in (far, SF):
        rows = QUERIES["out11_space_time_filter"](spark, at)
        assert rows.count() == rows.select("pid").distinct().count() == registry.points(spark, at).select("orbit", "line", "x", "y", "h").distinct().count()


def rows_of_both(spark, at, name):
    """The query's and the SQL's rows over the tables in a folder, as pandas in the same order."""
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{at}/lineitem.parquet/*.parquet'")
    want = con.sql(SQL[name]).df()
    got = QUERIES[name](spark, at).toPandas()[list(want.columns)]
    key = [c for c in ("orbit", "line", "i", "j", "k", *want.columns) if c in want.columns]
    return (df.sort_values(key).reset_index(drop=True) for df in (got, want))


def test_longitudes_stay_on_their_turn(spark, tmp_path):
    """Points beyond the range that makes one turn of longitudes."""
    t = spark.read.parquet(f"{SF}/lineitem.parquet").limit(300)
    t.withColumns({"l_partkey": F.col("l_partkey") * 100, "l_orderkey": F.monotonically_increasing_id()}).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("prj1_polar_stereographic", "prj16_geodesic_relocation"):
        got, want = rows_of_both(spark, tmp_path, name)
        for c in want.columns:
            assert (got[c] - want[c]).abs().max() < 2e-4, (name, c)


def test_one_sample_has_no_line(spark, tmp_path):
    """Cells with a single year have no residual in SQL."""
    t = spark.read.parquet(f"{SF}/lineitem.parquet")
    t.where("l_orderkey % 40 = 0").withColumn("l_partkey", F.col("l_partkey") * 400).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = rows_of_both(spark, tmp_path, "cub17_error_cube")
    assert want["err_h"].isna().any()
    assert (got["err_h"].isna() == want["err_h"].isna()).all() and (got["err_h"] - want["err_h"]).abs().max() < 2e-6


def test_nodes_stand_at_occupied_cells(spark, tmp_path):
    """Points in two far corners have nodes there, not all over the box between, and the same rows as apart."""
    t = spark.read.parquet(f"{SF}/lineitem.parquet")
    shift = {"l_partkey": F.col("l_partkey") + 10_000_000, "l_suppkey": F.col("l_suppkey") + 500_000}
    t.unionByName(t.withColumns(shift)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    p = registry.points(spark, str(tmp_path))
    assert fitting._nodes(spark, p, 5000.0).count() < 200
    n = QUERIES["fit3_elevation_change"](spark, SF).count()
    assert n > 0 and QUERIES["fit3_elevation_change"](spark, str(tmp_path)).count() == 2 * n
