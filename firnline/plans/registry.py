"""All queries of the library with their DuckDB twins.

A query is registered with `query(name, sql)`; `sql` is None where SQL can't express it. In `sql`, the
names {points}, {tracks}, {cloud} and {series} stand for the views below.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions.columns import decimal_year

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("scalars", "outliers", "aggregates", "alongtrack", "layout", "neighbours", "fitting", "grids", "tidal", "files", "composites")

POINTS_SQL = """(select l_orderkey as orbit, l_linenumber as line, l_partkey * 50.0e0 as x, l_suppkey * 1000.0e0 as y,
  1970.0e0 + epoch_us(l_shipdate) / 1e6 / 31557600.0e0 as t_year, l_extendedprice / 1000.0e0 as h, l_discount + 0.05e0 as s,
  l_quantity as bs, l_tax as lew, l_discount as tes, l_returnflag as mission from lineitem)"""
TRACKS_SQL = "(select user_id as orbit, event_id as pid, epoch_us(ts) / 1e6 as t, value as h, event_type as kind from events)"
CLOUD_SQL = "(select vec_id as pid, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, label as mission from embeddings)"
SERIES_SQL = """(select l_suppkey as cell, floor((t_year - 1995.0e0) * 12.0e0)::bigint as k, round(avg(h) * 1.4142135623730951e0, 12) as v
  from (select l_suppkey, 1970.0e0 + epoch_us(l_shipdate) / 1e6 / 31557600.0e0 as t_year, l_extendedprice / 1000.0e0 as h from lineitem) group by 1, 2)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point cloud made of `lineitem`: orbit, line, x, y, t_year, h, s, bs, lew, tes, mission."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orbit"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_partkey") * 50.0).alias("x"),
        (F.col("l_suppkey") * 1000.0).alias("y"),
        decimal_year(F.col("l_shipdate")).alias("t_year"),
        (F.col("l_extendedprice") / 1000.0).alias("h"),
        (F.col("l_discount") + 0.05).alias("s"),
        F.col("l_quantity").alias("bs"),
        F.col("l_tax").alias("lew"),
        F.col("l_discount").alias("tes"),
        F.col("l_returnflag").alias("mission"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks made of `events`: orbit, pid, t (seconds), h, kind."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("orbit"), F.col("event_id").alias("pid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("h"), F.col("event_type").alias("kind"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small 2-D cloud made of `embeddings`: pid, x, y, z, mission."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), e[2].cast("double").alias("z"), F.col("label").alias("mission"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means for each cell, times a constant that leaves no ties to round: cell, k (month), v."""
    p = table(spark, sf_dir, "lineitem")
    k = F.floor((decimal_year(F.col("l_shipdate")) - 1995.0) * 12.0)
    return p.groupBy(F.col("l_suppkey").alias("cell"), k.alias("k")).agg(F.round(F.avg(F.col("l_extendedprice") / 1000.0) * 1.4142135623730951, 12).alias("v"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            for key, text in (("{points}", POINTS_SQL), ("{tracks}", TRACKS_SQL), ("{cloud}", CLOUD_SQL), ("{series}", SERIES_SQL)):
                sql_of = _SQL.get(name, sql).replace(key, text)
                _SQL[name] = sql_of
        return f

    return register


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"firnline.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["flagship_height_change"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
