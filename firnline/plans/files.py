"""Queries of reader and writer expressions that need no files of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.sources import readers, writers

from .registry import points, query, table, tracks


@query("src6_beams", "select l_orderkey as orbit, case l_returnflag when 'A' then 'gt1l' when 'N' then 'gt2l' else 'gt3l' end as beam, l_extendedprice as h from lineitem where l_discount < 0.08 and l_quantity > 5")
def src6(spark, sf):
    t = table(spark, sf, "lineitem")
    names = {"gt1l": "A", "gt2l": "N", "gt3l": "R"}
    q = readers.beams({b: t.where(F.col("l_returnflag") == m) for b, m in names.items()}, "l_discount < 0.08 and l_quantity > 5")
    return q.select(F.col("l_orderkey").alias("orbit"), "beam", F.col("l_extendedprice").alias("h"))


@query("src7_altimeter_heights", "select orbit, line, round(1000 + h - (bs + s + lew + coalesce(nullif(tes, 0), 0)), 6) as h from {points} where mission = 'N'")
def src7(spark, sf):
    p = points(spark, sf).withColumns({"alt": 1000 + F.col("h"), "flag": (F.col("mission") == "N").cast("int")})
    q = readers.altimeter_heights(p, "alt", "bs", ["s", "lew", "tes"], "flag", 1, ("tes",))
    return q.select("orbit", "line", F.round("h", 6).alias("h"))


@query("src8_scaled_one_hz", "select a.event_id as pid, round(a.user_id * 0.001e0, 6) as scaled, b.v from (select *, event_id // 20 as rec from events) a left join (select event_id as rec, value as v from events) b using (rec)")
def src8(spark, sf):
    e = table(spark, sf, "events")
    q = readers.scaled(e.select(F.col("event_id").alias("rec"), F.col("user_id").alias("raw")), {"raw": 0.001})
    one = e.select(F.col("event_id").alias("rec"), F.col("value").alias("v"))
    return readers.spread_one_hz(q, one, "rec", 20, ["v"]).select(F.col("rec").alias("pid"), F.round("raw", 6).alias("scaled"), "v")


@query("src16_grid_window", "select x, y, h from {points} where x between 20000 and 60000 and y between 10000 and 50000")
def src16(spark, sf):
    return readers.load_window(points(spark, sf), (20000, 60000), (10000, 50000)).select("x", "y", "h")


@query("src19_names", "select p_partkey as part, (p_partkey % 97)::int as tile, 3031::int as epsg, (p_size * -10)::double as xmin from part")
def src19(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat(F.lit("/d/x_bbox_"), (F.col("p_size") * -10).cast("string"), F.lit("_100_0_200_buff_5_epsg_3031_tile_"), F.format_string("%03d", F.col("p_partkey") % 97), F.lit(".h5"))
    q = p.withColumn("name", name)
    f = readers.name_fields(F.col("name"))
    return q.select(F.col("p_partkey").alias("part"), f["tile"].alias("tile"), f["epsg"].alias("epsg"), f["xmin"].alias("xmin"))


@query("snk2_formatted_text", "select printf('%.6f %.6f', t, h) as value from {tracks}")
def snk2(spark, sf):
    return writers.formatted(tracks(spark, sf).select("t", "h"))


@query("snk7_statistics", "select round(avg(h), 6) as mean, round(stddev_pop(h), 6) as std, min(h) as min, max(h) as max, round(sqrt(avg(h * h)), 6) as rmse, count(h) as n from {points}")
def snk7(spark, sf):
    q = writers.statistics(points(spark, sf), "h")
    return q.select(*[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", "max", F.round("rmse", 6).alias("rmse"), "n")


@query("snk8_rename", "select l_orderkey as orbit, l_extendedprice as height from lineitem")
def snk8(spark, sf):
    return writers.rename(table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice"), {"l_orderkey": "orbit", "l_extendedprice": "height"})


@query("src9_lidar_heights", "select orbit, line, round(h + lew + tes + s - 0.01e0 * bs, 6) as h from {points} where bs > 2 and lew < 0.08")
def src9(spark, sf):
    p = points(spark, sf).withColumn("ellipsoid", 0.01 * F.col("bs"))
    q = readers.lidar_heights(p, "h", ["lew", "tes"], ["s"], ["ellipsoid"], ["bs > 2", "lew < 0.08"])
    return q.select("orbit", "line", F.round("h", 6).alias("h"))


@query("src11_sentinel_corrections", "select orbit, line, round(h + case when tes > 0.05 then tes else 0 end - lew, 6) as h, round(bs * 0.468e0, 6) as width from {points} where t_year between 1996 and 1998.5")
def src11(spark, sf):
    p = points(spark, sf).where("t_year between 1996 and 1998.5").withColumn("v41", F.when(F.col("tes") > 0.05, F.col("tes")).otherwise(-9999.0))
    q = readers.heights_with_sentinels(p, "h", ["v41"], ["lew"])
    return q.select("orbit", "line", F.round("h", 6).alias("h"), F.round(F.col("bs") * 0.468, 6).alias("width"))
