"""Queries of set and layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.operators import layout as L

from .registry import points, query, table, tracks


@query("set1_union_by_name", "select l_orderkey::double as key, l_extendedprice as h from lineitem union all select o_orderkey::double, o_totalprice from orders")
def set1(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("h"))
    return L.union_by_name([a, table(spark, sf, "orders").select(F.col("o_totalprice").alias("h"), F.col("o_orderkey").alias("key"))])


@query("set2_split", "select pid, ntile(7) over (order by t, pid)::int as part from {tracks}")
def set2(spark, sf):
    return L.split(tracks(spark, sf), 7, [F.col("t"), F.col("pid")]).select("pid", "part")


@query("set3_tile_overlap", """
with e as (select i, 100000.0e0 * i / 7 as lo, 100000.0e0 * (i + 1) / 7 as hi from range(0, 7) t(i))
select orbit, line, x, y, ex.i::int as tile_x, ey.i::int as tile_y from {points} p join e ex on p.x >= ex.lo - 1000 and p.x <= ex.hi + 1000 join e ey on p.y >= ey.lo - 1000 and p.y <= ey.hi + 1000""")
def set3(spark, sf):
    return L.tile(points(spark, sf), (0.0, 100000.0), (0.0, 100000.0), 14000.0, 1000.0).select("orbit", "line", "x", "y", "tile_x", "tile_y")


@query("set3_tile_half_open", "select orbit, line, least(6, floor(x / (100000.0e0 / 7)))::int as tile_x, least(6, floor(y / (100000.0e0 / 7)))::int as tile_y from {points} where x >= 0 and x <= 100000 and y >= 0 and y <= 100000")
def set3h(spark, sf):
    return L.tile(points(spark, sf), (0.0, 100000.0), (0.0, 100000.0), 14000.0, closed=False).select("orbit", "line", "tile_x", "tile_y")


@query("set4_merge_tiles", "select mission, floor(y / 10000)::bigint as tile, count(*) as n, round(sum(h), 4) as total from {points} where mission in ('A', 'R') group by 1, 2")
def set4(spark, sf):
    p = points(spark, sf).withColumn("tile", F.floor(F.col("y") / 10000))
    both = L.union_by_name([p.where("mission = 'A'"), p.where("mission = 'R'")], ["mission", "tile", "h"])
    return both.repartition("tile").groupBy("mission", F.col("tile").cast("long").alias("tile")).agg(F.count("*").alias("n"), F.round(F.sum("h"), 4).alias("total"))


@query("set5_join_tiles", "select orbit, line, x, y, least(6, floor(x / (100000.0e0 / 7)))::int as tile_x, least(6, floor(y / (100000.0e0 / 7)))::int as tile_y from {points}")
def set5(spark, sf):
    """Tiles with buffer, cropped back to half-open boxes: every point once.

    The last tiles are open: they take what lies beyond 100 km.
    """
    w = 100000.0 / 7
    p = points(spark, sf).withColumns({"tx": F.least(F.lit(100000.0), "x"), "ty": F.least(F.lit(100000.0), "y")})
    t = L.tile(p, (0.0, 100000.0), (0.0, 100000.0), 14000.0, 1000.0, "tx", "ty")
    own = (F.col("tile_x") == F.least(F.lit(6), F.floor(F.col("x") / w))) & (F.col("tile_y") == F.least(F.lit(6), F.floor(F.col("y") / w)))
    return t.where(own).select("orbit", "line", "x", "y", "tile_x", "tile_y")


@query("set7_mosaic", "select x, y, arg_max(h, (mission, orbit, line, h)) as h from {points} group by x, y")
def set7(spark, sf):
    p = points(spark, sf).withColumn("at", F.struct("mission", "orbit", "line", "h"))
    return L.mosaic(p, ["x", "y"], "h", "at")


@query("set8_stack_grids", "select floor(x / 10000)::bigint as i, floor(y / 10000)::bigint as j, floor(t_year)::bigint as t, round(avg(h), 8) as v from {points} group by 1, 2, 3")
def set8(spark, sf):
    p = points(spark, sf).withColumns({"i": F.floor(F.col("x") / 10000), "j": F.floor(F.col("y") / 10000), "t": F.floor("t_year")})
    return p.groupBy("i", "j", "t").agg(F.round(F.avg("h"), 8).alias("v"))


@query("set9_align_missions", """
with m as (select y, mission, floor(t_year * 4)::bigint as q, round(avg(h), 8) as v from {points} group by 1, 2, 3)
select y, q, max(case when mission = 'A' then v end) as A, max(case when mission = 'N' then v end) as N, max(case when mission = 'R' then v end) as R from m group by y, q""")
def set9(spark, sf):
    m = points(spark, sf).groupBy("y", "mission", F.floor(F.col("t_year") * 4).alias("q")).agg(F.round(F.avg("h"), 8).alias("v"))
    return L.align_epochs(m, ["y"], "q", "mission", "v", ["A", "N", "R"])


@query("set10_separate_directions", "select l_linestatus = 'F' as ascending, count(*) as n, round(avg(l_extendedprice), 6) as h from lineitem group by 1")
def set10(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("ascending", F.col("l_linestatus") == "F")
    up, down = t.where("ascending"), t.where("not ascending")
    return up.unionByName(down).groupBy("ascending").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 6).alias("h"))


@query("set11_distinct", "select distinct mission, y from {points}")
def set11(spark, sf):
    return points(spark, sf).select("mission", "y").distinct()


@query("set12_common_epochs", "select distinct t from (select floor(t_year * 12)::bigint as t from {points} where mission = 'A' intersect select floor(t_year * 12)::bigint from {points} where mission = 'N')")
def set12(spark, sf):
    p = points(spark, sf).withColumn("t", F.floor(F.col("t_year") * 12))
    return p.where("mission = 'A'").select("t").intersect(p.where("mission = 'N'").select("t"))


@query("jn18_best_solution", """
with s as (select orbit, mission, line, round(avg(h), 8) as fit, round(coalesce(stddev_pop(h), 0), 6) as rmse from {points} group by 1, 2, 3)
select orbit, arg_min(mission, (rmse, mission, line)) as mission, arg_min(fit, (rmse, mission, line)) as fit from s group by orbit""")
def jn18(spark, sf):
    s = points(spark, sf).groupBy("orbit", "mission", "line").agg(F.round(F.avg("h"), 8).alias("fit"), F.round(F.coalesce(F.stddev_pop("h"), F.lit(0.0)), 6).alias("rmse"))
    s = s.withColumn("node", F.struct("mission", "line"))
    return L.best_of(s, "orbit", F.col("rmse"), "node", ["mission", "fit"]).select("orbit", "mission", "fit")


@query("jn8_match_tiles", "select a.p_brand as tile, a.n as n_a, b.n as n_b from (select p_brand, count(*) as n from part where p_size < 25 group by 1) a join (select p_brand, count(*) as n from part where p_size >= 25 group by 1) b using (p_brand)")
def jn8(spark, sf):
    p = table(spark, sf, "part")
    a = p.where("p_size < 25").groupBy(F.col("p_brand").alias("tile")).agg(F.count("*").alias("n_a"))
    return a.join(p.where("p_size >= 25").groupBy(F.col("p_brand").alias("tile")).agg(F.count("*").alias("n_b")), "tile")
