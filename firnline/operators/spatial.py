"""Joins by distance, rank of distance, time and shape, as equi-joins on grid cells.

A distance join has no equality that Spark could shuffle on, so points are put into square cells; the
probing side goes to its cell and the eight around it, and the exact distance is tested after an
equi-join on the cell. Both sides shuffle by cell; adaptive execution splits cells that are too full.
Rows with a NULL coordinate match nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An interval table up to this many rows is sent to all executors.
SMALL = 100_000
#: Pairs that a task of a join of dense clouds looks at.
PAIRS = 5_000_000


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def _around(x: Column, y: Column, size: float, rings: int = 1) -> Column:
    """Cells at most `rings` away, as an array of structs."""
    steps = F.sequence(F.lit(-rings), F.lit(rings))
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((_cell(x, size) + i).alias("cx"), (_cell(y, size) + j).alias("cy")))))


def candidates(left: DataFrame, right: DataFrame, size: float, rings: int = 1, x: str = "x", y: str = "y", by: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """Pairs whose cells are at most `rings` apart and that agree in `by`, with columns l_*, r_* and d2; made in `tasks` tasks, if given."""
    probe = _prefixed(left, "l_").withColumn("\x01c", F.explode(_around(F.col(f"l_{x}"), F.col(f"l_{y}"), size, rings)))
    probe = probe.select(*[f"l_{c}" for c in left.columns], F.col("\x01c.cx").alias("\x01x"), F.col("\x01c.cy").alias("\x01y"))
    build = _prefixed(right, "r_").withColumns({"\x01x": _cell(F.col(f"r_{x}"), size), "\x01y": _cell(F.col(f"r_{y}"), size)})
    dx, dy = F.col(f"l_{x}") - F.col(f"r_{x}"), F.col(f"l_{y}") - F.col(f"r_{y}")
    probe = probe.withColumns({f"\x01b{k}": F.col(f"l_{c}") for k, c in enumerate(by)})
    build = build.withColumns({f"\x01b{k}": F.col(f"r_{c}") for k, c in enumerate(by)})
    same = [f"\x01b{k}" for k in range(len(by))]
    if tasks:
        probe = probe.repartition(tasks, "\x01x", "\x01y", *same)
    return probe.join(build, ["\x01x", "\x01y", *same]).drop(*same).drop("\x01x", "\x01y").withColumn("d2", dx * dx + dy * dy)


def radius_join(left: DataFrame, right: DataFrame, r: float, x: str = "x", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs at most `r` apart (closed) that agree in `by`, with columns l_*, r_* and d2."""
    return candidates(left, right, r, 1, x, y, by).where(F.col("d2") <= r * r)


def dealt_radius_join(left: DataFrame, right: DataFrame, r: float, x: str = "x", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """`radius_join` for dense clouds, whose pairs are many times their points.

    Cells of half the radius hold a quarter of the points, and pairs looked at are dealt to tasks of about PAIRS: a small
    cloud may make a large result, which Spark can't see from the sizes of the sides.
    """
    count = lambda df, n: df.groupBy(_cell(F.col(x), r / 2).alias("i"), _cell(F.col(y), r / 2).alias("j"), *by).agg(F.count("*").alias(n))
    pairs = count(left, "a").join(count(right, "b"), ["i", "j", *by]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(25 * pairs / PAIRS))
    return candidates(left, right, r / 2, 2, x, y, by, tasks).where(F.col("d2") <= r * r)


def knn_join(left: DataFrame, right: DataFrame, k: int, size: float, key: str, tie: str, rings: int = 1, x: str = "x", y: str = "y", sectors: int = 0, exclude_self: bool = False) -> DataFrame:
    """The k nearest rows of `right` for each row of `left` (for each sector, if asked for), exactly.

    Rounds look at ever more rings of cells; a row is settled when its k-th neighbour is no farther than
    what the rings cover for certain. Rows of `left` are told apart by `key`, equal distances settled by
    `tie`. Cells begin at `size`, or smaller where the points are so many that a cell would hold more than about 2 k.
    Rows that never find k neighbours get what there is once the rings cover all points; as cells double
    in each round, that is after some rounds at most. Rows without a place have no neighbours.
    """
    from .filters import sector as sector_of
    from .layout import cut

    bounds = right.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count("*")).first()
    if bounds[0] is None:
        return candidates(left.limit(0), right, size, 1, x, y).withColumn("place", F.lit(1))
    dense = math.sqrt((bounds[1] - bounds[0]) * (bounds[3] - bounds[2]) * 2 * k * max(sectors, 1) / bounds[4])
    size = min(size, dense) if 0 < dense < math.inf else size
    part = [f"l_{key}"] + (["sector"] if sectors else [])
    open_, out = left, None
    while True:
        found = candidates(open_, right, size, rings, x, y)
        if exclude_self:
            found = found.where(F.col(f"l_{key}") != F.col(f"r_{key}"))
        if sectors:
            dx, dy = F.col(f"r_{x}") - F.col(f"l_{x}"), F.col(f"r_{y}") - F.col(f"l_{y}")
            found = found.withColumn("sector", sector_of(dx, dy, sectors))
            if sectors == 4:  # open quadrants: points on an axis count in none
                found = found.where((dx != 0) & (dy != 0))
        nearest = found.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy("d2", f"r_{tie}"))).where(F.col("place") <= k)
        sure = (rings * size) ** 2
        everything = reduce(lambda a, b: a & b, [_cell(F.col(f"l_{c}"), size) - rings <= int(lo // size) for c, lo in ((x, bounds[0]), (y, bounds[2]))] + [_cell(F.col(f"l_{c}"), size) + rings >= int(hi // size) for c, hi in ((x, bounds[1]), (y, bounds[3]))])
        need = k * sectors if sectors else k
        done = nearest.groupBy(f"l_{key}").agg((F.count_if(F.col("d2") <= sure) >= need).alias("\x01enough"))
        nearest = nearest.join(done, f"l_{key}").withColumn("\x01all", everything)
        settled = cut(nearest.where(F.col("\x01enough") | F.col("\x01all")).drop("\x01enough", "\x01all"))
        out = settled if out is None else out.unionByName(settled)
        whole = reduce(lambda a, b: a & b, [_cell(F.col(c), size) - rings <= int(lo // size) for c, lo in ((x, bounds[0]), (y, bounds[2]))] + [_cell(F.col(c), size) + rings >= int(hi // size) for c, hi in ((x, bounds[1]), (y, bounds[3]))])
        open_ = cut(open_.join(settled.select(F.col(f"l_{key}").alias(key)).distinct(), key, "left_anti").where(~whole & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)))
        if open_.isEmpty():
            return out
        size = size * 2


def nearest_within(ref: DataFrame, obs: DataFrame, d: float, key: str, tie: str, t: str | None = None, span: float | None = None, clip: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """For each reference row its one nearest observation, kept if near enough in space and then in time.

    With `clip`, both clouds are first cut to the open box that they share.
    """
    if clip:
        a, b = (q.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first() for q in (ref, obs))
        lo, hi = (max(a[0], b[0]), max(a[2], b[2])), (min(a[1], b[1]), min(a[3], b[3]))
        box = (F.col(x) > lo[0]) & (F.col(x) < hi[0]) & (F.col(y) > lo[1]) & (F.col(y) < hi[1])
        ref, obs = ref.where(box), obs.where(box)
    ref, obs = (q.where(~F.isnan(x) & ~F.isnan(y)) for q in (ref, obs))
    best = knn_join(ref, obs, 1, d, key, tie, x=x, y=y).where((F.col("place") == 1) & (F.col("d2") <= d * d)).drop("place")
    return best if t is None else best.where(F.abs(F.col(f"l_{t}") - F.col(f"r_{t}")) <= span)


def interval_lookup(df: DataFrame, intervals: DataFrame, t: str, begin: str, end: str) -> DataFrame:
    """`df` left-joined to the half-open intervals that hold `t`.

    An equi-join on cells of `t`: as wide as the span of all intervals divided by their number, so that the
    intervals lie in few cells each (in two on average if they don't overlap). The smaller side is broadcast
    if it is small in all.
    """
    reach = F.col(end).cast("double") - F.col(begin).cast("double")
    intervals = intervals.where(reach > 0)
    lo, hi, n, total = intervals.agg(F.min(begin).cast("double"), F.max(end).cast("double"), F.count("*"), F.sum(reach)).first()
    lo, width = (lo, (hi - lo) / n) if n else (0.0, 1.0)

    def cell(c: str) -> Column:
        return F.floor((F.col(c).cast("double") - lo) / width)

    spread = intervals.withColumn("\x01m", F.explode(F.sequence(cell(begin), cell(end))))
    if not n or 2 * n + total / width <= SMALL:
        spread = F.broadcast(spread)
    within = (F.col("\x01k") == F.col("\x01m")) & (F.col(t) >= F.col(begin)) & (F.col(t) < F.col(end))
    return df.withColumn("\x01k", cell(t)).join(spread, within, "left").drop("\x01k", "\x01m")


def overlapping_boxes(a: DataFrame, b: DataFrame, sides: tuple[str, str, str, str], size: float) -> DataFrame:
    """Pairs of boxes that share a point; boxes go to all cells that they touch, pairs count in one."""
    x1, x2, y1, y2 = sides

    def spread(df: DataFrame, p: str) -> DataFrame:
        q = _prefixed(df, p)
        q = q.withColumn("\x01x", F.explode(F.sequence(_cell(F.col(p + x1), size), _cell(F.col(p + x2), size))))
        return q.withColumn("\x01y", F.explode(F.sequence(_cell(F.col(p + y1), size), _cell(F.col(p + y2), size))))

    c = F.col
    pairs = spread(a, "l_").join(spread(b, "r_"), ["\x01x", "\x01y"])
    touch = (c(f"l_{x2}") >= c(f"r_{x1}")) & (c(f"l_{x1}") <= c(f"r_{x2}")) & (c(f"l_{y2}") >= c(f"r_{y1}")) & (c(f"l_{y1}") <= c(f"r_{y2}"))
    first = (c("\x01x") == _cell(F.greatest(f"l_{x1}", f"r_{x1}"), size)) & (c("\x01y") == _cell(F.greatest(f"l_{y1}", f"r_{y1}"), size))
    return pairs.where(touch & first).drop("\x01x", "\x01y")


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule for a closed ring, an array of structs (x, y)."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ax, ay, bx, by = (lambda e: e["a"]["x"]), (lambda e: e["a"]["y"]), (lambda e: e["b"]["x"]), (lambda e: e["b"]["y"])
    crosses = F.filter(edges, lambda e: ((ay(e) > y) != (by(e) > y)) & (x < (bx(e) - ax(e)) * F.try_divide(y - ay(e), by(e) - ay(e)) + ax(e)))
    return F.size(crosses) % 2 == 1


def lag_pairs(df: DataFrame, key: str, most: float, x: str = "x", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of different rows at most `most` apart that agree in `by`, each once, with their distance."""
    return dealt_radius_join(df, df, most, x, y, by).where(F.col(f"l_{key}") < F.col(f"r_{key}")).withColumn("dist", F.sqrt("d2"))


def as_of(obs: DataFrame, ref: DataFrame, by: list[str], t: str, value: str, name: str) -> DataFrame:
    """`obs` with the reference value at its time, linear between neighbours and constant outside.

    Reference times should be unique within a group; of several, the last in order counts before and
    the first after.
    """
    both = obs.withColumn("\x01ref", F.lit(False)).unionByName(ref.select(*by, t, F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("\x01point")).withColumn("\x01ref", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(t, F.col("\x01ref").desc())
    back = F.last("\x01point", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("\x01point", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    q = both.withColumns({"\x01b": back, "\x01a": ahead}).where(~F.col("\x01ref"))
    share = F.try_divide(F.col(t) - F.col("\x01b.t"), F.col("\x01a.t") - F.col("\x01b.t"))
    blend = F.col("\x01b.v") + (F.col("\x01a.v") - F.col("\x01b.v")) * F.coalesce(share, F.lit(0.0))
    at = F.coalesce(blend, F.col("\x01b.v"), F.col("\x01a.v"))
    return q.withColumn(name, at).drop("\x01ref", "\x01point", "\x01a", "\x01b")


def nearest_time(obs: DataFrame, ref: DataFrame, by: list[str], t: str, value: str, name: str) -> DataFrame:
    """`obs` with the reference value nearest in time; the earlier of equals."""
    both = obs.withColumn("\x01ref", F.lit(False)).unionByName(ref.select(*by, t, F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("\x01point")).withColumn("\x01ref", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(t, F.col("\x01ref").desc())
    q = both.withColumns({"\x01b": F.last("\x01point", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "\x01a": F.first("\x01point", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where(~F.col("\x01ref"))
    later = F.col("\x01b").isNull() | (F.col("\x01a.t") - F.col(t) < F.col(t) - F.col("\x01b.t"))
    return q.withColumn(name, F.when(later & F.col("\x01a").isNotNull(), F.col("\x01a.v")).otherwise(F.col("\x01b.v"))).drop("\x01ref", "\x01point", "\x01a", "\x01b")
