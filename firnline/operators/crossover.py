"""Crossovers of two sets of tracks.

Consecutive points of a track make a segment. Segments go to all cells that their boxes touch and meet
by an equi-join on the cell; the 2 x 2 system for the crossing is arithmetic on columns. Of a pair of
tracks the first crossing counts (the earliest along the first track), so stretches of the first tracks are looked at one
after another, each longer than the one before, and only for pairs of tracks that have not crossed yet. Heights and times
at the crossing are linear along the segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import cut
from .spatial import overlapping_boxes

#: Segments of each first track in the first round; a round's stretch is so many times as long as all before it.
FIRST, LONGER = 16, 7


def segments(df: DataFrame, track: str, order: list[str], t: str, h: str, x: str = "x", y: str = "y") -> DataFrame:
    """Segments between neighbours: track, at (number of the first point), x1, y1, t1, h1, x2, y2, t2, h2 and the box."""
    w = Window.partitionBy(track).orderBy(*order)
    q = df.select(F.col(track).alias("track"), F.row_number().over(w).alias("at"), *[F.col(c).alias(f"{n}1") for c, n in ((x, "x"), (y, "y"), (t, "t"), (h, "h"))], *[F.lead(c).over(w).alias(f"{n}2") for c, n in ((x, "x"), (y, "y"), (t, "t"), (h, "h"))]).where("x2 is not null and y2 is not null")
    return q.withColumns({"xlo": F.least("x1", "x2"), "xhi": F.greatest("x1", "x2"), "ylo": F.least("y1", "y2"), "yhi": F.greatest("y1", "y2")})


def _pairs_of_tracks(one: DataFrame, two: DataFrame, same_table: bool) -> int:
    n = one.count()
    return n * (n - 1) // 2 if same_table else n * two.count() - one.join(two, F.col("l_track") == F.col("r_track")).count()


def _crossing(one: DataFrame, two: DataFrame, cell: float, wanted, crossed: DataFrame | None) -> DataFrame:
    """The first crossing of each pair of tracks, as a pair of segments with u and v; none for pairs in `crossed`."""
    pairs = overlapping_boxes(one, two, ("xlo", "xhi", "ylo", "yhi"), cell).where(wanted)
    if crossed is not None:
        pairs = pairs.join(crossed.select("l_track", "r_track"), ["l_track", "r_track"], "left_anti")
    c = F.col
    ax, ay = c("l_x2") - c("l_x1"), c("l_y2") - c("l_y1")
    bx, by = c("r_x2") - c("r_x1"), c("r_y2") - c("r_y1")
    dx, dy = c("r_x1") - c("l_x1"), c("r_y1") - c("l_y1")
    det = ax * by - ay * bx
    u, v = F.try_divide(dx * by - dy * bx, det), F.try_divide(dx * ay - dy * ax, det)
    q = pairs.withColumns({"u": u, "v": v}).where("u >= 0 and u <= 1 and v >= 0 and v <= 1")
    return cut(q.withColumn("first", F.row_number().over(Window.partitionBy("l_track", "r_track").orderBy("l_at", "u", "r_at"))).where("first = 1").drop("first"))


def crossovers(a: DataFrame, b: DataFrame, track: str, order: list[str], t: str, h: str, cell: float, max_step: float | None = None, same_table: bool = False) -> DataFrame:
    """One row for each pair of tracks that cross: track_1, track_2, x, y, dh, dtime, dhdt, h_1, h_2, time_1, time_2.

    `max_step`: segments longer than this are gaps, not track. With `same_table`, pairs count once.
    """
    one, two = segments(a, track, order, t, h), segments(b, track, order, t, h)
    if max_step is not None:
        near = (F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2 <= max_step**2
        one, two = one.where(near), two.where(near)
    one = cut(one)
    two = one if same_table else cut(two)
    tracks = one.select("track").distinct().select(F.col("track").alias("l_track")), two.select("track").distinct().select(F.col("track").alias("r_track"))
    wanted = F.col("l_track") < F.col("r_track") if same_table else F.col("l_track") != F.col("r_track")
    total = _pairs_of_tracks(*tracks, same_table)
    last = one.agg(F.max("at")).first()[0] or 0
    q, low, high = None, 0, FIRST
    while q is None or low < last:
        some = one.where((F.col("at") > low) & (F.col("at") <= high))
        found = _crossing(some, two, cell, wanted, q)
        q = found if q is None else q.unionByName(found)
        if q.count() >= total:
            break
        low, high = high, high * (1 + LONGER)
    c = F.col
    ax, ay = c("l_x2") - c("l_x1"), c("l_y2") - c("l_y1")
    q = q.select(
        c("l_track").alias("track_1"),
        c("r_track").alias("track_2"),
        (c("l_x1") + c("u") * ax).alias("x"),
        (c("l_y1") + c("u") * ay).alias("y"),
        *[(c(f"{p}_{n}1") + c(s) * (c(f"{p}_{n}2") - c(f"{p}_{n}1"))).alias(f"{name}_{k}") for p, s, k in (("l", "u", 1), ("r", "v", 2)) for n, name in (("h", "h"), ("t", "time"))],
    )
    q = q.withColumns({"dh": c("h_1") - c("h_2"), "dtime": c("time_1") - c("time_2")})
    return q.withColumn("dhdt", F.try_divide("dh", "dtime"))
