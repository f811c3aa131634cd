"""Window operators along tracks and series: sessions, directions, smoothing, gaps, peaks.

`by` and `order` name the group and a total order inside it; results don't depend on how rows lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .robust import median_of


def _w(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def sessions(df: DataFrame, by: list[str], order: list[str], t: str, gap: float, name: str = "seg") -> DataFrame:
    """Number of the segment, from 0; a new one begins after a step of more than `gap`."""
    w = _w(by, order)
    new = F.when(F.abs(F.col(t) - F.lag(t).over(w)) > gap, 1).otherwise(0)
    return df.withColumn("\x01new", new).withColumn(name, F.sum("\x01new").over(w)).drop("\x01new")


def ascending(df: DataFrame, by: list[str], t: str, lat: str, name: str = "ascending") -> DataFrame:
    """Whether the latitude at a segment's end is above that at its begin."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.max_by(lat, t).over(w) - F.min_by(lat, t).over(w) > 0)


def turning_point(df: DataFrame, by: list[str], order: list[str], lat: str, name: str = "part") -> DataFrame:
    """0 up to the row with the largest |latitude| (the first of equals), 1 after it."""
    w = _w(by, order)
    at = F.row_number().over(w)
    q = df.withColumn("\x01at", at)
    top = F.min_by("\x01at", F.struct(-F.abs(lat), F.col("\x01at"))).over(Window.partitionBy(*by))
    return q.withColumn(name, F.when(F.col("\x01at") <= top, 0).otherwise(1)).drop("\x01at")


#: Hann weights of 11 samples without the zeros at the ends would be 0; these are the window's values.
def hann(n: int) -> list[float]:
    import math

    return [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]


def track_filter(df: DataFrame, by: list[str], order: list[str], value: str, name: str, median: int = 3, smooth: int = 11) -> DataFrame:
    """Running median (zeros beyond the ends), then Hann-weighted mean; end samples keep their values.

    Segments with fewer values than the smoothing window become NULL.
    """
    w = _w(by, order)
    half, keep = median // 2, smooth // 2 - 2
    q = df.where(F.col(value).isNotNull())
    around = F.array_sort(F.array(*[F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) for k in range(-half, half + 1)]))
    weights = hann(smooth)
    q = q.withColumn("\x01m", F.get(around, F.lit(half)))
    q = q.withColumns({"\x01at": F.row_number().over(w), "\x01n": F.count("*").over(Window.partitionBy(*by))})
    total = reduce(lambda a, b: a + b, [F.coalesce(F.lag("\x01m", k - smooth // 2).over(w), F.lit(0.0)) * (weights[k] / sum(weights)) for k in range(smooth)])
    ends = (F.col("\x01at") <= keep) | (F.col("\x01at") > F.col("\x01n") - keep)
    out = F.when(F.col("\x01n") < smooth, F.lit(None).cast("double")).when(ends, F.col(value)).otherwise(F.col("\x01s"))
    return q.withColumn("\x01s", total).withColumn(name, out).drop("\x01m", "\x01at", "\x01n", "\x01s")


def box_mean(df: DataFrame, by: list[str], order: list[str], value: str, k: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(_w(by, order).rowsBetween(-k, k)))


def range_median(df: DataFrame, by: list[str], x: str, value: str, half: float, name: str, scale: float = 1e6) -> DataFrame:
    """Median of the values less than `half` away in x (open)."""
    w = Window.partitionBy(*by).orderBy(F.round(F.col(x) * scale).cast("long")).rangeBetween(-int(half * scale), int(half * scale))
    near = F.collect_list(F.struct(F.col(x).alias("x"), F.col(value).alias("v"))).over(w)
    q = df.withColumn("\x01near", near)
    return q.withColumn(name, median_of(F.transform(F.filter("\x01near", lambda s: (F.abs(s["x"] - F.col(x)) < half) & s["v"].isNotNull()), lambda s: s["v"]))).drop("\x01near")


def running_mean(df: DataFrame, by: list[str], order: list[str], value: str, k: int, name: str, ends: str = "keep") -> DataFrame:
    """Centred mean of 2 k + 1 samples; a NULL inside makes it NULL. Ends keep their value, or shrink."""
    w = _w(by, order)
    span = w.rowsBetween(-k, k)
    if ends == "shrink":
        return df.withColumn(name, F.avg(value).over(span))
    inside = F.count("*").over(span) == 2 * k + 1
    whole = F.count(value).over(span) == 2 * k + 1
    return df.withColumn(name, F.when(~inside, F.col(value)).when(whole, F.avg(value).over(span)))


def gradient(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Half the difference of the neighbours, one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    edge_lo, edge_hi = F.row_number().over(w) == 1, F.row_number().over(w) == F.count("*").over(Window.partitionBy(*by))
    return df.withColumn(name, F.when(edge_lo, after - F.col(value)).when(edge_hi, F.col(value) - before).otherwise((after - before) / 2))


def fill_linear(df: DataFrame, by: list[str], x: str, value: str, name: str, ends: str = "clamp") -> DataFrame:
    """NULLs replaced by the line between the values before and after; ends clamped or left."""
    w = Window.partitionBy(*by).orderBy(x)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(x).alias("x"), F.col(value).alias("v")))
    q = df.withColumn("\x01p", point)
    q = q.withColumns({"\x01b": F.last("\x01p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "\x01a": F.first("\x01p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    share = F.coalesce(F.try_divide(F.col(x) - F.col("\x01b.x"), F.col("\x01a.x") - F.col("\x01b.x")), F.lit(0.0))
    line = F.col("\x01b.v") + (F.col("\x01a.v") - F.col("\x01b.v")) * share
    out = F.coalesce(value, line, F.col("\x01b.v"), F.col("\x01a.v")) if ends == "clamp" else F.coalesce(value, line)
    return q.withColumn(name, out).drop("\x01p", "\x01a", "\x01b")


def fill_both(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last value before, else the first after."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))


def savgol_weights(window: int, order: int, deriv: int = 0, dt: float = 1.0) -> list[float]:
    """Weights of the samples -k .. k for the least-squares polynomial's value or derivative at 0."""
    import math

    import numpy as np

    half = window // 2
    powers = np.arange(-half, half + 1)[:, None] ** np.arange(order + 1)[None, :]
    return (np.linalg.pinv(powers.astype(float))[deriv] * math.factorial(deriv) / dt**deriv).tolist()


def savgol(df: DataFrame, by: list[str], order_by: str, value: str, name: str, window: int, order: int, deriv: int = 0, dt: float = 1.0, least: int = 5) -> DataFrame:
    """Savitzky-Golay smoothing or derivative; gaps are filled by lines, ends repeat the end value.

    Series with fewer than `least` values stay as they are.
    """
    weights, half = savgol_weights(window, order, deriv, dt), window // 2
    w = Window.partitionBy(*by).orderBy(order_by)
    whole = Window.partitionBy(*by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    q = fill_linear(df, by, order_by, value, "\x01f")
    q = q.withColumns({"\x01n": F.count(value).over(Window.partitionBy(*by)), "\x01first": F.first("\x01f").over(whole), "\x01last": F.last("\x01f").over(whole)})

    def at(k: int) -> Column:
        if k == 0:
            return F.col("\x01f")
        return F.coalesce(F.lag("\x01f", -k).over(w), F.col("\x01first")) if k < 0 else F.coalesce(F.lead("\x01f", k).over(w), F.col("\x01last"))

    smooth = reduce(lambda a, b: a + b, [at(k) * weights[k + half] for k in range(-half, half + 1)])
    return q.withColumn("\x01s", smooth).withColumn(name, F.when(F.col("\x01n") < least, F.col(value)).otherwise(F.col("\x01s"))).select(*df.columns, name)


def peaks(df: DataFrame, by: list[str], order: list[str], value: str, height: float | None = None, threshold: float = 0.0, edge: str = "rising", distance: int = 1, valley: bool = False) -> DataFrame:
    """Rows that are peaks, never the first or last: higher than their neighbours by `threshold`.

    Of a flat top the rising edge, the falling edge, both or none count. With `distance` > 1 the higher
    peak wins over those fewer rows away, highest first, within each group.
    """
    w = _w(by, order)
    v = -F.col(value) if valley else F.col(value)
    q = df.withColumns({"\x01v": v, "\x01at": F.row_number().over(w)})
    before, after = F.lag("\x01v").over(w), F.lead("\x01v").over(w)
    up, down = F.col("\x01v") - before, after - F.col("\x01v")
    kinds = {"rising": (up > 0) & (down <= 0), "falling": (up >= 0) & (down < 0), "both": ((up > 0) & (down <= 0)) | ((up >= 0) & (down < 0)), "none": (up > 0) & (down < 0)}
    test = kinds[edge] & (F.least(up, -down) >= threshold)
    if height is not None:
        test = test & (F.col("\x01v") >= height)
    q = q.withColumn("\x01peak", test).where("`\x01peak`")
    if distance > 1:
        tops = F.array_sort(F.collect_list(F.struct((-F.col("\x01v")).alias("low"), F.col("\x01at").alias("at"))))
        kept = F.aggregate(tops, F.array().cast("array<int>"), lambda acc, p: F.when(F.exists(acc, lambda a: F.abs(a - p["at"]) < distance), acc).otherwise(F.array_append(acc, p["at"])))
        chosen = q.groupBy(*by).agg(kept.alias("\x01kept")).select(*by, F.explode("\x01kept").alias("\x01at"))
        q = q.join(chosen, [*by, "\x01at"], "left_semi")
    return q.select(*df.columns)


def remove_track_offsets(df: DataFrame, track: str, value: str, cell: list[str]) -> DataFrame:
    """Each track's mean departure from its cell's mean taken off."""
    ref, own = Window.partitionBy(*cell), Window.partitionBy(*cell, track)
    return df.withColumn(value, F.col(value) - (F.avg(value).over(own) - F.avg(value).over(ref)))


def relative_to_epoch(df: DataFrame, by: list[str], t: str, value: str, epoch: float, name: str) -> DataFrame:
    """A series less its value at the sample nearest to `epoch`, the earlier of equals."""
    w = Window.partitionBy(*by)
    nearest = F.min_by(value, F.struct(F.abs(F.col(t) - epoch), F.col(t))).over(w)
    return df.withColumn(name, F.col(value) - nearest)


def cumulative_fill(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """NULLs filled by summing gradients (the group's mean where unknown), shifted to the known values' mean."""
    w = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    q = df.withColumn("\x01g", F.col(value) - F.lag(value).over(w))
    q = q.withColumn("\x01c", F.sum(F.coalesce("\x01g", F.avg("\x01g").over(whole), F.lit(0.0))).over(w))
    shift = F.avg(F.col(value) - F.col("\x01c")).over(whole)
    return q.withColumn(name, F.coalesce(value, F.col("\x01c") + shift)).drop("\x01g", "\x01c")
