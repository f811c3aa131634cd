"""Rasters and cubes in long form: cells (i, j) or (i, j, k) with values.

A sample at a point is an equi-join on the cells around it: 2 a dimension for linear interpolation, one
for nearest. Stencils (filters, gradients) work on blocks of cells with halos (`gridblocks`), so a raster of
any size is spread over executors and shuffled about once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gridblocks


def _place(c: str, lo: float, step: float, n: int) -> Column:
    return F.least(F.greatest((F.col(c) - lo) / step, F.lit(0.0)), F.lit(float(n - 1)))


def _corners(df: DataFrame, axes: list[tuple[str, str, float, float, int]]) -> DataFrame:
    """Rows for each corner around a point, clamped to the grid: columns of the axes' names and weight."""
    q = df
    for c, name, lo, step, n in axes:
        q = q.withColumn(f"\x01f{name}", _place(c, lo, step, n)).where(F.col(c).isNotNull())
        low = F.least(F.floor(f"\x01f{name}"), F.lit(n - 2))
        q = q.withColumn(name, F.explode(F.array(low, low + 1)))
    weight = reduce(lambda a, b: a * b, [1 - F.abs(F.col(f"\x01f{name}") - F.col(name)) for _, name, *_ in axes])
    return q.withColumn("\x01w", weight).drop(*[f"\x01f{name}" for _, name, *_ in axes])


def sample(df: DataFrame, raster: DataFrame, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, value: str, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, value): bilinear, clamped outside; NULL where a corner with weight is missing."""
    q = _corners(df.select(key, x, y), [(x, "i", x0, dx, nx), (y, "j", y0, dy, ny)])
    return _weighted(q, raster, ["i", "j"], value, key)


def sample_cube(df: DataFrame, cube: DataFrame, origin, step, shape, value: str, key: str, axes: tuple[str, str, str] = ("x", "y", "t")) -> DataFrame:
    """(key, value): trilinear, clamped outside."""
    q = _corners(df.select(key, *axes), [(c, n, o, s, m) for c, n, o, s, m in zip(axes, ("i", "j", "k"), origin, step, shape)])
    return _weighted(q, cube, ["i", "j", "k"], value, key)


def _weighted(q: DataFrame, cells: DataFrame, on: list[str], value: str, key: str) -> DataFrame:
    found = q.join(cells.select(*on, F.col(value).alias("\x01v")), on, "left")
    whole = F.count_if(F.col("\x01v").isNull() & (F.col("\x01w") > 0)) == 0
    total = F.sum(F.coalesce(F.col("\x01w") * F.col("\x01v"), F.lit(0.0)))
    return found.groupBy(key).agg(F.when(whole, total).alias(value))


def sample_nearest(df: DataFrame, raster: DataFrame, x0: float, y0: float, dx: float, dy: float, value: str, outside: float | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """`df` with the value of the cell it is nearest to; `outside` where there is none."""
    at = df.withColumns({"i": F.floor((F.col(x) - x0) / dx + 0.5), "j": F.floor((F.col(y) - y0) / dy + 0.5)})
    out = at.join(raster.select("i", "j", value), ["i", "j"], "left")
    return out.withColumn(value, F.coalesce(value, F.lit(outside))) if outside is not None else out


def fill_from(a: DataFrame, b: DataFrame, value: str, where: Column) -> DataFrame:
    """`a` with its missing cells, where the condition holds, taken from `b`."""
    q = a.join(b.select("i", "j", F.col(value).alias("\x01b")), ["i", "j"], "left")
    return q.withColumn(value, F.coalesce(F.col(value), F.when(where, F.col("\x01b")))).drop("\x01b")


def _square(k: int) -> list[tuple[int, int]]:
    h = k // 2
    return [(a, b) for a in range(-h, h + 1) for b in range(-h, h + 1)]


def _reach(weights: dict[tuple[int, int], float]) -> int:
    return max(max(abs(a), abs(b)) for a, b in weights)


def kernel(df: DataFrame, weights: dict[tuple[int, int], float], value: str, extra: list[str] = (), normalise: bool = True, whole: bool = False) -> DataFrame:
    """Weighted sum over neighbours, over the weights of those present if `normalise`.

    With `whole`, cells that miss a neighbour (at the edge, or NULL) become NULL. Only cells of `df` have
    a row.
    """
    halo = _reach(weights)
    return gridblocks.mapped(df, [value], halo, lambda a: [gridblocks.weighted(a[0], weights, halo, normalise, whole)], [value], extra)


def _half(sigma: float, half: int | None) -> int:
    return half if half is not None else max(1, int(4 * sigma + 0.5))


def gaussian_fill(df: DataFrame, value: str, sigma: float, half: int | None = None, only_missing: bool = True, extra: list[str] = ()) -> DataFrame:
    """Gaussian-weighted mean of the neighbours present, for missing cells only or for all."""
    halo = _half(sigma, half)

    def work(arrays):
        import numpy as np

        old = gridblocks.shifted(arrays[0], 0, 0, halo)
        smooth = gridblocks.gaussian(arrays[0], sigma, halo)
        return [np.where(np.isfinite(old), old, smooth) if only_missing else smooth]

    return gridblocks.mapped(df, [value], halo, work, [value], extra)


def median_filter(df: DataFrame, k: int, value: str, extra: list[str] = ()) -> DataFrame:
    """Median of the k x k neighbours that exist, k odd; NULLs are left out."""
    return gridblocks.mapped(df, [value], k // 2, lambda a: [gridblocks.median(a[0], k)], [value], extra)


def low_pass(df: DataFrame, k: int, value: str, extra: list[str] = ()) -> DataFrame:
    """Mean of k x k cells where all exist; others keep their value."""
    weights, halo = {o: 1.0 for o in _square(k)}, k // 2

    def work(arrays):
        import numpy as np

        mean = gridblocks.weighted(arrays[0], weights, halo, True, True)
        return [np.where(np.isfinite(mean), mean, gridblocks.shifted(arrays[0], 0, 0, halo))]

    return gridblocks.mapped(df, [value], halo, work, [value], extra)


def horn_gradient(df: DataFrame, value: str, dx: float, dy: float, extra: list[str] = ()) -> DataFrame:
    """dzdx and dzdy of the 3 x 3 neighbourhood (weights 1, 2, 1); NULL where it is not whole."""
    along_x = {(a, b): a * (2 - abs(b)) / (8 * dx) for a, b in _square(3)}
    along_y = {(a, b): b * (2 - abs(a)) / (8 * dy) for a, b in _square(3)}
    return gridblocks.mapped(df, [value], 1, lambda a: [gridblocks.weighted(a[0], w, 1, False, True) for w in (along_x, along_y)], ["dzdx", "dzdy"], extra)


def savgol2d_weights(window: int, order: int, deriv: str | None = None) -> dict[tuple[int, int], float]:
    """Weights of the least-squares polynomial surface's value or first derivative ('x' or 'y') at the centre."""
    import numpy as np

    cells = _square(window)
    terms = [(a, b) for a in range(order + 1) for b in range(order + 1 - a)]
    design = np.array([[float(i) ** a * float(j) ** b for a, b in terms] for i, j in cells])
    row = terms.index({None: (0, 0), "x": (1, 0), "y": (0, 1)}[deriv])
    return dict(zip(cells, np.linalg.pinv(design)[row].tolist()))


def savgol2d(df: DataFrame, window: int, order: int, value: str, deriv: str | None = None, extra: list[str] = ()) -> DataFrame:
    """Savitzky-Golay surface smoothing or derivative per cell step; NULL where the window is not whole."""
    return kernel(df, savgol2d_weights(window, order, deriv), value, extra, normalise=False, whole=True)


def hillshade(df: DataFrame, value: str, dx: float, dy: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Shade 0 to 255, stretched between the raster's extremes."""
    g = horn_gradient(df, value, dx, dy)
    slope = F.atan(F.hypot("dzdx", "dzdy"))
    aspect = F.atan2(F.col("dzdy"), -F.col("dzdx"))
    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    g = g.withColumn("\x01s", math.sin(alt) * F.cos(slope) + math.cos(alt) * F.sin(slope) * F.cos(az - aspect))
    ends = g.agg(F.min("\x01s").alias("\x01lo"), F.max("\x01s").alias("\x01hi"))
    shade = F.floor(255 * F.try_divide(F.col("\x01s") - F.col("\x01lo"), F.col("\x01hi") - F.col("\x01lo"))).cast("int")
    return g.join(F.broadcast(ends)).withColumn("shade", shade).drop("\x01s", "\x01lo", "\x01hi")


def flux_divergence(df: DataFrame, h: str, u: str, v: str, dx: float, dy: float, window: int = 3, order: int = 1, extra: list[str] = ()) -> DataFrame:
    """div, stretching and advection of the flux h (u, v), from surface derivatives of the three fields."""
    wx, wy, halo = savgol2d_weights(window, order, "x"), savgol2d_weights(window, order, "y"), window // 2

    def work(arrays):
        hh, uu, vv = (gridblocks.shifted(a, 0, 0, halo) for a in arrays)
        slope = lambda k, w, step: gridblocks.weighted(arrays[k], w, halo, False, True) / step
        stretch = hh * (slope(1, wx, dx) + slope(2, wy, dy))
        advect = uu * slope(0, wx, dx) + vv * slope(0, wy, dy)
        return [stretch + advect, stretch, advect]

    out = ["div", "stretching", "advection"]
    return gridblocks.mapped(df, [h, u, v], halo, work, out, extra).select(*extra, "i", "j", *out)


def distance_to(df: DataFrame, zero: Column, extra: list[str] = ()) -> DataFrame:
    """`df` with the distance in cells to the nearest cell where `zero` holds, however far; NULL if there is none."""
    near = gridblocks.squared_distance(df, zero, extra).select(*[F.col(c).alias(f"\x01e{k}") for k, c in enumerate(extra)], F.col("i").alias("\x01i"), F.col("j").alias("\x01j"), F.sqrt("squared").alias("distance"))
    same = [F.col(c).eqNullSafe(F.col(f"\x01e{k}")) for k, c in enumerate(extra)]
    q = df.join(near, [*same, F.col("i") == F.col("\x01i"), F.col("j") == F.col("\x01j")], "left")
    return q.drop("\x01i", "\x01j", *[f"\x01e{k}" for k in range(len(extra))])


def buffer_class(df: DataFrame, zero: Column, classes: int = 5, extra: list[str] = ()) -> DataFrame:
    """1 .. classes for cells so many steps from the zero cells, 0 inside them, NULL beyond; `distance` is NULL there too.

    Looks no farther than `classes`, so blocks with a halo do, where `distance_to` needs whole rows and columns.
    """
    halo = max(0, math.ceil(classes))
    marked = df.withColumn("\x01zero", F.when(zero, 1.0))
    near = gridblocks.mapped(marked, ["\x01zero"], halo, lambda arrays: [gridblocks.distance_within(arrays[0], halo)], ["distance"], extra).drop("\x01zero")
    lost = df.where("i is null or j is null").withColumn("distance", F.lit(None).cast("double"))
    return near.unionByName(lost).withColumn("class", F.when(F.col("distance") <= classes, F.ceil("distance").cast("int")))


def extend_field(df: DataFrame, value: str, sigmas: list[float], mask: Column | None = None) -> DataFrame:
    """Missing cells filled by ever wider Gaussians, one after another; cells outside the mask become NULL."""
    halves = [max(1, int(2 * s)) for s in sigmas]

    def work(arrays):
        import numpy as np

        a, row = arrays
        for s, half in zip(sigmas, halves):
            inner, a_row = gridblocks.shifted(a, 0, 0, half), gridblocks.shifted(row, 0, 0, half)
            filled = np.where(np.isfinite(inner), inner, gridblocks.gaussian(a, s, half))
            a, row = np.where(np.isfinite(a_row), filled, np.nan), a_row
        return [a]

    out = gridblocks.mapped(df.withColumn("\x01row", F.lit(1.0)), [value, "\x01row"], sum(halves), work, [value]).drop("\x01row")
    return out if mask is None else out.withColumn(value, F.when(mask, F.col(value)))


def regrid(nodes: DataFrame, raster: DataFrame, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, value: str, key: str) -> DataFrame:
    """Bilinear values at nodes; NULL outside the grid."""
    inside = F.col("x").between(x0, x0 + (nx - 1) * dx) & F.col("y").between(y0, y0 + (ny - 1) * dy)
    got = sample(nodes.where(inside), raster, x0, y0, dx, dy, nx, ny, value, key)
    return nodes.join(got, key, "left")


def classes(df: DataFrame, value: str, named: dict[str, list[int]]) -> DataFrame:
    """A 0/1 column for each named set of class values."""
    return df.select("*", *[F.col(value).isin(v).cast("int").alias(k) for k, v in named.items()])


def relative_to_first(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(value, F.col(value) - F.first(value).over(w))


# SRC-12
def patched_tides(cells: DataFrame, xlim: tuple[float, float] = (0.0, 360.0), ylim: tuple[float, float] = (-90.0, 90.0), per_degree: int = 30) -> DataFrame:
    """(constituent, i, j, lon, lat, re, im, patch): a compact tide model on one fine grid of `per_degree` cells a degree.

    `cells` are what `readers.compact_tide_elevations` gives of one file. Where a local patch has a value it is taken (of
    several the last patch's); elsewhere the global grid is interpolated bilinearly, NULL next to cells without a tide. i and j
    count from longitude 0 and latitude -90; only cells whose centres lie inside the half-open limits have rows.
    """
    whole = cells.where("patch = 0")
    lon0, lon1, lat0, lat1, n, m = whole.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat"), F.max("i"), F.max("j")).first()
    columns = ["constituent", "i", "j", "lon", "lat", "re", "im", "patch"]
    if n is None:
        return cells.withColumn("patch", F.col("patch").cast("int")).select(*columns).limit(0)
    first = lambda lo, base: max(0, -int(-((lo - base) * per_degree - 0.5) // 1))
    i0, i1, j0, j1 = first(xlim[0], 0.0), first(xlim[1], 0.0), first(ylim[0], -90.0), first(ylim[1], -90.0)
    wide = max(0, i1 - i0)
    at = cells.sparkSession.range(wide * max(0, j1 - j0)).select((F.col("id") % max(wide, 1) + i0).cast("int").alias("gi"), (F.floor(F.col("id") / max(wide, 1)) + j0).cast("int").alias("gj"))
    at = at.withColumns({"lon": (F.col("gi") + 0.5) / per_degree, "lat": (F.col("gj") + 0.5) / per_degree - 90.0})
    corners = _corners(at, [("lon", "i", lon0, (lon1 - lon0) / max(n, 1) or 1.0, n + 1), ("lat", "j", lat0, (lat1 - lat0) / max(m, 1) or 1.0, m + 1)])
    found = corners.join(whole.select("constituent", "i", "j", "re", "im"), ["i", "j"])
    known = F.count_if(F.col("re").isNull() & (F.col("\x01w") > 0)) == 0
    mean = {c: F.when(known, F.sum(F.coalesce(F.col("\x01w") * F.col(c), F.lit(0.0)))).alias(c) for c in ("re", "im")}
    coarse = found.groupBy("constituent", "gi", "gj", "lon", "lat").agg(*mean.values())
    lon = F.when(F.col("lon") <= 0, F.col("lon") + 360).otherwise(F.col("lon"))
    local = cells.where("patch > 0").select("constituent", F.floor(lon * per_degree).cast("int").alias("gi"), F.floor((F.col("lat") + 90) * per_degree).cast("int").alias("gj"), F.struct("patch", "re", "im").alias("p"))
    local = local.groupBy("constituent", "gi", "gj").agg(F.max("p").alias("p"))
    both = coarse.join(local, ["constituent", "gi", "gj"], "left")
    value = lambda c: F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(c)).alias(c)
    return both.select("constituent", F.col("gi").alias("i"), F.col("gj").alias("j"), "lon", "lat", value("re"), value("im"), F.col("p.patch").alias("patch"))
