"""Rasters as blocks: a task holds a square of cells with a halo from its neighbours, and works on dense arrays.

One shuffle brings each cell to its block and to those whose halo it lies in, about one copy of the raster as
long as blocks are wide against the halo. Kernels then run as numpy sums of shifted arrays; a row of the raster
keeps its other columns. A raster has one row a cell; NULL and NaN are missing values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import by_runs, runs

#: Cells along a block's side; wider where a halo is wide.
SIDE = 256


def mapped(df: DataFrame, values: list[str], halo: int, work: Callable, outputs: list[str], extra: list[str] = (), side: int | None = None) -> DataFrame:
    """`df` with the columns `outputs` (doubles), replaced where `df` has them.

    `work(arrays)` gets one array for each of `values`, NaN where nothing is known, with `halo` cells more at each
    side, and gives one array for each of `outputs`, without the halo; NaN becomes NULL. `extra` tells rasters apart.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    side = side or max(SIDE, 4 * halo)
    plain = [c for c in df.columns if c not in outputs]
    schema = StructType([*(df.schema[c] for c in plain), *(StructField(c, DoubleType()) for c in outputs)])
    arrow = to_arrow_schema(schema)
    keys = [f"\x01k{k}" for k in range(len(extra))]
    block = lambda c, by: F.floor((F.col(c) + by) / side)
    names = [f"\x01v{k}" for k in range(len(values))]
    q = df.withColumns({**{k: F.col(c) for k, c in zip(keys, extra)}, **{n: F.col(c).cast("double") for n, c in zip(names, values)}, "\x01i": F.col("i").cast("long"), "\x01j": F.col("j").cast("long")})
    q = q.withColumn("\x01bi", F.explode(F.sequence(block("i", -halo), block("i", halo)))).withColumn("\x01bj", F.explode(F.sequence(block("j", -halo), block("j", halo))))
    own = (F.col("\x01bi") == block("i", 0)) & (F.col("\x01bj") == block("j", 0))
    at = [*keys, "\x01bi", "\x01bj"]
    q = q.select(*at, (~own).alias("\x01far"), "\x01i", "\x01j", *names, *[F.when(own, F.col(c)).alias(f"\x01p{k}") for k, c in enumerate(plain)])
    q = q.repartition(*at).sortWithinPartitions(*at, "\x01far")
    first = len(at) + 3

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for parts in runs(batches, len(at)):
            t = pa.Table.from_batches(parts).combine_chunks()
            n = int(np.searchsorted(t.column(len(at)).to_numpy(), True))
            if not n:
                continue
            i, j = t.column(len(at) + 1).to_numpy(), t.column(len(at) + 2).to_numpy()
            li, lj = i[:n].min() - halo, j[:n].min() - halo
            hi, hj = i[:n].max() + halo, j[:n].max() + halo
            inside = (i >= li) & (i <= hi) & (j >= lj) & (j <= hj)
            arrays = []
            for k in range(len(values)):
                a = np.full((hi - li + 1, hj - lj + 1), np.nan)
                a[i[inside] - li, j[inside] - lj] = t.column(first + k).to_numpy()[inside]
                arrays.append(a)
            found = work(arrays)
            kept = [t.column(first + len(values) + k).slice(0, n).combine_chunks() for k in range(len(plain))]
            own_i, own_j = i[:n] - li - halo, j[:n] - lj - halo
            yield pa.record_batch([*kept, *(pa.array(f[own_i, own_j], from_pandas=True) for f in found)], schema=arrow)

    placed = q.where(F.col("\x01i").isNotNull() & F.col("\x01j").isNotNull())
    return placed.mapInArrow(run, schema).select(*df.columns, *[c for c in outputs if c not in df.columns])


def shifted(a, di: int, dj: int, halo: int):
    """The neighbours (di, dj) of the cells without the halo."""
    n, m = a.shape
    return a[halo + di : n - halo + di, halo + dj : m - halo + dj]


def weighted(a, weights: dict, halo: int, normalise: bool, whole: bool):
    """Sum of the neighbours times `weights`, over the weights of those there if `normalise`; see `raster.kernel`."""
    import numpy as np

    there = np.isfinite(a)
    filled = np.where(there, a, 0.0)
    total = np.zeros((a.shape[0] - 2 * halo, a.shape[1] - 2 * halo))
    weight, count = total.copy(), total.copy()
    for (di, dj), w in weights.items():
        here = shifted(there, di, dj, halo)
        if w:
            total += w * shifted(filled, di, dj, halo)
            weight += w * here
        count += here
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(weight != 0, total / weight, np.nan) if normalise else total
    return np.where(count == len(weights) if whole else count > 0, out, np.nan)


def gaussian(a, sigma: float, half: int):
    """Gaussian mean of what is there within `half` cells, of the array without `half` cells at each side: along one axis, then the other."""
    import numpy as np

    w = np.exp(-(np.arange(-half, half + 1.0) ** 2) / (2 * sigma * sigma))

    def along(x):
        n = x.shape[0] - 2 * half
        return sum(w[k] * x[k : k + n] for k in range(2 * half + 1))

    there = np.isfinite(a)
    total, weight = (along(along(x).T).T for x in (np.where(there, a, 0.0), there.astype(float)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight > 0, total / weight, np.nan)


def median(a, k: int):
    """Median of what is there of k x k cells, of the array without k // 2 cells at each side."""
    import numpy as np

    out = np.empty((a.shape[0] - k + 1, a.shape[1] - k + 1))
    windows = np.lib.stride_tricks.sliding_window_view(a, (k, k))
    for row in range(len(out)):
        s = np.sort(windows[row].reshape(out.shape[1], k * k), axis=1)
        n = np.isfinite(s).sum(axis=1)
        pick = lambda m: np.take_along_axis(s, np.maximum(m, 0)[:, None], axis=1)[:, 0]
        out[row] = np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, np.nan)
    return out


def distance_within(a, most: int):
    """Distance to the nearest finite cell at most `most` away, else NaN, of the array without `most` cells at each side: along rows, then columns."""
    import numpy as np

    there = np.isfinite(a)
    n, m = a.shape[0] - 2 * most, a.shape[1] - 2 * most
    along = np.full((a.shape[0], m), np.inf)
    for d in range(most, -1, -1):
        along[there[:, most - d : most - d + m] | there[:, most + d : most + d + m]] = d * d
    best = np.full((n, m), np.inf)
    for d in range(-most, most + 1):
        np.minimum(best, along[most + d : most + d + n] + d * d, out=best)
    return np.where(best <= most * most, np.sqrt(best), np.nan)


def envelope(at, height, to):
    """min over k of height[k] + (to - at[k])^2 for each of the sorted places `to`, by the lower envelope of the parabolas.

    `at` is sorted and has each place once.
    """
    import numpy as np

    kept, edges = [], []
    for k in range(len(at)):
        edge = -np.inf
        while kept:
            b = kept[-1]
            edge = ((height[k] + at[k] ** 2) - (height[b] + at[b] ** 2)) / (2.0 * (at[k] - at[b]))
            if edge > edges[-1]:
                break
            kept.pop()
            edges.pop()
            edge = -np.inf
        kept.append(k)
        edges.append(edge)
    best = np.array(kept)[np.searchsorted(np.array(edges), to, "right") - 1]
    return height[best] + (to - at[best]) ** 2


def squared_distance(df: DataFrame, zero, extra: list[str] = ()) -> DataFrame:
    """(extra, i, j, squared): squared distance in cells to the nearest cell where `zero` holds, however far.

    Along rows first: the distance of every column to the nearest zero of a row. Then each column takes the
    lower envelope of its rows' parabolas. A row or a column of the raster meets in one task. Cells of a raster
    without a zero are NULL; cells without a place have no row.
    """
    keys = list(extra)
    q = df.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.coalesce(zero, F.lit(False)).alias("z")).where("i is not null and j is not null")
    names = [f"e{k}" for k in range(len(keys))]
    q = q.toDF(*names, "i", "j", "z")
    span = q.groupBy(*names).agg(F.min("j").alias("low"), F.max("j").alias("high"))
    zeros = q.where("z").select(*names, "i", "j")
    on = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    zeros = zeros.alias("a").join(span.alias("b"), on).select("a.*", "low", "high") if names else zeros.crossJoin(F.broadcast(span))
    kinds = ", ".join([*(f"{n} {q.schema[n].dataType.simpleString()}" for n in names), ""]) if names else ""

    def along(key, arrays):
        import numpy as np

        j, low, high = arrays
        j = np.unique(j)
        to = np.arange(low[0], high[0] + 1)
        right = np.searchsorted(j, to)
        far = np.iinfo(np.int64).max // 4
        g = np.minimum(np.where(right < len(j), j[np.minimum(right, len(j) - 1)] - to, far), np.where(right > 0, to - j[np.maximum(right - 1, 0)], far))
        return (*([k] * len(to) for k in key[:-1]), np.full(len(to), key[-1]), to, g * g)

    rows = by_runs(zeros, [*names, "i"], ["j", "low", "high"], ["j"], along, f"{kinds}i long, j long, height long")

    def down(key, arrays):
        import numpy as np

        i, height = arrays
        known = ~np.isnan(height)
        to = i[~known]
        if not len(to):
            return None
        out = envelope(i[known].astype(float), height[known], to.astype(float)) if known.any() else np.full(len(to), np.nan)
        return (*([k] * len(to) for k in key[:-1]), to, np.full(len(to), key[-1]), out)

    both = rows.select(*names, "i", "j", F.col("height").cast("double").alias("height")).unionByName(q.select(*names, "i", "j", F.lit(None).cast("double").alias("height")))
    found = by_runs(both, [*names, "j"], ["i", "height"], ["i"], down, f"{kinds}i long, j long, squared double")
    return found.withColumn("squared", F.when(~F.isnan("squared"), F.col("squared"))).toDF(*keys, "i", "j", "squared")
