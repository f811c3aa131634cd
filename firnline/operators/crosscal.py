"""Cross-calibration of missions by biases chained along a tree of overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import by_runs

def overlap_tree(series: dict) -> list[tuple]:
    """(mission, parent, bias, common) of every mission of `series` ({mission: (epochs, values)}), the root first.

    Missions are joined by the tree with the most common epochs; of equal overlaps the pair that begins first counts.
    Trees without a common epoch are joined where the gap between two epochs is shortest. The root is the mission that
    begins first. A step is the median difference at common epochs, or the difference at the nearest epochs over a
    gap; `bias` is the sum of the steps from the root.
    """
    import numpy as np

    names = sorted(series, key=lambda m: (series[m][0][0], str(m)))
    edges = []
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            (ta, va), (tb, vb) = series[names[a]], series[names[b]]
            _, ia, ib = np.intersect1d(ta, tb, assume_unique=True, return_indices=True)
            if len(ia):
                edges.append((-len(ia), 0.0, a, b, float(np.median(vb[ib] - va[ia])), len(ia)))
            else:  # the nearest epochs; of series that lie apart, the end of one and the begin of the other
                near = int(np.abs(ta[:, None] - tb[None, :]).argmin())
                i, j = near // len(tb), near % len(tb)
                edges.append((0, float(abs(ta[i] - tb[j])), a, b, float(vb[j] - va[i]), 0))
    group = list(range(len(names)))

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    near: dict[int, list] = {k: [] for k in range(len(names))}
    for _, _, a, b, step, common in sorted(edges, key=lambda e: e[:4]):
        if root(a) != root(b):
            group[root(a)] = root(b)
            near[a].append((b, step, common))
            near[b].append((a, -step, common))
    out, waiting = [], [(0, None, 0.0, 0)] if names else []
    while waiting:
        k, parent, bias, common = waiting.pop(0)
        out.append((names[k], None if parent is None else names[parent], bias, common))
        waiting += [(b, k, bias + step, n) for b, step, n in near[k] if b != parent]
    return out


def monthly(df: DataFrame, cell: str, k: str, mission: str, value: str) -> DataFrame:
    """Median of each mission's values at an epoch of a cell; rows without one of them are left out."""
    q = df.dropna(subset=[k, mission, value]).where(~F.isnan(F.col(value).cast("double")))
    return q.groupBy(cell, mission, F.col(k).cast("long").alias(k)).agg(F.median(value).alias(value))


# FIT-9
def chained_biases(df: DataFrame, cell: str, k: str, mission: str, value: str, window: int = 5, least: int = 5) -> DataFrame:
    """(cell, mission, parent, bias, common) for the missions with `least` epochs or more in a cell.

    Each mission's series is smoothed by a line over `window` of its epochs (ends repeat the first and last value), then
    missions are chained by `overlap_tree`: a mission that shares no epoch with the first one is levelled through those
    between them. `df` has one row for each cell, mission and epoch (see `monthly`).
    """
    from .alongtrack import savgol_weights

    weights = savgol_weights(window, 1)

    def work(c, arrays):
        import numpy as np

        (c,) = c
        missions, epochs, values = arrays
        series = {}
        for m in dict.fromkeys(missions.tolist()):
            at = missions == m
            v = values[at].astype(float)
            if len(v) >= least:
                half = window // 2
                padded = np.concatenate([[v[0]] * half, v, [v[-1]] * half])
                series[m] = (epochs[at], np.convolve(padded, weights[::-1], "valid"))
        return tuple(zip(*((c, *found) for found in overlap_tree(series)))) or None

    kinds = df.schema[cell].dataType.simpleString(), df.schema[mission].dataType.simpleString()
    return by_runs(df, [cell], [mission, k, value], [mission, k], work, f"{cell} {kinds[0]}, {mission} {kinds[1]}, parent {kinds[1]}, bias double, common long")


def chained_series(df: DataFrame, cell: str, k: str, mission: str, value: str, reference: int | None = None, window: int = 5, least: int = 5) -> DataFrame:
    """(cell, k, value, missions): all missions of a cell on one level, fused by the median at each epoch.

    Values are relative to the cell's epoch nearest to `reference` (of equals the earlier), or to the root's level without one.
    """
    q = monthly(df, cell, k, mission, value)
    bias = chained_biases(q, cell, k, mission, value, window, least).select(F.col(cell).alias("\x01c"), F.col(mission).alias("\x01m"), "bias")
    level = q.join(bias, F.col(cell).eqNullSafe(F.col("\x01c")) & (F.col(mission) == F.col("\x01m")))
    out = level.groupBy(cell, k).agg(F.median(F.col(value) - F.col("bias")).alias(value), F.count("*").alias("missions"))
    if reference is None:
        return out
    near = F.min_by(value, F.struct(F.abs(F.col(k) - reference), F.col(k))).over(Window.partitionBy(cell))
    return out.withColumn(value, F.col(value) - near)
