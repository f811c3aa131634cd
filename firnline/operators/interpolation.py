"""Scattered points to nodes: medians, Gaussian weights, inverse distance, kriging, optimal interpolation.

Neighbours come from the joins of `spatial`; weighted means stay in SQL aggregates. Kriging and optimal
interpolation solve one small dense system a node, in numpy inside a grouped task: a group holds a
node's neighbours, whose number the caller bounds (k neighbours) or the radius does.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spatial import knn_join, radius_join


def grid(spark: SparkSession, xmin: float, xmax: float, ymin: float, ymax: float, dx: float, dy: float) -> DataFrame:
    """Nodes i, j, x, y about dx, dy apart, evenly from limit to limit."""
    nx, ny = int(abs(xmax - xmin) / dx) + 1, int(abs(ymax - ymin) / dy) + 1
    n = spark.range(nx * ny)
    i, j = F.floor(F.col("id") / ny).cast("int"), (F.col("id") % ny).cast("int")
    return n.select(i.alias("i"), j.alias("j"), (xmin + i * ((xmax - xmin) / max(1, nx - 1))).alias("x"), (ymin + j * ((ymax - ymin) / max(1, ny - 1))).alias("y"))


def relocated_join(nodes: DataFrame, points: DataFrame, r: float, key: str, times: int = 1) -> DataFrame:
    """Radius join around each node's centroid (median of its points), moved `times` times at most.

    A centroid farther than r from the node is not used.
    """
    at = nodes
    for _ in range(times):
        q = radius_join(at, points, r).groupBy(f"l_{key}").agg(F.median("r_x").alias("\x01mx"), F.median("r_y").alias("\x01my"))
        start = nodes.select(F.col(key).alias("\x01k"), F.col("x").alias("\x01x0"), F.col("y").alias("\x01y0"))
        moved = at.join(q.withColumnRenamed(f"l_{key}", key), key).join(start, F.col(key) == F.col("\x01k"))
        near = F.sqrt((F.col("\x01mx") - F.col("\x01x0")) ** 2 + (F.col("\x01my") - F.col("\x01y0")) ** 2) <= r
        at = moved.withColumns({"x": F.when(near, F.col("\x01mx")).otherwise(F.col("x")), "y": F.when(near, F.col("\x01my")).otherwise(F.col("y"))}).select(*nodes.columns)
    return radius_join(at, points, r)


def _near_enough(q: DataFrame, key: str, d: float) -> DataFrame:
    """Nodes whose nearest neighbour is within d (their other neighbours may be farther)."""
    near = q.groupBy(f"l_{key}").agg(F.min("d2").alias("\x01d")).where(F.col("\x01d") <= d * d).select(f"l_{key}")
    return q.join(near, f"l_{key}", "left_semi")


def median_knn(nodes: DataFrame, points: DataFrame, key: str, tie: str, z: str, k: int, d: float, cell: float) -> DataFrame:
    q = _near_enough(knn_join(nodes, points, k, cell, key, tie), key, d)
    return q.groupBy(F.col(f"l_{key}").alias(key)).agg(F.median(f"r_{z}").alias("z"), F.count("*").alias("n"))


def gaussian_knn(nodes: DataFrame, points: DataFrame, key: str, tie: str, z: str, s: str, k: int, d: float, a: float, cell: float) -> DataFrame:
    """Mean weighted by exp(-d2 / 2 a2) / s2, and its error from the spread and the mean sigma."""
    q = _near_enough(knn_join(nodes, points, k, cell, key, tie), key, d)
    w = F.exp(-F.col("d2") / (2 * a * a)) / F.pow(F.col(f"r_{s}"), F.lit(2)) + 1e-6
    q = q.withColumn("\x01w", w)
    mean = F.sum(F.col("\x01w") * F.col(f"r_{z}")) / F.sum("\x01w")
    var = F.sum(F.col("\x01w") * F.col(f"r_{z}") ** 2) / F.sum("\x01w") - F.pow(mean, F.lit(2))
    return q.groupBy(F.col(f"l_{key}").alias(key)).agg(mean.alias("z"), F.sqrt(F.greatest(var, F.lit(0.0)) + F.pow(F.avg(f"r_{s}"), F.lit(2))).alias("err"), F.count("*").alias("n"))


def gaussian_space_time(nodes: DataFrame, points: DataFrame, key: str, z: str, t: str, epochs: list[float], r: float, a: float, tau: float) -> DataFrame:
    """For each node and epoch the mean of all points within r, weighted in space and in time."""
    q = radius_join(nodes, points, r).where(F.abs(f"r_{z}") >= 1e-6).withColumn("epoch", F.explode(F.array(*[F.lit(float(e)) for e in epochs])))
    w = F.exp(-F.col("d2") / (2 * a * a)) * F.exp(-F.pow(F.col(f"r_{t}") - F.col("epoch"), F.lit(2)) / (2 * tau * tau))
    return q.withColumn("\x01w", w).groupBy(F.col(f"l_{key}").alias(key), "epoch").agg((F.sum(F.col("\x01w") * F.col(f"r_{z}")) / F.sum("\x01w")).alias("z"), F.count("*").alias("n"))


def inverse_distance(nodes: DataFrame, points: DataFrame, key: str, tie: str, z: str, k: int, r: float, cell: float) -> DataFrame:
    q = knn_join(nodes, points, k, cell, key, tie).where(F.col("d2") <= r * r)
    w = F.try_divide(F.lit(1.0), F.col("d2"))
    exact = F.max(F.when(F.col("d2") == 0, F.col(f"r_{z}")))
    return q.groupBy(F.col(f"l_{key}").alias(key)).agg(F.coalesce(exact, F.sum(F.col(f"r_{z}") * w) / F.sum(w)).alias("z"))


def fill_nearest(df: DataFrame, value: str, key: str, cell: float) -> DataFrame:
    """Missing values from the nearest row that has one."""
    have, lack = df.where(F.col(value).isNotNull()), df.where(F.col(value).isNull())
    got = knn_join(lack, have, 1, cell, key, key).select(F.col(f"l_{key}").alias(key), F.col(f"r_{value}").alias("\x01v"))
    return df.join(got, key, "left").withColumn(value, F.coalesce(value, "\x01v")).drop("\x01v")


def _model(kind: str, d, c0: float, a: float):
    """Covariance at distance d; a is the distance at which it has about halved."""
    import numpy as np

    if kind == "gauss":
        return c0 * np.exp(-((d / (a * 1.2)) ** 2))
    if kind == "markov":
        q = d / (0.595 * a)
        return c0 * (1 + q) * np.exp(-q)
    if kind == "generic":
        q = d / (0.9132 * a)
        return c0 * (1 + q - 0.5 * q * q) * np.exp(-q)
    return c0 * np.exp(-d / (a * 1.4427))


#: Points of a node whose system is solved as one matrix, and with times (512 MB and a copy); larger ones are solved by cells, or by rows of so many numbers at a time.
DENSE, TIMED, ROWS = 3_000, 8_000, 4_000_000
#: Tasks that few nodes are dealt to.
NODE_TASKS = 1_000
#: Points whose view of a large system speeds up its solution.
LANDMARKS = 1_000
#: Nodes of a cell and side for covariances of points that are more than RINGS cells apart, mean points of a cell, cells of a side at most.
NODES, RINGS, EACH, CELLS = 10, 2, 50, 48
#: Covariances of near points that are held (800 MB); of more, they are made anew for each step.
HELD = 100_000_000
#: Largest error of a product by cells, as a share of the variance times the sum of the vector's sizes.
EXACT = 1e-13


def _by_cells(x, y, cov, length: float):
    """A function v to K v, K the covariances `cov(distance)` of all pairs of points; None where cells would not be exact enough.

    Points of near cells meet as they are. Those of other cells meet through a grid of Chebyshev nodes in each cell,
    between which a covariance that far out is a polynomial to within EXACT (looked at on some rows); the sums over
    all cells are a convolution. Time and memory grow with the points, not with their square.
    """
    import numpy as np

    n = len(x)
    span = max(np.ptp(x), np.ptp(y))
    least = int(np.ceil(2 * span / length))
    if not 0 < least <= CELLS:
        return None
    g = max(2 * RINGS + 2, least, min(int(np.sqrt(n / EACH)), CELLS))
    side = span / g * (1 + 1e-9)
    cx, cy = (np.floor((c - c.min()) / side).astype(np.int64) for c in (x, y))
    cell = cx * g + cy
    order = np.argsort(cell, kind="stable")
    xs, ys, cell = x[order], y[order], cell[order]
    edges = np.searchsorted(cell, np.arange(g * g + 1))
    used = np.unique(cell)

    # what a point gives to and takes from the nodes of its cell
    k = np.arange(NODES)
    at = np.cos((2 * k + 1) * np.pi / (2 * NODES))
    chebyshev = lambda t: np.cos(k * np.arccos(np.clip(t, -1, 1))[..., None])
    weights = lambda t: (chebyshev(t) * np.where(k == 0, 1, 2) / NODES) @ chebyshev(at).T
    mine = lambda c, low, i: weights(2 * ((c - low) / side - i) - 1)
    wx, wy = mine(xs, x.min(), cell // g), mine(ys, y.min(), cell % g)
    nx, ny = (v.ravel() * side / 2 for v in np.meshgrid(at, at, indexing="ij"))

    def between(i, j):  # covariances of the nodes of two cells
        return cov(np.hypot(nx[:, None] - nx[None, :] + i * side, ny[:, None] - ny[None, :] + j * side))

    ring = [(i, j) for i in range(-RINGS - 2, RINGS + 3) for j in range(-RINGS - 2, RINGS + 3) if max(abs(i), abs(j)) > RINGS]
    u, size, _ = np.linalg.svd(np.concatenate([between(i, j) for i, j in ring], axis=1), full_matrices=False)
    u = u[:, size > 1e-14 * size[0]]
    basis = np.concatenate([(a[:, :, None] * b[:, None, :]).reshape(len(a), -1) @ u for a, b in zip(np.array_split(wx, n // 10_000 + 1), np.array_split(wy, n // 10_000 + 1))])
    m = u.shape[1]
    shift = np.zeros((2 * g, 2 * g, m, m))
    for i in range(1 - g, g):
        for j in range(1 - g, g):
            if max(abs(i), abs(j)) > RINGS:
                shift[i, j] = u.T @ between(i, j) @ u
    shift = np.fft.rfft2(shift, axes=(0, 1))

    blocks = []
    for c in used:
        i, j = divmod(int(c), g)
        lo, hi = edges[c], edges[i * g + min(j + RINGS, g - 1) + 1]
        beside = [np.arange(edges[r * g + max(j - RINGS, 0)], edges[r * g + min(j + RINGS, g - 1) + 1]) for r in range(i + 1, min(i + RINGS, g - 1) + 1)]
        blocks.append((lo, edges[c + 1], np.concatenate([np.arange(lo, hi), *beside])))
    near = lambda lo, hi, to: cov(np.hypot(xs[lo:hi, None] - xs[None, to], ys[lo:hi, None] - ys[None, to]))
    held = [near(*b) for b in blocks] if sum((hi - lo) * len(to) for lo, hi, to in blocks) <= HELD else None

    def times(v):
        v = v[order]
        given = np.zeros((g * g, m))
        given[used] = np.add.reduceat(basis * v[:, None], edges[used])
        far = np.fft.rfft2(given.reshape(g, g, m), (2 * g, 2 * g), axes=(0, 1))
        far = np.fft.irfft2((shift @ far[..., None])[..., 0], (2 * g, 2 * g), axes=(0, 1))[:g, :g].reshape(g * g, m)
        out = (basis * far[cell]).sum(axis=1)
        for k, (lo, hi, to) in enumerate(blocks):
            block = near(lo, hi, to) if held is None else held[k]
            out[lo:hi] += block @ v[to]
            later = to[hi - lo :]
            out[later] += block[:, hi - lo :].T @ v[lo:hi]
        back = np.empty(n)
        back[order] = out
        return back

    some = np.linspace(0, n - 1, 16).astype(int)
    trial = np.random.default_rng(7).normal(size=n)
    want = cov(np.hypot(x[some, None] - x[None, :], y[some, None] - y[None, :])) @ trial
    if np.abs(times(trial)[some] - want).max() > EXACT * cov(np.zeros(1))[0] * np.abs(trial).sum():
        return None
    return times


def _apart(x, y, most: int):
    """Places of up to `most` points, each as far as can be from those before it."""
    import numpy as np

    at, far = [0], np.hypot(x - x[0], y - y[0])
    while len(at) < most and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, np.hypot(x - x[at[-1]], y - y[at[-1]]))
    return np.array(at)


def _by_gradients(rows, noise, right, parts, landmarks: int, tolerance: float = 1e-12, product=None, at=None):
    """Solution of (rows + diagonal `noise`) w = right by conjugate gradients; `rows(k)` makes rows of the matrix, `product(v)` their product, if there is a faster way.

    Preconditioned by the same system with the matrix as the points `at`, or some evenly chosen ones, see it.
    """
    import numpy as np

    n = len(right)
    at = np.unique(np.linspace(0, n - 1, min(landmarks, n)).astype(int)) if at is None else at
    seen = rows(at)
    size, turn = np.linalg.eigh((seen[:, at] + seen[:, at].T) / 2)
    kept = size > 1e-9 * size[-1]
    seen = (turn[:, kept] / np.sqrt(size[kept])).T @ seen
    core = np.linalg.inv(np.eye(len(seen)) + (seen / noise) @ seen.T)
    near = lambda v: (v - ((core @ (seen @ (v / noise))) @ seen)) / noise
    product = product or (lambda v: np.concatenate([rows(k) @ v for k in parts]))
    times = lambda v: product(v) + noise * v
    x, r = np.zeros(n), right.copy()
    z = near(r)
    p, rz, goal = z.copy(), r @ z, tolerance * np.sqrt(right @ right)
    for _ in range(2 * n):
        q = times(p)
        step = rz / (p @ q)
        x, r = x + step * p, r - step * q
        if np.sqrt(r @ r) <= goal:
            break
        z = near(r)
        rz, before = r @ z, rz
        p = z + rz / before * p
    return x


def solve(x0: float, y0: float, x, y, z, s, a: float, kind: str = "markov", same=None, same_error: float = 0.0, t=None, t0: float = 0.0, tau: float | None = None, dense: int | None = None) -> tuple[float, float]:
    """Estimate and error at one node: simple kriging about the median with noise variances s2.

    With `tau`, covariances also fall with the time between points, exp(-(dt / tau)^2), and to the epoch t0.
    Up to `dense` points (DENSE, with `tau` TIMED) are one matrix. For more the matrix is never held: conjugate gradients, which end at a residual of
    10^-12, take its products by cells (`_by_cells`), whose time grows with the points. With `tau`, or where cells would not be
    exact enough, its rows are made anew, some at a time, for each step, in a time that grows with the square of the points.
    """
    import numpy as np

    mean, c0 = np.median(z), max(np.var(z), 1e-12)

    def rows(k):
        cov = _model(kind, np.hypot(x[k, None] - x[None, :], y[k, None] - y[None, :]), c0, a)
        if tau:
            cov = cov * np.exp(-(((t[k, None] - t[None, :]) / tau) ** 2))
        if same is not None and same_error:
            cov = cov + same_error**2 * ((same[k, None] == same[None, :]) & (k[:, None] != np.arange(len(z))[None, :]))
        return cov

    noise = s**2 + 1e-10 * c0
    to = _model(kind, np.hypot(x - x0, y - y0), c0, a)
    if tau:
        to = to * np.exp(-(((t - t0) / tau) ** 2))
    parts = np.array_split(np.arange(len(z)), max(1, len(z) * len(z) // ROWS))
    if len(z) <= (dense or (TIMED if tau else DENSE)):
        system = np.empty((len(z), len(z)))
        for k in parts:
            system[k] = rows(k)
        system[np.diag_indices(len(z))] += noise
        weights = np.linalg.solve(system, to)
    else:
        product = None if tau else _by_cells(x, y, lambda d: _model(kind, d, c0, a), a)
        if product and same is not None and same_error:
            by_cells, track = product, np.unique(same, return_inverse=True)[1]
            product = lambda v: by_cells(v) + same_error**2 * (np.bincount(track, v)[track] - v)
        weights = _by_gradients(rows, noise, to, parts, LANDMARKS, product=product, at=_apart(x, y, LANDMARKS))
    return float(mean + weights @ (z - mean)), float(np.sqrt(max(c0 - weights @ to, 0.0)))


def kriging(nodes: DataFrame, points: DataFrame, key: str, tie: str, z: str, s: str, k: int, a: float, cell: float, kind: str = "markov", sectors: int = 0) -> DataFrame:
    """(key, z, err, n) from each node's k nearest points (of each sector, if asked for)."""
    q = knn_join(nodes, points, k, cell, key, tie, sectors=sectors).select(F.col(f"l_{key}").alias("key"), F.col("l_x").alias("x0"), F.col("l_y").alias("y0"), F.col("r_x").alias("x"), F.col("r_y").alias("y"), F.col(f"r_{z}").alias("z"), F.col(f"r_{s}").alias("s"))

    def one(pdf):
        import pandas as pd

        rows = []
        for node, g in pdf.groupby("key", sort=False):
            if g["z"].isna().any():
                continue
            est, err = solve(g["x0"].iloc[0], g["y0"].iloc[0], *(g[c].to_numpy() for c in ("x", "y", "z", "s")), a, kind)
            rows.append((node, est, err, len(g)))
        return pd.DataFrame(rows, columns=["key", "z", "err", "n"])

    return q.groupBy("key").applyInPandas(one, f"key {nodes.schema[key].dataType.simpleString()}, z double, err double, n long").withColumnRenamed("key", key)


def optimal(nodes: DataFrame, points: DataFrame, key: str, z: str, s: str, t: str, track: str, r: float, a: float, kind: str = "markov", least: int = 25, n_sigma: float = 3.0, track_error: float = 0.0, most: int | None = None, tau: float | None = None, t_ref: float | None = None, sectors: int = 0, per_sector: int = 0) -> DataFrame:
    """Optimal interpolation from all points within r: (key, z, err, n, t_mean, t_span, d_mean).

    Values beyond n MADs of the node's median are left out first; then, with `sectors`, all but the nearest `per_sector`
    points of each of so many equal directions (first east; of equal distances the first in x, y, z, t). Nodes with fewer
    than `least` points have no row; points of one track share `track_error`. With `tau` the covariance falls with time
    too, to `t_ref`, or to the mean time of the node's points. See `solve` for how large systems are solved.
    """
    q = radius_join(nodes, points, r).select(F.col(f"l_{key}").alias("key"), F.col("l_x").alias("x0"), F.col("l_y").alias("y0"), F.col("r_x").alias("x"), F.col("r_y").alias("y"), F.col(f"r_{z}").alias("z"), F.col(f"r_{s}").alias("s"), F.col(f"r_{t}").alias("t"), F.col(f"r_{track}").cast("string").alias("track"))

    def one(pdf):
        import numpy as np
        import pandas as pd

        rows = []
        for node, g in pdf.groupby("key", sort=False):
            g = g.dropna(subset=["x", "y", "z", "s", *(["t"] if tau else [])])
            dev = (g["z"] - g["z"].median()).abs()
            g = g[dev <= n_sigma * 1.4826 * dev.median()] if dev.median() > 0 else g
            if len(g) < least:
                continue
            if most is not None and len(g) > most:
                raise ValueError(f"node {node} has {len(g)} points within {r}; at most {most} are wanted")
            g = g.sort_values(["x", "y", "z", "t"])
            x0, y0 = g["x0"].iloc[0], g["y0"].iloc[0]
            if sectors:
                turn = np.floor(np.arctan2(g["y"] - y0, g["x"] - x0) / (2 * np.pi) * sectors) % sectors
                near = np.hypot(g["x"] - x0, g["y"] - y0)
                order = np.lexsort((near, turn))
                rank = np.empty(len(g), int)
                rank[order] = np.arange(len(g)) - np.searchsorted(turn.to_numpy()[order], turn.to_numpy()[order])
                g = g[rank < per_sector]
                if len(g) < least:
                    continue
            x, y, tt = (g[c].to_numpy(float) for c in ("x", "y", "t"))
            at = float(np.nanmean(tt)) if t_ref is None else t_ref
            est, err = solve(x0, y0, x, y, g["z"].to_numpy(), g["s"].to_numpy(), a, kind, pd.factorize(g["track"])[0], track_error, tt, at, tau)
            rows.append((node, est, err, len(g), g["t"].mean(), g["t"].max() - g["t"].min(), float(np.hypot(x - x0, y - y0).mean())))
        return pd.DataFrame(rows, columns=["key", "z", "err", "n", "t_mean", "t_span", "d_mean"])

    schema = f"key {nodes.schema[key].dataType.simpleString()}, z double, err double, n long, t_mean double, t_span double, d_mean double"
    # a node may be a long task: few nodes get a task each, as small as what they hold is for Spark
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * nodes.count(), NODE_TASKS))
    q = q.repartition(tasks, "key")
    return q.groupBy("key").applyInPandas(one, schema).withColumnRenamed("key", key)


def running_median(v, k: int):
    """Median of the k values around each, fewer at the ends."""
    import numpy as np

    h = k // 2
    return np.array([np.median(v[max(0, i - h) : i + h + 1]) for i in range(len(v))])


# FIT-10
def robust_covariance(lags, cov, kind: str = "markov", window: int = 3, scale: float = 0.1, rounds: int = 200) -> dict:
    """c0, a and misfit of a covariance model fitted to the running medians of `cov` by soft-L1 loss, with its lengths.

    Residuals larger than `scale` times the largest covariance count less and less (square root of one plus the square). `half`
    and `efold` are the lags at which the model has fallen to a half and to 1/e, `zero` is the lag at which the medians
    first cross zero (None if they don't). One number a lag, so this is worked out where it is called.
    """
    import numpy as np

    order = np.argsort(lags)
    d, c = np.asarray(lags, float)[order], np.asarray(cov, float)[order]
    c = running_median(c, window)
    unit = scale * np.abs(c).max() or 1.0

    def loss(p):
        z = ((_model(kind, d, *p) - c) / unit) ** 2
        return (2 * (np.sqrt(1 + z) - 1)).sum()

    def search(p):  # damped steps of reweighted least squares
        damp, now = 1e-3, loss(p)
        for _ in range(rounds):
            res = (_model(kind, d, *p) - c) / unit
            step = 1e-6 * np.maximum(np.abs(p), 1e-9)
            jac = np.stack([(_model(kind, d, *(p + np.eye(2)[k] * step[k])) - _model(kind, d, *(p - np.eye(2)[k] * step[k]))) / (2 * step[k] * unit) for k in (0, 1)], axis=1)
            w = 1 / np.sqrt(1 + res**2)
            normal, slope = (jac * w[:, None]).T @ jac, (jac * w[:, None]).T @ res
            try:
                new = p - np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-300), slope)
            except np.linalg.LinAlgError:
                break
            if new[1] > 0 and (there := loss(new)) <= now:
                done = now - there <= 1e-14 * (now + 1e-300)
                p, now, damp = new, there, damp / 5
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e12:
                    break
        return now, p

    starts = [np.array([c[0] if c[0] > 0 else np.abs(c).max(), f * d[-1]]) for f in (0.05, 0.15, 0.4, 1.0)]
    _, (c0, a) = min((search(p) for p in starts), key=lambda found: found[0])
    shape = lambda x: _model(kind, x, 1.0, a)

    def falls_to(level):
        lo, hi = 0.0, a
        while shape(hi) > level:
            hi *= 2
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if shape(mid) > level else (lo, mid)
        return float(hi)

    cross = np.flatnonzero(np.sign(c[:-1]) * np.sign(c[1:]) < 0)
    zero = float(d[cross[0]] - c[cross[0]] * (d[cross[0] + 1] - d[cross[0]]) / (c[cross[0] + 1] - c[cross[0]])) if len(cross) else None
    return {"c0": float(c0), "a": float(a), "misfit": float(np.sqrt(np.mean((c0 * shape(d) - c) ** 2))), "half": falls_to(0.5), "efold": falls_to(1 / np.e), "zero": zero}


def fit_covariance(lags: list[float], cov: list[float], kind: str = "markov", rounds: int = 200) -> tuple[float, float, float]:
    """c0, a and root mean square misfit of a covariance model, by a search that halves its steps."""
    import numpy as np

    d, c = np.asarray(lags, float), np.asarray(cov, float)
    best, a, step = math.inf, max(d.mean(), 1e-9), max(d.mean(), 1e-9) / 2
    c0 = 0.0
    for _ in range(rounds):
        for trial in (a - step, a, a + step):
            if trial <= 0:
                continue
            shape = _model(kind, d, 1.0, trial)
            scale = float(shape @ c / (shape @ shape))
            miss = float(np.sqrt(np.mean((scale * shape - c) ** 2)))
            if miss < best - 1e-15:
                best, a, c0 = miss, trial, scale
                break
        else:
            step /= 2
    return c0, a, best
