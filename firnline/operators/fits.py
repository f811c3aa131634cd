"""Grouped model fits: least squares with outlier rejection, robust lines, surfaces, series filters.

Closed forms stay in SQL aggregates. Fits that iterate run in numpy inside grouped tasks; a group is a
node's or a cell's points, whose number the radius or the cell bounds.
Groups with fewer values than a fit needs have no row in the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .blocks import GATHERED, runs


def quadratic(df: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """Trend of the line, and quadratic coefficient of the parabola, fitted to each centred series."""
    q = df.where(F.col(value).isNotNull() & F.col(t).isNotNull()).withColumn("\x01t", F.col(t) - F.avg(t).over(Window.partitionBy(*by)))
    x = F.col("\x01t")
    s = q.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(x**k).alias(f"s{k}") for k in (2, 3, 4)], *[F.sum(x**k * F.col(value)).alias(f"y{k}") for k in (0, 1, 2)])
    c = F.col
    quad = F.try_divide(c("n") * c("s2") * c("y2") - c("s2") * c("s2") * c("y0") - c("n") * c("s3") * c("y1"), c("n") * c("s2") * c("s4") - c("s2") * c("s2") * c("s2") - c("n") * c("s3") * c("s3"))
    return s.select(*by, F.try_divide("y1", "s2").alias("trend"), quad.alias("quad"))


def plane_trend(df: DataFrame, by: list[str], x: str, y: str, value: str) -> DataFrame:
    """value = c + a x + b y for each group, by normal equations: columns a, b, c, n. Groups may be of any size: tasks hold centred moments only."""
    s = df.dropna(subset=[x, y, value]).groupBy(*by).agg(F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.var_pop(y).alias("yy"), F.covar_pop(x, value).alias("xv"), F.covar_pop(y, value).alias("yv"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(value).alias("mv"), F.count("*").alias("n"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumns({"a": F.try_divide(F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy"), det), "b": F.try_divide(F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy"), det)})
    return s.select(*by, "a", "b", (F.col("mv") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"), "n")


# FIT-1
def lstsq(design, value, n_iter: int = 5, n_sigma: float | None = None, weight=None, limit: float | None = None):
    """Least squares of smallest norm, again without outliers until there are none.

    Returns coefficients, their standard errors, and which rows were used. `weight` multiplies squared
    residuals. Outliers are farther than n MADs, or than `limit`, from the fit.
    """
    import numpy as np

    good = np.isfinite(value) & np.isfinite(design).all(axis=1)
    root = np.sqrt(weight) if weight is not None else np.ones(len(value))
    coef = np.full(design.shape[1], np.nan)
    for _ in range(n_iter if n_sigma is not None else 1):
        if good.sum() < 1:
            break
        coef = np.linalg.lstsq(design[good] * root[good, None], value[good] * root[good], rcond=None)[0]
        if n_sigma is None:
            break
        resid = value - design @ coef
        std = mad(resid[good])
        bad = good & ((np.abs(resid) > n_sigma * std) if limit is None else (np.abs(resid) > n_sigma * std) | (np.abs(resid) > limit))
        if not bad.any() or std == 0:
            break
        good &= ~bad
    used = design[good] * root[good, None]
    resid = (value[good] - design[good] @ coef) * root[good]
    cov = np.linalg.pinv(used.T @ used) * (resid.var() if len(resid) else np.nan)
    return coef, np.sqrt(np.maximum(np.diag(cov), 0)), good


def mad(x) -> float:
    import numpy as np

    x = x[np.isfinite(x)]
    return float(1.4826 * np.median(np.abs(x - np.median(x)))) if len(x) else float("nan")


# FIT-2
def surface_design(t, x, y, trend: int = 1, surface: int = 2, season: bool = False, extra=None):
    """Columns 1, t .. t^trend, surface terms up to order 1 or 2, cosine and sine of a year, extra ones."""
    import numpy as np

    cols = [np.ones(len(t))]
    factor = 1.0
    for k in range(1, trend + 1):
        factor *= k
        cols.append(t**k / factor)
    if surface >= 1:
        cols += [x, y]
    if surface >= 2:
        cols += [x * y, x * x, y * y]
    if season:
        cols += [np.cos(2 * np.pi * t), np.sin(2 * np.pi * t)]
    for c in extra or []:
        cols.append(c)
    return np.column_stack(cols)


# FIT-4
def huber(design, value, rounds: int = 50, k: float = 1.345):
    """Robust regression by reweighting: residuals beyond k scales count less."""
    import numpy as np

    coef = np.linalg.lstsq(design, value, rcond=None)[0]
    for _ in range(rounds):
        resid = value - design @ coef
        scale = np.median(np.abs(resid)) / 0.6745
        if scale <= 0:
            break
        w = np.minimum(1.0, k * scale / np.maximum(np.abs(resid), 1e-300))
        root = np.sqrt(w)
        new = np.linalg.lstsq(design * root[:, None], value * root, rcond=None)[0]
        if np.allclose(new, coef, rtol=1e-8, atol=1e-10):
            return new
        coef = new
    return coef


def by_group(df: DataFrame, key: str, fit: Callable, schema: str) -> DataFrame:
    """`fit(key value, pandas of the group)` gives a list of row tuples. Memory is one group's."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(k, pdf):
        import pandas as pd

        return pd.DataFrame(fit(k[0], pdf), columns=names)

    return df.groupBy(key).applyInPandas(run, schema)


def robust_line(df: DataFrame, key: str, t: str, value: str, key_type: str = "long", order: list[str] = ()) -> DataFrame:
    """(key, slope, level, n): Huber line of each group, level at the mean time."""

    def fit(k, g):
        import numpy as np

        g = g.dropna(subset=[t, value]).sort_values([t, value])
        if len(g) < 3:
            return []
        x = g[t].to_numpy(float)
        c = huber(np.column_stack([np.ones(len(g)), x - x.mean()]), g[value].to_numpy(float))
        return [(k, c[1], c[0], len(g))]

    return by_group(df.select(key, t, value), key, fit, f"{key} {key_type}, slope double, level double, n long")


# FIT-3
@dataclass(frozen=True)
class SurfaceModel:
    """What `elevation_change` fits: a surface of order `surface`, a trend of order `trend`, a year's cycle, `params`
    (centred on their medians) and a step for each of `missions` (values of the column `mission`; one that has the node
    for itself gets no step). Observations weigh 1 / `sigma` squared, less by distance and time over the two scales.
    """

    surface: int = 1
    trend: int = 2
    season: bool = True
    params: tuple[str, ...] = ()
    mission: str | None = None
    missions: tuple[float, ...] = ()
    sigma: str | None = None
    space_scale: float | None = None
    time_scale: float | None = None

    def columns(self) -> list[str]:
        return [*self.params, *([self.mission] if self.mission else []), *([self.sigma] if self.sigma else [])]

    def design(self, t, x, y, values, there):
        """Stack of design matrices and root weights; x and y in search radii from the centre."""
        import warnings

        import numpy as np

        values = list(values)
        cols, factor = [np.ones_like(t)], 1.0
        for k in range(1, self.trend + 1):
            factor *= k
            cols.append(t**k / factor)
        if self.season:
            cols += [np.cos(2 * np.pi * t), np.sin(2 * np.pi * t)]
        self_time = len(cols)
        if self.surface >= 1:
            cols += [x, y]
        if self.surface >= 2:
            cols += [x * y, x * x, y * y]
        for _ in self.params:
            v = np.where(there, values.pop(0), np.nan)
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)
                cols.append(v - np.nanmedian(v, axis=1)[:, None])
        if self.mission:
            m = values.pop(0)
            first = np.take_along_axis(m, there.argmax(axis=1)[:, None], axis=1)
            several = (there & (m != first)).any(axis=1)[:, None]
            cols += [((m == k) & several).astype(float) for k in self.missions]
        weight = 1.0 / values.pop(0) ** 2 if self.sigma else np.ones_like(t)
        return np.stack(cols, axis=2), self_time, weight


def _surface_fits(nodes, points, node, t, h, r, model, edit, keep, schema, block):
    """`keep(solved)` of every stack of nodes; see `elevation_change` for what is fitted."""
    least, min_span, n_sigma, max_rate, t_ref, relocations, months, limit = edit

    def work(b):
        import numpy as np

        nx, ny = b["nodes"]
        px, py, pt, ph, *pv = b["points"]
        ok = np.isfinite(pt) & np.isfinite(ph) & np.isfinite(np.stack([px, *pv])).all(axis=0)
        place = np.flatnonzero(ok)
        px, py, pt, ph, pv = px[ok], py[ok], pt[ok], ph[ok], [v[ok] for v in pv]
        at, point, cx, cy = blocks.neighbours(nx, ny, px, py, pt, r, relocations, months)
        count = np.bincount(at, minlength=len(nx))
        start = np.cumsum(count) - count
        enough = np.flatnonzero(count >= max(least, 1))
        k = 1 + model.trend + 2 * model.season + (0, 2, 5)[model.surface] + len(model.params) + len(model.missions)
        for some in blocks.stacks(count[enough], k):
            i = enough[some]
            where, there = blocks.padded(start[i], count[i], int(count[i].max()))
            p = point[where]
            tt = pt[p]
            low, high = np.where(there, tt, np.inf).min(axis=1), np.where(there, tt, -np.inf).max(axis=1)
            ref = np.where(there, tt, 0.0).sum(axis=1) / count[i] if t_ref is None else np.full(len(i), float(t_ref))
            dx, dy, dt = px[p] - cx[i][:, None], py[p] - cy[i][:, None], tt - ref[:, None]
            a, n_time, weight = model.design(dt, dx / max(r, 1e-12), dy / max(r, 1e-12), [v[p] for v in pv], there)
            dist = np.hypot(dx, dy)
            if model.space_scale:
                weight = weight * np.exp(-dist / model.space_scale)
            if model.time_scale:
                weight = weight * np.exp(-np.abs(dt) / model.time_scale)
            value = ph[p]
            c, e, good = blocks.lstsq(a, value, there, np.sqrt(weight), 5, n_sigma, limit)
            fine = (high - low >= min_span) & ~(np.abs(c[:, 1]) > max_rate) & np.isfinite(c[:, 0])
            if t_ref is not None and model.trend:
                fine &= (low <= t_ref) & (high >= t_ref)
            if not fine.any():
                continue
            solved = {"i": i, "p": place[p], "there": there, "t": tt, "dt": dt, "dist": dist, "a": a, "c": c, "e": e, "good": good, "resid": value - np.einsum("bnk,bk->bn", a, c), "value": value, "weight": weight, "n_time": n_time, "x": cx[i], "y": cy[i], "span": high - low, "ref": ref}
            yield from keep({name: v[fine] if name != "n_time" else v for name, v in solved.items()}, b)

    halo = r * (2 if relocations else 1)
    return blocks.mapped(nodes, points, node, [t, h, *model.columns()], block or blocks.BLOCK * r, halo, work, schema)


def elevation_change(nodes: DataFrame, points: DataFrame, node: str, t: str, h: str, r: float, least: int = 25, min_span: float = 0.0, n_sigma: float | None = 3.5, max_rate: float = 15.0, surface: int = 1, season: bool = True, t_ref: float | None = None, *, model: SurfaceModel | None = None, relocations: int = 0, months: int | None = None, limit: float | None = None, block: float | None = None) -> DataFrame:
    """Per node: place, height, rate, acceleration and their errors, the year's amplitude and phase, misfit and more.

    A surface with trend and season (or `model`) is fitted to the points within r of the node, or of the median
    of its points after `relocations` (see `blocks.neighbours`). Points beyond `n_sigma` MADs or `limit` leave
    the fit. Nodes with too few points, too short a span, too large a rate, or all points on one side of a
    given `t_ref` have no row. Amplitude is that of the cosine and sine terms. `offsets` are the steps of
    `model.missions`. Points with a missing value take no part. The points within `block` (a multiple of r) of
    each other meet in one task.
    """
    model = model or SurfaceModel(surface=surface, season=season)
    kind = nodes.schema[node].dataType.simpleString()
    names = ["x", "y", "p0", "p1", "p2", "p0_error", "p1_error", "p2_error", "amplitude", "phase", "rmse", "dmin", "tspan"]

    def keep(s, b):
        import numpy as np
        import pyarrow as pa

        c, e = s["c"], s["e"]
        zero = np.zeros(len(c))
        term = lambda v, k: v[:, k] if model.trend >= k else zero
        cos, sin = (c[:, s["n_time"] - 2], c[:, s["n_time"] - 1]) if model.season else (zero, zero)
        rmse = blocks.masked_mad(s["resid"], s["good"])
        dmin = np.where(s["there"], s["dist"], np.inf).min(axis=1)
        out = [s["x"], s["y"], c[:, 0], term(c, 1), term(c, 2), e[:, 0], term(e, 1), term(e, 2), np.hypot(cos, sin), np.degrees(np.arctan2(cos, sin)) % 360, rmse, dmin, s["span"]]
        steps = c[:, c.shape[1] - len(model.missions) :] if model.missions else np.zeros((len(c), 0))
        yield pa.record_batch([b["node"].take(pa.array(s["i"])), *map(pa.array, out), pa.array(s["good"].sum(axis=1)), pa.array(steps.tolist(), pa.list_(pa.float64()))], names=["node", *names, "nobs", "offsets"])

    schema = f"node {kind}, {', '.join(f'{c} double' for c in names)}, nobs long, offsets array<double>"
    return _surface_fits(nodes, points, node, t, h, r, model, (least, min_span, n_sigma, max_rate, t_ref, relocations, months, limit), keep, schema, block)


def elevation_series(nodes: DataFrame, points: DataFrame, node: str, t: str, h: str, r: float, t0: float, step: float, window: float, n_bins: int, least: int = 25, min_span: float = 0.0, n_sigma: float | None = 3.5, max_rate: float = 15.0, t_ref: float | None = None, *, model: SurfaceModel | None = None, relocations: int = 0, months: int | None = None, limit: float | None = None, block: float | None = None) -> DataFrame:
    """(node, k, time, height, variance, n): the height change of each node of `elevation_change` in time bins.

    A point's height change is its residual with the trend and season of the fit put back; residuals beyond
    `n_sigma` MADs are left out. Bin k is centred on t0 + (k + 1/2) step and `window` wide, its edges
    closed; its height is the weighted mean after an edit by 3.5 MADs, as in `bins.resampled`. Empty bins have no row.
    """
    model = model or SurfaceModel()
    kind = nodes.schema[node].dataType.simpleString()

    def keep(s, b):
        import numpy as np
        import pyarrow as pa

        inside = s["there"] & (np.abs(s["resid"]) <= (n_sigma or np.inf) * blocks.masked_mad(s["resid"], s["there"])[:, None])
        time_part = np.einsum("bnk,bk->bn", s["a"][:, :, 1 : s["n_time"]], s["c"][:, 1 : s["n_time"]])
        row, col = np.nonzero(inside)
        tt, hh, w = s["t"][row, col], (s["resid"] + time_part)[row, col], s["weight"][row, col]
        first = np.floor((tt - window / 2 - t0) / step - 0.5).astype(np.int64) - 1
        reach = int(np.ceil(window / step)) + 4
        k = (first[:, None] + np.arange(reach)).ravel()
        row, tt, hh, w = (np.repeat(v, reach) for v in (row, tt, hh, w))
        centre = t0 + (k + 0.5) * step
        ok = (k >= 0) & (k < n_bins) & (tt >= centre - window / 2) & (tt <= centre + window / 2)
        row, k, hh, w = row[ok], k[ok], hh[ok], w[ok]
        cells, group = np.unique(row * n_bins + k, return_inverse=True)
        mid = blocks.medians(group, hh, len(cells))
        spread = 1.4826 * blocks.medians(group, np.abs(hh - mid[group]), len(cells))
        ok = np.abs(hh - mid[group]) <= 3.5 * spread[group]
        group, hh, w = group[ok], hh[ok], w[ok]
        total = np.bincount(group, w, len(cells))
        n = np.bincount(group, minlength=len(cells))
        some = n > 0
        mean = np.bincount(group, w * hh, len(cells))[some] / total[some]
        full = np.zeros(len(cells))
        full[some] = mean
        var = np.bincount(group, w * (hh - full[group]) ** 2, len(cells))[some] / total[some]
        at, kk = cells[some] // n_bins, cells[some] % n_bins
        yield pa.record_batch([b["node"].take(pa.array(s["i"][at])), pa.array(kk), pa.array(t0 + (kk + 0.5) * step), pa.array(mean), pa.array(var), pa.array(n[some])], names=["node", "k", "time", "height", "variance", "n"])

    schema = f"node {kind}, k long, time double, height double, variance double, n long"
    return _surface_fits(nodes, points, node, t, h, r, model, (least, min_span, n_sigma, max_rate, t_ref, relocations, months, limit), keep, schema, block)


# FIT-5
def topography_residuals(nodes: DataFrame, points: DataFrame, node: str, pid: str, t: str, h: str, r: float, least: int = 20, quad_from: int = 50, n_sigma: float | None = 3.5, *, t_ref: float | None = None, min_span: float = 0.0, relocations: int = 0, months: int | None = None, mission: str | None = None, scale: float | None = None, limit: float | None = None, block: float | None = None) -> DataFrame:
    """Per point: residual of its best node's surface (smallest misfit, of equals the first node).

    A surface with a trend about `t_ref` (the mean time of the node's points without one) is fitted around each
    node; of second order from more than `quad_from` points on. `mission` is a column that shifts heights
    linearly, `scale` weighs points by 1 / (1 + (distance / scale)^2), `limit` drops residuals and nodes beyond it.
    Columns pid, res (height less all terms but the trend), mod, err, order, t_ref, slope_x, slope_y, node.
    Points that no node's fit keeps have no row.
    """
    kinds = points.schema[pid].dataType.simpleString(), nodes.schema[node].dataType.simpleString()

    def work(b):
        import numpy as np
        import pyarrow as pa

        nx, ny = b["nodes"]
        px, py, pt, ph, *pv = b["points"]
        ok = np.isfinite(np.stack([px, pt, ph, *pv])).all(axis=0) & b["pid"].is_valid().to_numpy(zero_copy_only=False)
        place = np.flatnonzero(ok)
        px, py, pt, ph, pv = px[ok], py[ok], pt[ok], ph[ok], [v[ok] for v in pv]
        at, point, cx, cy = blocks.neighbours(nx, ny, px, py, pt, r, relocations, months)
        count = np.bincount(at, minlength=len(nx))
        start = np.cumsum(count) - count
        found = []
        for order in (1, 2):
            enough = np.flatnonzero((count >= max(least, 1)) & ((count > quad_from) == (order == 2)))
            for some in blocks.stacks(count[enough], 7 + bool(mission)):
                i = enough[some]
                where, there = blocks.padded(start[i], count[i], int(count[i].max()))
                p = point[where]
                tt = pt[p]
                low, high = np.where(there, tt, np.inf).min(axis=1), np.where(there, tt, -np.inf).max(axis=1)
                ref = np.where(there, tt, 0.0).sum(axis=1) / count[i] if t_ref is None else np.full(len(i), float(t_ref))
                dx, dy = px[p] - cx[i][:, None], py[p] - cy[i][:, None]
                x, y, one = dx / r, dy / r, np.ones_like(tt)
                cols = [one, tt - ref[:, None], x, y, *([x * y, x * x, y * y] if order == 2 else []), *(v[p] for v in pv)]
                a = np.stack(cols, axis=2)
                root = None if scale is None else np.sqrt(1 / (1 + (dx * dx + dy * dy) / scale**2))
                c, _, good = blocks.lstsq(a, ph[p], there, root, 5, n_sigma)
                fit = np.einsum("bnk,bk->bn", a, c)
                mod = fit - a[:, :, 1] * c[:, 1:2]
                err = blocks.masked_mad(ph[p] - fit, good)
                fine = high - low >= min_span
                if t_ref is not None:
                    fine &= (low < t_ref) & (high > t_ref)
                if limit is not None:
                    good = good & (np.abs(ph[p] - fit) <= limit)
                    fine &= err <= limit
                row, col = np.nonzero(good & fine[:, None])
                found.append((p[row, col], i[row], (ph[p] - mod)[row, col], mod[row, col], err[row], np.full(len(row), order), ref[row], c[row, 2] / r, c[row, 3] / r))
        if not found:
            return
        point, i, res, mod, err, order, ref, sx, sy = (np.concatenate(v) for v in zip(*found))
        sort = np.lexsort((i, err, point))
        best = sort[np.flatnonzero(np.diff(point[sort], prepend=-1))]
        out = [b["pid"].take(pa.array(place[point[best]])), *(pa.array(v[best]) for v in (res, mod, err)), pa.array(order[best].astype(np.int32)), *(pa.array(v[best]) for v in (ref, sx, sy)), b["node"].take(pa.array(i[best]))]
        yield pa.record_batch(out, names=["pid", "res", "mod", "err", "order", "t_ref", "slope_x", "slope_y", "node"])

    schema = f"pid {kinds[0]}, res double, mod double, err double, order int, t_ref double, slope_x double, slope_y double, node {kinds[1]}"
    columns = [t, h, *([mission] if mission else [])]
    solutions = blocks.mapped(nodes, points, node, columns, block or blocks.BLOCK * r, r * (2 if relocations else 1), work, schema, pid)
    best = solutions.groupBy("pid").agg(F.min_by(F.struct("res", "mod", "err", "order", "t_ref", "slope_x", "slope_y", "node"), F.struct("err", "node")).alias("b"))
    return best.select("pid", "b.*")


# FIT-6, FIT-7
def scattering_correction(df: DataFrame, cell: str, pid: str, t: str, h: str, params: list[str], least: int = 50, n_sigma: float = 3.5, worst: float = 0.05) -> DataFrame:
    """Per point: the height change explained by waveform parameters in its cell, 0 where that is no help.

    Centred, normalised parameters are regressed on detrended heights; a fit that makes the spread larger
    by more than `worst` is not used. Columns pid, h_bs, r2, d_std and the coefficients b_<param>. Points
    with a missing height or parameter take no part in the fit and have a NULL h_bs. A task reads its cells one
    after another from sorted Arrow batches; memory is one cell's.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    def fit(values):
        """h_bs, r2, d_std and coefficients of a cell from its columns t, h and params in order of time."""
        import numpy as np

        ok = ~np.isnan(values).any(axis=0)
        n = int(ok.sum())
        found = np.where(ok, 0.0, np.nan)
        if n < least:
            return found, 0.0, 0.0, np.zeros(len(params))
        tt, hh, *vv = values[:, ok]
        line = np.column_stack([np.ones(n), tt - tt.mean()])
        flat = hh - line @ np.linalg.lstsq(line, hh, rcond=None)[0]
        w = []
        for v in vv:
            v = v - v.mean()
            w.append(v / (mad(v) or 1.0))
        a = np.column_stack(w)
        c, _, good = lstsq(a, flat, 5, n_sigma)
        cor = a @ c
        before, after = mad(flat), mad(flat - cor)
        if not np.isfinite(cor).all() or after > before * (1 + worst):
            c, cor, after = c * 0, cor * 0, before
        total = ((flat[good] - flat[good].mean()) ** 2).sum()
        found[ok] = cor
        return found, 1 - ((flat[good] - cor[good]) ** 2).sum() / total if total > 0 else 0.0, after - before, c

    kind = df.schema[pid].dataType.simpleString()
    schema = f"{pid} {kind}, h_bs double, r2 double, d_std double, " + ", ".join(f"b_{p} double" for p in params)
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        waiting, n = [], 0
        for parts in runs(batches, 1):
            rows = pa.Table.from_batches(parts).combine_chunks()
            h_bs, *one = fit(np.array([rows.column(2 + k).to_numpy() for k in range(2 + len(params))]))
            same = [np.full(rows.num_rows, v) for v in (one[0], one[1], *one[2])]
            waiting.append(pa.record_batch([rows.column(1).combine_chunks(), *(pa.array(v, from_pandas=True) for v in (h_bs, *same))], schema=arrow))
            n += rows.num_rows
            if n >= GATHERED:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, n = [], 0
        if n:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    numbers = [F.col(c).cast("double").alias(f"\x01{k}") for k, c in enumerate([t, h, *params])]
    rows = df.select(F.col(cell).alias("\x01cell"), F.col(pid).alias("\x01pid"), *numbers)
    return rows.repartition("\x01cell").sortWithinPartitions("\x01cell", "\x010", "\x01pid").mapInArrow(run, schema)


# FIT-8, FIT-9
def cross_calibrate(df: DataFrame, cell: str, t: str, mission: str, value: str) -> DataFrame:
    """Per cell and mission: the offset that a common trend, season and one dummy a mission leave.

    Offsets are relative to the mission with the earliest sample.
    """

    def fit(k, g):
        import numpy as np

        g = g.dropna().sort_values([t, mission])
        names = list(dict.fromkeys(g[mission]))
        if len(g) < 5 + len(names):
            return []
        tt = g[t].to_numpy(float)
        tt = tt - tt.mean()
        dummies = [(g[mission] == m).to_numpy(float) for m in names[1:]]
        c = huber(surface_design(tt, tt, tt, trend=2, surface=0, season=True, extra=dummies), g[value].to_numpy(float))
        return [(k, m, o) for m, o in zip(names, [0.0, *c[len(c) - len(dummies) :]])]

    kinds = df.schema[cell].dataType.simpleString(), df.schema[mission].dataType.simpleString()
    return by_group(df.select(cell, t, mission, value), cell, fit, f"{cell} {kinds[0]}, {mission} {kinds[1]}, offset double")


def fused(df: DataFrame, cell: str, t: str, mission: str, value: str, name: str = "fused") -> DataFrame:
    """`df` with the values of all missions on one level: less the offset of their mission in their cell.

    NULL where a cell has too few values for offsets, or the value is missing.
    """
    offsets = cross_calibrate(df, cell, t, mission, value).select(F.col(cell).alias("\x01c"), F.col(mission).alias("\x01m"), F.col("offset").alias("\x01o"))
    q = df.join(offsets, F.col(cell).eqNullSafe(F.col("\x01c")) & F.col(mission).eqNullSafe(F.col("\x01m")), "left")
    return q.withColumn(name, F.col(value) - F.col("\x01o")).drop("\x01c", "\x01m", "\x01o")


# OUT-5, OUT-6
def sigma_filter(df: DataFrame, key: str, pid: str, t: str, value: str, order: int = 1, rounds: int = 3, n_sigma: float = 3.0, window: float = 0.25, by_bins: bool = False) -> DataFrame:
    """(pid, value): NULL where a value is beyond n MADs of a polynomial fitted to binned medians, or of
    the binned medians themselves; repeated, each time on what is left."""

    def fit(k, g):
        import numpy as np

        g = g.sort_values([t, pid])
        x, y = g[t].to_numpy(float), g[value].to_numpy(float).copy()
        for _ in range(rounds):
            ok = np.isfinite(y)
            if ok.sum() < 10:
                break
            centres = np.arange(x[ok].min(), x[ok].max() + window, window)
            bins = np.digitize(x[ok], centres)
            med = [(x[ok][bins == b].mean(), np.median(y[ok][bins == b])) for b in np.unique(bins)]
            bx, by = np.array(med).T
            model = np.interp(x, bx, by) if by_bins or len(bx) <= order else np.polyval(np.polyfit(bx - x.mean(), by, order), x - x.mean())
            resid = y - model
            bad = np.abs(resid) > n_sigma * mad(resid)
            if not bad.any():
                break
            y[bad] = np.nan
        return [(p, None if np.isnan(v) else float(v)) for p, v in zip(g[pid], y)]

    kind = df.schema[pid].dataType.simpleString()
    return by_group(df.select(key, pid, t, value), key, fit, f"{pid} {kind}, {value} double")


# OUT-9
def block_fit_filter(df: DataFrame, cell: str, pid: str, x: str, y: str, value: str, n_sigma: float = 3.0, limit: float | None = None, rounds: int = 3) -> DataFrame:
    """(pid, value): NULL where a value is an outlier of its cell's bi-quadratic surface.

    Cells are read in order and solved as stacks of like size; memory is that of some cells, at least one.
    """
    kinds = df.schema[cell].dataType.simpleString(), df.schema[pid].dataType.simpleString()
    rows = df.select(F.col(cell).alias("cell"), F.col(pid).alias("pid"), *[F.col(c).cast("double").alias(c) for c in (x, y, value)])
    rows = rows.repartition("cell").sortWithinPartitions("cell", "pid")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def solved(parts, sizes):
            t = pa.Table.from_batches(parts).combine_chunks()
            xx, yy, v = (t.column(k).to_numpy().astype(float) for k in (2, 3, 4))
            count = np.array(sizes)
            start = np.cumsum(count) - count
            ok = np.isfinite(v)
            keep = ok.copy()
            for i in blocks.stacks(count, 9):
                where, there = blocks.padded(start[i], count[i], int(count[i].max()))
                good = there & ok[where]
                centred = [np.where(there, c[where], np.nan) for c in (xx, yy)]
                fit = good.sum(axis=1) >= 10
                if not fit.any():
                    continue
                where, there, good, centred = where[fit], there[fit], good[fit], [c[fit] for c in centred]
                for k, c in enumerate(centred):
                    placed = np.isfinite(c)
                    c = c - (np.where(placed, c, 0.0).sum(axis=1) / np.maximum(placed.sum(axis=1), 1))[:, None]
                    far = np.where(placed, np.abs(c), 0.0).max(axis=1)
                    centred[k] = c / np.where(far > 0, far, 1.0)[:, None]
                p, q = centred
                design = np.stack([np.ones_like(p), p, q, p * q, p**2, q**2, p**2 * q, p * q**2, p**2 * q**2], axis=2)
                _, _, good = blocks.lstsq(design, v[where], good, None, rounds, n_sigma, limit)
                keep[where[there]] = good[there]
            return pa.record_batch([t.column(1).combine_chunks(), pa.array(np.where(keep, v, np.nan), from_pandas=True)], names=[pid, value])

        held, sizes = [], []
        for parts in blocks.runs(batches, 1):
            held += parts
            sizes.append(sum(b.num_rows for b in parts))
            if sum(sizes[-100:]) >= blocks.GATHERED or len(sizes) >= blocks.GATHERED:
                yield solved(held, sizes)
                held, sizes = [], []
        if sizes:
            yield solved(held, sizes)

    return rows.mapInArrow(run, f"{pid} {kinds[1]}, {value} double")


# OUT-11
def space_time_filter(nodes: DataFrame, points: DataFrame, node: str, pid: str, t: str, h: str, r: float, half_cell: float, least: int = 50, n_sigma: float = 3.0, window: float = 0.25, block: float | None = None) -> DataFrame:
    """(pid, ok): whether a point agrees with the detrended binned medians around the node whose cell holds it."""
    kind = points.schema[pid].dataType.simpleString()

    def work(b):
        import numpy as np
        import pyarrow as pa

        nx, ny = b["nodes"]
        px, py, pt, ph = b["points"]
        fine = np.isfinite(pt) & np.isfinite(ph) & b["pid"].is_valid().to_numpy(zero_copy_only=False)
        place = np.flatnonzero(fine)
        px, py, pt, ph = px[fine], py[fine], pt[fine], ph[fine]
        at, point = blocks.within(nx, ny, px, py, r)
        count = np.bincount(at, minlength=len(nx))
        enough = count[at] >= max(least, 1)
        at, point = at[enough], point[enough]
        if not len(at):
            return
        x, y = pt[point], ph[point]
        # bins of a node in order of time, their mean times and median values, as one flat list of knots
        start = np.full(len(nx), np.inf)
        np.minimum.at(start, at, x)
        step = np.floor((x - start[at]) / window).astype(np.int64)
        wide = int(step.max()) + 1
        knots, knot = np.unique(at * wide + step, return_inverse=True)
        kt = np.bincount(knot, x, len(knots)) / np.bincount(knot, minlength=len(knots))
        kv = blocks.medians(knot, y, len(knots))
        owner = knots // wide
        first, last = np.searchsorted(owner, at, "left"), np.searchsorted(owner, at, "right") - 1
        low = np.clip(knot - (x < kt[knot]), first, last)
        high = np.minimum(low + 1, last)
        gap = kt[high] - kt[low]
        share = np.clip(np.where(gap > 0, (x - kt[low]) / np.where(gap > 0, gap, 1.0), 0.0), 0.0, 1.0)
        resid = y - (kv[low] + (kv[high] - kv[low]) * share)
        off = np.abs(resid - blocks.medians(at, resid, len(nx))[at])
        ok = off < n_sigma * 1.4826 * blocks.medians(at, off, len(nx))[at]
        # half-open to the micrometre: a point on an edge has one cell
        dx, dy = np.round(px[point] - nx[at] + half_cell, 6), np.round(py[point] - ny[at] + half_cell, 6)
        side = round(2 * half_cell, 6)
        own = (dx >= 0) & (dx < side) & (dy >= 0) & (dy < side)
        yield pa.record_batch([b["pid"].take(pa.array(place[point[own]])), pa.array(ok[own])], names=["pid", "ok"])

    return blocks.mapped(nodes, points, node, [t, h], block or blocks.BLOCK * r, r, work, f"pid {kind}, ok boolean", pid)


# OUT-19, OUT-20
def series_filter(df: DataFrame, cell: str, k: str, value: str, window: int = 5, n_sigma: float = 5.0) -> DataFrame:
    """(cell, k, value): outliers of a smooth trend replaced by interpolation, runs of one value left out of
    the statistics; what was missing stays missing."""
    from .alongtrack import savgol_weights

    def fit(c, g):
        import numpy as np

        g = g.sort_values(k)
        at, y = g[k].to_numpy(float), g[value].to_numpy(float)
        ok = np.isfinite(y)
        if ok.sum() < window + 2:
            return [(c, int(a), None if np.isnan(v) else float(v)) for a, v in zip(g[k], y)]
        same = np.zeros(len(y), bool)
        same[1:] = y[1:] == y[:-1]
        use = ok & ~same
        gross = use & (np.abs(y - np.median(y[use])) > n_sigma * mad(y[use]))
        use &= ~gross
        filled = np.interp(at, at[use], y[use])
        padded = np.concatenate([[filled[0]] * (window // 2), filled, [filled[-1]] * (window // 2)])
        smooth = np.convolve(padded, savgol_weights(window, 1)[::-1], "valid")
        resid = filled - smooth
        far = np.abs(resid - np.median(resid[use])) > n_sigma * mad(resid[use])
        keep = use & ~far
        out = np.where(ok & ~same & ~keep, np.interp(at, at[keep], y[keep]) if keep.any() else y, y)
        return [(c, int(a), None if not o else float(v)) for a, v, o in zip(g[k], out, ok)]

    kinds = df.schema[cell].dataType.simpleString(), "long"
    return by_group(df.select(cell, k, value), cell, fit, f"{cell} {kinds[0]}, {k} {kinds[1]}, {value} double")
