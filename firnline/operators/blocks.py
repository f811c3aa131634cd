"""Fits around many nodes at once: square blocks of nodes and points, stacked least squares.

Nodes and the points near them meet in blocks of many search radii; a point also goes to the blocks
whose halo it lies in, so that one shuffle brings a node all points that it or its relocated centre can
reach. A task reads its blocks one after another, finds the neighbours of all nodes of a block by sorted
cells, and solves the nodes' systems as stacks of equal size, padded with rows of zeros. Memory is that
of one block with its halo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in one stack of design matrices.
STACK = 2_000_000
#: Side of a block in search radii.
BLOCK = 24
#: Rows of one batch of small groups' results.
GATHERED = 10_000


def runs(batches: Iterator, keys: int) -> Iterator:
    """Consecutive rows with equal values in the first `keys` columns, as lists of record batches."""
    import numpy as np

    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in range(keys):
            codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            change |= np.diff(codes) != 0
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            value = tuple(batch.column(k)[lo].as_py() for k in range(keys))
            if held and value != now:
                yield held
                held = []
            now = value
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def by_runs(df: DataFrame, keys: list[str], columns: list[str], order: list[str], work: Callable, schema: str) -> DataFrame:
    """`work(key, arrays)` for each value of `keys`: arrays of `columns`, in the given order, null as None or NaN.

    A partition's groups are read one after another from sorted Arrow batches, without a frame for each
    group. `work` gives a tuple of columns of `schema`, or None. Memory is one group's.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        waiting, n = [], 0
        for parts in runs(batches, len(keys)):
            t = pa.Table.from_batches(parts)
            found = work(tuple(parts[0].column(k)[0].as_py() for k in range(len(keys))), [t.column(len(keys) + k).to_numpy() for k in range(len(columns))])
            if found is None:
                continue
            waiting.append(pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(found, arrow)], schema=arrow))
            n += waiting[-1].num_rows
            if n >= GATHERED:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, n = [], 0
        if n:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    return rows.mapInArrow(run, schema)


def mapped(nodes: DataFrame, points: DataFrame, node: str, columns: list[str], block: float, halo: float, work: Callable, schema: str, pid: str | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """`work(block)` for every block with nodes, as one DataFrame.

    `block` is a dict of numpy arrays: `nodes` (x, y), `points` (x, y and `columns` as doubles, null as NaN), and
    pyarrow arrays `node` and `pid`, in the order of the arrays. Nodes stand in the order of their ids; columns of theirs
    named in `own` follow their places. `work` gives record batches. Rows without a place are left out.
    """
    placed = lambda df: df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    ids = (nodes.schema[node].dataType, points.schema[pid].dataType if pid else nodes.schema[node].dataType)
    cell = lambda c, by: F.floor((F.col(c) + by) / block)
    wide = range(max(len(columns), len(own)))
    doubles = lambda names: [(F.col(names[k]) if k < len(names) else F.lit(None)).cast("double").alias(f"v{k}") for k in wide]
    a = placed(nodes.select(F.col(node).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *doubles(own)))
    a = a.select(cell("x", 0).alias("bx"), cell("y", 0).alias("by"), F.lit(0).alias("kind"), "id", F.lit(None).cast(ids[1]).alias("pid"), "x", "y", *[f"v{k}" for k in wide])
    values: list[Column] = doubles(columns)
    b = placed(points.select((F.col(pid) if pid else F.lit(None).cast(ids[1])).alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *values))
    b = b.withColumn("bx", F.explode(F.sequence(cell("x", -halo), cell("x", halo)))).withColumn("by", F.explode(F.sequence(cell("y", -halo), cell("y", halo))))
    b = b.select("bx", "by", F.lit(1).alias("kind"), F.lit(None).cast(ids[0]).alias("id"), "pid", "x", "y", *[f"v{k}" for k in wide])
    rows = a.unionByName(b).repartition("bx", "by").sortWithinPartitions("bx", "by", "kind", "id")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def done(parts: list) -> Iterator:
            t = pa.Table.from_batches(parts).combine_chunks()
            split = int(np.searchsorted(t["kind"].to_numpy(), 1))
            if not split:
                return
            get = lambda name, rows: rows[name].to_numpy(zero_copy_only=False).astype(float)
            n, p = t.slice(0, split), t.slice(split)
            yield from work({"nodes": (get("x", n), get("y", n), *(get(f"v{k}", n) for k in range(len(own)))), "points": [get("x", p), get("y", p), *(get(f"v{k}", p) for k in range(len(columns)))], "node": n["id"].combine_chunks(), "pid": p["pid"].combine_chunks()})

        for parts in runs(batches, 2):
            yield from done(parts)

    return rows.mapInArrow(run, schema)


def within(nx, ny, px, py, r: float):
    """Pairs (node, point) at most `r` apart (closed), by node: two arrays of places."""
    import numpy as np

    if not len(px) or not len(nx):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = r if r > 0 else 1.0
    cx, cy = np.floor(px / size).astype(np.int64), np.floor(py / size).astype(np.int64)
    low, wide = min(cy.min(), np.floor(ny.min() / size)) - 2, max(cy.max(), np.floor(ny.max() / size)) + 3
    span = int(wide - low)
    key = cx * span + (cy - int(low))
    order = np.argsort(key, kind="stable")
    key = key[order]
    qx, qy = np.floor(nx / size).astype(np.int64), np.floor(ny / size).astype(np.int64) - int(low)
    starts = np.stack([np.searchsorted(key, (qx + d) * span + qy - 1, "left") for d in (-1, 0, 1)], 1)
    ends = np.stack([np.searchsorted(key, (qx + d) * span + qy + 1, "right") for d in (-1, 0, 1)], 1)
    n = (ends - starts).ravel()
    node = np.repeat(np.repeat(np.arange(len(nx)), 3), n)
    point = order[np.repeat(starts.ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())]
    dx, dy = nx[node] - px[point], ny[node] - py[point]
    near = dx * dx + dy * dy <= r * r
    return node[near], point[near]


def medians(group, value, n: int):
    """Median of the values of each group 0 .. n-1, NaN without any."""
    import numpy as np

    order = np.lexsort((value, group))
    count = np.bincount(group, minlength=n)
    start = np.cumsum(count) - count
    v = np.append(value[order], np.nan)
    mid = lambda k: v[np.where(count > 0, start + k, len(v) - 1)]
    return (mid((count - 1) // 2) + mid(count // 2)) / 2


def neighbours(nx, ny, px, py, t, r: float, relocations: int = 0, months: int | None = None):
    """(node, point, x, y): pairs within r of the nodes' centres, and the centres.

    Each relocation moves the centre to the median of its points, unless that is more than r from where the
    node began; with `months`, a node whose points stand in so many calendar months moves no more.
    """
    import numpy as np

    node, point = within(nx, ny, px, py, r)
    x, y, moving = nx.copy(), ny.copy(), np.ones(len(nx), bool)
    for _ in range(relocations):
        count = np.bincount(node, minlength=len(nx))
        if months is not None:
            month = np.floor(t[point] * 12).astype(np.int64)
            once = np.unique(np.stack([node, month], 1), axis=0)
            moving &= np.bincount(once[:, 0], minlength=len(nx)) < months
        mx, my = medians(node, px[point], len(nx)), medians(node, py[point], len(nx))
        moving &= (count >= 2) & (np.hypot(mx - nx, my - ny) <= r)
        if not moving.any():
            break
        x, y = np.where(moving, mx, x), np.where(moving, my, y)
        at = np.flatnonzero(moving)
        new = within(x[at], y[at], px, py, r)
        keep = ~moving[node]
        node, point = np.concatenate([node[keep], at[new[0]]]), np.concatenate([point[keep], new[1]])
        order = np.argsort(node, kind="stable")
        node, point = node[order], point[order]
    return node, point, x, y


def stacks(count, columns: int) -> Iterator:
    """Places of groups of like size, the product of padded rows and columns at most STACK where a group allows it."""
    import numpy as np

    order = np.argsort(count, kind="stable")
    k = 0
    while k < len(order):
        most = max(int(1.5 * count[order[k]]), int(count[order[k]]) + 8)
        end = int(np.searchsorted(count[order], most, "right"))
        end = max(k + 1, min(end, k + STACK // (columns * most)))
        yield order[k:end]
        k = end


def masked_mad(value, good):
    """1.4826 times the median distance from the median of the good values of each row."""
    import numpy as np

    n = good.sum(axis=1)

    def median(v):
        s = np.sort(np.where(good, v, np.inf), axis=1)
        pick = lambda k: np.take_along_axis(s, np.maximum(k, 0)[:, None], axis=1)[:, 0]
        return np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, np.nan)

    return 1.4826 * median(np.abs(value - median(value)[:, None]))


def lstsq(design, value, good, root=None, n_iter: int = 5, n_sigma: float | None = None, limit: float | None = None):
    """Stacked least squares of smallest norm with editing, as `fits.lstsq` does for one system.

    `design` is (systems, rows, columns), `good` says which rows count and `root` multiplies rows. Returns
    coefficients, standard errors and the rows used.
    """
    import numpy as np

    good = good & np.isfinite(value) & np.isfinite(design).all(axis=2)
    design, value = np.where(good[..., None], design, 0.0), np.where(good, value, 0.0)
    root = np.ones_like(value) if root is None else np.where(good, root, 0.0)
    k = design.shape[2]
    small = np.finfo(float).eps

    def triangle(at, ok):
        scaled = design[at] * (root[at] * ok)[..., None]
        q, r = np.linalg.qr(scaled)
        return q, np.linalg.pinv(r, rcond=small * np.maximum(ok.sum(axis=1), k))

    coef = np.full((len(value), k), np.nan)
    active = np.flatnonzero(good.any(axis=1))
    for _ in range(n_iter if n_sigma is not None else 1):
        if not len(active):
            break
        ok = good[active]
        q, inverse = triangle(active, ok)
        coef[active] = np.einsum("bij,bkj,bk->bi", inverse, q, value[active] * root[active] * ok, optimize=True)
        if n_sigma is None:
            break
        resid = value[active] - np.einsum("bnk,bk->bn", design[active], coef[active])
        std = masked_mad(resid, ok)
        far = np.abs(resid) > n_sigma * std[:, None]
        bad = ok & (far if limit is None else far | (np.abs(resid) > limit))
        again = bad.any(axis=1) & (std != 0)
        active, bad = active[again], bad[again]
        good[active] &= ~bad
        active = active[good[active].any(axis=1)]
    error = np.full((len(value), k), np.nan)
    at = np.flatnonzero(good.any(axis=1))
    if len(at):
        ok = good[at]
        _, inverse = triangle(at, ok)
        resid = np.where(ok, (value[at] - np.einsum("bnk,bk->bn", design[at], coef[at])) * root[at], 0.0)
        n = ok.sum(axis=1)
        mean = resid.sum(axis=1) / n
        var = (np.where(ok, resid - mean[:, None], 0.0) ** 2).sum(axis=1) / n
        error[at] = np.sqrt(np.maximum(np.einsum("bij,bij->bi", inverse, inverse) * var[:, None], 0))
    return coef, error, good


def padded(start, count, most: int):
    """(places, there): a row of places into flat arrays for each group, and which of them are its own."""
    import numpy as np

    k = np.arange(most)
    there = k < count[:, None]
    return np.where(there, start[:, None] + k, 0), there
