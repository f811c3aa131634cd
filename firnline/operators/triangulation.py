"""Linear interpolation of scattered points on their Delaunay triangles, without one triangulation of the table.

The triangle of a place is the face under it of the lower hull of the points lifted to (x, y, x^2 + y^2): the combination of
three points around the place with the least lifted height. It is found by pivots as in linear programming, for all
nodes of a block at once: one point enters, one leaves, until no point lies in the triangle's circumcircle. A block
sees the points of its halo, so a triangle counts only if its circumcircle lies inside what the block has seen; the other
nodes go on with twice the halo. The result depends neither on blocks nor on halos: where four or more points lie on
one circle, a tiny height made from each point's own coordinates decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .layout import cut

#: Numbers in one table of nodes by points.
TABLE = 2_000_000
#: Pivots of one search; some twenty are usual.
PIVOTS = 400


def _own_height(x, y):
    """A number from 0 to 1 made from each place."""
    import numpy as np

    h = (x + 0.0).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (y + 0.0).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


def _weights(corner, place):
    """Barycentric coordinates of `place` (n, 2) in the triangles `corner` (n, 3, 2)."""
    import numpy as np

    a, b = corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0]
    p = place - corner[:, 0]
    det = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        u = (p[:, 0] * b[:, 1] - p[:, 1] * b[:, 0]) / det
        v = (a[:, 0] * p[:, 1] - a[:, 1] * p[:, 0]) / det
    return np.stack([1 - u - v, u, v], axis=1)


def _slopes(corner, height):
    """Plane through the lifted corners: value at the first, slope along x and y."""
    import numpy as np

    a, b = corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0]
    ha, hb = height[:, 1] - height[:, 0], height[:, 2] - height[:, 0]
    det = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    gx, gy = (ha * b[:, 1] - hb * a[:, 1]) / det, (hb * a[:, 0] - ha * b[:, 0]) / det
    return height[:, 0] - gx * corner[:, 0, 0] - gy * corner[:, 0, 1], gx, gy


def triangles(q, p, height):
    """Places in p of the corners of the Delaunay triangle of each q; -1 in a row if q is outside the hull of p.

    Coordinates are about 1 in size; `height` are the lifted heights. Three corners far outside, of which as little as possible
    may remain, begin.
    """
    import numpy as np

    far = np.array([(-10.0, -10.0), (25.0, -10.0), (-10.0, 25.0)])
    points = np.concatenate([p, far])
    n = len(p)
    heights = np.concatenate([height, np.zeros(3)])
    art = np.concatenate([np.zeros(n), np.ones(3)])
    corner = np.tile(np.arange(n, n + 3), (len(q), 1))
    out = np.full((len(q), 3), -1)
    open_ = np.arange(len(q)) if n else np.zeros(0, np.int64)
    for _ in range(PIVOTS):
        if not len(open_):
            break
        c = corner[open_]
        xy = points[c]
        outside = (c >= n).any(axis=1)
        level, gx, gy = _slopes(xy, np.where(outside[:, None], art[c], heights[c]))
        enter, best = np.empty(len(open_), np.int64), np.empty(len(open_))
        step = max(1, TABLE // max(n, 1))
        for s in range(0, len(open_), step):
            k = slice(s, s + step)
            own = np.where(outside[k, None], 0.0, height[None, :])
            cost = own - level[k, None] - gx[k, None] * p[None, :, 0] - gy[k, None] * p[None, :, 1]
            np.put_along_axis(cost, np.where(c[k] < n, c[k], 0), np.where(c[k] < n, np.inf, np.take_along_axis(cost, np.where(c[k] < n, c[k], 0), axis=1)), axis=1)
            enter[k] = cost.argmin(axis=1)
            best[k] = cost[np.arange(cost.shape[0]), enter[k]]
        tolerance = 1e-14 * (1 + np.abs(gx) + np.abs(gy))
        done = best >= -tolerance
        inside = done & ~outside
        out[open_[inside]] = c[inside]
        open_, c, xy, enter = open_[~done], c[~done], xy[~done], enter[~done]
        if not len(open_):
            break
        share, into = np.maximum(_weights(xy, q[open_]), 0.0), _weights(xy, points[enter])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(into > 1e-14, share / into, np.inf)
        leave = ratio.argmin(axis=1)
        corner[open_, leave] = enter
    return out


def circles(corner):
    """Centres and radii of the circles through the corners (n, 3, 2)."""
    import numpy as np

    a, b = corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0]
    d = 2 * (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
    sa, sb = (a**2).sum(axis=1), (b**2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = (sa * b[:, 1] - sb * a[:, 1]) / d, (sb * a[:, 0] - sa * b[:, 0]) / d
    return corner[:, 0, 0] + ux, corner[:, 0, 1] + uy, np.hypot(ux, uy)


# INT-9
def linear(nodes: DataFrame, points: DataFrame, key: str, z: str, block: float, halo: float | None = None, reach: float | None = None) -> DataFrame:
    """(key, z): linear interpolation at each node on the Delaunay triangle of `points` that holds it; NULL outside their hull.

    Points at one place count once, with their mean; those without a place or a value don't. `halo` is what
    the first round sees around blocks of side `block` (a tenth of it if None); it doubles in each round for the nodes
    that have not settled. Near the hull circumcircles are wide, and outside it a block must see all points; with
    `reach`, triangles whose circumcircle has a larger radius count as none, and nothing farther than twice that is looked at.
    Nodes without a place have a NULL. `key` tells nodes apart.
    """
    have = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(z).isNotNull() & ~F.isnan(z) & ~F.isnan("x") & ~F.isnan("y"))
    places = cut(have.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.avg(z).alias("z")))
    west, east, south, north, n = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    kind = nodes.schema[key].dataType.simpleString()
    if not n:
        return nodes.select(key, F.lit(None).cast("double").alias("z"))
    spacing2 = max((east - west) * (north - south) / n, 1e-300)
    centre = ((west + east) / 2, (south + north) / 2)

    def work_of(halo: float):
        def work(b):
            import numpy as np
            import pyarrow as pa

            nx, ny = b["nodes"]
            px, py, pz = b["points"]
            lo = np.array([np.floor(nx[0] / block), np.floor(ny[0] / block)]) * block - halo
            hi = lo + block + 2 * halo
            mid, scale = (lo + hi) / 2, (hi - lo).max() / 2
            p = np.stack([(px - mid[0]) / scale, (py - mid[1]) / scale], axis=1)
            q = np.stack([(nx - mid[0]) / scale, (ny - mid[1]) / scale], axis=1)
            to = np.stack([centre[0] - nx, centre[1] - ny], axis=1) / scale
            moved = q + 1e-9 * (to + 0.1 * np.stack([-to[:, 1], to[:, 0]], axis=1))  # off edges, and inside where a node is on the hull
            height = (p**2).sum(axis=1) + 1e-7 * spacing2 / scale**2 * _own_height(px, py)
            found = triangles(moved, p, height)
            some = found[:, 0] >= 0
            value, settled = np.full(len(nx), np.nan), np.zeros(len(nx), bool)
            corner = np.stack([px[found[some]], py[found[some]]], axis=2)
            x, y, radius = circles(corner)
            known = (x - radius >= lo[0]) & (y - radius >= lo[1]) & (x + radius < hi[0]) & (y + radius < hi[1])
            share = _weights(corner, np.stack([nx[some], ny[some]], axis=1))
            value[some] = (share * pz[found[some]]).sum(axis=1)
            settled[some] = known
            if reach is not None:
                value[np.flatnonzero(some)[radius > reach]] = np.nan
            if (lo <= [west, south]).all() and (hi > [east, north]).all() or (reach is not None and halo >= 2 * reach):
                settled[:] = True  # a circle of at most `reach` around a node lies in twice that
            yield pa.record_batch([b["node"], pa.array(value, from_pandas=True), pa.array(settled)], names=["node", "z", "settled"])

        return work

    open_, out, halo = cut(nodes.select(key, "x", "y")), None, halo or block / 10
    while True:
        found = cut(blocks.mapped(open_, places, key, ["z"], block, halo, work_of(halo), f"node {kind}, z double, settled boolean"))
        done = found.where("settled").select(F.col("node").alias("\x01n"), "z")
        out = done if out is None else out.unionByName(done)
        left = found.where("not settled").select(F.col("node").alias("\x01n"))
        if left.isEmpty():
            break
        open_ = cut(open_.join(left, F.col(key) == F.col("\x01n"), "left_semi"))
        halo *= 2
    return nodes.select(key).join(out, F.col(key) == F.col("\x01n"), "left").select(key, "z")
