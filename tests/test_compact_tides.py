"""Compact tide models: a generated file with two patches, read and merged."""

import struct

import numpy as np
import pytest

from firnline.operators import raster
from firnline.sources import readers

NX, NY, LAT, LON = 8, 6, (-60.0, 0.0), (0.0, 80.0)


def record(*parts):
    body = b"".join(parts)
    size = struct.pack(">i", len(body))
    return size + body + size


def ints(*v):
    return np.array(v, ">i4").tobytes()


def floats(*v):
    return np.array(v, ">f4").tobytes()


def coarse(c, i, j):
    return (0.0, 0.0) if (i, j) == (7, 5) else (1 + i + 0.5 * j + c, 2 - 0.25 * i + j - c)


@pytest.fixture(scope="module")
def model(tmp_path_factory, spark):
    names = ["m2", "s2"]
    out = record(ints(NX, NY, 2), floats(*LAT, *LON), b"m2  s2  ")
    for c in range(2):
        out += record(floats(*(x for j in range(NY) for i in range(NX) for x in coarse(c, i, j))))
    # 4 x 3 cells of a thirtieth of a degree; the second lies over a part of the first and has one constituent
    for name, lat, lon, size, wet, own in (("bay", (-30.0, -29.9), (20.0, 20.0 + 4 / 30), (4, 3), [(1, 1), (2, 1), (4, 3)], names), ("cape", (-30.0, -29.9), (20.0 + 1 / 30, 20.0 + 5 / 30), (4, 3), [(1, 1), (4, 2)], ["s2"])):
        out += record(ints(*size, len(own), len(wet)), floats(*lat, *lon), "".join(n.ljust(4) for n in own).encode(), name.ljust(20).encode())
        out += record(ints(*(i for i, _ in wet)), ints(*(j for _, j in wet)))
        for k, n in enumerate(own):
            out += record(floats(*(x for w in range(len(wet)) for x in (100 * (name == "cape") + 10 * (n == "s2") + w, -w))))
    path = tmp_path_factory.mktemp("tides") / "h.bin"
    path.write_bytes(out)
    return readers.compact_tide_elevations(spark, str(path)).cache()


def test_global_grid_and_patches_are_read(model):
    rows = model.collect()
    assert sorted({(r.patch, r.name) for r in rows}, key=str) == [(0, None), (1, "bay"), (2, "cape")]
    grid = {(r.constituent, r.i, r.j): r for r in rows if r.patch == 0}
    assert len(grid) == 2 * NX * NY and grid["m2", 7, 5].re is None
    assert (grid["s2", 3, 2].re, grid["s2", 3, 2].im) == pytest.approx(coarse(1, 3, 2)) and (grid["s2", 3, 2].lon, grid["s2", 3, 2].lat) == (35.0, -35.0)
    local = {(r.patch, r.constituent, r.i, r.j): (r.re, r.im) for r in rows if r.patch}
    assert local == {(1, "m2", 0, 0): (0, 0), (1, "m2", 1, 0): (1, -1), (1, "m2", 3, 2): (2, -2), (1, "s2", 0, 0): (10, 0), (1, "s2", 1, 0): (11, -1), (1, "s2", 3, 2): (12, -2), (2, "s2", 0, 0): (110, 0), (2, "s2", 3, 1): (111, -1)}


def test_patches_lie_over_the_interpolated_grid(model):
    got = {(r.constituent, r.i, r.j): r for r in raster.patched_tides(model, (19.9, 20.3), (-30.1, -29.8)).collect()}
    assert len(got) == 2 * 12 * 9 and {r.patch for r in got.values()} == {None, 1, 2}
    i, j = 600, 1800  # the cell with its corner at 20 E, 30 S
    assert (got["m2", i, j].re, got["m2", i + 1, j].re, got["m2", i + 3, j + 2].re) == (0, 1, 2)
    assert (got["s2", i, j].re, got["s2", i + 1, j].re, got["s2", i + 4, j + 1].re) == (10, 110, 111)  # the later patch counts
    r = got["m2", i - 2, j - 1]
    fi, fj = (r.lon - 5) / 10, (r.lat + 55) / 10
    assert r.patch is None and (r.re, r.im) == pytest.approx((1 + fi + 0.5 * fj, 2 - 0.25 * fi + fj), abs=1e-5)
    corner = raster.patched_tides(model, (72.0, 73.0), (-8.0, -7.0)).collect()
    assert corner and {r.re for r in corner} == {None}  # next to a cell without a tide


def test_whole_records_only(spark, tmp_path):
    (tmp_path / "bad.bin").write_bytes(record(ints(1, 1, 0), floats(0, 1, 0, 1)) + b"\0\0\0\x09zz")
    with pytest.raises(Exception, match="no record at byte"):
        readers.compact_tide_elevations(spark, str(tmp_path / "bad.bin")).collect()
