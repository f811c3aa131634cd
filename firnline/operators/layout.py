"""How tables are laid out: unions, splits, tiles with overlap, mosaics, global numbering.

A point may lie in several tiles; tiles are closed boxes with a buffer. Numbering and splitting never
bring a whole table into one task: rows are range-partitioned, partitions counted, and places added up.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once into the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="firnline-"))
    return df.checkpoint()


#: Rows of a task where `spread` deals them.
ROWS = 200_000


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """`df` dealt by the columns `by` to as many tasks as give each about `ROWS` rows, for windows and groups that follow.

    The number of tasks grows with the table, so what one of them sorts or gathers does not. Rows are counted first:
    for tables as they were read, which is cheap.
    """
    n = max(-(-df.count() // ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with its place (from 1) in the given total order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(placed.select("*", F.spark_partition_id().alias("\x01part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("\x01at")))
    counts = placed.groupBy("\x01part").agg(F.count("*").alias("\x01n"))
    before = counts.select("\x01part", (F.sum("\x01n").over(Window.orderBy("\x01part")) - F.col("\x01n")).alias("\x01before"))
    return placed.join(F.broadcast(before), "\x01part").select(*df.columns, (F.col("\x01before") + F.col("\x01at") + 1).alias(name))


def median_of_all(df: DataFrame, value: str) -> float | None:
    """The exact median of a whole column, from places in ranges of values; the driver gets one number."""
    values = ranked(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), [F.col("v")], "place")
    n = values.count()
    return values.where(F.col("place").between((n + 1) // 2, n // 2 + 1)).agg(F.avg("v")).first()[0] if n else None


def union_by_name(tables: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """All rows of all tables, numbers as doubles; the columns of the first table, or those named."""
    names = names or tables[0].columns
    out = None
    for t in tables:
        part = t.select(*[F.col(n).cast("double").alias(n) if dict(t.dtypes)[n] in ("int", "bigint", "float", "smallint", "double") else F.col(n) for n in names])
        out = part if out is None else out.unionByName(part)
    return out


def split(df: DataFrame, parts: int, order: list[Column], name: str = "part") -> DataFrame:
    """Contiguous near-equal parts 1 .. n; the first parts get the rows that are over."""
    placed = cut(ranked(df, order, "\x01place"))
    n = placed.count()
    size, over = divmod(n, parts)
    at = F.col("\x01place") - 1
    edge = over * (size + 1)
    part = F.when(at < edge, F.floor(at / (size + 1))).otherwise(over + F.floor((at - edge) / max(1, size))) + 1
    return placed.withColumn(name, part.cast("int")).drop("\x01place")


def tile_edges(lo: float, hi: float, width: float) -> list[float]:
    """Edges of about `width` apart that divide lo .. hi evenly."""
    n = max(1, int(abs(hi - lo) / width))
    return [lo + k * (hi - lo) / n for k in range(n + 1)]


def tile(df: DataFrame, xlim: tuple[float, float], ylim: tuple[float, float], width: float, buffer: float = 0.0, x: str = "x", y: str = "y", closed: bool = True) -> DataFrame:
    """One row for each tile a point lies in: columns tile_x, tile_y.

    Closed tiles with buffer share the points of their edges; with `closed` False, and no buffer, each
    point has one tile.
    """
    out = df
    for name, c, (lo, hi) in (("tile_x", x, xlim), ("tile_y", y, ylim)):
        n = len(tile_edges(lo, hi, width)) - 1
        step = (hi - lo) / n
        if closed:
            first = F.greatest(F.lit(0), F.ceil((F.col(c) - buffer - lo) / step).cast("int") - 1)
            last = F.least(F.lit(n - 1), F.floor((F.col(c) + buffer - lo) / step).cast("int"))
            out = out.withColumn("\x01tiles", F.when(first <= last, F.sequence(first, last))).withColumn(name, F.explode("\x01tiles")).drop("\x01tiles")
        else:
            at = F.floor((F.col(c) - lo) / step).cast("int")
            out = out.where((F.col(c) >= lo) & (F.col(c) <= hi)).withColumn(name, F.least(F.lit(n - 1), at))
    return out


def crop(df: DataFrame, xmin: Column, xmax: Column, ymin: Column, ymax: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside their own tile's box."""
    return df.where((F.col(x) >= xmin) & (F.col(x) <= xmax) & (F.col(y) >= ymin) & (F.col(y) <= ymax))


def mosaic(tiles: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """One value for each cell from overlapping sub-grids: that of the last tile in order which has one."""
    return tiles.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max_by(value, order).alias(value))


def align_epochs(df: DataFrame, cell: list[str], t: str, mission: str, value: str, missions: list) -> DataFrame:
    """One row for each epoch of a cell with a column for each mission."""
    return df.groupBy(*cell, t).pivot(mission, missions).agg(F.first(value))


def best_of(df: DataFrame, key: str, measure: Column, node: str, values: list[str], smallest: bool = True, last_node_wins: bool = False) -> DataFrame:
    """For each key the values of its best solution; of equals the first node's, or the last's."""
    tie = -F.col(node) if last_node_wins else F.col(node)
    rank = F.struct(measure if smallest else -measure, tie)
    return df.groupBy(key).agg(F.min_by(F.struct(node, *values), rank).alias("\x01best")).select(key, "\x01best.*")
