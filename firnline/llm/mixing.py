"""Mixing sources to target weights by weighted fair queueing (operator 6), in DataFrame functions only.

Every document stands in its source's queue once for each pass, in an order shuffled by hash. It
leaves the queue at its virtual finish time: the source's words up to and including it, divided by
the source's target. All queues merged by finish time are the mix; it ends where the words reach
the total budget, which is when each source has given about its target.

Running sums over a source never stand in one task: a source's queue is cut into ranges of the hash,
the ranges are summed, and only a range's own rows are summed one by one. The merged order is cut
into ranges of finish time in the same way, and only the range in which the budget ends is looked at
row by row.

Edge cases: a null text has no words; a null source is a source, last in order; documents without
words are never taken; repeated rows have equal places and are taken alike; no documents give an
empty result. Rerunning gives the same mix, whatever the partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, shuffle_parts, text_of

#: Sources up to this many go to all executors in their join; beyond, the join shuffles.
BROADCAST_SOURCES = 50_000


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with a column `name`: 0, 1, ... in the given order, without one task that sees all rows.

    The driver gets one count for each partition.
    """
    placed = df.repartitionByRange(shuffle_parts(df), *order).sortWithinPartitions(*order)
    placed = cut(placed.select("*", F.spark_partition_id().alias("\x01part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("\x01at")))
    start, before = [], 0
    for part, n in sorted(placed.groupBy("\x01part").count().collect()):
        start += [F.lit(part), F.lit(before)]
        before += n
    offset = F.element_at(F.create_map(*start), F.col("\x01part")) if start else F.lit(0)
    return placed.select(*df.columns, (offset + F.col("\x01at")).alias(name))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """`sources` (source, source_size) with rank and target.

    Weights repeat in the order of the sources; the targets add up to `share` of all sizes, none is above
    `most` times its source's size, and what a stopped source leaves goes to the others by weight.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut(numbered(sources, [F.col("source").asc_nulls_last()], "rank").withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int"))))
    cap = most * F.col("source_size")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = share * (total or 0) / (weight or 1.0), -1
    while True:
        at_cap = cap <= F.col("weight") * level
        n, used, left = ranked.agg(F.count_if(at_cap), F.sum(F.when(at_cap, cap)), F.sum(F.when(~at_cap, F.col("weight")))).first()
        if n == stopped or not left:
            break
        stopped, level = n, (share * total - (used or 0)) / left
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level)).drop("weight")


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2, seed: int = 17, range_rows: int = 50_000, source_rows: int = 4_000) -> DataFrame:
    """One row for each row of `docs`: id_col, size, source_size, target, times, taken, finish.

    times: how often the mix takes the document; taken: its words in the mix; finish: virtual finish
    time of each pass. `size` defaults to the words of the column `text`. Ranges of a source hold about
    `source_rows` documents, ranges of finish time about `range_rows`.
    """
    size = F.regexp_count(text_of("text"), F.lit(WORD)) if size is None else size
    thin = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size")))
    sources = cut(targets(thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, share, most))
    n, budget = thin.count(), share * (thin.agg(F.sum("size")).first()[0] or 0)
    known = sources.withColumnRenamed("source", "\x01source")
    known = F.broadcast(known) if sources.count() <= BROADCAST_SOURCES else known
    rows = thin.join(known, F.col("source").eqNullSafe(F.col("\x01source"))).select("id", "size", "rank", "docs", "source_size", "target")
    passes = math.ceil(most)
    for p in range(passes):
        key = F.xxhash64(F.lit(seed + p), "id")
        # the upper half of the hash, as 0 .. 2^32 - 1, falls into equal ranges
        part = F.floor((F.shiftright(key, 32) + (1 << 31)) * F.ceil(F.col("docs") / source_rows) / (1 << 32))
        rows = cut(rows.withColumns({f"key{p}": key, f"part{p}": part}))
        sums = rows.groupBy("rank", f"part{p}").agg(F.sum("size").alias("all"))
        sums = sums.withColumn("before", F.sum("all").over(Window.partitionBy("rank").orderBy(f"part{p}")) - F.col("all")).drop("all")
        within = Window.partitionBy("rank", f"part{p}").orderBy(f"key{p}", "id").rangeBetween(Window.unboundedPreceding, 0)
        upto = F.col("before") + F.sum("size").over(within) + p * F.col("source_size")
        rows = rows.join(sums, ["rank", f"part{p}"]).withColumn(f"finish{p}", F.when((F.col("size") > 0) & (F.col("target") > 0), upto / F.col("target"))).drop("before", f"part{p}")
    rows = cut(rows)
    place = [F.struct(F.col(f"finish{p}").alias("finish"), F.lit(p).alias("pass"), "rank", F.col(f"key{p}").alias("key"), "id") for p in range(passes)]
    width = 1 / max(1, math.ceil(n * passes / range_rows))
    queue = rows.select("size", F.explode(F.array(*place)).alias("at")).where("at.finish is not null").withColumn("range", F.floor(F.col("at.finish") / width))
    ends = queue.groupBy("range").agg(F.sum("size").alias("all")).withColumn("upto", F.sum("all").over(Window.orderBy("range")))
    over = ends.where(F.col("upto") > budget).orderBy("range").select("range", F.col("upto") - F.col("all")).first()
    if over is None:
        taken = [F.col(f"finish{p}").isNotNull() for p in range(passes)]
    else:
        last = queue.where(F.col("range") == over[0]).withColumn("upto", F.sum("size").over(Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        last = last.where(F.col("upto") + over[1] <= budget).agg(F.max("at").alias("at")).first()["at"]
        if last is None:
            taken = [F.floor(F.col(f"finish{p}") / width) < over[0] for p in range(passes)]
        else:
            end = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["pass"]).alias("pass"), F.lit(last["rank"]).alias("rank"), F.lit(last["key"]).alias("key"), F.lit(last["id"]).cast(thin.schema["id"].dataType).alias("id"))
            taken = [F.col(f"finish{p}").isNotNull() & (place[p] <= end) for p in range(passes)]
    times = sum((F.coalesce(t, F.lit(False)).cast("int") for t in taken[1:]), F.coalesce(taken[0], F.lit(False)).cast("int"))
    finish = F.array(*[F.col(f"finish{p}") for p in range(passes)])
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"), finish.alias("finish"))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken, with all their columns.

    Rows that repeat an id are taken alike.
    """
    taken = plan(docs, id_col, **options).where("times > 0").groupBy(F.col(id_col).alias("\x01id")).agg(F.max("times").alias("\x01times"))
    rows = docs.join(taken, F.col(id_col).eqNullSafe(F.col("\x01id")))
    return rows.withColumn("\x01times", F.explode(F.array_repeat(F.lit(0), F.col("\x01times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
