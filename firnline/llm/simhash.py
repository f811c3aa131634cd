"""SimHash near-duplicates by tiled exact comparison (operator 8).

A document's fingerprint takes each bit that more than half of its shingles' hashes have. Documents
whose fingerprints differ in `radius` bits at most are linked. Equal fingerprints are one node; the
different ones are compared exactly, in tiles of a numpy matrix: exclusive-or, bit counts, and no
comparison of tiles whose population counts differ by more than the radius.

Which fingerprints share a tile: 64 bits are cut into m blocks, and two fingerprints within the
radius agree on at least m - radius whole blocks. For each choice of so many blocks, those with equal
bits there meet. m grows with the number of fingerprints, so that about a thousand meet at random;
any m finds the same links. Where more than `tile_rows` meet, they are dealt out by population count
and a hash, and each pair of parts within the radius is a tile of its own.

Edge cases: null and empty texts have no words, hence fingerprint zero, and are linked like any
other; a null id never becomes a component's id unless all ids of the component are null; repeated
rows each get their row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed
from .graph import components

BITS = 64
#: Fingerprints with at least this part of all rows (1 / HEAVY) are joined by broadcast.
HEAVY = 1000
#: Tiles that are dealt out are sent to all executors up to this many; beyond, they are joined by shuffle.
BROADCAST_TILES = 500_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()  # bytes split at space and 9 to 13


def shingle_hashes(words: list[bytes], size: int, block: int = 1 << 15):
    """Arrays of the hashes of all shingles, `block` at a time; fewer than `size` words are one shingle."""
    import numpy as np
    import xxhash

    whole, n, digest = b" ".join(words), max(1, len(words) - size + 1), xxhash.xxh64_intdigest
    if n == 1:
        if words:
            yield np.array([digest(whole, 42)], np.uint64)
        return
    starts, at = [0], 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    for k in range(0, n, block):
        yield np.array([digest(whole[i : j - 1], 42) for i, j in zip(starts[k : min(n, k + block)], starts[k + size :])], np.uint64)


def bits_of(h):
    """How many of the hashes have each bit."""
    import numpy as np

    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def print_of(counts, n: int) -> int:
    """The fingerprint of `n` hashes: the bits that over half of them have."""
    import numpy as np

    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = 3, block: int = 1 << 15) -> int:
    """SimHash of a text's word shingles of `size` words, as an unsigned integer."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= size:
        return int(next(shingle_hashes(words, size))[0])
    return print_of(sum(map(bits_of, shingle_hashes(words, size, block))), len(words) - size + 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id_col, print): the fingerprint as a signed long, for each row."""
    import pyarrow as pa

    source = docs.select(id_col, F.col(text_col).alias("\x01text"))
    schema = source.select(id_col).schema.add("print", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = np.array([fingerprint(x.as_py(), size) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def _masks(m: int, radius: int) -> list[int]:
    """As signed longs, the bits of each choice of m - radius blocks out of m."""
    edges = [round(k * BITS / m) for k in range(m + 1)]
    blocks = [sum(1 << i for i in range(edges[k], edges[k + 1])) for k in range(m)]
    masks = [sum(x) for x in combinations(blocks, m - radius)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in masks]


def forest(pdf, radius: int, alike=None, united=(), block: int = 256, others: int = 8):
    """Links (a, b) between the names of one task's rows: in each tile as few as hold its groups together.

    Rows of a tile agree in choice, bits and part. `united`: pairs of places in `pdf` that are linked already.
    Of the pairs that would join two groups, the one with the fewest different bits is taken. `alike(i, j)`
    says for places in `pdf`, all within the radius, how sure a link of two rows is: below 0 there is none,
    below 1 up to `others` more pairs of a row are taken as well, should this one fall short. Then the surest
    pairs are taken first.
    """
    import numpy as np
    import pandas as pd

    prints, name = pdf["print"].to_numpy().view(np.uint64), pdf["name"].to_numpy()
    pop = np.bitwise_count(prints).astype(np.int64)
    order = np.lexsort((pop, pdf["part"], pdf["bits"], pdf["choice"]))
    prints, pop, name = prints[order], pop[order], name[order]
    keys = np.stack([pdf[c].to_numpy()[order] for c in ("choice", "bits", "part")], axis=1)
    group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
    n, root = len(prints), np.arange(len(prints))
    for k, r in _joined([(a, b) for a, b in np.argsort(order)[np.array(list(united), int).reshape(-1, 2)].tolist()]).items():
        root[k] = r
    found: list = []
    for a in range(0, n, block):
        ea = min(a + block, n)
        for b in range(a, n, block):
            if group[b] > group[ea - 1] or skipped(group, pop, a, ea, b, radius):
                break
            eb = min(b + block, n)
            apart = np.bitwise_count(prints[a:ea, None] ^ prints[None, b:eb])
            near = apart <= radius
            near &= group[a:ea, None] == group[None, b:eb]
            near &= root[a:ea, None] != root[None, b:eb]
            i, j = np.nonzero(near)
            bits = apart[i, j]
            i, j = i + a, j + b
            if alike is not None and len(i):
                sure = alike(order[i], order[j])
                bits = -sure
                open_ = np.nonzero((sure >= 0) & (sure < 1))[0]
                by = open_[np.lexsort((bits[open_], i[open_]))]
                new = np.concatenate([[True], i[by][1:] != i[by][:-1]])[: len(by)]
                rank = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
                found.append((i[by[rank < others]], j[by[rank < others]]))
                i, j, bits = i[sure >= 0], j[sure >= 0], bits[sure >= 0]
            while (open_ := root[i] != root[j]).any():
                i, j, bits = i[open_], j[open_], bits[open_]
                high, low = np.maximum(root[i], root[j]), np.minimum(root[i], root[j])
                by = np.lexsort((j, i, bits, high))
                best = by[np.concatenate([[True], high[by][1:] != high[by][:-1]])]
                found.append((i[best], j[best]))
                to = np.arange(n)
                to[high[best]] = low[best]
                while (to[to] != to).any():
                    to = to[to]
                root = to[root]
    if not found:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    i, j = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"a": name[i], "b": name[j]}).drop_duplicates()


def _joined(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """For each number in the pairs the smallest one that they connect it with."""
    up: dict[int, int] = {}

    def top(k: int) -> int:
        while up.setdefault(k, k) != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {k: top(k) for k in up}


def skipped(group, pop, a: int, ea: int, b: int, radius: int) -> bool:
    """Whether blocks a:ea and b: of one tile, in order of population count, are too far apart to be compared."""
    return bool(group[b] == group[ea - 1] == group[a] and pop[b] - pop[ea - 1] > radius)


def tiled(keyed: DataFrame, radius: int, tile_rows: int, task_rows: int, n: int, by_count: bool = True) -> DataFrame:
    """`keyed` (print, choice, bits, ...; `n` rows) with a column `task`; rows that share a tile are in one task.

    A tile is what agrees in choice and bits. Larger ones than `tile_rows` are dealt to parts, and each pair of
    parts is a tile: parts by population count and a hash, paired up to the radius, or (for a radius that most
    counts lie within) by a hash alone.
    """
    tasks = max(1, math.ceil(n / task_rows))
    hot = cut(packed(keyed.groupBy("choice", "bits").count(), n).where(F.col("count") > tile_rows))
    tiles = keyed.withColumn("part", F.lit(0).cast("long"))
    if many := hot.count():
        known = keyed.join(F.broadcast(hot) if many <= BROADCAST_TILES else hot, ["choice", "bits"], "left")
        tiles = known.where("count is null").drop("count").withColumn("part", F.lit(0).cast("long"))
        pop = F.bit_count("print") if by_count else F.lit(0)
        parts = F.ceil(F.col("count") / tile_rows) if by_count else F.ceil(2 * F.col("count") / tile_rows)
        mine = pop * 65536 + F.pmod(F.xxhash64("name"), parts)
        counts = F.sequence(pop - radius, pop + radius) if by_count else F.array(pop)
        others = F.flatten(F.transform(counts, lambda p: F.transform(F.sequence(F.lit(0), parts - 1), lambda s: p * 65536 + s)))
        pair = F.transform(others, lambda o: F.xxhash64(F.least(o, mine), F.greatest(o, mine)))
        tiles = tiles.unionByName(known.where("count is not null").withColumn("part", F.explode(pair)).drop("count"))
    return tiles.withColumn("task", F.pmod(F.xxhash64("choice", "bits", "part"), F.lit(tasks)))


def links(prints: DataFrame, radius: int = 3, meet: int = 1024, tile_rows: int = 8192, task_rows: int = 200_000) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of different fingerprints within `radius` bits.

    `prints` has distinct longs in its column `print`. `meet`: rows that may agree on the blocks at
    random; `tile_rows`: rows that one task compares with each other; `task_rows`: rows in a task.
    """
    n = prints.count()
    m = radius + 1
    while m < 12 and n > meet * 2 ** (BITS * (m - radius) // m):
        m += 1
    masks = _masks(m, radius)
    pick: list[Column] = [F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(x)).alias("bits")) for k, x in enumerate(masks)]
    keyed = prints.select("print", F.explode(F.array(*pick)).alias("key")).select("print", F.col("print").alias("name"), "key.choice", "key.bits")
    return tiled(keyed, radius, tile_rows, task_rows, n * len(masks)).groupBy("task").applyInPandas(lambda pdf: forest(pdf, radius), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, size: int = 3) -> DataFrame:
    """(id_col, print, component_id) for each row; component_id is the smallest id that links reach."""
    signed = cut(fingerprints(docs, id_col, text_col, size))
    distinct = cut(signed.groupBy("print").agg(F.min(id_col).alias("first"), F.count("*").alias("copies")))
    roots = components(links(distinct.select("print"), radius)).withColumnRenamed("node", "print")
    linked = distinct.join(roots, "print")
    low = linked.groupBy("root").agg(F.min("first").alias("low"))
    named = distinct.join(linked.join(low, "root").select("print", "low"), "print", "left").select("print", "copies", F.coalesce("low", "first").alias("component_id"))
    # at most HEAVY prints can have this share of the rows: theirs are joined where they lie
    many = max(2, math.ceil(distinct.agg(F.sum("copies")).first()[0] / HEAVY)) if not distinct.isEmpty() else 2
    named = cut(named)
    frequent = F.broadcast(named.where(F.col("copies") >= many).select("print", F.struct("component_id").alias("known")))
    rows = signed.join(frequent, "print", "left")
    rare = rows.where("known is null").drop("known").join(named.where(F.col("copies") < many).select("print", "component_id"), "print")
    return rare.select(id_col, "print", "component_id").unionByName(rows.where("known is not null").select(id_col, "print", "known.component_id"))
