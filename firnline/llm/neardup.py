"""Near-duplicate documents at a wide radius: SimHash tiles, and exact likeness of what they link (operator 8).

Documents are near copies if their sets of five-word shingles have a Jaccard likeness of `similarity` or
more. Two such sets differ in about a seventh of their SimHash bits, too many to agree on whole blocks of
them. So tiles are formed by least hashes of the sets instead: texts meet that agree on both least hashes
of one of BANDS bands (at likeness 0.8 a pair misses all with a chance of 0.36^6 = 0.2 %). Inside a tile,
fingerprints are compared exactly as in `simhash`; a pair within RADIUS bits whose sketches look alike too
becomes a candidate, if it joins two groups of the tile. The candidates' shingle sets are then compared
in full. Where one falls short, the tiles that it stands in are settled at once: their rows come together with
their whole shingle sets, and every pair within RADIUS bits that would join two groups is compared. So there are two
rounds, and groups are those of all pairs that meet and are near copies (a tile without a short candidate has its
groups by then; a pair that sketches misjudge by more than MARGIN counts only in the second round).

Equal texts are one node, so a text that a third of all rows repeat makes no links.

Edge cases: words are separated by space and characters 9 to 13, A-Z lower-cased; a text of fewer words
than a shingle is one shingle; null, empty and blank texts are near copies of each other; a null id is
larger than all others; rows that repeat id and text are one document; texts whose 64-bit hashes collide
count as equal. Many different texts that all agree on a band are compared in pairs of parts, each of a
bounded size, in different tasks: exact, and quadratic in the number of such texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_TEXTS, cut, fresh, join_frequent, packed, text_of
from .graph import components
from .simhash import BITS, bits_of, forest, print_of, shingle_hashes, tiled, words_of

#: Least hashes of a band, and bands.
ROWS, BANDS = 2, 6
#: Different bits of candidates: at likeness 0.8 the mean is 9.7 of 64, the standard deviation 2.9.
RADIUS = 20
#: Least hashes in a sketch, one byte each; a likeness of 0.8 is read to within 0.035 (standard deviation).
SKETCH, MARGIN = 128, 0.1
#: Rows of a tile, and of a task, that are settled by their whole sets.
SETTLED_ROWS, SETTLED_TASK = 1024, 1024
#: Numbers of shingles that are compared with a text at once.
COMPARED = 200_000
#: Documents that go, and texts whose sets are compared, are sent to all executors up to so many; beyond, texts are shuffled.
BROADCAST_GONE, BROADCAST_NODES = 500_000, 1_000_000


def _factors():
    import numpy as np

    return np.random.default_rng(8).integers(1, 1 << 63, SKETCH, np.uint64) | np.uint64(1)


def _sketched(text: str | None, size: int, factors):
    """Fingerprint, band keys and sketch of a text."""
    import numpy as np

    counts, n, least = np.zeros(BITS, np.int64), 0, np.full(SKETCH, ~np.uint64(0), np.uint64)
    for h in shingle_hashes(words_of(text), size, 1 << 12):
        counts += bits_of(h)
        n += len(h)
        least = np.minimum(least, (h[:, None] * factors).min(axis=0))
    first = least[: ROWS * BANDS].reshape(BANDS, ROWS) * np.uint64(0x9E3779B97F4A7C15)
    keys = (first[:, 0] ^ (first[:, 1] >> np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)
    return print_of(counts, n) if n else 0, keys.view(np.int64), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, node, print, bands, sketch) for each row; node is a hash of the text."""
    import pyarrow as pa

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("node"), F.col(text_col).alias("text"))
    schema = source.select("id", "node").schema.add("print", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        factors = _factors()
        for batch in batches:
            prints, bands, sketch = zip(*[_sketched(x.as_py(), size, factors) for x in batch.column(2)]) if batch.num_rows else ((), (), ())
            cols = [batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(list(bands), pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "node", "print", "bands", "sketch"])

    from pyspark.sql.types import ArrayType, BinaryType, LongType

    return source.mapInArrow(run, schema.add("bands", ArrayType(LongType())).add("sketch", BinaryType()))


def _candidates(pdf, radius: int, similarity: float):
    """Candidates of one task's tiles: within the radius, sketches alike, joining two groups; the surest ones."""
    import numpy as np

    sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), SKETCH)

    def alike(i, j):
        out = np.zeros(len(i))
        for k in range(0, len(i), 8192):
            x, y = i[k : k + 8192], j[k : k + 8192]
            # 0 where it may just reach the similarity, 1 where it surely does
            out[k : k + 8192] = ((sketch[x] == sketch[y]).mean(axis=1) - similarity + MARGIN) / (2 * MARGIN)
        return out

    return forest(pdf, radius, alike, others=0)


def _settled(pdf, radius: int, similarity: float):
    """Near copies (a, b) that join the groups of each tile of one task, by whole sets; `root` are the groups known so far."""
    import numpy as np
    import pandas as pd

    out = []
    for _, tile in pdf.groupby(["choice", "bits", "part"], sort=False):
        tile = tile.drop_duplicates("name").sort_values("name")
        names, prints = tile["name"].to_numpy(), tile["print"].to_numpy().view(np.uint64)
        group = np.unique(tile["root"].to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(x, np.uint32) for x in tile["held"]]
        size = np.array([len(x) for x in sets])
        edges = np.concatenate([[0], np.cumsum(size)])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32) if edges[-1] else np.zeros(0, np.int32)
        mark = np.zeros(edges[-1] + 1, np.int8)
        for k in range(len(names) - 1):
            later = np.flatnonzero((group[k + 1 :] != group[k]) & (np.bitwise_count(prints[k + 1 :] ^ prints[k]) <= radius)) + k + 1
            # sizes that differ by more than the similarity allows share too little
            later = later[np.minimum(size[later], size[k]) >= similarity * np.maximum(size[later], size[k]) - 1e-9]
            if not len(later):
                continue
            mark[ids[edges[k] : edges[k + 1]]] = 1
            common = np.zeros(len(later), np.int64)
            parts = np.searchsorted(np.cumsum(size[later]), np.arange(0, size[later].sum() + 1, COMPARED))
            for a, b in zip([0, *(parts[1:] + 1)], [*(parts[1:] + 1), len(later)]):
                n = size[later[a:b]]
                at = np.repeat(edges[later[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                held = np.concatenate([[0], np.cumsum(mark[ids[at]], dtype=np.int64)])
                common[a:b] = np.diff(held[np.concatenate([[0], np.cumsum(n)])])
            mark[ids[edges[k] : edges[k + 1]]] = 0
            for j in later[common >= similarity * (size[later] + size[k] - common) - 1e-9].tolist():
                if group[j] != group[k]:
                    out.append((names[k], names[j]))
                    group[group == group[j]] = group[k]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def shingle_sets(asked: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, held): the 32-bit hashes of the shingles of each of the `asked` nodes, sorted; cut. `texts`: (node, text)."""
    import pyarrow as pa

    n = asked.count()
    asked = F.broadcast(asked) if n <= BROADCAST_NODES else asked

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = []
            for x in batch.column(1):
                parts = [h.astype(np.uint32) for h in shingle_hashes(words_of(x.as_py()), size)]
                out.append(np.unique(np.concatenate(parts)).tobytes() if parts else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "held"])

    one = packed(texts.join(asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), n, PART_TEXTS)
    return cut(one.mapInArrow(sets, "node long, held binary"))


def _verified(links: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b, near): which links are near copies, by their whole shingle sets. `texts`: (node, text)."""
    import pyarrow as pa

    n = links.count()
    held = shingle_sets(cut(packed(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n)), texts, size)
    both = links.join(held.select(F.col("node").alias("a"), F.col("held").alias("one")), "a").join(held.select(F.col("node").alias("b"), F.col("held").alias("two")), "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            near = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(one.as_py(), np.uint32), np.frombuffer(two.as_py(), np.uint32)
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return cut(packed(both.select("a", "b", "one", "two"), n, PART_TEXTS).mapInArrow(compared, "a long, b long, near boolean"))


def near_copies(nodes: DataFrame, texts: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = RADIUS, tile_rows: int = 8192, task_rows: int = 20_000) -> DataFrame:
    """(node, root) of all nodes that have near copies. `nodes`: (node, print, bands, sketch), cut; `texts`: (node, text)."""
    thin = nodes.select(F.col("node").alias("name"), F.posexplode("bands").alias("choice", "bits"))
    # a tile of one row has no pair; the others' rows get what is compared only then
    crowded = thin.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1").select("choice", "bits")
    many = nodes.count()
    met = cut(packed(thin.join(crowded, ["choice", "bits"]).select("name", "choice", "bits"), many * BANDS))
    n = met.count()
    print_ = cut(packed(nodes.join(met.select(F.col("name").alias("node")).distinct(), "node").select(F.col("node").alias("name"), "print", "sketch"), many))
    first = tiled(met.join(print_, "name"), radius, tile_rows, task_rows, n, by_count=False).groupBy("task").applyInPandas(lambda pdf: _candidates(pdf, radius, similarity), "a long, b long")
    first = cut(packed(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n))
    if first.isEmpty():
        return nodes.select("node", F.col("node").alias("root")).limit(0)
    tried = _verified(first, texts, size, similarity)
    short, near = tried.where(~F.col("near")), tried.where("near").select("a", "b")
    if short.isEmpty():
        return components(near)
    # the tiles in which a candidate fell short are settled with all that is known
    asked = short.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    tiles = met.join(asked, "name", "left_semi").select("choice", "bits").distinct()
    rows = cut(packed(met.join(tiles, ["choice", "bits"], "left_semi"), n))
    held = shingle_sets(cut(packed(rows.select(F.col("name").alias("node")).distinct(), many)), texts, size).withColumnRenamed("node", "name")
    roots = components(near).withColumnRenamed("node", "name")
    known = cut(packed(print_.drop("sketch").join(held, "name").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name")), many, PART_TEXTS))
    dealt = tiled(rows.join(known.select("name", "print", "root"), "name"), radius, SETTLED_ROWS, SETTLED_TASK, rows.count(), by_count=False)
    # the sets join last, so that counts of tiles don't carry them
    last = dealt.join(known.select("name", "held"), "name").groupBy("task").applyInPandas(lambda pdf: _settled(pdf, radius, similarity), "a long, b long")
    return components(near.union(cut(last)))


def gone(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The documents (id, node) that are near copies of one that stays, and those that stay but are repeated."""
    signed = cut(sketches(docs, id_col, text_col, size))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "node")
    n = signed.count()
    nodes = cut(packed(signed.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("print").alias("print"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), n))
    texts = docs.select(F.xxhash64(text_of(text_col)).alias("node"), F.col(text_col).alias("text"))
    roots = near_copies(nodes.select("node", "print", "bands", "sketch"), texts, size, similarity)
    linked = cut(packed(nodes.select("node", "first").join(roots, "node"), n))
    low = packed(linked.groupBy("root").agg(F.min("first").alias("stays")), n)
    stays = cut(packed(join_frequent(linked.select("node", "root"), cut(low), "root"), n).select("node", "stays"))
    alone = nodes.where("copies > 1").join(stays, "node", "left_anti").select("node", F.col("first").alias("stays"))
    rows = cut(packed(signed.groupBy("id", "node").agg(F.count("*").alias("n")), n))
    crowd = cut(packed(join_frequent(rows, cut(packed(stays.union(alone), n)), "node"), n))
    one = crowd.where(~F.col("id").eqNullSafe(F.col("stays.id")) | (F.col("node") != F.col("stays.node")))
    again = crowd.where(F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("node") == F.col("stays.node")) & (F.col("n") > 1))
    return one.select("id", "node"), again.select("id", "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` without near copies: of each group the one with the smallest id stays, once."""
    leave, again = gone(docs, id_col, text_col, size, similarity)
    node, key, other = (fresh(docs, x) for x in ("node", "gone_id", "gone_node"))
    names = [F.col(f"`{c}`") for c in docs.columns]

    def without(rows: DataFrame, few: DataFrame, how: str) -> DataFrame:
        few = few.select(F.col("id").alias(key), F.col("node").alias(other))
        few = F.broadcast(few) if few.count() <= BROADCAST_GONE else few
        return rows.join(few, (F.col(node) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(key)), how)

    rows = docs.withColumn(node, F.xxhash64(text_of(text_col)))
    kept = without(rows, leave, "left_anti")
    if not again.isEmpty():
        kept = without(kept, again, "left_anti").unionByName(without(kept, again, "left_semi").dropDuplicates([id_col, node]))
    return kept.select(*names)
