"""Source divergence audit (operator 13): how far the words of each source are from those of other sources.

First every task sketches the document frequencies of its terms (count-min: a few rows of counters,
saturated at the least frequency that counts); the sketches are summed counter by counter where blocks
of counters meet. A sum is never below a term's true frequency, so a term whose smallest counter is
below the least frequency can't be kept. One bit a counter goes back to the tasks, which count the
other terms exactly, combined before they are shuffled. Sources of a language are then compared by
joins of the terms that both have; what a term adds where one side or both lack it needs no join.

Edge cases: null text, language and source are read as ''. A source without terms is still a group;
a language without kept terms has pairs of value 0. Repeated rows are documents of their own. Only A-Z
are lower-cased. No documents give an empty table. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: Rows of a sketch, and bounds of the counters of a row; the bits that travel are DEPTH * width / 8 bytes.
DEPTH, LEAST_WIDTH, MOST_WIDTH = 3, 1 << 16, 1 << 24
#: Counters to a document, where that is between the bounds.
PER_DOCUMENT = 8
BLOCK = 1 << 14
#: Terms that a task holds before it emits what it has counted.
HELD = 1_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters A-Z and a-z and of characters above 127, in UTF-8, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _places(lang: str, words: list[bytes], width: int) -> list[np.ndarray]:
    """The counter of each word in every row of the sketch."""
    seed = xxhash.xxh32_intdigest(lang)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * high) & np.uint64(width - 1)).astype(np.int64) for k in range(DEPTH)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(lang, source, text in bytes), one text in Python at a time."""
    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for k, (lang, source) in enumerate(zip(langs, sources)):
            yield lang, source, texts[k].as_py()


def _sketch(docs: DataFrame, width: int, least: int) -> np.ndarray:
    """True for each counter that reaches `least`: DEPTH rows of `width`."""
    kind = np.uint8 if least < 256 else np.uint32

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((DEPTH, width), np.uint32)
        held: dict[str, Counter] = {}

        def put() -> None:
            for lang, found in held.items():
                n = np.fromiter(found.values(), np.int64, len(found))
                for k, at in enumerate(_places(lang, list(found), width)):
                    order = np.argsort(at)
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    counters[k][at[order][first]] += np.add.reduceat(n[order], first).astype(np.uint32)
            np.minimum(counters, least, out=counters)
            held.clear()

        for lang, _, text in _rows(batches):
            held.setdefault(lang, Counter()).update(set(terms(text)))
            if sum(map(len, held.values())) >= HELD:
                put()
        if held:
            put()
        blocks = counters.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        if len(some):
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([blocks[k].astype(kind).tobytes() for k in some], pa.binary())], names=["block", "counters"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counters in zip(batch.column(0).to_pylist(), batch.column(1)):
                total = sums.setdefault(block, np.zeros(BLOCK, np.uint32))
                total += np.frombuffer(counters.as_py(), kind)
                np.minimum(total, least, out=total)
        bits = [np.packbits(total >= least).tobytes() for total in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["block", "bits"])

    parts = docs.mapInArrow(sketched, "block int, counters binary")
    table = parts.repartition("block").mapInArrow(merged, "block int, bits binary").toArrow()
    reached = np.zeros((DEPTH * width // BLOCK, BLOCK), bool)
    for block, bits in zip(table["block"].to_pylist(), table["bits"].to_pylist()):
        reached[block] = np.unpackbits(np.frombuffer(bits, np.uint8))
    return reached.reshape(DEPTH, width)


def _counted(docs: DataFrame, width: int, reached) -> DataFrame:
    """(lang, source, term, times, docs) of the terms that the sketch lets through."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(reached.value, np.uint8)).reshape(DEPTH, width)
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in held.items():
                words = list(times)
                ok = np.ones(len(words), bool)
                for k, at in enumerate(_places(lang, words, width)):
                    ok &= bits[k][at] == 1
                words = [w for w, good in zip(words, ok) if good]
                if words:
                    same = lambda x: pa.array([x] * len(words), pa.string())
                    yield pa.record_batch([same(lang), same(source), pa.array(words, pa.binary()).cast(pa.string()), pa.array([times[w] for w in words], pa.int64()), pa.array([docs[w] for w in words], pa.int64())], names=["lang", "source", "term", "times", "docs"])
            held.clear()

        n = 0
        for lang, source, text in _rows(batches):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, found = len(times), terms(text)
            times.update(found)
            docs.update(set(found))
            n += len(times) - before
            if n >= HELD:
                yield from rows()
                n = 0
        yield from rows()

    found = docs.mapInArrow(counted, "lang string, source string, term string, times long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))


def _width(docs: DataFrame) -> int:
    wanted = max(LEAST_WIDTH, min(MOST_WIDTH, PER_DOCUMENT * docs.count()))
    return 1 << (wanted - 1).bit_length()


def _share(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 * (count + 2) / (n + 2 v)) for whole numbers of up to 20 digits; NULL where no term is kept."""
    most = lambda x: f"cast({x} as decimal(20,0))"
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * ({most(count)} + 2)) div nullif({most(n)} + 2 * {most(v)}, 0)")


def _apart(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)); no p is above 10^9 + 1, so the square fits in 64 bits."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _terms(counts: DataFrame, sizes: DataFrame, to: int) -> DataFrame:
    """The first `to` terms of each source that it has more often than its language."""
    found = counts.join(sizes.select("lang", "source", "n", "lang_n", "v"), ["lang", "source"])
    found = found.select("lang", "source", F.col("term").alias("item"), _share("times", "n", "v").alias("p"), _share("all_times", "lang_n", "v").alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = found.select("lang", "source", F.lit("term").alias("part"), "item", F.expr(_apart("p", "q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= to)


def _pairs(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The distance of every two sources of a language.

    With z for the p of a term that a source lacks, the sum over all V terms is the sum over the terms of
    one side against the other's z, for both sides, (V - both numbers of terms) times f of both z, and,
    for each term that both have, what these have counted wrongly. Terms with equal counts are summed at once.
    """
    z = sizes.select("lang", "source", "z", "terms", "v")
    p = counts.join(sizes.select("lang", "source", "n", "v", "z"), ["lang", "source"]).select("lang", "term", "source", _share("times", "n", "v").alias("p"), "z")
    a, b = p, p.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("z").alias("y"))
    shared = a.join(b, ["lang", "term"]).where("source < other")
    more = f"{_apart('p', 'q')} - {_apart('p', 'y')} - {_apart('z', 'q')} + {_apart('z', 'y')}"
    shared = shared.select("lang", "source", "other", F.expr(more).alias("f")).groupBy("lang", "source", "other").agg(F.sum("f").alias("f"))

    alike = p.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    others = z.select("lang", F.col("source").alias("other"), F.col("z").alias("y"), F.col("terms").alias("other_terms"))
    sides = alike.join(others, "lang").where("source <> other")
    sides = sides.groupBy("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other")).agg(F.sum(F.expr(f"m * ({_apart('p', 'y')})")).alias("f"))

    rest = z.join(others, "lang").where("source < other").select("lang", "source", "other", F.expr(f"(v - terms - other_terms) * ({_apart('z', 'y')})").alias("f"))
    sums = rest.unionByName(sides).unionByName(shared).groupBy("lang", "source", "other").agg(F.sum("f").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = both.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    return found.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, *, least: int = 10, terms_to: int = 10, width: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Part `pair`: each other source of the language, and the sum of f over all kept terms; part `term`: the
    `terms_to` kept terms that stand out most in the source against its whole language. A term is kept
    if `least` documents of the language have it. With p and q as `_share` gives them for both sides, f is
    as `_apart` gives it. `width` sets the counters of a row of the sketch (a power of two of at least BLOCK);
    it changes how much is counted, not the result.
    """
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], text_of("text").cast("binary").alias("text"))
    width = width or _width(docs)
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(_sketch(read, width, least)).tobytes())
    counted = stored(_counted(read, width, sent))
    sent.destroy()
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("all_times")).where(F.col("docs") >= least)
    kept = stored(kept.drop("docs"))
    counts = stored(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "times", "all_times"))

    whole = kept.groupBy("lang").agg(F.sum("all_times").alias("lang_n"), F.count("*").alias("v"))
    own = counts.groupBy("lang", "source").agg(F.sum("times").alias("n"), F.count("*").alias("terms"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    sizes = stored(sizes.withColumn("z", _share("0", "n", "v")))
    return _terms(counts, sizes, terms_to).unionByName(_pairs(counts, sizes))
