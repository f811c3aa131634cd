"""Phrase collocation mining (operator 11): counted n-grams, exact scores, no phrase inside a likelier longer one.

All n-grams become rows, summed per language: a task turns its words into numbers, counts the
n-grams of many texts with sorts of whole numbers and emits one row for each, so that what is
shuffled is already combined. n-grams go up word by word: of three words and more, those are rows
whose two shorter parts can both have the least count, by a bitmap of the parts that do; the bitmap
never says no to such a part, so no candidate is lost and what is counted is exact. The bitmap has a
fixed size. Cuts join the counts of both parts, scores are whole numbers in Decimal, candidates in a
frequent extension by one word are anti-joined, and the first of each language come from two levels
of windows, so no task sees all phrases of a language.

Edge cases: a null text is empty, a null language is `und`; texts without words add nothing; repeated
rows count as often as they stand; no documents give an empty table. Only A-Z are lower-cased.
Words hold any characters but separators, spaces and tabs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: What ends a piece; no phrase goes across.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Bits of the map of frequent shorter parts: 8 MB.
BITS = 1 << 26
#: n-grams and words that a task holds before it emits them.
HELD, HELD_WORDS = 2_500_000, 400_000
#: Texts are read in slices of about so many bytes; rows are emitted so many at a time.
SLICE, EMITTED = 1 << 21, 20_000
SALTS = 64

ROWS = "lang string, words int, phrase string, times long"
_FOLD = bytes(ord(".") if c in SEPARATORS else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD))


def _bit(words: list[np.ndarray], lang: str) -> np.ndarray:
    """The place in the bitmap of each n-gram; `words` has the hashes of its first words, of its second words and so on."""
    h = np.full(len(words[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for w in words:
        h = (h ^ w) * _MIX[0]
        h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return (h >> np.uint64(32)) & np.uint64(BITS - 1)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Words(dict):
    """Numbers words as they are first seen; 0 ends a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Counts:
    """n-grams of one language: `sizes` words each, those above two words only if their parts are in `bitmap`."""

    def __init__(self, lang: str, sizes: tuple[int, ...], bitmap: np.ndarray | None) -> None:
        self.lang, self.sizes, self.bitmap = lang, sizes, bitmap
        self.clear()

    def clear(self) -> None:
        self.words, self.hashes, self.held, self.per = _Words(), np.zeros(0, np.uint64), 0, 3
        self.found: dict[int, list[tuple[np.ndarray, ...]]] = {n: [] for n in self.sizes}

    def add(self, texts: list[bytes]) -> None:
        tokens = b" . ".join(texts).translate(_FOLD).replace(b".", b" . ").split(b" ")
        at = self.words
        w = np.fromiter(map(at.__getitem__, filter(None, tokens)), np.int64)
        del tokens
        if self.per == 3 and len(at) >= 1 << 21:  # more words than 21 bits can tell apart
            self.found = {n: [(*_pack(_unpack(f[:-1], n, 3), 2), f[-1]) for f in found] for n, found in self.found.items()}
            self.per = 2
        if self.bitmap is not None and len(at) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, _hashes(list(islice(at, len(self.hashes), None)))])
        for n in self.sizes:
            parts = [w[k : len(w) - n + 1 + k] for k in range(n)] if len(w) >= n else [w[:0]] * n
            ok = reduce(np.logical_and, [p > 0 for p in parts])
            parts = [p[ok] for p in parts]
            if self.bitmap is not None and len(parts[0]):
                h = [self.hashes[p] for p in parts]
                ok = _set(self.bitmap, _bit(h[:-1], self.lang))
                ok[ok] = _set(self.bitmap, _bit([x[ok] for x in h[1:]], self.lang))
                parts = [p[ok] for p in parts]
            self.found[n].append(_summed(_pack(parts, self.per), np.ones(len(parts[0]), np.int64)))
            self.held += len(self.found[n][-1][0])

    def full(self) -> bool:
        return self.held >= HELD or len(self.words) >= HELD_WORDS

    def rows(self) -> Iterator[pa.RecordBatch]:
        words = pa.array(list(self.words), pa.binary()).cast(pa.string())
        for n, found in self.found.items():
            if not found:
                continue
            *keys, times = _summed([np.concatenate(f) for f in list(zip(*found))[:-1]], np.concatenate([f[-1] for f in found]))
            found.clear()
            for s in range(0, len(times), EMITTED):
                here = [words.take(pa.array(p)) for p in _unpack([k[s : s + EMITTED] for k in keys], n, self.per)]
                phrase = pc.binary_join_element_wise(*here, " ") if n > 1 else here[0]
                yield pa.record_batch([pa.array([self.lang] * len(phrase), pa.string()), pa.array([n] * len(phrase), pa.int32()), phrase, pa.array(times[s : s + EMITTED])], names=["lang", "words", "phrase", "times"])
        self.clear()


def _pack(parts: list[np.ndarray], per: int) -> list[np.ndarray]:
    """The words of n-grams as whole numbers, `per` words in each."""
    return [reduce(lambda a, b: (a << 63 // per) | b, parts[k : k + per]) for k in range(0, len(parts), per)]


def _unpack(keys, n: int, per: int) -> list[np.ndarray]:
    bits, out = 63 // per, []
    for k, key in enumerate(keys):
        size = min(per, n - k * per)
        out += [(key >> bits * (size - 1 - i)) & ((1 << bits) - 1) for i in range(size)]
    return out


def _summed(keys: list[np.ndarray], times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal n-grams once, with the sum of their times."""
    if not len(times):
        return *keys, times
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return *(k[first] for k in keys), np.add.reduceat(times[order], first)


def _ngrams(docs: DataFrame, sizes: tuple[int, ...], bitmap=None) -> DataFrame:
    """(lang, words, phrase, times) of the n-grams of `sizes` words, combined by task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        held: dict[str, _Counts] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            waiting: dict[str, list[bytes]] = {}
            weight = 0
            for k, lang in enumerate(langs):
                text = texts[k].as_py()
                waiting.setdefault(lang, []).append(text)
                weight += len(text)
                if weight < SLICE and k < len(langs) - 1:
                    continue
                for name, some in waiting.items():
                    if name not in held:
                        held[name] = _Counts(name, sizes, bits)
                    held[name].add(some)
                waiting, weight = {}, 0
                while sum(c.held for c in held.values()) >= HELD or any(c.full() for c in held.values()):
                    yield from max(held.values(), key=lambda c: (c.full(), c.held)).rows()
        for c in held.values():
            yield from c.rows()

    found = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(rows, ROWS)
    return found.groupBy("lang", "words", "phrase").agg(F.sum("times").alias("times"))


def _bitmap(phrases: DataFrame):
    """Broadcast bitmap of `phrases`, made as bytes of blocks: the driver gets BITS / 8 bytes at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[tuple[str, int], list[list[bytes]]] = {}
            for lang, phrase in zip(langs, phrases):
                words = phrase.split(b" ")
                by.setdefault((lang, len(words)), []).append(words)
            for (lang, _), rows in by.items():
                at = _bit([_hashes(list(w)) for w in zip(*rows)], lang).astype(np.int64)
                yield pa.record_batch([pa.array(at >> 6), pa.array(np.left_shift(np.ones(len(at), np.int64), at & 63))], names=["at", "bits"])

    found = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(bits, "at long, bits long")
    table = found.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(BITS // 64, np.int64)
    words[table["at"].to_numpy()] = table["bits"].to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(words.astype("<i8").tobytes())


def _first(found: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each language with their `rank`; a language is first cut in SALTS parts."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most).drop("rank", "salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def mine(docs: DataFrame, *, max_n: int = 3, least: int = 10, share: int = 50, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` collocations of each language.

    A candidate has 2 to `max_n` words and a count `a` of at least `least`; it goes if a longer candidate
    that holds it has at least `share` hundredths of its count. (If any does, one with one word more does,
    as its count is no smaller.) l and r are the counts of the two parts of the cut with the lowest score
    floor(1000000 * a * a / (l * r)), n the words of the language. Counts may reach 10^12.
    """
    if max_n < 2 or least < 1:
        raise ValueError("max_n has to be 2 or more and least 1 or more")
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of("text").alias("text"))
    counted = stored(_ngrams(text, (1, 2)).where((F.col("words") == 1) | (F.col("times") >= least)))
    total = counted.where("words = 1").groupBy("lang").agg(F.sum("times").alias("n"))
    levels = [counted.where(F.col("times") >= least)]
    sent = []
    for n in range(3, max_n + 1):
        sent.append(_bitmap(levels[-1].where(F.col("words") == n - 1)))
        levels.append(stored(_ngrams(text, (n,), sent[-1]).where(F.col("times") >= least)))
        sent[-1].destroy()
    known = reduce(DataFrame.unionByName, levels)
    candidates = known.where("words > 1")

    parts = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = candidates.select("lang", "words", "phrase", F.col("times").alias("a"), cut.alias("k"))
    joined = lambda frm, size: F.array_join(F.slice(parts, frm, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    whole = F.col("times").cast("decimal(15,0)")
    sides = known.select("lang", F.col("phrase").alias("part"), whole.alias("f"))
    cuts = cuts.join(sides.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(sides.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    a = "cast(a as decimal(15,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * {a} * {a}) div (l * r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), best)

    shorter = F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1)))
    longer = candidates.where("words > 2").select("lang", shorter.alias("phrase"), "times").groupBy("lang", "phrase").agg(F.max("times").alias("longer"))
    held = (scored["lang"] == longer["lang"]) & (scored["phrase"] == longer["phrase"])
    free = scored.join(longer, held & (100 * longer["longer"] >= share * scored["a"]), "left_anti")
    flat = free.select("lang", "phrase", "a", F.col("best.l").cast("long").alias("l"), F.col("best.r").cast("long").alias("r"), F.col("best.score").cast("long").alias("score"))
    first = _first(flat, [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
