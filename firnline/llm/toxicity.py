"""Toxicity by class-conditional Kneser-Ney models (operator 4).

An expression is a word, read as characters between a begin and an end mark. Two models give its
log-likelihood: toxic and ordinary, each with absolute discounting of its own character n-grams, both
backing off to one Kneser-Ney model whose continuation counts come from the two classes together. Where
neither class knows a context, both fall back to the same number and the ratio is zero; so rare words
say little, and a rare form of a known expression says what its characters say.

A document is judged by its length-normalised log-likelihood ratio and by those of its strongest
expressions (a long document stays comparable with a short one). A logistic regression on labelled
documents that were kept out of the counts turns these into a score from 0 to 1.

Counts run over all occurrences in all labelled rows of the training part, and counts of counts,
continuation counts and context totals over all n-grams: the model is a table made by joins and
aggregates, and grows with the labelled rows. N-grams in contexts that one class has never seen have
ratio zero, as has what the model does not know, so they are not stored. A table of up to
`broadcast_grams` rows goes to all executors and texts are scored where they lie; a larger one stays a
table that is joined to the different words of the texts, with equal scores. Only the calibration is
fitted on a bounded sample: `max_calibration` labelled documents, those with the smallest hash.

Words are the same in training and scoring: runs of letters of the lower-cased text, as Python reads them.

Edge cases: null and empty texts score as a text without evidence; labels that are null don't count; a
document with several labels is toxic if one says so; if a class has no training row, all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema as to_arrow

from .common import cut, fresh, text_of

ORDER = 5
#: Expressions are runs of letters; longer runs are read in pieces of this length.
LETTERS = 32
BEGIN, END = "\x02", "\x03"
#: Labels up to this many rows go to all executors in the training join; beyond, the join shuffles.
BROADCAST_LABELS = 2_000_000
#: Rows of a model that goes to all executors; beyond, it is joined.
BROADCAST_GRAMS = 4_000_000
#: Words that a task keeps the ratios of, or counts before it sends them on.
CACHE_WORDS = 100_000
TOP = 3
#: Counts of the common model that a class starts with in every context.
PRIOR = 8.0
FEATURES = 2 + TOP


def _codes(words: list[str]):
    """Hash of the n-gram that ends at each character but the first, hash of its context, and word starts."""
    import numpy as np

    text = "".join([f"{BEGIN}{w}{END}" for w in words])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(code)) - np.repeat(first, size)
    mixed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros((ORDER + 1, len(code)), np.uint64)
    factor = np.uint64(1)
    for o in range(1, ORDER + 1):
        total[o] = total[o - 1]
        if o > len(code):
            continue
        total[o, o - 1 :] += mixed[: len(code) - o + 1] * factor
        factor = np.uint64(int(factor) * 0xD6E8FEB86659FD93 % (1 << 64))
    length = np.minimum(place + 1, ORDER)
    own = total[length, np.arange(len(code))] + length.astype(np.uint64)
    short = np.minimum(place + 1, ORDER - 1)
    context = np.roll(total[short, np.arange(len(code))] + short.astype(np.uint64), 1)
    ends = place > 0
    return own[ends], context[ends], first - np.arange(len(words))


def _gram_hash(grams: list[str]):
    """The same hash for n-grams given as strings."""
    import numpy as np

    size = np.array([len(g) for g in grams])
    out = np.zeros(len(grams), np.uint64)
    factor = np.uint64(1)
    for k in range(ORDER):
        has = size > k
        code = np.array([ord(g[-1 - k]) if len(g) > k else 0 for g in grams], np.uint64)
        mixed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        out[has] += (mixed * factor)[has]
        factor = np.uint64(int(factor) * 0xD6E8FEB86659FD93 % (1 << 64))
    return out + size.astype(np.uint64)


@dataclass
class Model:
    """Log-likelihood ratios of n-grams (gram, ratio) and, for n-grams not kept, of contexts (gram, ratio)."""

    grams: DataFrame
    contexts: DataFrame
    #: The same in every executor, if the tables are small.
    shared: Broadcast | None = None
    beta: list[float] | None = None


class Tables:
    """Small tables as sorted hashes and values."""

    def __init__(self, grams, contexts):
        self.grams, self.ratios = self._sorted(grams)
        self.contexts, self.weights = self._sorted(contexts)

    @staticmethod
    def _sorted(table):
        import numpy as np

        keys, values = _gram_hash(table["gram"].to_pylist()), table["ratio"].to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order]

    def words(self, words: list[str]):
        """Log-likelihood ratio of each word."""
        import numpy as np

        if not words or not len(self.contexts):
            return np.zeros(len(words))
        own, context, first = _codes(words)
        back = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        found = np.where(self.contexts[back] == context, self.weights[back], 0.0)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            found = np.where(self.grams[at] == own, self.ratios[at], found)
        return np.add.reduceat(found, first)


CLASSES = ("toxic", "plain", "both")


def _discounts(of: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many n-grams have counts 1 to 4."""
    y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
    raw = [k - (k + 1) * y * of[k] / of[k - 1] if of[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [min(k - 0.02, max(0.1, d)) for k, d in zip((1, 2, 3), raw)]


def _context(gram: Column) -> Column:
    return F.substring(gram, F.lit(1), F.length(gram) - 1)


def shared_backoff(grams: DataFrame) -> tuple[DataFrame, float]:
    """(gram, share): Kneser-Ney probabilities of the n-grams of all lower orders, and that of an unknown character.

    A lower-order n-gram counts the different characters before it, whichever class has them; n-grams that
    begin a word have nothing before them and count as one.
    """
    level, counts = grams.where(F.length("gram") == ORDER).select("gram"), {}
    for o in range(ORDER - 1, 0, -1):
        if o < ORDER - 1:
            level = level.union(grams.where((F.length("gram") == o + 1) & F.col("gram").startswith(BEGIN)).select("gram"))
        counts[o] = level.groupBy(F.substring("gram", 2, ORDER).alias("gram")).agg(F.count("*").alias("n")).cache()
        level = counts[o].select("gram")
    seen = counts[1].select(F.lit(1).alias("o"), "n")
    for o in range(2, ORDER):
        seen = seen.union(counts[o].select(F.lit(o), "n"))
    of = {r["o"]: r for r in seen.groupBy("o").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()}
    letters = 1 / (1 + (of[1]["kinds"] if 1 in of else 0))
    levels: list[DataFrame] = []
    for o in range(1, ORDER):
        once, twice = (of[o]["once"], of[o]["twice"]) if o in of else (0, 0)
        cut_by = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
        rows = counts[o].withColumn("context", _context(F.col("gram")))
        rows = rows.join(rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "context")
        below: Column = F.lit(letters)
        if levels:
            rows = rows.join(levels[-1].select(F.col("gram").alias("rest"), F.col("share").alias("below")), F.substring("gram", 2, ORDER) == F.col("rest"), "left")
            below = F.coalesce("below", F.lit(letters))
        levels.append(rows.select("gram", ((F.greatest(F.col("n") - cut_by, F.lit(0.0)) + cut_by * F.col("kinds") * below) / F.col("total")).alias("share")).cache())
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    out = cut(out)
    for used in [*counts.values(), *levels]:
        used.unpersist()
    return out, letters


def fit(grams: DataFrame) -> Model | None:
    """The model of n-gram counts (gram, toxic, plain), which have been cut; None if a class has none.

    N-grams are ORDER characters long, or shorter if they begin a word. Each class discounts counts of its
    own; the mass that this frees, and PRIOR counts, go to the common model of both classes, which backs off
    to the shared continuation counts.
    """
    grams = grams.withColumn("both", F.col("toxic") + F.col("plain"))
    of = grams.agg(*[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in CLASSES for k in (1, 2, 3, 4)], F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")).first()
    if not of["toxic"] or not of["plain"]:
        return None
    cuts = {c: _discounts([of[f"{c}{k}"] for k in (1, 2, 3, 4)]) for c in CLASSES}
    shared, letters = shared_backoff(grams)
    kind = {c: [F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2), F.count_if(F.col(c) > 2)] for c in CLASSES}
    freed = {c: sum((d * n for d, n in zip(cuts[c], kind[c])), F.lit(0.0)) for c in CLASSES}
    contexts = grams.groupBy(_context(F.col("gram")).alias("context")).agg(*[F.sum(c).alias(f"{c}_total") for c in CLASSES], *[freed[c].alias(f"{c}_freed") for c in CLASSES])
    contexts = contexts.where("toxic_total > 0 and plain_total > 0")
    prior = {"toxic": PRIOR, "plain": PRIOR, "both": 0.0}

    def share(c: str) -> Column:
        n, d = F.col(c), cuts[c]
        return F.when(n > 0, n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])).otherwise(0.0) / (F.col(f"{c}_total") + prior[c])

    def rest(c: str) -> Column:
        return (F.col(f"{c}_freed") + prior[c]) / (F.col(f"{c}_total") + prior[c])

    weights = cut(contexts.select(F.col("context").alias("gram"), (F.ln(rest("toxic")) - F.ln(rest("plain"))).alias("ratio")))
    rows = grams.withColumn("context", _context(F.col("gram"))).join(contexts, "context")
    rows = rows.join(shared.withColumnRenamed("gram", "rest"), F.substring("gram", 2, ORDER) == F.col("rest"), "left")
    rows = rows.withColumn("base", share("both") + rest("both") * F.coalesce("share", F.lit(letters)))
    ratio = F.ln(share("toxic") + rest("toxic") * F.col("base")) - F.ln(share("plain") + rest("plain") * F.col("base"))
    return Model(cut(rows.select("gram", ratio.alias("ratio"))), weights)


_WORD = re.compile(r"[^\W\d_]{1,%d}" % LETTERS)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _features_of(tables: Tables, texts: list[str | None], known: dict[str, float]):
    """For each text: mean ratio for a character, its strongest expressions' ratios, log of the length."""
    import numpy as np

    split = [words_of(t) for t in texts]
    new = list({w for words in split for w in words if w not in known})
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        new = list({w for words in split for w in words})
    for k in range(0, len(new), 10_000):
        part = new[k : k + 10_000]
        known.update(zip(part, tables.words(part).tolist()))
    out = np.zeros((len(texts), FEATURES))
    for k, words in enumerate(split):
        if words:
            ratio = np.array([known[w] for w in words])
            top = np.sort(np.partition(ratio, len(ratio) - TOP)[-TOP:] if len(ratio) > TOP else ratio)[::-1]
            out[k, 0] = ratio.sum() / (sum(map(len, words)) + len(words))
            out[k, 1 : 1 + len(top)] = np.maximum(top, 0)
            out[k, 1 + TOP] = math.log1p(len(words)) / 5
    return out


def _counted(texts: DataFrame, key: list[str], alike: bool = False) -> DataFrame:
    """(key, word, n): how often each word stands in the texts of a key, summed up as far as one batch goes.

    `alike`: the texts of a key are all the same and count once for each batch.
    """
    import pyarrow as pa

    schema = texts.select(*key).schema.add("word", "string").add("n", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, Counter] = defaultdict(Counter)
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                keys = list(zip(*[part.column(i).to_pylist() for i in range(len(key))]))
                for k, text in zip(keys, part.column(len(key))):
                    if not (alike and k in counts):
                        counts[k].update(words_of(text.as_py()))
                if a + 500 >= batch.num_rows or sum(map(len, counts.values())) > CACHE_WORDS:
                    cols: list[list] = [[k[i] for k, c in counts.items() for _ in c] for i in range(len(key))]
                    cols += [[w for c in counts.values() for w in c], [n for c in counts.values() for n in c.values()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, to_arrow(schema))], schema=to_arrow(schema))
                    counts.clear()

    return texts.mapInArrow(run, schema)


def _grams(word: Column) -> Column:
    """The n-grams that end at each character of a word but its begin mark."""
    whole = F.concat(F.lit(BEGIN), word, F.lit(END))
    return F.transform(F.sequence(F.lit(2), F.length(word) + 2), lambda i: whole.substr(F.greatest(F.lit(1), i - (ORDER - 1)), F.least(F.lit(ORDER), i)))


def _joined(texts: DataFrame, model: Model) -> DataFrame:
    """(k, x): the features of each different text by joins, for a model of any size; k are two hashes of the text."""
    words = cut(_counted(texts, ["k1", "k2"], alike=True))
    grams = words.select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    contexts = model.contexts.select(F.col("gram").alias("context"), F.col("ratio").alias("weight"))
    ratios = grams.join(model.grams, "gram", "left").join(contexts, _context(F.col("gram")) == F.col("context"), "left")
    ratios = ratios.groupBy("word").agg(F.sum(F.coalesce("ratio", "weight", F.lit(0.0))).alias("ratio"))
    # a text's own words, once for each word: rows that repeat a text add nothing
    held = words.join(ratios, "word").groupBy("k1", "k2").agg(F.collect_set(F.struct("ratio", "word", "n")).alias("held"))
    total = F.aggregate("held", F.lit(0.0), lambda a, h: a + h["ratio"] * h["n"])
    size = F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + h["n"] * (F.length(h["word"]) + 1))
    count = F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + h["n"])
    best = F.slice(F.sort_array("held", asc=False), 1, TOP)
    best = F.flatten(F.transform(best, lambda h: F.array_repeat(F.greatest(h["ratio"], F.lit(0.0)), F.least(h["n"], F.lit(TOP)).cast("int"))))
    best = F.slice(F.concat(best, F.array_repeat(F.lit(0.0), TOP)), 1, TOP)
    return held.select("k1", "k2", F.concat(F.array(total / size), best, F.array(F.log1p(count) / 5)).alias("x"))


def _with_evidence(rows: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """`rows` with a column `name`, the features of their texts."""
    if model.shared is None:
        keys = {fresh(rows, "k1"): F.xxhash64(text_of(text_col)), fresh(rows, "k2"): F.xxhash64(F.lit(1), text_of(text_col))}
        found = _joined(rows.select(*[v.alias(k) for k, v in zip(("k1", "k2"), keys.values())], text_of(text_col).alias("\x01text")), model)
        found = found.select(*[F.col(k).alias(c) for k, c in zip(("k1", "k2"), keys)], F.col("x").alias(name))
        none = F.array(*[F.lit(0.0)] * FEATURES)
        return rows.withColumns(keys).join(found, list(keys), "left").withColumn(name, F.coalesce(name, none)).select(*rows.columns, name)
    shared = model.shared

    import numpy as np
    import pyarrow as pa

    def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words: dict[str, float] = {}
        for texts in parts:  # a few texts in Python at a time, as a batch may have long ones
            found = [_features_of(shared.value, texts.slice(k, 200).to_pylist(), words) for k in range(0, len(texts), 200)]
            flat = pa.array(np.concatenate(found).ravel() if found else np.zeros(0))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * FEATURES, pa.int32()), flat)

    judged.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn(name, F.arrow_udf(judged, "array<double>")(text_of(text_col)))


def _logistic(x, y, ridge: float = 1e-2, rounds: int = 50):
    """Coefficients (last: constant) by Newton's method."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_calibration: int = 20_000, broadcast_grams: int = BROADCAST_GRAMS) -> Model | None:
    """Counts over all documents with a label; a fifth of them (by hash) calibrate instead of counting."""
    import numpy as np

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("toxic"))
    known = F.broadcast(known) if labels.count() <= BROADCAST_LABELS else known
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(known, "id")
    keep_out = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    n = F.col("n")
    words = _counted(rows.where(~keep_out).select("toxic", "text"), ["toxic"]).groupBy("word").agg(F.sum(n * F.col("toxic")).alias("toxic"), F.sum(n * (1 - F.col("toxic"))).alias("plain"))
    grams = words.select("toxic", "plain", F.explode(_grams(F.col("word"))).alias("gram")).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    model = fit(cut(grams))
    if model is None:
        return None
    if model.grams.count() + model.contexts.count() <= broadcast_grams:
        model.shared = docs.sparkSession.sparkContext.broadcast(Tables(model.grams.toArrow(), model.contexts.toArrow()))
    sample = rows.where(keep_out)
    if sample.count() > max_calibration:
        sample = sample.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(max_calibration)
    found = _with_evidence(sample.select("text", F.col("toxic").cast("double").alias("y")), model, "text", "x").select("x", "y").toArrow()
    y = np.array(found["y"].to_pylist())
    if len(set(y.tolist())) < 2:
        return None
    order = sorted(zip(found["x"].to_pylist(), y.tolist()))
    model.beta = _logistic(np.array([x for x, _ in order]), np.array([v for _, v in order])).tolist()
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a new column `name` from 0 to 1. A broadcast model needs no shuffle."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {name} already")
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    x = fresh(docs, "evidence")
    sums = sum((F.get(x, F.lit(k)) * b for k, b in enumerate(model.beta[:-1])), F.lit(model.beta[-1]))
    return _with_evidence(docs, model, text_col, x).withColumn(name, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sums))))).drop(x)
