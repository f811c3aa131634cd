"""Document fingerprints by winnowing (operator 1), in DataFrame functions only.

Every k-gram of code points has a hash; of each window of w hashes in a row the smallest is kept, the
rightmost of equals, with its position. Hence two texts that share a passage of k + w - 1 code points
share a kept hash that stands inside it, and no text without a common k-gram shares one (but for
collisions of 33-bit hashes).

The hash of a k-gram is a rolling one: each further code point shifts it by a bit and adds that code
point's own hash by exclusive-or; a code point that leaves the gram is taken off in the same way. All
grams' hashes come by doubling (a gram of 2n is the gram of n before, shifted by n bits, and the one
behind), and the minima of windows by taking four together at a time: a code point costs log2(k) + log4(w)
short steps. A kept hash is one long, 33 bits of hash above and the reversed position below: the smallest
long is the rightmost minimum.

Edge cases: a null or empty text has an empty fingerprint, two of them have likeness 1, an empty and
another one 0; a text shorter than k has one hash, of all of it; one with fewer than w hashes has one
window. Rows with equal ids come in the order of a hash of their texts, a null id comes first; rows that
are equal in both stand in one task, side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, text_of

#: Code points of a gram (a power of two, 32 at most) and hashes of a window.
K, W = 16, 36
_POS = (1 << 31) - 1


def _let(value: Column, use) -> Column:
    """`use(value)` with the value worked out once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with_later(items: Column, apart: list[int], how) -> Column:
    """For each place i, `how(i, item i, items i + apart ...)`; null past the end."""
    return _let(items, lambda h: F.transform(h, lambda x, i: how(i, x, *[F.get(h, i + k) for k in apart])))


def _steps(size: int, most: int) -> list[list[int]]:
    """How far apart items are combined, up to `most` at once, till `size` of them have come together."""
    out, have = [], 1
    while have < size:
        parts = min(most, -(-size // have))
        out.append([min(k * have, size - have) for k in range(1, parts)])
        have = min(size, have * parts)
    return out


def fingerprint(text: Column) -> Column:
    """Kept hashes in order of position, as packed longs."""
    n = F.length(text)
    rolled = _let(F.transform(F.split(text, ""), lambda c: F.xxhash64(c)), lambda h: F.when(n < K, F.concat(h, F.array_repeat(F.lit(0).cast("long"), K - n))).otherwise(h))
    *inner, last = _steps(K, 2)
    for step in inner:
        rolled = _with_later(rolled, step, lambda i, x, later, by=step[0]: F.shiftleft(x, by).bitwiseXOR(later))
    # every code point of the gram reaches the upper bits; the place takes the lower ones
    least = _with_later(rolled, last, lambda i, x, later: F.shiftleft(x, last[0]).bitwiseXOR(later).bitwiseAND(~_POS).bitwiseOR(F.lit(_POS) - i))
    for step in _steps(W, 4):
        least = _with_later(least, step, lambda i, *x: F.least(*x))
    windows = F.slice(least, 1, F.greatest(F.lit(1), n - (K - 1) - (W - 1)))
    return F.when(n > 0, F.array_distinct(windows)).otherwise(F.array().cast("array<long>"))


def position(packed: Column) -> Column:
    return F.lit(_POS) - packed.bitwiseAND(_POS)


def hashes(packed: Column) -> Column:
    """The different hashes of a fingerprint."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 31)))


def shown(packed: Column) -> Column:
    """A fingerprint as text: position:hash, separated by spaces."""
    return F.array_join(F.transform(packed, lambda x: F.concat(position(x).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftrightunsigned(x, 31))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints' hashes, 0 to 1."""
    both = F.array(F.struct(hashes(a).alias("a"), hashes(b).alias("b")))
    sizes = F.transform(both, lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("common"), (F.size(s["a"]) + F.size(s["b"])).alias("all")))
    return F.get(F.transform(sizes, lambda s: F.when(s["all"] == 0, F.lit(1.0)).otherwise(s["common"] / F.nullif(s["all"] - s["common"], F.lit(0)))), F.lit(0))


def _range_of(value: Column, bounds: list[Column]) -> Column:
    """How many of the sorted bounds are at most `value`."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)
    coarse = F.size(F.filter(F.array(*[g[0] for g in groups]), lambda b: b <= value))
    fine = F.array(*[F.array(*g) for g in groups])
    return _let(coarse, lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + F.size(F.filter(F.get(fine, c - 1), lambda b: b <= value)))).cast("int")


def with_next(rows: DataFrame, order: str, text: str, carried: list[str], added: dict[str, Column]) -> DataFrame:
    """`rows` with the columns `added` and `next`, the `carried` ones of the row that follows by `order`, then by a hash of `text`.

    The first row follows the last. Added columns are worked out after the rows have been dealt, so that
    they don't travel. Rows are dealt to ranges of about equal size, and the first row of each range goes
    to the range before as well; so no task sees more than a range. The driver gets a row for each range.
    """
    place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order"), F.xxhash64(text).alias("hash"))
    ranged = rows.select(place.alias("at")).repartitionByRange(4 * shuffle_parts(rows), "at")
    first = sorted((r[0] for r in ranged.groupBy(F.spark_partition_id()).agg(F.min("at")).select("min(at)").collect()), key=lambda r: (r[0], r[1] if r[0] else 0, r[2]))
    kind = rows.schema[order].dataType
    bounds = [F.struct(F.lit(r["known"]).alias("known"), F.lit(r["order"]).cast(kind).alias("order"), F.lit(r["hash"]).alias("hash")) for r in first]
    own = _let(F.col("\x01at"), lambda at: F.greatest(F.lit(0), _range_of(at, bounds) - 1))
    placed = rows.withColumn("\x01at", place).withColumn("\x01range", own)
    before = F.when(F.get(F.array(*bounds), F.col("\x01range")) == F.col("\x01at"), F.pmod(F.col("\x01range") - 1, F.lit(len(bounds)))) if bounds else F.lit(None)
    homes = F.array(F.struct(F.col("\x01range").alias("range"), F.lit(False).alias("guest")), F.struct(before.cast("int").alias("range"), F.lit(True).alias("guest")))
    dealt = placed.select(*rows.columns, "\x01at", F.explode(F.filter(homes, lambda h: h["range"].isNotNull())).alias("\x01home"))
    dealt = dealt.select(*rows.columns, "\x01at", F.col("\x01home.range").alias("\x01range"), F.col("\x01home.guest").alias("\x01guest"))
    dealt = dealt.repartition("\x01range").withColumns(added)
    follows = F.lead(F.struct(*carried)).over(Window.partitionBy("\x01range").orderBy("\x01guest", "\x01at"))
    return dealt.withColumn("next", follows).where(~F.col("\x01guest")).drop("\x01at", "\x01range", "\x01guest")


def _inside(kept: Column, last: Column) -> Column:
    """Of the kept hashes those that windows 0 .. `last` have picked; none if `last` is negative."""
    picked = F.array_min(F.filter(kept, lambda x: (position(x) >= last) & (position(x) < last + W)))
    return F.when(last >= 0, _let(position(picked), lambda p: F.filter(kept, lambda x: position(x) <= p))).otherwise(F.array().cast("array<long>"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to that and to the next text.

    The edited text has its last floor(n / 2) code points replaced by as many of the next document's
    first ones, or all if there are fewer. Windows that lie inside what stayed, or inside what came from
    the next document, have picked the same hashes before; only the seam between them is hashed again.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = with_next(rows, "id", "text", ["text", "kept"], {"kept": fingerprint(F.col("text"))})
    n, reach = F.length("text"), K + W - 1
    half = F.floor(n / 2).cast("int")
    came = F.least(half, F.length("next.text"))
    # the last window inside what stayed and inside what came, from 0 (negative: there is none)
    rows = rows.withColumns({"n": n, "edited": F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half)), "border": n - half, "last": n - half - reach, "last_new": came - reach})
    start = F.greatest(F.lit(0), F.col("last") + 1)
    stop = F.when(F.col("last_new") >= 0, F.col("border") + reach - 1).otherwise(F.length("edited"))
    rows = rows.withColumns({"start": start, "seam": F.substring("edited", start + 1, stop - start), "stayed": _inside(F.col("kept"), F.col("last")), "came": _inside(F.col("next.kept"), F.col("last_new"))})
    whole = (F.length("seam") >= reach) | (F.length("seam") == F.length("edited"))
    rows = rows.withColumn("found", fingerprint(F.when(whole, F.col("seam")).otherwise("")))
    moved = [F.transform("found", lambda x: x - F.col("start")), F.transform("came", lambda x: x - F.col("border"))]
    rows = rows.withColumn("edited_kept", F.array_distinct(F.concat("stayed", *moved)))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("kept")).alias("fingerprint"),
        shown(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next.kept")).alias("near_next"),
    )
