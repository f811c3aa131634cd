"""Quality rules as a bitmask ledger (operator 3).

`ledger` measures every document once and evaluates every rule once; a row keeps the measurements and
one long whose bit k says that rule k failed. A policy is a named, versioned set of rules: a mask.
Whether a policy keeps a document is one bitwise AND, so policies change without reading texts again,
and `ablations` counts in one aggregation what each rule of a policy removes, alone and in all.

Edge cases: null and empty texts have no words and fail `few_words`; words are separated by space and
characters 9 to 13; counts are whole-text counts, of any length; rows are independent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: Name and condition of failure, in order of the bits. New rules go to the end; bits are never reused.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("capitals", "100 * n_upper > 50 * n_letters"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r for r, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
PROSE = Policy("prose", 1, tuple(r for r, _ in RULES))

_SYMBOLS = b"#*$%&|<>"


def measured(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    raw = text.encode()
    words = raw.split()  # bytes split at space and 9 to 13
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = Counter(line for line in raw.split(b"\n") if line and not line.isspace())
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, upto = Counter(windows), 0
        for k, w in enumerate(windows):
            if seen[w] > 1:
                repeated += k + 3 - max(k, upto)
                upto = k + 3
    if text.isascii():
        letters, upper = (len(raw) - len(raw.translate(None, x)) for x in (_ASCII_LETTERS, _ASCII_UPPER))
    else:  # by Unicode category: letters, and upper-case letters among them
        of = [(category(c), k) for c, k in Counter(text).items()]
        letters, upper = sum(k for c, k in of if c[0] == "L"), sum(k for c, k in of if c == "Lu")
    return n, chars, len(raw) - len(raw.translate(None, _SYMBOLS)), sum(lines.values()) - len(lines), repeated, sum(lines.values()), upper, letters


_ASCII_UPPER = bytes(range(65, 91))
_ASCII_LETTERS = _ASCII_UPPER + bytes(range(97, 123))


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of `docs`: the columns `keep`, the measurements and `failed`, the bits of failed rules."""
    import pyarrow as pa

    source = docs.select(*keep, text_of(text_col).alias("\x01text"))
    schema = source.drop("\x01text").schema
    if clash := {k.lower() for k in keep} & {*MEASURES, "failed"}:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    for m in MEASURES:
        schema = schema.add(m, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measured(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            cols = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array([r[k] for r in found], pa.int64()) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)), F.lit(0)).cast("long")
    return source.mapInArrow(run, schema).withColumn("failed", bits)


def kept_by(policy: Policy, failed: str | Column = "failed") -> Column:
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(found: DataFrame, policy: Policy, failed: str = "failed") -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it removes.

    Also the OR and AND of all bits: rules that ever failed, and rules that every document fails.
    """
    hit = F.col(failed).bitwiseAND(F.lit(policy.mask))
    names = [r for r, _ in RULES]
    sums = found.agg(F.count("*").alias("docs"), F.bit_or(hit).alias("any_failed"), F.bit_and(hit).alias("all_failed"), *[f(b).alias(f"{kind}_{r}") for r in policy.rules for b in [1 << names.index(r)] for kind, f in (("fails", lambda b: F.count_if(hit.bitwiseAND(F.lit(b)) != 0)), ("only", lambda b: F.count_if(hit == b)))])
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"fails_{r}").alias("fails"), F.col(f"only_{r}").alias("removed_by_it_alone")) for r in policy.rules]))
    return sums.select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "docs", "any_failed", "all_failed", rows.alias("of")).select("policy", "version", "docs", "any_failed", "all_failed", "of.*")
