"""Secret scans with password guess costs (operator 5).

Known shapes (assignments, access keys, hex strings) are found by pattern. Every value that stands where a
credential is named, those inside such shapes too, is judged by how many guesses it would take: the cheapest
segmentation into words, dates, repeats, keyboard walks and brute-force spans, found by dynamic programming over
the ends of prefixes. A value outside the shapes that costs `min_cost` powers of ten or more is a secret too; a
placeholder such as "changeme123" is not.

The words are those that guessers try first, and the corpus's own: first all values are gathered (there are few),
then only the strings of letters that they are made of are counted in the texts, each different text once
and without the values themselves, so that a secret that copies of a text repeat does not become a word. A word
that one of n texts has ranks as the n-th. What is counted is combined by task, but for texts of which there are
copies; a bitmap of fixed size says which texts and which words these may be. Values of letters only are judged
with the words and parts of words of a public tokenizer as well, as prose follows such names too ("token embeddings").

Edge cases: null and empty texts have no spans; spans are code points, end exclusive; texts of any
length take time in proportion to it; equal rows get equal results. Repeated units of up to LONGEST_UNIT characters
are seen, and any that fill half of a value of up to twice that length.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator, Mapping
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_frequent, stored, text_of

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # whole runs: a shorter one fails, and no run starts inside another
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|log[io]n|auth(?:orization)?|bearer|(?:api|access|private)[_-]?key)["']?(?:[\x20\t]*+(?:=>|[:=])[\x20\t]*+|[\x20\t]++(?:is[\x20\t]++)?)["'`]?([^\s"'`<>,;]{8,})""", re.I | re.A)
#: One of these stands in every text that has an assignment or a credential context.
_NAMES = ("pass", "pwd", "secret", "token", "credential", "login", "logon", "auth", "bearer", "key")

# Words that guessers try first, in order of rank, and the rows of a keyboard.
COMMON_WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login princess sunshine shadow football baseball "
    "superman iloveyou trustno1 hello freedom whatever secret changeme default test guest user root pass token example "
    "sample dummy placeholder your here none null true false undefined redacted hidden xxxx key value string secretkey "
    "apikey company summer winter spring autumn january february march april may june july august september october "
    "november december monday tuesday wednesday thursday friday saturday sunday love money computer internet server "
    "database mysql oracle public private access service system config local host development production staging the and"
).split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

_RANK = {w: k + 1 for k, w in reversed(list(enumerate(COMMON_WORDS)))}
_LONGEST = max(map(len, COMMON_WORDS))
_LEET = str.maketrans("@431!05$7", "aaeiiosst")
_DATES = tuple(
    re.compile(p)
    for p in (
        r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d",
        r"(?:19|20)\d\d",
    )
)
#: Characters of a walk or repeat that count without its beginning, as another span may reach into it.
TAIL = 64
LONGEST_UNIT = 2048
#: Words of a table that values may be made of have so many letters; those in fewer different texts are none.
LETTERS, LEAST_TEXTS = (3, 24), 2
#: Bits of each bitmap that goes to all tasks: 2 MB.
BITS = 1 << 24
#: Words that a task counts before it emits them.
HELD = 500_000
#: Log10 of the guesses that choosing one more segment costs.
_STEP = 0.3


def _adjacent() -> set[tuple[str, str]]:
    """Pairs of keys next to each other, and neighbours of the alphabet and of the digits."""
    out = set()
    for y, row in enumerate(KEY_ROWS):
        for x, a in enumerate(row):
            for dy, dx in ((0, 1), (1, 0), (1, -1)):
                if y + dy < len(KEY_ROWS) and 0 <= x + dx < len(KEY_ROWS[y + dy]):
                    b = KEY_ROWS[y + dy][x + dx]
                    out |= {(a, b), (b, a)}
    for row in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        for a, b in zip(row, row[1:]):
            out |= {(a, b), (b, a)}
    return out


_NEXT = _adjacent()


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0


@lru_cache(maxsize=1)
def _pieces() -> tuple[str, ...]:
    """Words and parts of words, of three letters or more, in the public tokenizer's list."""
    import sentencepiece

    from .queries import model_path

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    words = (model.id_to_piece(k).lstrip("\u2581").lower() for k in range(model.get_piece_size()))
    return tuple(w for w in words if len(w) > 2 and w.isalpha())


class Ranks:
    """The words that guessers try, by rank: common ones, and `words` with ranks of their own, behind the common ones."""

    def __init__(self, words: Mapping[str, int] | None = None):
        self.of = dict(_RANK)
        for word, rank in (words or {}).items():
            self.of.setdefault(word, len(_RANK) + rank)
        self.longest = max(map(len, self.of))

    def with_pieces(self) -> Ranks:
        more = Ranks()
        more.of = {w: len(_RANK) + k + 1 for k, w in reversed(list(enumerate(_pieces())))} | self.of
        more.longest = max(map(len, more.of))
        return more


def _starts(first: int, end: int, least: int) -> list[int]:
    """Where a walk or repeat that ends at `end` may start: at its beginning, or at most TAIL characters before its end."""
    return [first, *range(max(first + 1, end - TAIL), end - least + 1)] if end - first >= least else []


def _repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """By end: (unit, copies) where the `unit` characters before stand again `copies` times; no unit is itself a repeat."""
    import numpy as np

    n = len(value)
    a = np.array([ord(c) for c in value], np.int32)
    out: dict[int, list[tuple[int, int]]] = {}
    own, reach = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for u in range(1, min(n // 2, LONGEST_UNIT) + 1):
        same = a[u:] == a[:-u]
        k = np.arange(1, len(same) + 1)
        run = k - np.maximum.accumulate(np.where(same, 0, k))
        for e in (np.flatnonzero(run >= u) + u + 1).tolist():
            long = int(run[e - u - 1])
            if own[e] and u % own[e] == 0 and reach[e] >= 2 * u:
                continue
            if not own[e]:
                own[e], reach[e] = u, long + u
            out.setdefault(e, []).append((u, long // u))
    return out


def guess_cost(value: str, words: Ranks | None = None) -> float:
    """Log10 of the guesses for the cheapest segmentation of `value`. `words`: those that guessers try."""
    ranks, longest = (words.of, words.longest) if words else (_RANK, _LONGEST)
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    dates: dict[int, list[int]] = {}
    for at in range(n):
        if value[at].isdigit():
            for date in _DATES:
                if m := date.match(value, at):
                    dates.setdefault(m.end(), []).append(at)
    # where the run of neighbouring keys that ends here began
    walk = [0] * (n + 1)
    for e in range(2, n + 1):
        walk[e] = walk[e - 1] if (low[e - 2], low[e - 1]) in _NEXT else e - 1
    repeats = _repeats(value)
    best, brute = [0.0] * (n + 1), [0.0] * (n + 1)
    for e in range(1, n + 1):
        # going on with brute force costs no new segment
        one = _char_cost(value[e - 1])
        brute[e] = min(brute[e - 1], best[e - 1] + _STEP) + one if e > 1 else one
        found = brute[e]
        for s in range(max(0, e - longest), e - 2):
            rank = ranks.get(plain[s:e]) or ranks.get(low[s:e])
            if rank:
                twisted = (low[s:e] != plain[s:e]) * 0.6 + (value[s:e] != low[s:e]) * 0.5
                found = min(found, best[s] + _STEP + math.log10(rank + 1) + twisted)
        for s in dates.get(e, ()):
            found = min(found, best[s] + _STEP + (math.log10(120) if e - s == 4 else math.log10(365 * 120)))
        for s in _starts(walk[e], e, 3):
            found = min(found, best[s] + _STEP + math.log10(47 * 4 * (e - s)))
        for u, copies in repeats.get(e, ()):
            for m in {copies, *range(1, min(copies, TAIL) + 1)}:
                found = min(found, best[e - m * u] + _STEP + math.log10(m + 1))
        best[e] = found
    return best[n]


_COMMON = Ranks()


def _base(text: str, low: str) -> list[tuple[int, int, int]]:
    """Spans of the known shapes: (start, place of the kind in KINDS, end)."""
    found = [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    return sorted(found)


def _values(text: str, low: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of every value of a credential context."""
    if not any(name in low for name in _NAMES):
        return []
    found = ((m.start(1), m[1].rstrip(".!?)]}:")) for m in _CONTEXT.finditer(text))
    return [(s, s + len(v), v) for s, v in found if len(v) >= 8]


def value_cost(value: str, words: Ranks | None = None) -> float:
    """The guess cost of a credential's value; letters only may be words of prose, so those of a tokenizer count as well."""
    words = words or _COMMON
    cost = guess_cost(value, words)
    letters = value.isalnum() and not any(map(str.isdigit, value))
    return min(cost, guess_cost(value, words.with_pieces())) if letters else cost


def spans(text: str, min_cost: float = 11.0, words: Ranks | None = None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every secret, sorted."""
    low = text.lower()
    base = _base(text, low)
    return sorted(base + [(s, 3, e) for s, e, v in _values(text, low) if not _meets(s, e, base) and value_cost(v, words) >= min_cost])


def _meets(start: int, end: int, base: list[tuple[int, int, int]]) -> bool:
    return any(a < end and start < b for a, _, b in base)


def _named(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


_RUN = re.compile(f"[a-z]{{{LETTERS[0]},}}")


def parts_of(value: str) -> set[str]:
    """The strings of letters that may be words of `value`, as it stands and with digits and signs read as letters."""
    low = value.lower()
    runs = {run for text in (low, low.translate(_LEET)) for run in _RUN.findall(text)}
    return {run[a:b] for run in runs for a in range(len(run)) for b in range(a + LETTERS[0], min(a + LETTERS[1], len(run)) + 1)}


def _place(h: int) -> tuple[int, int]:
    return (h & (BITS - 1)) >> 3, 1 << (h & 7)


def _bitmap(hashes: DataFrame):
    """Broadcast bitmap of the 64-bit `hash`es; the driver gets BITS / 8 bytes at most."""
    import numpy as np

    low = F.col("hash").bitwiseAND(BITS - 1)
    bits = F.shiftright(low, 6).alias("at"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(63).cast("int"))).alias("bits")
    table = hashes.groupBy(bits[0]).agg(bits[1]).toArrow()
    words = np.zeros(BITS // 64, np.int64)
    words[table["at"].to_numpy()] = table["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(words.astype("<i8").tobytes())


def word_texts(docs: DataFrame, asked: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, texts): in how many different texts each of the words `asked` (column word) stands, outside credentials' values."""
    import pyarrow as pa

    texts = docs.select(F.xxhash64(text_of(text_col)).alias("hash"), text_of(text_col).alias("text"))
    wanted, copied = _bitmap(asked.select(F.xxhash64("word").alias("hash"))), _bitmap(texts.groupBy("hash").count().where("count > 1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, copies, known = wanted.value, copied.value, {}
        held: dict[tuple[str, int | None], int] = {}

        def may_be(word: str) -> bool:
            if word not in known:
                if len(known) >= HELD:
                    known.clear()
                at, bit = _place(xxhash.xxh64_intdigest(word, 42))
                known[word] = bool(words[at] & bit)
            return known[word]

        def rows() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["word", "hash", "texts"])
            held.clear()
            return out

        for batch in batches:
            for h, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py()
                low = text.lower()
                if len(low) == len(text):  # else places differ; such a text has no values with letters that change their number
                    for s, e, _ in reversed(_values(text, low)):
                        low = low[:s] + " " + low[e:]
                at, bit = _place(h & (1 << 64) - 1)
                key = h if copies[at] & bit else None
                for word in {w for w in set(_WORD.findall(low)) if may_be(w)}:
                    held[word, key] = held.get((word, key), 0) + 1
                if len(held) >= HELD:
                    yield rows()
        if held:
            yield rows()

    found = texts.mapInArrow(run, "word string, hash long, texts long").groupBy("word", "hash").agg(F.sum("texts").alias("texts"))
    found = found.groupBy("word").agg(F.sum(F.when(F.col("hash").isNull(), F.col("texts")).otherwise(1)).alias("texts"))
    return found.join(asked, "word", "left_semi")


_WORD = re.compile(f"(?<![a-z])[a-z]{{{LETTERS[0]},{LETTERS[1]}}}(?![a-z])")


def value_costs(docs: DataFrame, values: DataFrame, text_col: str = "text") -> DataFrame:
    """(value, cost) of the different credential `values` of the table."""
    import pyarrow as pa

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                parts = sorted(parts_of(value))
                if parts:
                    yield pa.record_batch([pa.array([value] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["value", "word"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [value_cost(v, Ranks(dict(w or ()))) for v, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(costs, pa.float64())], names=["value", "cost"])

    parts = stored(values.mapInArrow(cut_up, "value string, word string"))
    counts = stored(word_texts(docs, parts.select("word").distinct(), text_col).where(F.col("texts") >= LEAST_TEXTS))
    # one of so many texts has the word, which makes it the n-th that a guesser tries
    n = docs.select(F.xxhash64(text_of(text_col)).alias("hash")).distinct().count()
    rank = F.ceil(F.lit(float(n)) / F.col("texts")).cast("long").alias("rank")
    known = join_frequent(parts, counts.select("word", rank), "word").groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("word", "rank"))).alias("words"))
    return values.join(known, "value", "left").select("value", "words").mapInArrow(judge, "value string, cost double")


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_cost: float = 11.0) -> DataFrame:
    """One row for each row of `docs`: the columns `keep`, counts by kind, base_sha256 of the spans found by
    pattern, all spans, and `costs`: start, end and guess cost (powers of ten) of every value of a credential context."""
    import pyarrow as pa

    source = docs.select(*keep, text_of(text_col).alias("\x01text"))
    kept = source.drop("\x01text").schema
    results = [f"n_{kind}" for kind in KINDS] + ["base_sha256", "spans", "costs"]
    if clash := set(results) & {k.lower() for k in keep}:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    span = "array<struct<start: int, kind: int, end: int>>"
    values = "array<struct<start: int, end: int, value: string, base: boolean>>"
    from pyspark.sql.types import StructType

    found_schema = StructType([*kept, *docs.sparkSession.createDataFrame([], f"`\x01row` string, `\x01base` {span}, `\x01values` {values}").schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = uuid.uuid4().hex, 0
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        value_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("base", pa.bool_())]))
        for batch in batches:
            bases, found = [], []
            for x in batch.column(batch.num_columns - 1):
                text = x.as_py()
                low = text.lower()
                base = _base(text, low)
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                found.append([{"start": s, "end": e, "value": v, "base": _meets(s, e, base)} for s, e, v in _values(text, low)])
            ids = [f"{task}-{n + k}" for k in range(batch.num_rows)]
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids), pa.array(bases, span_type), pa.array(found, value_type)], names=found_schema.fieldNames())

    rows = stored(source.mapInArrow(run, found_schema))
    some = rows.select("\x01row", F.explode("\x01values").alias("at")).select("\x01row", "at.*")
    different = stored(some.select("value").distinct())
    if different.isEmpty():
        judged = rows.withColumn("\x01judged", F.lit(None).cast("array<struct<start: int, end: int, cost: double, base: boolean>>"))
    else:
        costs = stored(value_costs(docs, different, text_col))
        judged = join_frequent(stored(some), costs, "value").groupBy("\x01row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "cost", "base"))).alias("\x01judged"))
        judged = rows.join(judged, "\x01row", "left")
    judged = judged.withColumn("\x01judged", F.coalesce("\x01judged", F.array().cast("array<struct<start: int, end: int, cost: double, base: boolean>>")))
    guessed = F.filter("\x01judged", lambda v: ~v["base"] & (v["cost"] >= min_cost))
    whole = F.array_sort(F.concat("\x01base", F.transform(guessed, lambda v: F.struct(v["start"].alias("start"), F.lit(3).alias("kind"), v["end"].alias("end")))))
    kind = F.array(*map(F.lit, KINDS))
    name = lambda spans: F.array_join(F.transform(spans, lambda v: F.concat_ws(":", F.get(kind, v["kind"]), v["start"], v["end"])), ",")
    of_kind = lambda k: F.size(F.filter("\x01base", lambda v: v["kind"] == k))
    count = [of_kind(k).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    costs = F.array_join(F.transform("\x01judged", lambda v: F.concat_ws(":", v["start"], v["end"], F.round(v["cost"], 3))), ",")
    return judged.select(*keep, *count, F.size(guessed).cast("long").alias("n_guess"), F.sha2(name("\x01base"), 256).alias("base_sha256"), name(whole).alias("spans"), costs.alias("costs"))
