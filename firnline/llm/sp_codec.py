"""SentencePiece encoding and decoding by a merge-type prefix table (operator 9).

A byte-pair encoding has one property that the encoder here rests on: a sequence of pieces is the
encoding of its text exactly if each two neighbours are, taken alone, the encoding of theirs. So for
each prefix of a text there is one last piece, and it is the one that (a) ends there, as an automaton
over all pieces reports, and (b) is compatible with the last piece of the prefix before it. Filling
that table is linear in the text; the ids are then read backwards from its end.

No piece of the vocabulary continues past a space into the next word, so the table is filled for each
word (with its space) by itself and kept in a bounded cache. A new word is first tried as a known one and
a short rest: if the last piece of the one and the first of the other are compatible, their encodings in
a row are the word's. The cache saves time only: what it has dropped is computed again.

Edge cases: a null or empty text encodes to begin and end ids and decodes to ''. U+2581 in a text is
the escaped space and decodes to a space, as in the library. Very long words take linear time.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words in each of a cache's two generations, and pairs that a worker keeps before it starts afresh.
CACHE_WORDS = 150_000
CACHE_PAIRS = 500_000
#: Rows of one batch of results, which may hold all ids of their texts.
ROWS = 500
#: Characters at the end of a word that may be the rest behind a known word.
REST = 6


class Words:
    """Ids of words in two generations: a full young one becomes the old one, and words that are met again move back."""

    __slots__ = ("young", "old")

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, word: str, ids: bytes) -> None:
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = ids


class PieceCodec:
    """Encoder and decoder of one byte-fallback BPE model file."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id = [self.unk] * 256
        self.surface: list[bytes] = [b""] * n
        self.is_byte = set()
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.is_byte.add(i)
                self.surface[i] = bytes([value])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.score[piece] = model.get_score(i)
                self.id_of[piece] = i
                self.surface[i] = piece.replace(SPACE, " ").encode()
        self.leads_with_space = {i for p, i in self.id_of.items() if p.startswith(SPACE)}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece goes on past a space; words can't be encoded one by one")
        #: A line break in no piece separates as a space does.
        self.line_breaks = not any("\n" in p for p in self.id_of)
        self.numbers: dict[str, int] = {}
        self.tokens: list[str] = []
        self.sizes: list[int] = []
        self.packed: list[bytes] = []
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            if len(piece) > 1 and self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (self.number(piece), len(piece)))
        self.automaton.make_automaton()
        #: Place in `tokens` of the piece with an id; None for bytes and controls.
        self.number_of = [None] * n
        for piece, i in self.id_of.items():
            self.number_of[i] = self.number(piece)
        self.spines: dict[str, tuple[list[str], list[str]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.spaced, self.bare = Words(), Words()

    def merged(self, text: str) -> list[str]:
        """The encoding by definition: merge the best-scored neighbours, leftmost of equals, till none fit."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def history(self, piece: str) -> tuple[list[str], list[str]] | None:
        """What stands at the left and at the right end of `piece` while it is merged, in order.

        None where a step's score is not below that of the step before: the order of the merges at
        one end can then depend on what happens elsewhere in the piece.
        """
        if piece not in self.spines:
            left, right, ok, last = [piece[0]], [piece[-1]], True, None
            parts = list(piece)
            while len(parts) > 1:
                s, k = max((self.score.get(parts[k] + parts[k + 1], float("-inf")), -k) for k in range(len(parts) - 1))
                ok, last = ok and (last is None or s <= last), s
                parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
                left += [parts[0]] * (parts[0] != left[-1])
                right += [parts[-1]] * (parts[-1] != right[-1])
            self.spines[piece] = (left, right) if ok else None
        return self.spines[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether `left` and `right` are the encoding of their text: no merge across their border comes
        before the merges that take the symbols at the border further into their own pieces."""
        one, two = self.history(left), self.history(right)
        if one is None or two is None:
            return self.merged(left + right) == [left, right]
        ends, starts, score, none = one[1], two[0], self.score, float("-inf")
        i = j = 0
        while True:
            own = score[ends[i + 1]] if i + 1 < len(ends) else none
            other = score[starts[j + 1]] if j + 1 < len(starts) else none
            across = score.get(ends[i] + starts[j])
            if across is not None and across > own and across >= other:
                return False
            if own == other == none:
                return True
            i, j = (i + 1, j) if own >= other else (i, j + 1)

    def number(self, token: str) -> int:
        """Place of a piece, or of a character that is no piece, in `tokens`."""
        k = self.numbers.get(token)
        if k is None:
            k = self.numbers[token] = len(self.tokens)
            self.tokens.append(token)
            self.sizes.append(len(token))
            i = self.id_of.get(token)
            self.packed.append(struct.pack("<I", i) if i is not None else b"".join(struct.pack("<I", self.byte_id[x]) for x in token.encode()))
        return k

    def _ids(self, word: str) -> bytes:
        """Ids of a word: the last token of every prefix, then the way back."""
        last: list[int] = []
        settled, pairs, numbers = 0, self.pairs, self.numbers
        for end, (token, size) in self.automaton.iter(word):  # by end, longest first
            if end < settled:
                continue
            while settled < end:  # nothing longer than a character fits there
                char = word[settled]
                last.append(numbers[char] if char in numbers else self.number(char))
                settled += 1
            if end >= size:
                before = last[end - size]
                fits = pairs.get(before << 32 | token)
                if fits is None:
                    fits = self._fits(before, token)
                if not fits:
                    continue
            last.append(token)
            settled += 1
        for char in word[settled:]:
            last.append(self.number(char))
        out, at, sizes, packed = [], len(word), self.sizes, self.packed
        while at:
            k = last[at - 1]
            out.append(packed[k])
            at -= sizes[k]
        out.reverse()
        return b"".join(out)

    def _fits(self, before: int, token: int) -> bool:
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        found = self.pairs[before << 32 | token] = self.compatible(self.tokens[before], self.tokens[token])
        return found

    def _known_and_rest(self, cache: Words, word: str) -> bytes | None:
        """The ids of a word that begins with one in `cache`, if the rest's ids may follow that one's."""
        number_of, young, old, rests = self.number_of, cache.young, cache.old, self.bare.young
        for k in range(len(word) - 1, max(1, len(word) - REST) - 1, -1):
            one = young.get(word[:k]) or old.get(word[:k])
            if one:
                two = rests.get(word[k:]) or self._word(self.bare, "", word[k:])
                before, token = number_of[int.from_bytes(one[-4:], "little")], number_of[int.from_bytes(two[:4], "little")]
                if before is not None and token is not None:
                    fits = self.pairs.get(before << 32 | token)
                    if self._fits(before, token) if fits is None else fits:
                        return one + two
        return None

    def _word(self, cache: Words, lead: str, word: str) -> bytes:
        got = cache.young.get(word)
        if got is None:
            got = cache.old.get(word)
            if got is None:
                got = (self._known_and_rest(cache, word) if len(word) > 2 else None) or self._ids(lead + word)
            if len(word) <= 64:
                cache.put(word, got)
        return got

    def encode(self, text: str) -> bytes:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        newline = struct.pack("<I", self.byte_id[10])
        spaced, bare = self.spaced, self.bare
        for k, line in enumerate(text.split("\n") if self.line_breaks else [text]):
            if k:
                out.append(newline)
            if SPACE in line or "  " in line or line[-1:] == " " or line[:1] == " ":
                # runs of spaces are pieces of their own and go before the word that follows
                whole = (SPACE if k == 0 else "") + line.replace(" ", SPACE)
                at, n = 0, len(whole)
                while at < n:
                    stop = at
                    while stop < n and whole[stop] == SPACE:
                        stop += 1
                    stop = whole.find(SPACE, stop)
                    stop = n if stop < 0 else stop
                    out.append(self._word(bare, "", whole[at:stop]))
                    at = stop
                continue
            words = line.split(" ")
            if k and words[0]:
                out.append(self._word(bare, "", words[0]))
            if k == 0 and not words[0]:  # an empty first line still has the leading space
                out.append(self._word(spaced, SPACE, ""))
            words = words[1:] if k or not words[0] else words
            found = list(map(spaced.young.get, words))
            if None in found:
                found = [self._word(spaced, SPACE, word) if got is None else got for word, got in zip(words, found)]
            out += found
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids; control ids vanish, bytes that are no UTF-8 become U+FFFD one by one."""
        surface, seq = self.surface, memoryview(ids).cast("I")
        first = next((i for i in seq if surface[i] or i in self.is_byte), None)
        whole = b"".join([surface[i] for i in seq])
        try:
            text = whole.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(seq)
        return text[1:] if first in self.leads_with_space else text

    def _decode_runs(self, seq) -> str:
        out, run = [], bytearray()
        for i in [*seq, None]:
            if i in self.is_byte:
                run += self.surface[i]
                continue
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """One codec for each worker process."""
    return PieceCodec(model_path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """One row for each row of `docs`: the columns `keep`, n_tokens, ids (if asked for), ids_sha256, decoded_sha256.

    ids are little-endian unsigned 32-bit integers with begin and end ids. Rows are independent: no
    shuffle, memory for one document at a time besides the caches.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("\x01text"))
    fields = StructType(source.schema.fields[:-1])
    added = "n_tokens long, " + "ids binary, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    clash = {x.split()[0] for x in added.split(", ")} & set(keep)
    if clash:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    schema = fields
    for x in added.split(", "):
        schema = schema.add(*x.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        head, tail = struct.pack("<I", c.bos), struct.pack("<I", c.eos)
        for batch in (part for whole in batches for part in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS))):
            col = batch.column(batch.num_columns - 1)
            n, ids, sha, back = [], [], [], []
            for k in range(batch.num_rows):
                seq = head + c.encode(col[k].as_py()) + tail
                n.append(len(seq) // 4)
                sha.append(hashlib.sha256(seq).hexdigest())
                back.append(hashlib.sha256(c.decode(seq).encode()).hexdigest())
                if with_ids:
                    ids.append(seq)
            cols = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(n, pa.int64())]
            cols += [pa.array(ids, pa.binary())] * with_ids + [pa.array(sha, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return source.mapInArrow(run, schema)
