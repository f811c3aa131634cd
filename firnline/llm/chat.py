"""Chat formatting as prefix trees (operator 12): turns that conversations share are emitted once, depth-first.

Every conversation is a path of turns. A turn's node is named by a digest of all turns up to it, so
conversations that begin alike share nodes. Distinct paths are sorted by their nodes, which is
depth-first order, by ranges; a task walks its range with one stack and emits what a path has beyond
the path before it. A row of the output is a piece of that walk of at most `capacity` tokens: token
ids, positions (a token's depth in its own conversation, not its place in the row), a loss mask over the
texts of assistants, and for each node the intervals of its ancestors in the row, to which its tokens
attend beside their own node. Where a row is full the next one starts anew, so that it can be read and
trained on by itself: there the ancestors of its first conversation stand again. In a row nothing
stands twice. A conversation longer than `capacity` has a row of its own; none is cut.

A turn reads `### role: text</turn>` and a new line. The strings of the template are escaped in texts and
roles by a backslash, and so are backslashes, so reading back is exact. Head, text and end of a turn are
encoded one by one with a byte-level vocabulary, so no token crosses the edge of a text.

Edge cases: a null text or role is empty; turns are sorted by turn (null first), then role and text,
and repeated rows are turns of their own; a row without conversation id is a conversation of one turn;
no rows give an empty table. A conversation has to fit in a row of a table, as its texts do.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_frequent, shuffle_parts, stored, text_of

#: The template.
HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
#: A role also ends at its colon.
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]++|\\(?:\\|###|</turn>|:))*+): ((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")
#: Tokens of a row.
CAPACITY = 1 << 16
#: Rows or conversations in one Arrow batch.
BATCH = 64

_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([("node", pa.binary()), ("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("ancestors", pa.list_(_SPAN))])
_LEAF = pa.struct([("leaf", pa.binary()), ("node", pa.int32())])
_ROW = pa.schema([("ids", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("nodes", pa.list_(_NODE)), ("leaves", pa.list_(_LEAF))])
ROW = "ids array<int>, positions array<int>, loss array<boolean>, nodes array<struct<node: binary, parent: int, start: int, end: int, position: int, ancestors: array<struct<start: int, end: int>>>>, leaves array<struct<leaf: binary, node: int>>"
_PATHS = "conv_id {}, leaf binary, path array<binary>, turns array<struct<role: string, text: string>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    return HEAD + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + AFTER_ROLE, escape(text), END


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@cache
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Trees:
    """`rows`: the packed walk; `members`: which leaf each conversation ends at (conv_id, leaf)."""

    rows: DataFrame
    members: DataFrame


def _paths(conversations: DataFrame) -> DataFrame:
    """One row a conversation: its id, the digests of its prefixes, its turns in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: tuple | None = None
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv is None or conv != now[0]:
                    if now:
                        done.append(now)
                        if len(done) >= BATCH:
                            yield _record(done, batch.schema.field(0).type, said_type)
                            done = []
                    now = (conv, [], [])
                said = role.encode(), text.encode()
                h = hashlib.blake2b(now[1][-1] if now[1] else b"", digest_size=16)
                h.update(len(said[0]).to_bytes(8, "little") + said[0] + said[1])
                now[1].append(h.digest())
                now[2].append((role, text))
        if now:
            done.append(now)
        if done:
            yield _record(done, batch.schema.field(0).type, said_type)

    kind = conversations.schema["conv_id"].dataType
    said_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    read = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), text_of("text").alias("text"), "turn")
    key = F.xxhash64("conv_id", F.when(F.col("conv_id").isNull(), F.xxhash64("role", "text")))
    placed = read.repartition(shuffle_parts(conversations), key).sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(rows, _PATHS.format(kind.simpleString()))


def _record(done: list[tuple], conv_type: pa.DataType, said_type: pa.DataType) -> pa.RecordBatch:
    said = pa.array([[{"role": r, "text": t} for r, t in d[2]] for d in done], said_type)
    return pa.record_batch([pa.array([d[0] for d in done], conv_type), pa.array([d[1][-1] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.list_(pa.binary())), said], names=["conv_id", "leaf", "path", "turns"])


class _Row:
    """One row of the output while it is being filled."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.positions: list[int] = []
        self.loss: list[bool] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.stack: list[int] = []

    def shared(self, path: list[bytes]) -> int:
        """How many nodes of `path` are on the stack."""
        n = 0
        while n < min(len(path), len(self.stack)) and self.nodes[self.stack[n]]["node"] == path[n]:
            n += 1
        return n

    def add(self, path: list[bytes], turns: list[list[tuple[list[int], bool]]]) -> None:
        """`turns`: the pieces (ids, under loss) of each node of `path` beyond those shared."""
        del self.stack[self.shared(path) :]
        for node, pieces in zip(path[len(self.stack) :], turns):
            up = self.nodes[self.stack[-1]] if self.stack else None
            start, position, spans = len(self.ids), 0, []
            if up:
                position = up["position"] + up["end"] - up["start"]
                spans = [*up["ancestors"], {"start": up["start"], "end": up["end"]}]
                if len(spans) > 1 and spans[-2]["end"] == spans[-1]["start"]:
                    spans[-2:] = [{"start": spans[-2]["start"], "end": spans[-1]["end"]}]
            for ids, loss in pieces:
                self.ids += ids
                self.loss += [loss] * len(ids)
            self.positions += range(position, position + len(self.ids) - start)
            self.nodes.append({"node": node, "parent": self.stack[-1] if self.stack else -1, "start": start, "end": len(self.ids), "position": position, "ancestors": spans})
            self.stack.append(len(self.nodes) - 1)
        self.leaves.append({"leaf": path[-1], "node": self.stack[-1]})

    def record(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"ids": self.ids, "positions": self.positions, "loss": self.loss, "nodes": self.nodes, "leaves": self.leaves}], _ROW)


def format_trees(conversations: DataFrame, vocabulary: str, pattern: str, *, capacity: int = CAPACITY, assistant: str = ASSISTANT) -> Trees:
    """Rows of at most `capacity` tokens, longer conversations apart. Columns: conv_id, turn, role, text.

    `vocabulary` is a file of byte-level ranks and `pattern` the expression that splits texts for it. Rows follow
    the ranges of the sort, so which conversations share a row depends on them; what a conversation reads does not.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        row = _Row()

        def pieces(turn: dict) -> list[tuple[list[int], bool]]:
            said = turn["role"] == assistant
            return [(encode(part), said and k == 1) for k, part in enumerate(turn_parts(turn["role"], turn["text"]))]

        for batch in batches:
            for path, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                turns = turns.as_py()
                k = row.shared(path)
                new = [pieces(t) for t in turns[k:]]
                if row.leaves and len(row.ids) + sum(len(ids) for t in new for ids, _ in t) > capacity:
                    yield row.record()
                    row, new = _Row(), [*(pieces(t) for t in turns[:k]), *new]
                row.add(path, new)
        if row.leaves:
            yield row.record()

    paths = stored(_paths(conversations))
    distinct = paths.select("leaf", "path", "turns").dropDuplicates(["leaf"])
    placed = distinct.repartitionByRange(shuffle_parts(conversations), "path").sortWithinPartitions("path")
    return Trees(placed.select("path", "turns").mapInArrow(pack, ROW), paths.select("conv_id", "leaf"))


def read_back(rows: DataFrame, vocabulary: str, pattern: str, *, assistant: str = ASSISTANT) -> DataFrame:
    """(leaf, formatted, turns, loss_text): every distinct conversation, read from `rows` alone.

    A conversation is what its last node attends to: the ancestors' intervals and the node itself.
    `loss_text` are the pieces under the loss mask, unescaped.
    """
    kinds = "leaf binary, formatted string, turns array<struct<role: string, text: string>>, loss_text array<string>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoding(vocabulary, pattern).decode_bytes
        turns_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for k in range(batch.num_rows):
                ids, loss, nodes, leaves = (batch.column(name)[k].as_py() for name in ("ids", "loss", "nodes", "leaves"))
                for some in (leaves[s : s + BATCH] for s in range(0, len(leaves), BATCH)):
                    out = []
                    for leaf in some:
                        node = nodes[leaf["node"]]
                        seen, mask = [], []
                        for span in [*node["ancestors"], node]:
                            seen += ids[span["start"] : span["end"]]
                            mask += loss[span["start"] : span["end"]]
                        formatted = decode(seen).decode()
                        edges = [0, *(i for i in range(1, len(mask)) if mask[i] != mask[i - 1]), len(mask)]
                        said = [unescape(decode(seen[a:b]).decode()) for a, b in zip(edges, edges[1:]) if b > a and mask[a]]
                        out.append((leaf["leaf"], formatted, [{"role": r, "text": t} for r, t in parse(formatted)], said))
                    yield pa.record_batch([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out]), pa.array([o[2] for o in out], turns_type), pa.array([o[3] for o in out], pa.list_(pa.string()))], names=["leaf", "formatted", "turns", "loss_text"])

    return rows.mapInArrow(read, kinds)


def per_conversation(trees: Trees, found: DataFrame) -> DataFrame:
    """`found`, which has a row for each `leaf`, for every conversation; leaves of many conversations come to them."""
    return join_frequent(stored(trees.members), stored(found), "leaf").drop("leaf")
