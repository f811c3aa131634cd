"""Token ids packed into rows of a fixed length (operator 2).

Documents are encoded, cut without loss into pieces of at most `length` ids, and packed by best-fit
decreasing: the longest piece first, each into the row with the least room that still holds it. A
segment tree over the amounts of room finds that row in log2(length) steps. A packed row is a line of
the id matrix, with cumulative segment lengths and positions that restart at 0 in every segment.

Packing takes place in blocks of `block_ids` ids in the order of the input's partitions: memory is
bounded, nothing is shuffled, and a task that runs again makes the same rows. So which pieces share a
row depends on how the input lies: another partitioning gives other rows (of the same ids), with other
pack_ids. A block of the default size is filled to a few thousandths, whichever documents it has.

Edge cases: null and empty texts are their begin and end ids; a document longer than a row fills rows
and leaves a rest that is packed like any piece, each piece with its offset; pieces of equal length go
in the order in which they come; repeated rows are packed each; ids of documents may have any type and
may be null; no documents make no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import text_of

MOST = 1 << 16


@lru_cache(maxsize=2)
def tokenizer(model_path: str):
    """One tokenizer for each worker process, the library's own: it needs no cache of words."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


class RoomTree:
    """Rows by their room, 0 to `most`, with search for the least room that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Row with the least room of at least `need`, and that room; the row leaves the tree."""
        k, count = need + self.size, self.count
        while not count[k]:
            while k & 1:  # up, till there is a right neighbour
                k >>= 1
            if not k:
                return None
            k |= 1
        while k < self.size:
            k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Which pieces go into which row."""
    tree, rows = RoomTree(length), []
    for piece in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        got = tree.take(sizes[piece])
        if got is None:
            got = len(rows), length
            rows.append([])
        row, room = got
        rows[row].append(piece)
        if room > sizes[piece]:
            tree.put(row, room - sizes[piece])
    return rows


def pack(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, block_ids: int = 1 << 22, pad: int = 0) -> DataFrame:
    """Packed rows: ids (little-endian, 16 bits, filled up with `pad` to `length`), n_ids without the filling,
    cu_seqlens, positions (16 bits, as long as ids), and of each segment the document and its offset there.

    pack_id: partition above, number in it below. `length` and the vocabulary are at most 65,536.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

    if not 0 < length <= MOST:
        raise ValueError(f"rows have 1 to {MOST} ids, not {length}")
    if tokenizer(model_path).get_piece_size() > MOST or not 0 <= pad < MOST:
        raise ValueError(f"ids are below {MOST}")
    fields = {"pack_id": LongType(), "n_ids": IntegerType(), "ids": BinaryType(), "cu_seqlens": ArrayType(IntegerType()), "positions": BinaryType(), "doc_ids": ArrayType(docs.schema[id_col].dataType), "offsets": ArrayType(LongType())}
    schema = StructType()
    for name, kind in fields.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        t = tokenizer(model_path)
        number = TaskContext.get().partitionId() << 33
        owners: list = []  # ids of the waiting documents, and their token ids
        coded: list[bytes] = []

        def packed():
            nonlocal number
            sizes = np.array([len(x) // 2 for x in coded])
            ids = np.frombuffer(b"".join(coded), "<u2")
            cuts = -(-sizes // length)
            doc = np.repeat(np.arange(len(sizes)), cuts)
            offset = length * (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
            size = np.minimum(length, sizes[doc] - offset)
            start = (np.cumsum(sizes) - sizes)[doc] + offset
            rows = best_fit(size.tolist(), length)
            held = pa.concat_arrays(owners)
            owners.clear()
            coded.clear()
            for k in range(0, len(rows), 512):
                part = rows[k : k + 512]
                n = np.array([len(row) for row in part])
                piece = np.concatenate([np.array(row) for row in part])
                long = size[piece]
                ends = np.cumsum(long)
                place = np.arange(ends[-1]) - np.repeat(ends - long, long)
                last = np.cumsum(n)
                used = np.add.reduceat(long, last - n)
                inside = np.arange(length) < used[:, None]
                matrix, at = np.full((len(part), length), pad, "<u2"), np.zeros((len(part), length), "<u2")
                matrix[inside] = ids[place + np.repeat(start[piece], long)]
                at[inside] = place
                cu = np.insert(ends - np.repeat(np.cumsum(used) - used, n), last - n, 0)
                edges = np.concatenate([[0], last]).astype(np.int32)
                columns = [
                    pa.array(np.arange(number, number + len(part))),
                    pa.array(used, pa.int32()),
                    pa.array([r.tobytes() for r in matrix], pa.binary()),
                    pa.ListArray.from_arrays(edges + np.arange(len(edges), dtype=np.int32), pa.array(cu, pa.int32())),
                    pa.array([r.tobytes() for r in at], pa.binary()),
                    pa.ListArray.from_arrays(edges, held.take(pa.array(doc[piece]))),
                    pa.ListArray.from_arrays(edges, pa.array(offset[piece], pa.int64())),
                ]
                number += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=list(fields))

        waiting = 0
        for batch in batches:
            first = 0
            for k, text in enumerate(batch.column(1)):
                coded.append(np.array(t.encode(text.as_py(), add_bos=True, add_eos=True), "<u2").tobytes())
                waiting += len(coded[-1]) // 2
                if waiting >= block_ids:
                    owners.append(batch.column(0).slice(first, k + 1 - first))
                    yield from packed()
                    first, waiting = k + 1, 0
            if first < batch.num_rows:
                owners.append(batch.column(0).slice(first))
        if coded:
            yield from packed()

    return docs.select(id_col, text_of(text_col).alias("\x01text")).mapInArrow(run, schema)
