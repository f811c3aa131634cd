import random

import numpy as np
import public_tokenizers
import sentencepiece

from firnline.llm import packing

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_best_fit_is_the_brute_force_one():
    r = random.Random(4)
    for _ in range(30):
        sizes, length = [r.randint(1, 64) for _ in range(r.randint(0, 80))], 64
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [x for x in rooms if x >= s]
            rooms.remove(min(fits)) if fits else None
            rooms.append((min(fits) if fits else length) - s)
        rows = packing.best_fit(sizes, length)
        assert sorted(length - sum(sizes[p] for p in row) for row in rows) == sorted(rooms)
        assert sorted(p for row in rows for p in row) == list(range(len(sizes)))


def test_rows_hold_every_document_whole(spark, odd):
    rows = packing.pack(odd, MODEL, length=128, block_ids=2000).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = []
    for r in rows:
        ids, at = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(at) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids <= 128
        for a, b, doc, off in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.offsets):
            assert at[a:b].tolist() == list(range(b - a))
            pieces.append((str(doc), off, ids[a:b].tolist()))
    want = []
    for d in odd.collect():
        seq = [1, *sp.encode(d.text or ""), 2]
        want += [(str(d.doc_id), k, seq[k : k + 128]) for k in range(0, len(seq), 128)]
    assert sorted(pieces) == sorted(want)
    assert len({r.pack_id for r in rows}) == len(rows)


def test_empty_table(empty):
    assert packing.pack(empty, MODEL).count() == 0


def test_sizes_that_do_not_fit_are_refused(empty):
    import pytest

    for options in ({"length": 0}, {"length": 70_000}, {"pad": -1}):
        with pytest.raises(ValueError):
            packing.pack(empty, MODEL, **options)


def test_ids_may_be_strings(spark):
    df = spark.createDataFrame([("a", "some words"), (None, "more of them")], "doc_id string, text string")
    [row] = packing.pack(df.coalesce(1), MODEL, length=64).collect()
    assert sorted(row.doc_ids, key=str) == [None, "a"]


def test_tasks_keep_no_words(spark):
    from firnline.llm import sp_codec

    sp_codec.codec.cache_clear()
    rows = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert packing.pack(rows.coalesce(1), MODEL, length=16).collect()[0].n_ids == 2 * 2 + len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode("one two"))
    assert sp_codec.codec.cache_info().currsize == 0
