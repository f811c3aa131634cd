import hashlib

import xxhash
from pyspark.sql import functions as F

from firnline.llm import winnowing as w


def brute(hashes, window):
    """Positions of rightmost minima of all windows."""
    if not hashes:
        return []
    n = max(1, len(hashes) - window + 1)
    return sorted({max(j for j in range(i, min(len(hashes), i + window)) if hashes[j] == min(hashes[i : i + window])) for i in range(n)})


def test_picks_rightmost_minima_of_every_window(spark):
    texts = ["abcabcabc" * 30, "x" * 120, "the quick brown fox " * 20, "é漢字😀" * 40, "short", "", "a" * 16, "b" * 51, "c" * 52]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", w.fingerprint(F.col("t")).alias("f")).collect():
        have = [((1 << 31) - 1 - (x & ((1 << 31) - 1)), x >> 31) for x in r.f]
        g = rolling(r.t)
        assert have == [(p, g[p]) for p in brute(g, w.W)]


def rolling(text):
    """Hashes of all grams, one code point at a time: in comes the new one, out goes the one K before."""
    own = [xxhash.xxh64_intdigest(c.encode(), 42) for c in text]
    own += [0] * (w.K - len(own)) if own else []
    out, h = [], 0
    for k, c in enumerate(own):
        h = h << 1 ^ c ^ (own[k - w.K] << w.K if k >= w.K else 0)
        signed = (h + (1 << 63)) % (1 << 64) - (1 << 63)
        out.append(signed >> 31)
    return out[w.K - 1 :]


def test_edited_texts_and_neighbours(spark, odd):
    got = w.edited_pairs(odd).collect()
    rows = [(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()]
    rows.sort(key=lambda r: (*r[:2], xxhash.xxh64_intdigest(r[2].encode(), 42) ^ 1 << 63))
    assert len(got) == len(rows)
    expected = []
    for k, (_, _, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][2], len(t) // 2
        expected.append((len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == sorted(expected)
    df = spark.createDataFrame([(t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][2][: len(t) // 2],) for k, (_, _, t) in enumerate(rows)], "e string")
    whole = sorted(r[0] for r in df.select(w.shown(w.fingerprint(F.col("e")))).collect())
    assert sorted(r.edited_fingerprint for r in got) == whole
    by_text = {}
    for r in w.edited_pairs(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_a_shared_passage_shares_a_hash(spark):
    passage = "a passage of exactly fifty-one code points, no less!"[: w.K + w.W - 1]
    df = spark.createDataFrame([("qwerty uiop " * 9 + passage + " zz" * 40, "other words " * 7 + passage + "1234" * 30)], "a string, b string")
    assert df.select(w.likeness(w.fingerprint(F.col("a")), w.fingerprint(F.col("b")))).first()[0] > 0


def test_empty_table_and_single_row(spark, empty):
    assert w.edited_pairs(empty).count() == 0
    one = spark.createDataFrame([(1, "only one text here")], "doc_id long, text string")
    r = w.edited_pairs(one).first()
    assert r.near_next == 1.0
