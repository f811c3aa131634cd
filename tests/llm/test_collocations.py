import random
import re
from collections import Counter

import pytest

from firnline.llm import collocations


def brute(rows, max_n=3, least=10, share=50, most=2000):
    """The report from plain counts: rows of (lang, text)."""
    out = []
    for lang in {r[0] if r[0] is not None else "und" for r in rows}:
        f = Counter()
        for own, text in rows:
            if (own if own is not None else "und") != lang:
                continue
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
                words = re.findall(r"[^\x20\x09]+", piece)
                for n in range(1, max_n + 1):
                    f.update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        found = []
        for p in candidates:
            a = f[p]
            if any(len(q) > len(p) and 100 * f[q] >= share * a and any(q[k : k + len(p)] == p for k in range(len(q))) for q in candidates):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(v for p, v in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def corpus(seed, docs=60):
    r = random.Random(seed)
    words = ["Ann", "bob", "ÉTÉ", "été", "naïve", "x\x1cy", "漢字", "😀", "e", "-", "b\u00a0c", "Dé", "\x00", "new", "york", "city"]
    rows = []
    for _ in range(docs):
        parts = []
        for _ in range(r.randint(0, 60)):
            parts.append(r.choice(words) if r.random() < 0.7 else "new york city" if r.random() < 0.5 else "bob e")
            parts.append(r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "! "]))
        rows.append((r.choice(["en", "en", "fr", None, "und"]), "".join(parts)))
    return rows + [("en", None), ("en", ""), ("xx", " \t\n"), (None, "bob e " * 40)]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, rank int, words int").repartition(4)
    return sorted(tuple(r) for r in collocations.mine(df, **more).collect())


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"max_n": 4, "least": 5, "share": 80}), (3, {"max_n": 2, "least": 3, "most": 7}), (4, {"max_n": 5, "least": 2})])
def test_report_is_the_brute_force_one(spark, seed, options):
    want = brute(corpus(seed), **options)
    assert len(want) > 10 and mined(spark, corpus(seed), **options) == want


def test_small_holds_and_many_words_change_nothing(spark, monkeypatch):
    want = mined(spark, corpus(5))
    for name, value in (("HELD", 50), ("HELD_WORDS", 20), ("SLICE", 64), ("EMITTED", 7), ("SALTS", 2)):
        monkeypatch.setattr(collocations, name, value)
    assert mined(spark, corpus(5)) == want


def test_more_words_than_21_bits_tell_apart():
    import numpy as np

    parts = [np.array([5, (1 << 21) + 3, 5]), np.array([1 << 20, 7, 1 << 20]), np.array([2, 2, 2])]
    *keys, times = collocations._summed(collocations._pack(parts, 2), np.ones(3, np.int64))
    back = collocations._unpack(keys, 3, 2)
    assert sorted(zip(*(p.tolist() for p in back), times.tolist())) == [(5, 1 << 20, 2, 2), ((1 << 21) + 3, 7, 2, 1)]


def test_scores_are_exact_beyond_64_bits(spark):
    """The same Decimal expression as in `mine`, for counts that no table here reaches."""
    a, left, right = 987654321987, 999999999989, 999999999961
    got = spark.sql(f"select (cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0))) as s").first().s
    assert got == 1000000 * a * a // (left * right)


def test_edge_cases(spark, odd, empty):
    assert collocations.mine(empty).count() == 0
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in collocations.mine(odd, least=3).collect()) == brute(rows, least=3)
    with pytest.raises(ValueError):
        collocations.mine(odd, max_n=1)
