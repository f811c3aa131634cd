import random
import re
from collections import Counter

import pytest

from firnline.llm import divergence


def brute(rows, least=10, to=10):
    """The audit from plain counts: rows of (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, s, [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for lang, s, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, sources = Counter(), {r[1] for r in rows if r[0] == lang}
        for own, _, ts in found:
            docs.update(set(ts) if own == lang else ())
        kept = sorted(t for t, n in docs.items() if n >= least)
        counts = {s: Counter(t for own, x, ts in found if (own, x) == (lang, s) for t in ts) for s in sources}
        whole = sum(counts.values(), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: share(c) for s, c in counts.items()}
        q = share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}]
            named = [("term", t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part in (pairs, named):
                part = sorted(part, key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k + 1) for k, x in enumerate(part[: to if part is named or (part and part[0][0] == "term") else None])]
    return sorted(out)


def corpus(seed, docs=150):
    r = random.Random(seed)
    words = ["Ann", "bob", "ÉTÉ", "été", "naïve", "漢字", "😀", "e", "-", "b\u00a0c", "z9z", "\x7fdel", "Q"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for _ in range(docs):
        source = r.choice(["a", "a", "a", "b", "c", None, "", "ß", "Z"])
        some = words[: r.randint(3, len(words))]
        rows.append((r.choice(["en", "fr", None]), source, r.choice([" ", "_", "1"]).join(r.choice(some) for _ in range(r.randint(0, 40)))))
    return rows + [("en", "silent", None), ("de", "only", "one"), ("de", "other", ""), ("it", "alone", "x " * 30)]


def audited(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, rank int, docs int").repartition(4)
    return sorted(tuple(r) for r in divergence.audit(df, **more).collect())


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"least": 3, "terms_to": 4}), (3, {"least": 300})])
def test_audit_is_the_brute_force_one(spark, seed, options):
    rows = corpus(seed)
    want = brute(rows, options.get("least", 10), options.get("terms_to", 10))
    assert len(want) > 60 and audited(spark, rows, **options) == want


def test_narrow_sketches_and_small_holds_change_nothing(spark, monkeypatch):
    rows = corpus(4)
    want = audited(spark, rows)
    monkeypatch.setattr(divergence, "BLOCK", 8)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert audited(spark, rows, width=16) == want  # most rare terms pass a sketch of 16 counters
    assert audited(spark, rows, width=1 << 16) == want


def test_sketch_never_underestimates_and_discards_rare_terms(spark):
    rows = [("en", "a", " ".join(f"rare{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + d)} often" for k in range(300))) for d in range(12)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("lang", "source", "cast(text as binary) as text").repartition(3)
    reached = divergence._sketch(df, 1 << 16, 10)
    passes = lambda words: [all(reached[k][at[i]] for k, at in enumerate(divergence._places("en", words, 1 << 16))) for i in range(len(words))]
    assert passes([b"often"]) == [True]
    rare = [t.encode() for _, _, text in rows for t in text.split() if t != "often"]
    assert sum(passes(rare)) < len(rare) / 100


def test_counts_beyond_64_bits_are_exact(spark):
    n, v, c = 10**13 + 7, 123457, 10**12 + 3
    df = spark.createDataFrame([(c, n, v)], "c long, n long, v long")
    assert df.select(divergence._share("c", "n", "v").alias("p")).first().p == 1 + 1000000000 * (c + 2) // (n + 2 * v)


def test_edge_cases(spark, odd, empty):
    assert divergence.audit(empty).count() == 0
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.audit(odd, least=3).collect()) == brute(rows, least=3)
