import math
import random
from collections import Counter

from pyspark.sql import functions as F

from firnline.llm import toxicity

from .conftest import VOCABULARY


def corpus(spark, n=900):
    r = random.Random(2)
    rows = []
    for k in range(n):
        words = [r.choice(VOCABULARY) + r.choice(VOCABULARY) for _ in range(r.randint(20, 200))]
        bad = r.random() < 0.2
        if bad:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["grumblox", "snarfy", "zonkhead"]) + r.choice(["", "s", "er"]))
        rows.append((k, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(2)
    return df


def test_held_out_documents_are_told_apart(spark):
    df = corpus(spark)
    train = df.where("doc_id % 3 <> 1").select("doc_id", "toxic")
    model = toxicity.train(df.drop("toxic"), train)
    rows = toxicity.score(df, model).where("doc_id % 3 = 1").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    wrong = sum((r.score >= 0.7) != bool(r.toxic) for r in rows)
    assert wrong <= 0.03 * len(rows)
    again = {r.doc_id: r.score for r in toxicity.score(df, toxicity.train(df.drop("toxic").repartition(3), train)).where("doc_id % 3 = 1").collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_edge_cases(spark, odd, empty):
    df = corpus(spark, 300)
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    rows = toxicity.score(odd, model, name="judged").collect()
    assert len(rows) == odd.count() and all(0 <= r.judged <= 1 for r in rows)
    assert toxicity.score(empty, model, name="judged").count() == 0
    labels = df.select("doc_id", F.lit(0).alias("toxic"))
    assert toxicity.train(df.drop("toxic"), labels) is None
    assert toxicity.train(df.drop("toxic"), labels.withColumn("toxic", F.lit(None).cast("int"))) is None
    assert {r.score for r in toxicity.score(df.drop("score"), None).collect()} == {0.0}


def test_a_table_of_any_size_gives_the_same_scores(spark, odd):
    df = corpus(spark, 300)
    labels = df.select("doc_id", "toxic")
    small, large = (toxicity.train(df.drop("toxic"), labels, broadcast_grams=n) for n in (10**6, 0))
    assert small.shared is not None and large.shared is None
    rows = df.select("doc_id", "text").union(odd.select("doc_id", "text")).union(df.select("doc_id", "text").limit(20))
    a, b = ([(r.doc_id, r.text, r.score) for r in toxicity.score(rows, m).collect()] for m in (small, large))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    assert len(a) == len(b) == rows.count()
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-9


def brute_ratios(words):
    """Log-likelihood ratio of every n-gram of a word list [(word, toxic)] by the textbook, with dictionaries."""
    n = toxicity.ORDER
    counts = [Counter(), Counter()]
    for word, toxic in words:
        whole = toxicity.BEGIN + word + toxicity.END
        for k in range(2, len(whole) + 1):
            counts[toxic][whole[max(0, k - n) : k]] += 1
    grams = set(counts[0]) | set(counts[1])
    share = {}
    level, letters = {g for g in grams if len(g) == n}, None
    lower = {}
    for o in range(n - 1, 0, -1):
        level |= {g for g in grams if len(g) == o + 1 and g[0] == toxicity.BEGIN}
        lower[o] = Counter(g[1:] for g in level)
        level = set(lower[o])
    letters = 1 / (len(lower[1]) + 1)
    for o in range(1, n):
        c = lower[o]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
        for g, v in c.items():
            same = [x for h, x in c.items() if h[:-1] == g[:-1]]
            share[g] = (max(v - d, 0) + d * len(same) * share.get(g[1:], letters)) / sum(same) if o > 1 else (max(v - d, 0) + d * len(same) * letters) / sum(same)

    def discount(c, v):
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        k = min(v, 3)
        raw = k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k
        return min(k - 0.02, max(0.1, raw))

    def probability(c, g, below, prior):
        same = {h: x for h, x in c.items() if h[:-1] == g[:-1]}
        total = sum(same.values()) + prior
        own = (c[g] - discount(c, c[g])) / total if c[g] else 0.0
        return own + (sum(discount(c, x) for x in same.values()) + prior) / total * below

    both = counts[0] + counts[1]
    out = {}
    for g in grams:
        if all(any(h[:-1] == g[:-1] for h in c) for c in counts):
            base = probability(both, g, share.get(g[1:], letters), 0)
            p, q = (probability(counts[k], g, base, toxicity.PRIOR) for k in (1, 0))
            out[g] = math.log(p / q)
    return out


def test_ratios_are_the_textbook_ones(spark):
    r = random.Random(7)
    words = [("".join(r.choice("abcde") for _ in range(r.randint(1, 7))), int(r.random() < 0.4)) for _ in range(150)]
    count = Counter(words)
    df = spark.createDataFrame([(w, c if t else 0, 0 if t else c) for (w, t), c in count.items()], "word string, toxic long, plain long")
    grams = df.select("toxic", "plain", F.explode(toxicity._grams(F.col("word"))).alias("gram")).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    model = toxicity.fit(grams.cache())
    got, want = {r.gram: r.ratio for r in model.grams.collect()}, brute_ratios(words)
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    tables = toxicity.Tables(model.grams.toArrow(), model.contexts.toArrow())
    for word in {w for w, _ in words}:
        whole = toxicity.BEGIN + word + toxicity.END
        known = sum(want.get(whole[max(0, k - toxicity.ORDER) : k], 0) for k in range(2, len(whole) + 1))
        assert abs(tables.words([word])[0] - known) < 1e-9
