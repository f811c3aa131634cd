import pytest
from pyspark.sql import functions as F

from firnline.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, list(names)
    while True:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] >= most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)


def test_targets_and_taken_words(spark):
    rows = [(k, " ".join(["w"] * (k % 37)), ["a", "b", "é", "Z", None][k * k % 5 if k % 3 else 0]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df, range_rows=200, source_rows=50).join(df, "doc_id").collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.times
        taken[r.source] += r.taken
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 80
    again = mixing.plan(df.repartition(7), range_rows=100, source_rows=31).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_mix_repeats_documents(spark, odd):
    plan = mixing.plan(odd).groupBy("doc_id").agg(F.max("times").alias("t")).collect()
    n = {r.doc_id: r.t for r in plan}
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    rows = {r.doc_id: r["count"] for r in odd.groupBy("doc_id").count().collect()}
    assert counts == {d: n[d] * rows[d] for d in n if n[d]}


def test_empty_and_wordless_tables(spark, empty):
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.plan(none).collect()] == [(0, 0.0, 0)] * 2
