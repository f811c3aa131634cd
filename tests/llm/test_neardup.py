import random

from firnline.llm import neardup

from .conftest import VOCABULARY, prose


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    r, texts = random.Random(11), []
    for k in range(60):
        base = prose(1000 + k, r.randint(30, 300)).split()
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            near = list(base)
            for _ in range(max(1, int(len(near) * r.choice([0.005, 0.01, 0.02, 0.03, 0.06])))):
                near[r.randrange(len(near))] = r.choice(VOCABULARY) + "x"
            texts.append(" ".join(near))
    texts += [texts[0]] * 40 + [texts[5].upper()]
    return list(enumerate(texts))


def test_one_of_each_group_stays(spark):
    rows = corpus()
    root, sets = list(range(len(rows))), [shingles(t) for _, t in rows]

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if likeness(sets[a], sets[b]) >= 0.8 - 1e-9 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {k for k in range(len(rows)) if find(k) == k}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in neardup.keep_one(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_refused_pairs_are_searched_again(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MARGIN", 0.3)  # nearly all pairs that meet are candidates
    test_one_of_each_group_stays(spark)


def test_large_tiles_are_dealt_out(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    nodes = neardup.sketches(df, "doc_id", "text", 5).dropDuplicates(["node"]).drop("id").cache()
    texts = df.select(neardup.F.xxhash64("text").alias("node"), "text")
    a, b = ({frozenset(x) for x in groups(neardup.near_copies(nodes, texts, **o))} for o in ({}, {"tile_rows": 3, "task_rows": 50}))
    assert a == b and a


def groups(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.root, set()).add(r.node)
    return out.values()


def test_edge_cases(spark, odd, empty):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    # the blank texts are one group, rows of one id and text are one document
    assert len(ids) == len(set(ids)) and 20 in ids and not {21, 22} & set(ids) and None in ids and 3 in ids
    assert neardup.keep_one(empty).count() == 0
