import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from firnline.llm import mixing, toxicity
from firnline.llm.queries import TOXIC, toxicity_model

from .test_neardup import likeness, shingles

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns) and out.dtypes == docs.dtypes
        docs = out.checkpoint()
        if name == "toxicity":
            assert 0.5 * n < docs.count() < n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


@pytest.mark.parametrize("name", ["without_toxic", "without_boilerplate", "without_near_duplicates", "mixed"])
def test_stages_take_odd_and_empty_tables(spark, odd, empty, name):
    stage = getattr(corpus_pipeline, name)
    assert stage(spark, empty, SF).count() == 0
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns and out.count() <= 2 * odd.count()


def test_encoding_takes_odd_and_empty_tables(spark, odd, empty):
    assert corpus_pipeline.encoded(spark, empty, SF).count() == 0
    assert corpus_pipeline.encoded(spark, odd, SF).count() == odd.count()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_are_their_operators(spark):
    """Each stage, held against a plain version of what it does, row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity_model(spark, docs, SF)).select("doc_id", "score").collect()}
    clean = corpus_pipeline.without_toxic(spark, docs, SF)
    assert rows_of(clean) == rows_of(docs.where(~F.col("doc_id").isin(*[d for d, s in scores.items() if s >= TOXIC])))

    white = " \t\n\x0b\x0c\r"
    sites, first = {}, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        for k, line in enumerate((r.text or "").split("\n")):
            if line.strip(white):
                sites.setdefault(line.strip(white), set()).add(r.source)
                first.setdefault(line.strip(white), (r.doc_id, k))
    wide = {line for line, s in sites.items() if len(s - {None}) >= 8}
    want = {r.doc_id: None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if x.strip(white) not in wide or first[x.strip(white)] == (r.doc_id, k)) for r in docs.collect()}
    got = {r.doc_id: r for r in corpus_pipeline.without_boilerplate(spark, docs, SF).collect()}
    assert {d: r.text for d, r in got.items()} == want and any(want[r.doc_id] != r.text for r in docs.collect())
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)

    texts = sorted((r.doc_id, shingles(r.text)) for r in docs.collect())
    root = {d: d for d, _ in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(texts):
        for b, y in texts[:i]:
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and likeness(x, y) >= 0.8 - 1e-9 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    kept = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert rows_of(kept) == rows_of(docs.where(F.col("doc_id").isin(*[d for d in root if find(d) == d])))
    assert kept.count() < docs.count()

    times = {r.doc_id: r.times for r in mixing.plan(docs).collect()}
    assert Counter(r.doc_id for r in corpus_pipeline.mixed(spark, docs, SF).collect()) == Counter({d: n for d, n in times.items() if n})

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in corpus_pipeline.encoded(spark, docs, SF).collect():
        ids = sp.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_every_stage_is_computed_once(spark, monkeypatch):
    plans, stored = [], corpus_pipeline.stored

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(corpus_pipeline, "stored", noted)
    last = corpus_pipeline.run(spark, SF)
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == len(corpus_pipeline.STAGES)
    assert [("ArrowEvalPython" in p, "MapInArrow" in p) for p in plans] == [(True, False), (False, False), (False, False), (False, False), (False, True)]
    assert last.count() > 0
