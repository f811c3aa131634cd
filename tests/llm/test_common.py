from firnline.llm import neardup
from firnline.llm.common import cut, join_frequent
from firnline.llm.graph import components


def test_join_frequent_is_a_join(spark):
    rows = [(k % 7 if k % 2 else 3, k) for k in range(900)] + [(None, 1), (99, 2)]
    left = cut(spark.createDataFrame(rows, "key int, v int"))
    right = cut(spark.createDataFrame([(k, f"n{k}") for k in range(8)] + [(None, "none")], "key int, name string"))
    found = join_frequent(left, right, "key")
    assert found.columns == ["key", "v", "name"]
    assert sorted(map(tuple, found.collect())) == sorted((k, v, f"n{k}") for k, v in rows if k is not None and k < 8)
    assert join_frequent(left.limit(0), right, "key").isEmpty()


def test_join_frequent_on_a_struct(spark):
    left = cut(spark.range(500).selectExpr("named_struct('h', id % 2, 'g', 5L) as line", "id"))
    right = cut(spark.range(1).selectExpr("named_struct('h', id, 'g', 5L) as line", "'x' as name"))
    assert sorted(r["id"] for r in join_frequent(left, right, "line").collect()) == list(range(0, 500, 2))


def test_components_with_hubs(spark):
    star = [(1000, k) for k in range(1, 400)] + [(5000, k) for k in range(5001, 5300)]
    path = [(k, k + 1) for k in range(7000, 7040)] + [(7040, 5299)]
    links = spark.createDataFrame([*star, *path, (9000, 9000), (None, 4)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    want = {k: 1 for k in [1000, *range(1, 400)]} | {k: 5000 for k in [*range(5000, 5300), *range(7000, 7041)]}
    assert found == want  # a link to itself makes no node


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    from firnline.llm import graph

    rounds = []
    monkeypatch.setattr(graph, "join_frequent", lambda *a: rounds.append(1) or join_frequent(*a))
    links = spark.createDataFrame([(k * 7919 % 300, (k + 1) * 7919 % 300) for k in range(299)], "a long, b long")
    assert {r["root"] for r in components(links).collect()} == {0}
    assert len(rounds) <= 2 * 12


def test_small_tables_make_few_partitions(spark):
    """However many partitions a shuffle has, a round of few links is few tasks and files."""
    keys = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long"))
        assert {r.root for r in found.collect()} == {0, 100} and found.rdd.getNumPartitions() == 1
        docs = spark.createDataFrame([(k, f"{'same words over and over ' * 9} {k % 3}") for k in range(30)] + [(99, "other")], "doc_id long, text string")
        leave, _ = neardup.gone(docs)
        assert leave.count() == 27 and leave.rdd.getNumPartitions() == 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
