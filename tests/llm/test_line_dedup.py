from collections import defaultdict

from firnline.llm import line_dedup


def brute(rows, least):
    """(id, text) to line numbers that go."""
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            x = line.strip(" \t\n\r\x0b\x0c")
            if x:
                if s is not None:
                    sites[x].add(s)
                at = (d is None, d or 0, k)
                first[x] = min(first.get(x, (at, t)), (at, t), key=lambda v: v[0])
    out = {}
    for d, t, s in rows:
        out[d, t] = [k for k, line in enumerate((t or "").split("\n")) if len(sites[x := line.strip(" \t\n\r\x0b\x0c")]) >= least and x and (first[x][0] != (d is None, d or 0, k))]
    return out


def table(spark):
    rows = []
    for k in range(60):
        lines = [f"own line {k}", f"site menu of {k % 12}", "  Licensed to all " if k % 5 else "Licensed to all", "", f"shared by {k % 3}"]
        rows.append((k, "\n".join(lines[k % 2 :]), f"s{k % 12}"))
    rows += [(70, None, "s1"), (71, "", "s2"), (None, "Licensed to all\nmine", "s3"), (72, "Licensed to all", None), (5, rows[5][1], "s5")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_lines_on_many_sites_go_but_the_first(spark):
    rows, df = table(spark)
    for least in (4, 8, 12):
        want = brute(rows, least)
        got = line_dedup.report(df, least_sites=least).collect()
        assert sorted(str((r.doc_id, list(r.removed))) for r in got) == sorted(str((d, want[d, t])) for d, t, _ in rows)
        texts = line_dedup.remove(df.withColumnRenamed("source", "site"), site_col="site", least_sites=least).collect()
        left = sorted(str((d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d, t]))) for d, t, _ in rows)
        assert sorted(str((r.doc_id, r.text)) for r in texts) == left


def test_edge_cases(odd, empty):
    out = line_dedup.remove(odd, length_col="n_chars")
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.report(empty).count() == 0 and line_dedup.remove(empty).count() == 0
