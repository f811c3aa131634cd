import random
import re

import numpy as np
import xxhash

from firnline.llm import simhash


def slow_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(prints, ids, radius=3):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a + 1, len(prints)):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                root[find(b)] = find(a)
    low = {}
    for k, d in enumerate(ids):
        low[find(k)] = min(low.get(find(k), d), d)
    return [low[find(k)] for k in range(len(ids))]


def test_fingerprints(spark, odd):
    for r in simhash.fingerprints(odd.select("doc_id", "text")).join(odd.select("doc_id", "text").dropDuplicates(), "doc_id").collect():
        assert r.print & (1 << 64) - 1 == slow_print(r.text)


def test_links_match_brute_force_in_all_layouts(spark):
    r = random.Random(5)
    prints = set()
    for _ in range(60):
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(r.randint(0, 12)):
            y = x
            for _ in range(r.randint(1, 4)):
                y ^= 1 << r.randrange(64)
            prints.add(y)
            x = r.choice([x, y])
    for _ in range(120):  # many that agree on 16 bits
        prints.add(r.getrandbits(48))
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    want = brute(prints, signed)
    df = spark.createDataFrame([(x,) for x in signed], "print long")
    from firnline.llm.graph import components

    for options in ({}, {"meet": 0.002}, {"tile_rows": 16, "task_rows": 200}):
        roots = {r.node: r.root for r in components(simhash.links(df, **options)).collect()}
        assert [roots.get(x, x) for x in signed] == want


def test_groups_and_keeping_one(spark, odd, empty):
    rows = simhash.groups(odd).collect()
    assert len(rows) == odd.count()
    known = sorted((r.doc_id, r.print & (1 << 64) - 1, r.component_id) for r in rows if r.doc_id is not None)
    want = brute([p for _, p, _ in known], [d for d, _, _ in known])
    assert [c for _, _, c in known] == want
    assert simhash.groups(empty).count() == 0


def test_long_text_in_blocks():
    words = " ".join(f"t{k % 977}" for k in range(5000))
    assert simhash.fingerprint(words, block=100) == simhash.fingerprint(words)
    assert np.uint64(simhash.fingerprint("One two")) == np.uint64(slow_print("One two"))


def test_tiles_that_are_skipped_have_no_link():
    """In one tile, the blocks whose population counts are too far apart: most of them, and none with a pair."""
    r = random.Random(9)
    prints = np.array(sorted((r.getrandbits(64) & r.getrandbits(64) if k % 2 else r.getrandbits(64) | r.getrandbits(64) for k in range(4000)), key=lambda x: bin(x).count("1")), np.uint64)
    pop, group, block = np.bitwise_count(prints).astype(int), np.zeros(4000, int), 256
    pairs = [(a, b) for a in range(0, 4000, block) for b in range(a, 4000, block)]
    skip = [(a, b) for a, b in pairs if simhash.skipped(group, pop, a, min(a + block, 4000), b, 3)]
    assert len(skip) > len(pairs) / 3
    for a, b in skip:
        assert (np.bitwise_count(prints[a : a + block, None] ^ prints[None, b : b + block]) > 3).all()
