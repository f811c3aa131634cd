import random

import pytest

VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "ko", "tri", "mel", "sun", "dor") for b in ("na", "li", "ret", "vos", "ky") for c in ("", "s", "ter", "nd", "le")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(VOCABULARY) for _ in range(n)]
    for k in range(11, n, 12):
        words[k] += "\n"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every edge case, and extra columns named as the operators name theirs."""
    rows = [(k, prose(k, 20 + 7 * k), f"site{k % 3}") for k in range(12)]
    rows += [(20, None, "site0"), (21, "", None), (22, " \n\t ", "site1"), (None, "no id here at all", "site1"), (23, prose(1, 27), "site2"), (24, "x" * 5000, "site0"), (25, "é漢字😀 " * 300, "site1"), (26, prose(5, 55) + " tail", "site1")]
    rows += [(3, prose(3, 41), "site0"), (3, prose(3, 41), "site0")]  # repeated rows
    extra = [(a, b, "en", c, len(b or ""), 1.0, "p", 7, b"", "s", 0) for a, b, c in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score double, print string, size int, ids binary, site string, rank int").coalesce(2)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
