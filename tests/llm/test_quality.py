import re
from collections import Counter

from firnline.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(wins)
    covered = {k + d for k, w in enumerate(wins) if n[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_are_the_brute_force_ones(odd):
    rows = quality.ledger(odd, keep=("doc_id", "text")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_repeats_symbols_and_policies(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good), (2, "a b c " * 30), (3, good.replace(" ", " ### ")), (4, "few words"), (5, None), (6, good.upper()), (7, "\n".join(["line one two three four five six"] * 9) + "\n" + good)]
    df = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("kept", quality.kept_by(quality.PROSE)).withColumn("base", quality.kept_by(quality.BASE))
    got = {r.doc_id: (r.base, r.kept) for r in df.collect()}
    assert got[1] == (True, True) and not got[2][0] and got[3] == (True, False) and not got[4][0] and not got[5][0] and got[6] == (True, False)
    table = {r.rule: (r.fails, r.removed_by_it_alone) for r in quality.ablations(df, quality.PROSE).collect()}
    assert table["few_words"] == (2, 2) and table["symbols"][0] == 1 and table["capitals"][1] == 1


def test_empty_table(empty):
    assert quality.ledger(empty).count() == 0


def test_letters_are_those_of_unicode():
    """Upper-case letters and letters by category, as the SQL twin counts them."""
    assert quality.measured("Ⅷ a")[6:] == (0, 1)
    assert quality.measured("É漢ß 😀 x² Ǆǅ")[6:] == (2, 6)


def test_names_that_clash_are_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        quality.ledger(spark.createDataFrame([(1, "x")], "n_words long, text string"), keep=("n_words",))
