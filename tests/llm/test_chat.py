import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from firnline.llm import chat

VOCABULARY = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
ODD = ["", "\\", "\\\\", "###", "####", "</turn>", "</turn", "\n### user: x</turn>\n", "\\### assistant: </turn> ok", ": ", "<</turn>", "é漢😀 ", "a" * 300, "\\:", "\x00"]


@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from("\\#</turn>: \nab")), st.text(alphabet=st.sampled_from("\\#</turn>: \nab"))), max_size=5))
@settings(max_examples=300, deadline=None)
def test_template_reads_back_any_turns(turns):
    assert chat.parse("".join("".join(chat.turn_parts(*t)) for t in turns)) == turns


def conversations(seed=2):
    r = random.Random(seed)
    rows, said = [], lambda: r.choice(ODD) + r.choice(["yes", "no", "maybe", "###"])
    begins = [[("system", "be brief"), ("user", "hello")], [("system", "be brief")], [("user", ODD[8]), ("assistant", ODD[8])], []]
    for c in range(80):
        turns = list(r.choice(begins)) + [(("user", "assistant")[k % 2], said()) for k in range(r.randint(1, 5))]
        for copy in range(1 if c % 7 else 4):
            rows += [(100 * copy + c, k, role, text, "x") for k, (role, text) in enumerate(turns)]
    rows += [(900, k, "user" if k % 2 else "assistant", f"turn {k}", "x") for k in range(300)]  # long
    rows += [(901, 0, None, None, "x"), (902, None, "user", "late", "x"), (902, 0, "assistant", "b", "x"), (902, 0, "assistant", "a", "x"), (902, 0, "assistant", "a", "x"), (903, 0, "us:er", "a: b", "x"), (None, 0, "user", "stray", "x"), (None, 0, "user", "stray", "x"), (904, 0, "assistant", "", "x")]
    return rows


def paths(rows):
    """Turns by conversation; each row without id is one of its own."""
    out, strays = {}, 0
    for conv, turn, role, text, _ in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        if conv is None:
            strays += 1
            conv = ("stray", strays)
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


@pytest.fixture(scope="module", params=[200, 1 << 16])
def trees(request, spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn int, role string, text string, path string").repartition(5)
    t = chat.format_trees(df, *VOCABULARY, capacity=request.param)
    return request.param, chat.Trees(t.rows.cache(), t.members.cache())


def test_every_conversation_reads_back(trees):
    _, t = trees
    want = paths(conversations())
    found = chat.per_conversation(t, chat.read_back(t.rows, *VOCABULARY)).collect()
    assert len(found) == len(want)
    for r in found:
        turns = [(x.role, x.text) for x in r.turns]
        assert turns in want.values() if r.conv_id is None else turns == want[r.conv_id]
        assert r.formatted == "".join("".join(chat.turn_parts(*x)) for x in turns)
        assert "".join(r.loss_text) == "".join(text for role, text in turns if role == "assistant")


def test_rows_are_bounded_depth_first_and_hold_each_turn_once(trees):
    capacity, t = trees
    rows = t.rows.collect()
    for r in rows:
        n = len(r.ids)
        assert len(r.positions) == len(r.loss) == n and len({x.node for x in r.nodes}) == len(r.nodes)
        assert n <= capacity or len(r.leaves) == 1
        end, open_ = 0, []
        for k, x in enumerate(r.nodes):
            assert x.start == end and x.end > x.start
            end = x.end
            while open_ and open_[-1] != x.parent:
                open_.pop()  # depth-first: a parent is still open
            assert (x.parent == -1) == (not open_)
            above = [r.nodes[p] for p in open_]
            seen = [i for s in x.ancestors for i in range(s.start, s.end)]
            assert seen == [i for p in above for i in range(p.start, p.end)]
            assert x.position == len(seen) and r.positions[x.start : x.end] == list(range(len(seen), len(seen) + x.end - x.start))
            assert all(a.end < b.start for a, b in zip(x.ancestors, x.ancestors[1:]))
            open_.append(k)
        assert end == n
    if capacity > 10000:
        prefixes = {tuple(turns[:k]) for turns in paths(conversations()).values() for k in range(1, len(turns) + 1)}
        assert len(prefixes) <= sum(len(r.nodes) for r in rows) <= len(prefixes) + 3 * len(rows)  # only ancestors of a row's first conversation stand again


def test_loss_covers_what_assistants_say(trees):
    _, t = trees
    decode = chat._encoding(*VOCABULARY).decode
    for r in t.rows.collect():
        for x in r.nodes:
            (role, text), = chat.parse(decode(r.ids[x.start : x.end]))
            said = [i for i in range(x.start, x.end) if r.loss[i]]
            assert decode([r.ids[i] for i in said]) == (chat.escape(text) if role == "assistant" else "")


def test_edge_cases(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    t = chat.format_trees(df, *VOCABULARY)
    assert t.rows.count() == 0 and chat.per_conversation(t, chat.read_back(t.rows, *VOCABULARY)).count() == 0
    named = spark.createDataFrame([("a", 1, "assistant", "x"), (None, 1, "user", "y")], "conv_id string, turn int, role string, text string")
    t = chat.format_trees(named, *VOCABULARY)
    assert sorted(str(r.conv_id) for r in chat.per_conversation(t, chat.read_back(t.rows, *VOCABULARY)).collect()) == ["None", "a"]
