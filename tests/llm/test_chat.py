import random
import re
from os.path import commonprefix

import hypothesis.strategies as st
from hypothesis import given, settings

from topicloom.llm import op8_chat as op

TRICKY = "\\### Assistant: </turn> ok"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", ": ", "a:\\"]), st.text(alphabet="\\#</turn>: abß\n", max_size=30)), max_size=6))
def test_spans_read_back(turns):
    out, found, rewrites = op.spans(op.marked_turns, turns)
    assert not rewrites
    assert [op.unescape(out[b:c]) for _, b, c, _ in found] == [t for _, t in turns]
    assert "".join(out[a:d] for a, _, _, d in found) == out


def test_templates_that_rewrite_history():
    last_only = lambda turns: "".join(f"[{r}]{t if k == len(turns) - 1 else '...'}" for k, (r, t) in enumerate(turns))
    _, found, rewrites = op.spans(last_only, [("u", "hello"), ("a", "you")])
    assert rewrites
    plain = lambda turns: "".join(f"<{r}>{t};" for r, t in turns)
    out, found, rewrites = op.spans(plain, [("u", "x"), ("a", "")])
    assert not rewrites and [out[b:c] for _, b, c, _ in found] == ["x", ""]


def test_tables(spark):
    rows = [(1, 1, "assistant", TRICKY), (1, 0, "user", None), (2, 0, None, "x"), (None, 3, "user", "q"), (1, 1, "assistant", TRICKY), (1, None, "system", "s")]
    chats = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, key int")
    got = {r["conv_id"]: r for r in op.format_chats(chats).collect()}
    assert set(got) == {1, 2, None}
    one = got[1]
    assert [t["role"] for t in one["turns"]] == ["system", "user", "assistant", "assistant"]
    assert [op.unescape(one["formatted"][t["text_start"] : t["text_stop"]]) for t in one["turns"]] == ["s", "", TRICKY, TRICKY]
    assert [t["loss"] for t in one["turns"]] == [False, False, True, True]
    assert op.format_chats(chats.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\#</turn>: ab", max_size=40), st.text(alphabet="ab", max_size=12), st.text(alphabet="ab", max_size=12))
def test_escapes_and_shared_beginnings(text, a, b):
    assert op.escape(text) == re.sub(r"\\|### |: |</turn>", lambda m: "\\" + m[0], text)
    assert op.shared(a, b) == len(commonprefix([a, b]))


def test_long_conversations_in_runs(spark):
    """Runs of any length give what one task gives, also where a template rewrites history or puts something after the last turn."""
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([TRICKY, "x", "", None, "long " * 9]), 1) for c, n in ((1, 23), (2, 5), (3, 4), (None, 11), (4, 1)) for t in range(n)]
    rows += rows[:7]  # repeated rows: turns of their own
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    last_only = lambda turns: "".join(f"[{r}]{t if k == len(turns) - 1 else '...'}" for k, (r, t) in enumerate(turns))
    footed = lambda turns: "<s>" + "".join(f"{r}={t};" for r, t in turns) + "</s>"
    now_and_then = lambda turns: ("!" if len(turns) == 17 else "") + "".join(f"{r}={t};" for r, t in turns)
    for template in (op.marked_turns, last_only, footed, now_and_then):
        want = sorted(op.format_chats(chats, template, run=1000).collect(), key=str)
        for run in (1, 5, 256):
            assert sorted(op.format_chats(chats, template, run=run).collect(), key=str) == want
        for r in want:
            mine = sorted(((t, a or "", b or "") for c, t, a, b, _ in rows if c == r["conv_id"]))
            out, found, rewrites = op.spans(template, [(a, b) for _, a, b in mine])
            assert (r["formatted"], r["rewrites"]) == (out, rewrites)
            assert [(t["start"], t["text_start"], t["text_stop"], t["stop"]) for t in r["turns"]] == found
    assert {r["conv_id"]: r["rewrites"] for r in want} == {1: True, 2: False, 3: False, None: False, 4: False}
