from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lakewarden.llm.chat import Formatter, Template, digests, format_conversations

PARTS = st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/TURN]", "\\", "<", "[", "s>", "/INST]", "a", " ", "\n", "é"])
TEXT = st.lists(PARTS, max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]"]), TEXT), max_size=8))
@settings(max_examples=500, deadline=None)
def test_round_trip(turns):
    form = Formatter(Template())
    parts = [("<s>", False)] + [p for role, text in turns for p in form.segments(role, text)]
    whole = "".join(p for p, _ in parts)
    assert form.turns(whole) == ([(r, t) for r, t in turns], "")
    assert "".join(form.unescape(p) for p, loss in parts if loss) == "".join(t for r, t in turns if r == "assistant")


def test_digests(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "</s> yes"), (2, 1, "assistant", "late"), (2, 0, "user", None), (3, 0, "assistant", "first"),
        (4, 0, "user", "a"), (4, 0, "user", "a"), (None, 0, "user", "q"), (5, None, None, "no role"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, nth string, loss long")
    got = {r.conv_id: r for r in digests(format_conversations(df)).collect()}
    convs: dict = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert {c: got[c].valid for c in got} == {1: True, 2: True, 3: False, 4: False, None: True, 5: False, -7: True}
    assert digests(format_conversations(df.limit(0))).count() == 0


def test_segments_carry_loss_flags(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    got = [(r.text, r.loss) for r in format_conversations(df).orderBy("nth").collect()]
    assert got == [("<s>", False), ("[INST]", False), ("q", False), ("[/INST]", False), ("a", True), ("</s>", False)]
