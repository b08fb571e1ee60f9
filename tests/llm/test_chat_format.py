"""Chat formatting: exact round trip, the machine's verdicts, escaping."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from faultline.llm import chat_format as C
from faultline.llm.queries import PROBE, op3_chat_format


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_reads_back(spark, sf001):
    want = {}
    for r in sorted(spark.read.parquet(f"{sf001}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    want[-1] = [("user", PROBE), ("assistant", PROBE)]
    rows = op3_chat_format(spark, sf001).collect()
    assert {r.conv_id for r in rows} == want.keys() and len(rows) == len(want)
    for r in rows:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        t = C.CHATML
        assert r.formatted_chars == sum(
            len(t.opener + t.escape_role(a) + t.after_role + t.escape(b) + t.closer) for a, b in turns)


@given(st.lists(st.tuples(st.text("ab<|\\>n\n"), st.text("ab<|\\>n\n")), max_size=5))
def test_any_text_reads_back(turns):
    s = "".join(x for role, text in turns for _, x, _ in C.segments_of(C.CHATML, "", role, text))
    assert C.parse(C.CHATML, s) == turns


def test_broken_text_is_refused():
    with pytest.raises(ValueError, match="no turn"):
        C.parse(C.CHATML, "hello")


def test_machine_and_odd_rows(spark):
    rows = [(1, 0, "user", "hi", 7), (1, 1, "assistant", "yes", 7), (2, 0, "assistant", "no", 7), (3, 0, "user", "a", 7),
            (4, 1, "user", "b", 7), (4, None, "system", None, 7), (4, 2, None, "c", 7), (None, 0, "user", "d", 7),
            (5, 0, "user", "x" * 300_000, 7), (5, 0, "user", "x" * 300_000, 7), (6, 2, "assistant", "", 7), (6, 1, "user", "", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind int")
    seg = C.format_chats(df)
    got = {r.conv_id: r for r in C.read_chats(seg).collect()}
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False, 5: False, 6: True}
    assert got[5].n_turns == 2 and got[1].loss_sha256 == sha("yes") and got[6].loss_chars == 0
    assert got[4].turns_sha256 == sha("system\n\nuser\nb\n\nc\n")
    text = {r.conv_id: r.text for r in C.formatted(seg).collect()}
    assert C.parse(C.CHATML, text[4]) == [("system", ""), ("user", "b"), ("", "c")]
    legal = {(r.conv_id, r.turn_index): r.legal for r in seg.collect()}
    assert legal[2, 0] is False and legal[1, 1] is True and legal[5, 1] is False
    assert C.read_chats(C.format_chats(df.limit(0))).collect() == []
