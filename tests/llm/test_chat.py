import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from factloom.llm import chat

tricky = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\n", "<", "|im_end|>", "n_", "[INS", "T]", "a", "é", "<|im_", "end|>\n"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(tricky, tricky), max_size=4))
def test_formatted_turns_come_back_and_hold_no_control_strings(turns):
    parts = [chat.format_turn(*t) for t in turns]
    assert chat.parse("".join(p for p, _ in parts)) == turns
    for segment, head in parts:
        body = segment[head:-len(chat.CLOSE) - 1]
        assert not any(c in body for c in chat.CONTROL)


SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("segment", T.StringType()))])
ROWS = [
    (1, 0, "system", "s", None), (1, 1, "user", "</s>[INST] ok", None), (1, 2, "assistant", "a\\1", None), (1, 3, "assistant", None, "x"), (1, 4, "user", "", None),
    (2, 0, "assistant", "b", None), (2, 0, "assistant", "a", None), (2, 0, "assistant", "a", None), (None, 5, None, None, None), (3, None, "assistant", "first", None), (3, 1, "user\n", "q", None),
    *((9, k, "assistant" if k % 2 else "user", f"turn {k} " * 40, None) for k in range(300)),
]


def test_digests_and_examples(spark):
    segments = chat.format_conversations(spark.createDataFrame(ROWS, SCHEMA))
    by = defaultdict(list)
    for r in sorted(ROWS, key=lambda r: tuple((x is not None, x or "") for x in r[:1]) + ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")):
        by[r[0]].append((r[2] or "", r[3] or ""))
    got = {r.conv_id: r for r in chat.conversation_digests(segments).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len("".join(chat.format_turn(*t)[0] for t in turns))
    spans = {(r.conv_id, r.example): r for r in chat.examples(segments).collect()}
    for r in chat.example_texts(segments).collect():
        turns = by[r.conv_id]
        place = [k for k, (role, _) in enumerate(turns) if role == "assistant"][r.example]
        assert chat.parse(r.text) == turns[:place + 1]
        assert chat.unescape(r.text[r.loss_start:r.loss_end]) == turns[place][1]
        span = spans.pop((r.conv_id, r.example))
        assert (span.length, span.loss_start, span.loss_end) == (len(r.text), r.loss_start, r.loss_end)
    assert not spans


def test_empty_table(spark):
    segments = chat.format_conversations(spark.createDataFrame([], SCHEMA))
    assert chat.conversation_digests(segments).count() == 0 and chat.example_texts(segments).count() == 0
