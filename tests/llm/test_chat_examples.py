import pytest

from factloom.llm import chat

ROWS = [(1, 0, "user", "q"), (1, 1, "assistant", "a\\1 </s>"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "tail"), (2, 0, "user", "alone")]


def test_digests_are_read_from_the_examples(spark):
    segments = chat.format_conversations(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    rows = sorted(chat.expand(segments).collect(), key=lambda r: (r.conv_id, r.last, r.example or 0))
    assert [(r.conv_id, r.example, len(chat.parse(r.text)), r.last) for r in rows] == [(1, 0, 2, False), (1, 1, 4, False), (1, None, 5, True), (2, None, 1, True)]
    assert {(r.conv_id, r.example, r.text, r.loss_start, r.loss_end) for r in rows if not r.last} == {tuple(r) for r in chat.example_texts(segments).collect()}
    frame = lambda rows: spark.createDataFrame(rows, chat.EXPANDED).coalesce(1)
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(chat.example_digests(frame(rows))) == same(chat.conversation_digests(segments))
    for change in ({"text": rows[1].text.replace("q", "z")}, {"loss_start": rows[1].loss_start - 1}, {"loss_end": rows[1].loss_end + 1}, {"example": 0}):
        bad = [tuple({**rows[1].asDict(), **change}.values()) if k == 1 else tuple(r) for k, r in enumerate(rows)]
        with pytest.raises(Exception, match="example"):
            chat.example_digests(frame(bad)).collect()
