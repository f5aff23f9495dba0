"""Prefix-target expansion of conversations into training examples.

A conversation is formatted as ``<|im_start|>role\\nbody<|im_end|>\\n`` for each turn
in order. Control strings inside a text are broken by a backslash behind their
first character, and backslashes are doubled, so that a body never holds a
control string and the text comes back exactly.

Every assistant turn is an example of its own: the formatted conversation up to
the end of that turn, with only that turn's body trainable. Since each
example is a prefix of one string, the string is kept once, in segments of a
turn each with their places in it, and an example is its end and the span of its
reply. ``example_texts`` and ``expand`` write the examples out in full, which grows
with the square of the replies; digests are read back from these texts.

Conversations are dealt by id and sorted by turn; a task passes over its turns
one by one; where examples are written out, one example at a time is held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that templates or tokenizers take as control, none of which may come out of a text.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPES = re.compile("\\\\|" + "|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)
TARGET_ROLE = "assistant"
SEGMENTS = "conv_id long, turn long, n_turn long, role string, segment string, start long, body_start long, body_end long, example long"


def escape(text: str) -> str:
    return _ESCAPES.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n_")


def unescape_role(text: str) -> str:
    return re.sub(r"\\(n_|.)", lambda m: "\n" if m[1] == "n_" else m[1], text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn's segment and where its body begins in it."""
    head = f"{OPEN}{escape_role(role)}\n"
    return f"{head}{escape(text)}{CLOSE}\n", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; anything else in it is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _segmenting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("n_turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
        ("start", pa.int64()), ("body_start", pa.int64()), ("body_end", pa.int64()), ("example", pa.int64()),
    ])
    conv: object = ()
    at = number = examples = 0
    for b in batches:
        rows = []
        for conv_id, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if conv_id != conv:
                conv, at, number, examples = conv_id, 0, 0, 0
            role, text = role or "", text or ""
            segment, head = format_turn(role, text)
            target = role == TARGET_ROLE
            rows.append((conv_id, turn, number, role, segment, at, at + head, at + len(segment) - len(CLOSE) - 1, examples if target else None))
            at, number, examples = at + len(segment), number + 1, examples + target
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: its formatted segment, where that lies in the conversation, and its example if it is a reply.

    Places count code points. Turns of one number are ordered by role and text;
    null turns come first. A null text is empty, a null role is the empty role,
    and null conversation ids are one conversation. Other columns aren't read.
    Rows stay sorted in their partitions, and each conversation is in one.
    """
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_segmenting, SEGMENTS)


def examples(segments: DataFrame) -> DataFrame:
    """(conv_id, example, turn, length, loss_start, loss_end): an example is the first ``length`` code points of its conversation."""
    return segments.where("example is not null").select(
        "conv_id", "example", "turn", (F.col("start") + F.char_length("segment")).alias("length"),
        F.col("body_start").alias("loss_start"), F.col("body_end").alias("loss_end"),
    )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv: object = ()
    parts: list[str] = []
    for b in batches:
        for conv_id, segment, example, lo, hi in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "segment", "example", "body_start", "body_end"))):
            if conv_id != conv:
                conv, parts = conv_id, []
            parts.append(segment)
            if example is not None:
                parts = ["".join(parts)]
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv_id], pa.int64()), "example": [example], "text": parts, "loss_start": [lo], "loss_end": [hi]})


def example_texts(segments: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): every example written out, straight from ``format_conversations``."""
    return segments.mapInArrow(_texts, "conv_id long, example long, text string, loss_start long, loss_end long")


EXPANDED = "conv_id long, example long, text string, loss_start long, loss_end long, last boolean"


def _expanding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv: object = ()
    parts: list[str] = []

    def row(*values: object) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["conv_id", "example", "text", "loss_start", "loss_end", "last"])

    for b in batches:
        for conv_id, segment, example, lo, hi in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "segment", "example", "body_start", "body_end"))):
            if conv_id != conv:
                if parts:
                    yield row(conv, None, "".join(parts), None, None, True)
                conv, parts = conv_id, []
            parts.append(segment)
            if example is not None:
                parts = ["".join(parts)]
                yield row(conv_id, example, parts[0], lo, hi, False)
    if parts:
        yield row(conv, None, "".join(parts), None, None, True)


def expand(segments: DataFrame) -> DataFrame:
    """The examples of ``example_texts``, in order, and behind those of each conversation a row without a target: its whole text, ``last``."""
    return segments.mapInArrow(_expanding, EXPANDED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64()),
    ])
    done, loss, chars, replies, before = [], hashlib.sha256(), 0, 0, []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        done.clear()
        return out

    for b in batches:
        for conv_id, example, text, lo, hi, last in zip(*(c.to_pylist() for c in b.columns)):
            turns = parse(text)  # of the example itself, context and all
            if turns[:len(before)] != before:
                raise ValueError(f"example {example} of conversation {conv_id} doesn't go on from the one before")
            before = turns
            if not last:
                reply = unescape(text[lo:hi])
                if example != replies or turns[-1] != (TARGET_ROLE, reply) or text[hi:] != CLOSE + "\n" or sum(role == TARGET_ROLE for role, _ in turns) != example + 1:
                    raise ValueError(f"example {example} of conversation {conv_id} has other than its own reply under the mask")
                loss.update(reply.encode())
                chars, replies = chars + len(reply), replies + 1
                continue
            digest = hashlib.sha256()
            for role, said in turns:
                digest.update(f"{role}\n{said}\n".encode())
            done.append((conv_id, len(turns), digest.hexdigest(), chars, loss.hexdigest(), len(text), replies))
            loss, chars, replies, before = hashlib.sha256(), 0, 0, []
        if len(done) >= 5000:
            yield flush()
    if done:
        yield flush()


def example_digests(expanded: DataFrame) -> DataFrame:
    """What expanded conversations hold, read back from each example's own text and loss span."""
    return expanded.mapInArrow(_digesting, DIGESTS)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """The digests of all conversations, from their examples written out in full."""
    return example_digests(expand(segments))
