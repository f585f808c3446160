"""Chat formatting by event-sourced reconstruction.

A log holds what happened to each message of a conversation: ``start`` (its
role), ``delta`` (more streamed text), ``edit`` (the text is replaced) and
``regenerate`` (the answer is thrown away and streamed anew). The log is
partitioned by conversation and, so that a conversation with a third of all events
spreads over tasks, by message; sorted by sequence, it is folded into final
messages as it streams by, and state is one message.

Final messages meet by conversation, in order, and are rendered into one formatted
text, handed on in parts of at most ``PART_CHARS`` or one message. Readers have
nothing but that text and its loss mask: turns are found by their marks.

Template: ``<s>role\\ntext</s>\\n``. Inside role and text, control strings lose
their first character to a two-character escape (``\\l`` for ``<``, ``\\b`` for
``[``; the escape character is doubled), a line end inside a role becomes ``\\n``.
So no text can hold a mark, and unescaping gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huescope.llm.common import TEXT_BYTES, arrow_map, pick

#: Marks of common chat templates, none of which may stand in a text unescaped.
CONTROL = re.compile(r"\\|<(?=/?s>|</?SYS>>|\|)|\[(?=/?INST\])|<(?=<SYS>>|</SYS>>)")
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TRAINED = "assistant"
#: Characters of a part of a formatted conversation, but for a longer message.
PART_CHARS = 1_000_000
OPENED, CLOSED = "<s>", "</s>\n"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted message and the start and end of the text under the loss mask in it."""
    head = f"<s>{escape(role)}".replace("\n", "\\n") + "\n"
    body = escape(text)
    end = len(head) + (len(body) if role == TRAINED else 0)
    return f"{head}{body}</s>\n", len(head), end


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of the turns of a formatted text, found by their marks."""
    begin = 0
    while begin < len(formatted):
        end = formatted.find(CLOSED, begin)
        if end < 0 or not formatted.startswith(OPENED, begin):
            raise ValueError("a turn has no marks")
        role, _, body = formatted[begin + len(OPENED) : end].partition("\n")
        yield unescape(role), unescape(body)
        begin = end + len(CLOSED)


def events_of(conversations: DataFrame, delta_chars: int = 80) -> DataFrame:
    """A log for finished conversations: conv_id, turn, copy, seq, kind, payload.

    Assistant answers are streamed in deltas after a first draft that is
    regenerated; other messages are typed half, then edited. Rows with equal
    (conv_id, turn) are messages of their own, numbered ``copy`` by role and text.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    copy = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    numbered = rows.withColumn("copy", F.row_number().over(copy))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name in ("conv_id", "turn"))

    def log(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, turn, role, text, n in incoming:
            if role == TRAINED:
                parts = [text[i : i + delta_chars] for i in range(0, len(text), delta_chars)]
                steps = [("delta", text[: delta_chars // 2]), ("regenerate", ""), *[("delta", p) for p in parts]]
            else:
                steps = [("delta", text[: len(text) // 2]), ("edit", text)]
            for seq, (kind_, payload) in enumerate([("start", role), *steps]):
                yield conv_id, turn, n, seq, kind_, payload

    return arrow_map(numbered, log, f"{kind}, copy int, seq long, kind string, payload string", 2000, TEXT_BYTES)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, copy, role, text.

    Events of a message apply in the order of ``seq``; a message without ``start``
    has the empty role. Events of unknown kind raise.
    """
    keys = ["conv_id", "turn", "copy"]
    ordered = pick(events, *keys, "seq", "kind", "payload").repartition(*keys).sortWithinPartitions(*keys, "seq")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema if f.name in keys)

    def fold(incoming: Iterator[tuple]) -> Iterator[tuple]:
        current, role, parts = None, "", []
        for conv_id, turn, copy, _, step, payload in incoming:
            if (conv_id, turn, copy) != current:
                if current is not None:
                    yield *current, role, "".join(parts)
                current, role, parts = (conv_id, turn, copy), "", []
            if step == "start":
                role = payload or ""
            elif step == "delta":
                parts.append(payload or "")
            elif step == "edit":
                parts = [payload or ""]
            elif step == "regenerate":
                parts = []
            else:
                raise ValueError(f"unknown event {step!r}")
        if current is not None:
            yield *current, role, "".join(parts)

    return arrow_map(ordered, fold, f"{kind}, role string, text string", 2000, TEXT_BYTES)


def render_conversations(messages: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, formatted, loss_starts, loss_ends (code points, in the conversation's text).

    The parts of a conversation, in order, are its formatted text; each holds whole
    turns. Its messages come by turn, then copy. A conversation streams through one
    task, of which it fills one part at a time; the exchange and sort spill.
    """
    keys = ["conv_id", "turn", "copy"]
    chosen = pick(messages, *keys, "role", "text").repartition("conv_id").sortWithinPartitions(*keys)
    kind = chosen.schema["conv_id"].dataType.simpleString()

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        current, open_ = None, False
        part, offset, held, texts, starts, ends = 0, 0, 0, [], [], []
        for conv_id, _, _, role, text in incoming:
            formatted, start, end = render(role, text)
            if open_ and (conv_id != current or held + len(formatted) > part_chars):
                yield current, part, "".join(texts), starts, ends
                part, offset, held, texts, starts, ends = part + 1, offset + held, 0, [], [], []
            if not open_ or conv_id != current:
                current, part, offset, open_ = conv_id, 0, 0, True
            if role == TRAINED:
                starts.append(offset + held + start)
                ends.append(offset + held + end)
            texts.append(formatted)
            held += len(formatted)
        if open_:
            yield current, part, "".join(texts), starts, ends

    schema = f"conv_id {kind}, part int, formatted string, loss_starts array<long>, loss_ends array<long>"
    return arrow_map(chosen, rows, schema, 2000, TEXT_BYTES)


def conversation_digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation, read back from its formatted text and loss mask.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The
    digests are sequential, so a conversation is one task's; its parts stream
    through with constant memory. ``in_order`` says that the parts still lie as
    ``render_conversations`` made them, and need no exchange.
    """
    ordered = pick(formatted, "conv_id", "part", "formatted", "loss_starts", "loss_ends")
    if not in_order:
        ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def fold(incoming: Iterator[tuple]) -> Iterator[tuple]:
        current, state = None, None
        for conv_id, part, text, starts, ends in incoming:
            if part == 0:
                if state is not None:
                    yield _totals(current, state)
                current, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in read_turns(text):
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            for start, end in zip(starts, ends):
                trained = unescape(text[start - state[4] : end - state[4]])
                state[2] += len(trained)
                state[3].update(trained.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
        if state is not None:
            yield _totals(current, state)

    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return arrow_map(ordered, fold, schema, 2000, TEXT_BYTES)


def _totals(conv_id, state: list) -> tuple:
    turns, all_text, chars, trained, formatted = state
    return conv_id, turns, all_text.hexdigest(), chars, trained.hexdigest(), formatted


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Log, fold and render whole conversations; see ``render_conversations``.

    Null roles and texts count as empty; a null turn sorts first, null conv_id is
    one conversation. Empty input gives no rows; further columns are ignored.
    """
    return render_conversations(fold_events(events_of(conversations)))
