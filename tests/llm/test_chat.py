"""Chat logs: folding, escaping, reading back."""

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from huescope.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, TURN string, kind string"
ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "a\\l b\\\\ <s> <|im_end|>"),
    (1, 3, "assistant", ""), (2, 0, "user", None), (2, 1, None, "no role"), (2, None, "user", "no turn"),
    (2, 2, "assistant", "x" * 300), (2, 2, "assistant", "x" * 300), (2, 2, "user", "tie"), (None, 0, "user", "no id"),
    (3, 5, "as\nsist</s>", "odd role"), (4, 0, "assistant", "very long " * 20_000), (5, 1, "user", ""),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3)


def expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append(((turn is not None, turn), role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        formatted = sum(len(chat.render(r, t)[0]) for _, r, t in turns)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        out[conv] = (len(turns), digest[0], len(loss), digest[1], formatted)
    return out


def test_conversations(spark):
    formatted = chat.format_conversations(frame(spark, ROWS))
    for in_order in (True, False):
        found = chat.conversation_digests(formatted, in_order).collect()
        assert {r[0]: tuple(r)[1:] for r in found} == expected(ROWS) and len(found) == len(expected(ROWS))


def test_turns_are_read_from_the_whole_text(spark):
    """Also across parts; every text holds marks, and loss spans count from the conversation's start."""
    marks = ["<s>", "</s>\n", "\n", "[/INST]", "\\", "<|im_end|>", "<s>user\n", ""]
    rows = [(c, t, "assistant" if t % 2 else "user", marks[(t + c) % len(marks)] * (1 + t % 3)) for c in range(4) for t in range(40)]
    messages = spark.createDataFrame([(*r[:2], 1, *r[2:]) for r in rows], "conv_id long, turn long, copy int, role string, text string")
    for part_chars in (1, 60, 10_000):
        parts = chat.render_conversations(messages, part_chars).orderBy("conv_id", "part").collect()
        assert (part_chars == 10_000) == (len(parts) == 4)
        for c in range(4):
            mine = [p for p in parts if p["conv_id"] == c]
            text = "".join(p["formatted"] for p in mine)
            assert list(chat.read_turns(text)) == [r[2:] for r in rows if r[0] == c]
            spans = [(a, b) for p in mine for a, b in zip(p["loss_starts"], p["loss_ends"])]
            assert [chat.unescape(text[a:b]) for a, b in spans] == [r[3] for r in rows if r[0] == c and r[2] == "assistant"]
            assert all(len(list(chat.read_turns(p["formatted"]))) >= 1 for p in mine)


def test_many_large_texts(spark):
    """Rows of more than a megabyte go on in bounded batches."""
    rows = spark.range(300, numPartitions=1).selectExpr(
        "id % 20 AS conv_id", "id AS turn", "'user' AS role", "repeat(concat('a<s>', id), 200000) AS text"
    )
    found = chat.conversation_digests(chat.format_conversations(rows), in_order=True).collect()
    assert sorted(r["n_turns"] for r in found) == [100] * 20 and min(r["formatted_chars"] for r in found) > 100 * 1_000_000


def test_batches_are_bounded_by_their_texts():
    from huescope.llm import common

    sizes = []

    class Rows:
        def mapInArrow(self, run, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_pylist([{"text": "x" * 1000} for _ in range(2000)])
            sizes.extend(b.num_rows for b in run(iter([batch])))

    common.arrow_map(Rows(), lambda rows: rows, "text string", 2000, 10_000)
    assert sum(sizes) == 2000 and max(sizes) == 10


def test_nothing(spark):
    assert chat.conversation_digests(chat.format_conversations(frame(spark, []))).count() == 0


def test_fold_of_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, 3, "delta", "c"), (1, 0, 1, 0, "start", "user"), (1, 0, 1, 2, "edit", "ab"), (1, 0, 1, 1, "delta", "zz"),
        (1, 1, 1, 0, "start", "assistant"), (1, 1, 1, 1, "delta", "draft"), (1, 1, 1, 2, "regenerate", None),
        (1, 1, 1, 3, "delta", "fi"), (1, 1, 1, 4, "delta", None), (1, 1, 1, 5, "delta", "nal"), (1, 2, 1, 0, "delta", "no start"),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, copy int, seq long, kind string, payload string")
    found = sorted(tuple(r) for r in chat.fold_events(events).collect())
    assert found == [(1, 0, 1, "user", "abc"), (1, 1, 1, "assistant", "final"), (1, 2, 1, "", "no start")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/s[]INST\\lbn|SY\n ", max_size=40), st.text(alphabet="<s>[INST]\\n\nx", max_size=15))
def test_escaping_is_reversible_and_leaves_no_mark(text, role):
    formatted, start, end = chat.render(role, text)
    assert list(chat.read_turns(formatted * 2)) == [(role, text)] * 2
    assert chat.unescape(formatted[start:end]) == (text if role == "assistant" else "")
    inner = formatted[3:-5]
    for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<|", "<<SYS>>", "<</SYS>>"):
        assert mark not in inner
