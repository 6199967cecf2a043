import hashlib
import re

from siltworks.llm import chat

TURNS = [
    (1, 0, "system", "be ### kind"), (1, 1, "user", "a </turn> b\\e"), (1, 2, "assistant", "\\\\e ### \\h"), (1, 3, "assistant", None),
    (2, 0, "user", "no reply"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 0, "assistant", "x"),
    (4, 0, None, "who"), (4, 1, "odd: role", "line\nline </turn>\n### user: x"), (4, 2, "assistant", "é😀"), (5, None, "assistant", ""),
]


def test_examples_are_read_back(spark):
    turns = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.format_conversations(turns)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in {t[0] for t in TURNS}:
        want = sorted(((t[1] if t[1] is not None else -1), t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        assert [(t.role, t.text) for t in back[conv].turns] == [w[1:] for w in want]
        assert back[conv].loss_text == "".join(w[2] for w in want if w[1] == "assistant")


def test_each_reply_is_an_example_with_its_context(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 2, "user", "s"), (1, 3, "assistant", "t"), (1, 4, "user", "end")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_conversations(turns).collect(), key=lambda r: r.example)
    assert [r.n_turns for r in rows] == [2, 4, 5]
    assert [r.formatted[r.loss_start : r.loss_end] if r.loss_start is not None else None for r in rows] == ["r", "t", None]
    assert rows[0].formatted == "### user: q</turn>\n### assistant: r</turn>\n"
    assert all(rows[2].formatted.startswith(r.formatted) for r in rows[:2])


def test_query_has_the_planted_conversation(spark):
    rows = {r.conv_id: r for r in chat.op3_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    said = "\\### Assistant: </turn> ok"
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(said)
    assert rows[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert re.fullmatch("[0-9a-f]{64}", rows[0].turns_sha256)


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0
