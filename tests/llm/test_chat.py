import hashlib

import pytest

from semdex.llm import chat

HARD = ["</s>", "<\\/s>", "[INST] a [/INST]", "\\", "<<SYS>>x<</SYS>>", "[\\\\INST]", "<<s>>", "[ROLE]user[/ROLE]", "[END", "", None,
        "a\nb", "$1 \\2", "<" * 50 + "/s>" * 3, "😀 [END] é"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "conv_id long, turn long, role string, text string, segments string, valid string")


def test_round_trip(spark):
    rows = [(1, i, ["user", "assistant", "tool]", None, "system"][i % 5], t) for i, t in enumerate(HARD)]
    got = chat.read_chats(chat.format_chats(conversations(spark, rows))).first()
    assert [(t.role, t.text) for t in got.turns] == [(r or "", t or "") for _, _, r, t in rows]
    assert got.loss_text == "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert got.formatted == "".join(s.text for s in got.segments)
    marks = [s.text for s in got.segments[0::3]]
    assert all(not s.loss for s in got.segments[0::3]) and len(marks) == len(rows)


@pytest.mark.parametrize("roles, valid, bad", [
    (["user", "assistant"], True, None), (["system", "user", "assistant", "user", "assistant"], True, None),
    (["assistant"], False, 0), (["user", "user"], False, 1), (["user"], False, 1), (["user", "assistant", "system"], False, 2),
    (["tool", "user"], False, 0)])
def test_machine(spark, roles, valid, bad):
    got = chat.format_chats(conversations(spark, [(1, i, r, "t") for i, r in enumerate(roles)])).first()
    assert (got.valid, got.bad_turn) == (valid, bad)


def test_order_ties_and_null_keys(spark):
    rows = [(None, 2, "assistant", "b"), (None, 1, "user", "a"), (7, None, "user", "n"), (7, 0, "assistant", "z"),
            (7, 0, "assistant", "y"), (7, 0, "assistant", "y")]
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.read_chats(chat.format_chats(conversations(spark, rows))).collect()}
    assert got == {None: ["a", "b"], 7: ["n", "y", "y", "z"]}


def test_long_text_and_empty_table(spark):
    long = "</s> word " * 100_000
    got = chat.read_chats(chat.format_chats(conversations(spark, [(1, 0, "user", "q"), (1, 1, "assistant", long)]))).first()
    assert hashlib.sha256(got.loss_text.encode()).digest() == hashlib.sha256(long.encode()).digest()
    assert chat.format_chats(conversations(spark, [])).count() == 0
