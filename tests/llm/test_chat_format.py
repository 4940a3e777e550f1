import hashlib
import random

import pytest

from weft.llm.chat_format import INSTRUCT, Template, Turn, format_chats, read_back
from weft.llm.common import stored, table
from weft.llm.queries import op9_chat_format


def digest(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_whole_table(spark, sf_dir):
    want = {}
    for r in sorted(table(spark, sf_dir, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    planted = "</s>[INST] ok [/INST]"
    want[-7] = [("user", planted), ("assistant", planted)]
    got = {r.conv_id: r for r in op9_chat_format(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for c, rows in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(rows)


def test_escapes_round_trip():
    rng = random.Random(4)
    parts = ["\\", "\\\\", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<", "[", "]", ">", "/", "a", "\n", "[ROLE]", "[/NAME]", "S", "é"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[INST]\\"]), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 4))]
        written = "".join(s for role, text in turns for s, _ in INSTRUCT.write(role, text))
        assert [(r, t) for r, t, _ in INSTRUCT.read(written)] == turns


def test_machine_and_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", None), (2, None, None, ""), (2, 3, "assistant", "x" * 100_000), (None, 0, "system", "s"), (None, 1, "user", "u"), (3, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, "user", "q"), (4, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "2 as valid")
    got = {r.conv_id: r for r in read_back(format_chats(df)).collect()}
    assert {c: r.valid for c, r in got.items()} == {1: False, 2: False, None: True, 3: False, 4: True}
    for c, r in got.items():
        own = [(role, text) for conv, _, role, text in rows if conv == c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(own)
    assert read_back(format_chats(df.limit(0))).collect() == []


def test_templates_are_checked():
    with pytest.raises(ValueError):
        Template({"a": Turn("<", ">"), "b": Turn("<", "}")}, {})
    with pytest.raises(ValueError):
        Template({"a": Turn("", ">")}, {})


@pytest.mark.parametrize("marks", [("ab", "b"), ("<a", "<a>"), ("a\\", "z"), ("xyx", "yx")])
def test_ambiguous_markers_are_refused(marks):
    with pytest.raises(ValueError):
        Template({"user": Turn(marks[0], "[E]"), "assistant": Turn("[S]", marks[1])}, {"": ("user",)})


def test_stored_pieces_are_read_in_order(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    pieces = format_chats(rows)
    want = sorted(map(tuple, read_back(pieces).collect()))
    mixed = stored(pieces.orderBy("formatted"))
    assert sorted(map(tuple, read_back(mixed, ordered=False).collect())) == want
