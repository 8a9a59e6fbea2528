import json
from datetime import datetime, timedelta

from sparkloom.llm import conversations as conv

T0 = datetime(2025, 1, 1)
SCHEMA = "record_id long, session_id string, line_no int, rec_type string, recorded_at timestamp, message string, is_meta boolean, agent_id string, text string, speaker int"


def say(role, content):
    return json.dumps({"role": role, "content": content})


def records(spark, *rows):
    """Rows of (session, line, type, message[, meta])."""
    full = [(n, r[0], r[1], r[2], T0 + timedelta(minutes=n), r[3], r[4] if len(r) > 4 else None, None, "clash", 1) for n, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, SCHEMA)


def kept(spark, *rows):
    return sorted((r.session_id, r.turn_no, r.record_id) for r in conv.conversations(records(spark, *rows)).collect())


PAIR = (("s", 1, "user", say("user", "hello there")), ("s", 2, "assistant", say("assistant", [{"type": "text", "text": "hello"}])))


def test_a_sound_session(spark):
    assert kept(spark, *PAIR) == [("s", 1, 1), ("s", 2, 2)]


def test_other_records_are_no_messages_and_never_break(spark):
    rows = [PAIR[0], ("s", 2, "system", None), ("s", 3, None, "{broken"), ("s", 4, "assistant", say("model", "yes"))]
    assert kept(spark, *rows) == [("s", 1, 1), ("s", 2, 4)]


def test_what_breaks_a_session(spark):
    broken = {
        "hole": [PAIR[0], ("s", 3, "assistant", say("assistant", "x"))],
        "null": [*PAIR, ("s", 3, "user", None), ("s", 4, "assistant", say("assistant", "x"))],
        "damaged": [*PAIR, ("s", 3, "assistant", '{"role": "assist')],
        "no reply": [*PAIR, ("s", 3, "user", say("user", "and?"))],
        "opened": [("s", 1, "assistant", say("assistant", "x"))],
        "silent": [("s", 1, "user", say("user", "  ")), ("s", 2, "assistant", say("assistant", []))],
        "unnumbered": [*PAIR, ("s", None, "system", None)],
    }
    rows = [(name, *row[1:]) for name, those in broken.items() for row in those]
    assert {s for s, *_ in kept(spark, *rows, *PAIR)} == {"s"}


def test_highest_record_counts_and_roles_are_spelled_in_many_ways(spark):
    rows = [("s", 1, None, say("Human", "hi")), ("s", 2, None, say("AI", "old")), ("s", 2, None, say("AI", "new"))]
    got = conv.conversations(records(spark, *rows)).orderBy("turn_no").collect()
    assert [(r.speaker, r.text) for r in got] == [("user", "hi"), ("assistant", "new")]


def test_meta_and_injected_text_say_nothing(spark):
    rows = [PAIR[0], ("s", 2, "user", say("user", "x"), True), ("s", 3, "user", say("user", "<ide_selection>a\nb</ide_selection> \n")), ("s", 4, "assistant", say("assistant", "y"))]
    assert kept(spark, *rows) == [("s", 1, 1), ("s", 2, 4)]


def test_empty_table_and_null_sessions(spark):
    assert kept(spark, (None, 1, "user", say("user", "x"))) == []
    assert conv.conversations(records(spark, *PAIR).limit(0)).count() == 0


def test_a_tool_answer_is_linked_to_its_call(spark):
    call = say("assistant", [{"type": "text", "text": "running"}, {"type": "tool_use", "id": "t1", "name": "Run"}])
    answer = say("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "ok"}, {"type": "text", "text": "done"}])
    rows = [PAIR[0], ("s", 2, "assistant", call), ("s", 3, "assistant", say("assistant", "zzz")), ("s", 4, "user", answer), ("s", 5, "assistant", say("assistant", "end"))]
    got = {r.turn_no: r for r in conv.conversations(records(spark, *rows)).collect()}
    assert got[4].parent_turn == 2 and got[1].parent_turn is None and got[1].tree_root == 1


def test_trees_do_not_depend_on_the_blocks(spark, monkeypatch):
    rows = []
    for n in range(1, 61):
        topic = "harvest orchard tractor" if n % 3 else f"planet{n // 20} gravity neutron"
        rows.append(("s", n, "user" if n % 2 else "assistant", say("user" if n % 2 else "assistant", f"{topic} word{n}")))
    whole = {r.turn_no: (r.parent_turn, r.tree_root) for r in conv.conversations(records(spark, *rows)).collect()}
    monkeypatch.setattr(conv, "BLOCK", 8)
    cut = {r.turn_no: (r.parent_turn, r.tree_root) for r in conv.conversations(records(spark, *rows)).collect()}
    assert len(whole) == 60 and whole == cut
    for turn, (parent, root) in whole.items():
        assert root == (turn if parent is None else whole[parent][1])
