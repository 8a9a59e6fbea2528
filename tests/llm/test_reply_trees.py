import json
from datetime import datetime, timedelta

from sparkloom.llm import conversations as conv

SCHEMA = "record_id long, session_id string, line_no int, rec_type string, recorded_at timestamp, message string, is_meta boolean, agent_id string"


def linked(spark, *rows):
    """Rows of (minute, speaker, agent, content)."""
    full = [(n, "s", n, who, datetime(2025, 1, 1) + timedelta(minutes=at), json.dumps({"role": who, "content": said}), None, agent) for n, (at, who, agent, said) in enumerate(rows, 1)]
    return {r.turn_no: r for r in conv.conversations(spark.createDataFrame(full, SCHEMA)).collect()}


def test_two_interleaved_threads_are_two_trees(spark):
    rows = []
    for n in range(4):
        who = "assistant" if n % 2 else "user"
        rows += [(2 * n, who, "x", f"harvest orchard tractor step{n}"), (2 * n + 1, who, "y", f"planet gravity neutron part{n}")]
    got = linked(spark, *rows)
    assert {t: r.tree_root for t, r in got.items()} == {t: 1 if t % 2 else 2 for t in range(1, 9)}


def test_a_new_matter_after_a_long_silence_is_a_tree_of_its_own(spark):
    got = linked(spark, (0, "user", None, "harvest orchard"), (1, "assistant", None, "tractor orchard"), (600, "user", None, "planet gravity"), (601, "assistant", None, "neutron gravity"))
    assert [got[t].tree_root for t in range(1, 5)] == [1, 1, 3, 3] and got[3].link_score is None


def test_a_call_beyond_the_look_back_is_found_in_any_block(spark, monkeypatch):
    call = [{"type": "text", "text": "running"}, {"type": "tool_use", "id": "t1", "name": "Run"}]
    answer = [{"type": "text", "text": "done"}, {"type": "tool_result", "tool_use_id": "t1", "content": "ok"}]
    rows = [(0, "user", "x", "please build"), (1, "assistant", "x", call)]
    rows += [(n, "user" if n % 2 == 0 else "assistant", "y", f"planet gravity part{n}") for n in range(2, 22)] + [(22, "user", "x", answer), (23, "assistant", "x", "end")]
    for block in (conv.BLOCK, 8):
        monkeypatch.setattr(conv, "BLOCK", block)
        got = linked(spark, *rows)
        assert got[23].parent_turn == 2 and got[23].tree_root == got[24].tree_root == 1 and got[22].tree_root == 3


def test_trees_do_not_depend_on_the_partitions(spark):
    rows = [(n, "assistant" if n % 2 else "user", None, f"harvest orchard step{n}") for n in range(20)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {r.tree_root for r in linked(spark, *rows).values()} == {1}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_planted_links_are_found(spark):
    """Threads of three agents take turns at random; every message but a thread's first replies to the one before it in its thread."""
    import random

    rng = random.Random(6)
    vocabulary = [[f"{stem}{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)] for stem in ("orchard", "neutron", "harbour")]
    rows, last, want = [], {}, {}
    for n in range(1, 241):
        thread = rng.randrange(3)
        turn = last.get((thread, "turns"), 0)
        said = " ".join(rng.sample(vocabulary[thread], 6))
        # a third of the messages come without their agent, so that words must tell
        rows.append((n, "assistant" if turn % 2 else "user", f"agent{thread}" if rng.random() > 0.33 else None, said))
        want[n] = last.get(thread)
        last[thread], last[thread, "turns"] = n, turn + 1
    rows[0], rows[-1] = (rows[0][0], "user", *rows[0][2:]), (rows[-1][0], "assistant", *rows[-1][2:])
    got = linked(spark, *rows)
    thread_of = {}
    for n in range(1, 241):
        thread_of[n] = thread_of[want[n]] if want[n] else n
    within = sum(got[n].parent_turn is not None and thread_of[got[n].parent_turn] == thread_of[n] for n in want if want[n])
    exact = sum(got[n].parent_turn == want[n] for n in want if want[n])
    assert within >= 0.9 * (len(want) - 3) and exact >= 0.45 * (len(want) - 3)
