import random

from pyspark.sql import functions as F

from sparkloom.operators import context as K
from sparkloom.operators import presentation


def files(spark, *texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "file_id long, body string, chunk_index_ int")


def test_fixed_chunks_cover_every_line(spark):
    body = "\r\n".join(f"line {i}" for i in range(1, 56))
    rows = K.fixed_chunks(files(spark, body, "one", "", None), "file_id", "body").orderBy("file_id", "chunk_index").collect()
    got = [(r.file_id, r.start_line, r.end_line) for r in rows]
    assert got == [(0, 1, 20), (0, 17, 36), (0, 33, 52), (0, 49, 55), (1, 1, 1)]
    assert rows[0].content.split("\n")[0] == "line 1" and rows[-1].content == "one"


def test_points_of_a_file_beyond_the_bound_are_unknown(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1)] * 3 + [("b", 1)], "path string, x int")
    monkeypatch.setattr(K, "MAX_POINTS", 2)
    assert {r.path: r.points for r in K.points_per_file(rows, ["path"]).collect()} == {"a": None, "b": 1}


def test_passages_leave_out_what_was_said_and_disclose_gaps(spark):
    pieces = spark.createDataFrame(
        [("q", "f", 0, 1, 3, "a\nb\nc"), ("q", "f", 1, 3, 5, "c\nd\ne"), ("q", "f", 2, 4, 5, "d\ne"), ("q", "f", 9, 9, 9, "z"), ("r", "f", 0, 2, 2, "b")],
        "question string, path string, chunk_index int, start_line int, end_line int, content string",
    )
    got = {r.question: r for r in K.passages(pieces, ["question"], ["path"]).collect()}
    assert got["q"].text == "a\nb\nc\nd\ne\n… lines 6-8 not indexed …\nz" and got["q"].gaps == 1
    assert (got["r"].start_line, got["r"].end_line, got["r"].text) == (2, 2, "b")


def test_neighbours_of_near_hits_come_once(spark):
    chunks = spark.createDataFrame([("f", i) for i in range(6)], "path string, chunk_index int")
    got = K.with_neighbours(chunks.filter("chunk_index in (2, 3, 5)"), chunks, [], ["path"], 1)
    assert sorted(r.chunk_index for r in got.collect()) == [1, 2, 3, 4, 5]


def test_spending_agrees_with_the_plain_assembly(spark):
    rng = random.Random(3)
    rows = [(q, n, rng.choice([50, 400, 900, 2500, 7000]), str(n)) for q in range(12) for n in range(8)]
    told = K.spend(spark.createDataFrame(rows, "question int, rank int, chars int, used string"), ["question"], ["rank"], "chars").collect()
    for q in range(12):
        plain = presentation.assemble([presentation.Candidate(f"{n}", "x", -n, ("w" * 9 + " ") * (c // 10)) for qq, n, c, _ in rows if qq == q])
        mine = {d: [str(r["rank"]) for r in sorted(told, key=lambda r: r["rank"]) if r.question == q and r.decision == d] for d in ("used", "partial", "dropped")}
        assert (mine["used"], mine["partial"], mine["dropped"]) == (plain.used, plain.partial, plain.dropped)


def test_cuts_to_whole_lines_or_words(spark):
    text = "one two\nthree four five six seven eight nine\nten"
    row = files(spark, text, "short", None).filter("file_id = 0").select(
        K.cut_to_lines(F.col("body"), 30).alias("a"), K.cut_to_lines(F.col("body"), 30, False).alias("b"), K.cut_to_lines(F.col("body"), 3).alias("c"), K.cut_to_lines(F.col("body"), 0).alias("d")
    )
    assert tuple(row.first()) == ("one two", "one two\nthree four five six", "", "")
    assert [r.x for r in files(spark, "short", None).select(K.cut_to_lines(F.col("body"), 30).alias("x")).collect()] == ["short", None]


def test_locations_and_headers(spark):
    rows = spark.createDataFrame([("a/b.py", 3, 3, None), ("a/b.py", 3, 9, None), ("x.epub", None, None, 4), ("x.PPTX", 1, 2, 5), ("x", 1, 2, 6)], "p string, s int, e int, u int")
    place = K.location(F.col("p"), F.col("s"), F.col("e"), F.col("u"))
    assert [r[0] for r in rows.select(place).collect()] == ["a/b.py:3", "a/b.py:3-9", "x.epub#chapter=4", "x.PPTX#slide=5", "x#page=6"]
    head = K.header(place, F.col("u"), F.col("s"), F.col("e"), F.lit("docs"), F.lit("/r"), F.lit("Intro"))
    assert [r[0] for r in rows.select(head).collect()][3] == "x.PPTX#slide=5 · lines 1-2 (corpus: docs · in /r) · Intro"


def test_heading_trails_skip_fences_and_reset(spark):
    text = "# A\n## B ##\ntext\n```\n# no\n```\n### C\n## D\n# E\n### F\n"
    got = [(r.line_no, r.trail) for r in K.heading_trails(files(spark, text, "", None), "file_id", "body").orderBy("line_no").collect()]
    assert got == [(1, "A"), (2, "A > B"), (7, "A > B > C"), (8, "A > D"), (9, "E"), (10, "E > F")]


def test_halves_and_shared_ends(spark):
    rows = spark.createDataFrame([("ab\ncd ef gh", "gh ij"), ("ab cd efghij", "xx"), ("abcdef", ""), ("aaaa", "aaab")], "a string, b string")
    first, second = K.halves(F.col("a"))
    got = [tuple(r) for r in rows.select(first, second, K.shared_ends(F.col("a"), F.col("b"))).collect()]
    assert got == [("ab", "cd ef gh", 2), ("ab cd", " efghij", 0), ("abc", "def", 0), ("aa", "aa", 3)]
