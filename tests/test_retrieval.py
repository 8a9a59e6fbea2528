import io
import subprocess
import zipfile
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chunker, metrics, presentation
from sparkloom.operators import retrieval as R
from sparkloom.plans.search import EmptyScope, SearchRequest, search
from sparkloom.sources import extract, workspace
from sparkloom.streaming import search_log


def test_keyword_scores(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "Beta beta alpha")], "item_id long, query_text string")
    got = {r.doc_id: r.score for r in R.keyword_scores(docs, asked).collect()}
    idf = lambda df: np.log(1 + (4 - df + 0.5) / (df + 0.5))
    assert got == pytest.approx({1: 2 * 2 * idf(1) + idf(2), 2: idf(2)})


def test_dense_topk_against_numpy_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 8)).astype("float32")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(90, None), (91, [0.0] * 8), (92, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in R.dense_topk(vectors, vectors.filter("vec_id in (3, 5)"), 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in (3, 5):
        scores = np.round(unit[q].astype(float) @ unit.T.astype(float), 6)
        assert [v for _, v in sorted(got[q])] == sorted(range(60), key=lambda i: (-scores[i], i))[:7]


def test_fusion(spark):
    one = spark.createDataFrame([(0, 1, 5.0, 1), (0, 2, 3.0, 2)], "q long, c long, score double, rank int")
    two = spark.createDataFrame([(0, 2, 0.9, 1)], "q long, c long, score double, rank int")
    assert {r.c: r.score for r in R.rrf([one, two], "q", "c").collect()} == pytest.approx({1: 0.5, 2: 1 / 3 + 0.5})
    got = {r.c: r.score for r in R.dbsf([one, two], "q", "c").collect()}
    sd = np.std([5, 3], ddof=1)
    assert got == pytest.approx({1: (5 - (4 - 3 * sd)) / (6 * sd), 2: (3 - (4 - 3 * sd)) / (6 * sd) + 0.5})


def test_titles_collapse_with_ties_to_the_lower_id(spark):
    hits = spark.createDataFrame([(0, 2, "r", "a/x.md", 1.0), (0, 1, "r", "a/x.txt", 1.0), (0, 3, "s", "a/x.md", 0.5)], "q long, c long, root string, path string, score double")
    assert sorted(r.c for r in R.distinct_by_title(hits, "q", "root", "path", "c").collect()) == [1, 3]


@pytest.mark.parametrize("budget", [20, 60, 400])
@pytest.mark.parametrize("mode", ["none", "blank-line", "language-aware"])
@pytest.mark.parametrize("overlap", [0, 15])
def test_chunks_stitch_to_the_file(budget, mode, overlap):
    text = "def a():\n    return 1\n\n\ndef b(x):\n" + "    x += 1\n" * 30 + "\nclass C:\n    pass\n\n# end"
    lines = chunker.lines_of(text)
    chunks = list(chunker.line_chunks(lines, chunker.boundary_lines(lines, "python", mode), [], budget, overlap))
    assert chunker.stitch([(a + 1, b + 1, c) for a, b, c in chunks]) == text
    assert all(len(c) <= budget for _, _, c in chunks)


def test_units_close_chunks_and_long_lines_are_cut():
    lines = ["one", "two", "three", "x" * 100, "four"]
    chunks = list(chunker.line_chunks(lines, [], [2], 30, 5))
    assert chunks[0] == (0, 1, "one\ntwo")
    pieces = [c for a, b, c in chunks if a == b == 3]
    assert all(len(p) <= 30 for p in pieces) and len(pieces) >= 4
    assert chunker.headings(["# A", "```", "# no", "```", "## B", "x", "# C"])[3:] == ["A", "A > B", "A > B", "C"]
    assert chunker.halve("ab\ncd ef") == ("ab", "cd ef")


def test_window_and_context():
    text = "\n".join(f"line {i} about nothing" for i in range(200))
    assert presentation.window(text, 0) == text and presentation.window("short", 100) == "short"
    shown = presentation.window(text, 120, frozenset({"77"}))
    assert "line 77 " in shown and shown.startswith("…\n") and shown.endswith("\n…") and len(shown) <= 124
    long = "a" * 900 + " needle " + "b" * 900
    import re

    cut = presentation.window(long, 100, phrase=re.compile("needle"))
    assert "needle" in cut and len(cut) <= 104
    c = [presentation.Candidate("a", "a:1", 3.0, "x" * 500), presentation.Candidate("b", "b:1", 2.0, "y\n" * 700), presentation.Candidate("c", "c:1", 1.0, "z" * 50)]
    got = presentation.assemble(c, 1100)
    assert got.used == ["a"] and got.partial == ["b"] and got.dropped == ["c"] and len(got.text) <= 1100
    assert presentation.line_window("a\nb\nc", 2, 9) == ("b\nc", 2, 3)


def test_metrics(spark):
    ranks = spark.createDataFrame([("g", 1), ("g", 4), ("g", None)], "g string, rank int")
    row = metrics.quality(ranks, ["g"]).first()
    assert (row.hit_1, row.hit_5, row.misses) == (0.333333, 0.666667, 1) and row.mrr == pytest.approx(1.25 / 3, abs=1e-6)
    scored = spark.createDataFrame([(0.1, False), (0.5, True), (0.5, False), (0.9, True)], "s double, p boolean")
    assert metrics.auc(scored, "s", "p").first().auc == 0.875
    pairs = spark.createDataFrame([(i, 1.0 + i % 2, 0.5) for i in range(60)], "id long, a double, b double")
    b = metrics.paired_bootstrap(pairs, 800).first()
    assert b.low < 1.0 < b.high and b.mean == pytest.approx(1.0, abs=0.05)


def _chunks(spark):
    rows = [(1, "en", "unit test of the parser", "docs/a.md"), (2, "en", "parser parser", "docs/b.md"), (3, "de", "parser", "docs/c.md"), (4, "en", "a unit. Test it", "src/d.md")]
    return spark.createDataFrame(rows, "chunk_id long, corpus_id string, content string, file_path string").withColumns({"chunk_set_id": F.lit("cs"), "source_id": F.lit("s")})


def test_search(spark):
    chunks = _chunks(spark)
    with pytest.raises(EmptyScope):
        search(spark, chunks, SearchRequest("parser", []))
    hits, notes = search(spark, chunks, SearchRequest("parser", ["en"]))
    assert [r.chunk_id for r in hits.collect()] == [2, 1] and notes
    hits, _ = search(spark, chunks, SearchRequest("", ["en"], mode="keyword", phrase="unit test"))
    assert sorted(r.chunk_id for r in hits.collect()) == [1, 4]
    hits, _ = search(spark, chunks, SearchRequest("unit test", ["en"], mode="keyword", path_prefix="src"))
    assert [r.chunk_id for r in hits.collect()] == [4]
    assert search(spark, chunks, SearchRequest("the of", ["en"], mode="keyword"))[0].count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.7, 0.7])], "chunk_id long, dense array<float>")
    hits, notes = search(spark, chunks, SearchRequest("parser", ["en"], vector=[1.0, 0.0]), vectors)
    assert hits.first().chunk_id == 1 and not notes


def test_scan_is_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 3 as k", "cast(id as string) as wide").write.parquet(path)
    out = io.StringIO()
    with redirect_stdout(out):
        spark.read.parquet(path).filter("k = 1").select("id").explain("formatted")
    assert "PushedFilters" in out.getvalue() and "wide" not in out.getvalue().split("ReadSchema")[1]


def test_html():
    page = "<html><head><title> T </title><script>var x='</p>'</script></head><body><p>one  <b>two</b>\nthree</p><pre>a\n  b</pre>x<br>y<style>p{}</style></body></html>"
    assert extract.html_text(page) == ("one two three\na\n  b\nx\ny", "T")


def test_archives_and_failures(spark):
    def archive(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(name.replace("__", "/").replace("_X", "."), text)
        return out.getvalue()

    word = '<w:document xmlns:w="u"><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:p><w:t>World</w:t></w:p></w:document>'
    rows = [("a.docx", archive(word__document_Xxml=word)), ("b.docx", b"no zip"), ("c.txt", "é".encode("latin-1")), ("d.txt", b"\xef\xbb\xbfx\x00y"), ("e.epub", archive(**{"1_Xhtml": "<p>one</p>", "2_Xhtml": "<p>two</p>"})), ("f.txt", None)]
    got = {r.path: r for r in extract.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"].text == "Hello\nWorld" and got["b.docx"].error and got["b.docx"].text is None
    assert got["c.txt"].text == "é" and got["d.txt"].text == "xy" and got["e.epub"].text == "one\ntwo" and len(got["e.epub"].units) == 2 and got["f.txt"].text == ""


def test_transcript():
    lines = [
        '{"type":"user","timestamp":"2025-01-01T10:00:00Z","message":{"role":"user","content":"hi <system-reminder>x</system-reminder>"}}',
        '{"type":"assistant","timestamp":"2025-01-01T10:01:00Z","message":{"content":[{"type":"text","text":"yo"},{"type":"tool_use","name":"Run","input":{"command":"cd /x && ls  -l"}}]}}',
        "broken",
        '{"type":"assistant","timestamp":"2025-01-01T10:20:00Z","message":{"content":[{"type":"text","text":"later"}]}}',
        '{"type":"user","isMeta":true,"message":{"content":"no"}}',
        '{"type":"ai-title","title":"T"}',
    ]
    text, units, title = extract.transcript_text("\n".join(lines))
    assert title == "T" and len(units) == 3 and "tool: Run ls -l" in text and "reminder" not in text and "no" not in text.split()


def test_walk_and_git(spark, tmp_path):
    root = tmp_path / "w"
    (root / "bin").mkdir(parents=True)
    for name, data in (("a.py", b"x = 1\n"), ("e.txt", b""), ("b.dat", b"a\0b"), ("bin/x.py", b"1"), ("skip.md", b"m"), ("keep.md", b"k")):
        (root / name).write_bytes(data)
    walked = workspace.walk(spark, str(root), exclude=["*.md", "!keep.md"])
    assert {r.relative_path: r.reason for r in walked.collect()} == {"a.py": None, "b.dat": "binary", "bin/x.py": "ignored", "skip.md": "ignored", "keep.md": None, "e.txt": "empty file"}
    assert {r.relative_path: r.text for r in workspace.read_texts(walked).collect()} == {"a.py": "x = 1\n", "keep.md": "k"}
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "a.py")
    run("-c", "user.name=n", "-c", "user.email=e@x", "commit", "-qm", "first\n\nbody")
    spark.dataSource.register(workspace.GitLog)
    rows = spark.read.format("git_log").load(str(root)).collect()
    assert len(rows) == 1 and rows[0].message == "first\n\nbody" and "a.py" in rows[0].stat and rows[0].path.startswith("commits/")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:1{i % 5}:00", "a" if i % 2 else "b") for i in range(30)], "id long, ts string, kind string").selectExpr("id", "cast(ts as timestamp) ts", "kind")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    search_log.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted(map(tuple, search_log.per_window(df, "ts", "kind", "1 hour").collect()))
    assert key(back) == key(rows)
    assert [r.id for r in search_log.page(rows, "id", 10, 3).collect()] == [9, 8, 7, 6]
