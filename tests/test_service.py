import subprocess
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import globs
from sparkloom.operators import metrics, sections
from sparkloom.operators import retrieval as R
from sparkloom.operators import service as V

SETS = "chunk_set_id string, corpus_id string, set_name string, is_default boolean, error string"


def test_scopes(spark):
    sets = spark.createDataFrame([("s2", "c", "fine", True, None), ("s1", "c", "fine", True, None), ("s3", "c", "coarse", False, None), ("s4", "d", "only", False, None), ("s5", None, "x", True, None)], SETS)
    asked = spark.createDataFrame([(x,) for x in ("c", "c:coarse", "c:none", "d", "e", "", None)], "argument string")
    got = {r.argument: (r.chunk_set_id, r.error) for r in V.resolve_scopes(asked, "argument", sets).collect()}
    assert got == {
        "c": ("s1", None), "c:coarse": ("s3", None), "c:none": (None, "unknown set none in c"), "d": (None, "no default set in d"), "e": (None, "unknown corpus e"),
        "": (None, "no corpus named"), None: (None, "no corpus named"),
    }


STATE = "source_id string, path string, size_bytes long, modified_ticks long, sha256 string, status string"


def test_a_refresh_settles_compares_indexes_and_deletes(spark):
    state = spark.createDataFrame([("s", p, 5, t, h, "Indexed") for p, t, h in (("same", 9, "a"), ("touched", 9, "a"), ("new", 9, "a"), ("gone", 9, "a"), ("noticks", 0, "a"), ("failed", 9, None))], STATE)
    listing = spark.createDataFrame([("s", p, 5, t, h, 1) for p, t, h in (("same", 9, "a"), ("touched", 8, "a"), ("new", 8, "b"), ("noticks", 0, "a"), ("failed", 9, "c"), ("odd", 7, None))], "source_id string, path string, size_bytes long, modified_ticks long, sha256 string, candidate_id int")
    plan = {r.path: r.action for r in V.refresh_plan(listing, state).collect()}
    assert plan == {"same": "settled", "touched": "same content", "new": "index", "gone": "delete", "noticks": "same content", "failed": "index", "odd": "unreadable"}
    assert {r.path for r in V.swept(listing, state).collect()} == {"odd"}
    assert {r.path: r.status for r in V.listing_with_states(listing, state).collect()}["odd"] == "Pending"
    assert V.refresh_plan(listing.limit(0), state.limit(0)).count() == 0


def test_prunable_directories(spark):
    rules = ["vendor/", "obj/", "!vendor/keep/a.txt", "!/obj/*/x"]
    dirs = spark.createDataFrame([(d,) for d in ("vendor", "vendor/keep", "vendor/other", "src/vendor", "obj", "obj/one", "src")], "d string")
    got = {r.d for r in dirs.filter(globs.prunable(F.col("d"), rules)).collect()}
    assert got == {"vendor/other", "src/vendor"}
    assert dirs.filter(globs.prunable(F.col("d"), [*rules, "!*.md"])).count() == 0  # a rule for any depth keeps all open


def test_sections_run_from_their_own_start(spark):
    t0 = datetime(2025, 1, 1)
    rows = [("s", n, who, None if at is None else t0 + timedelta(minutes=at), 7) for n, (who, at) in enumerate([("u", 0), ("u", 6), ("u", 11), ("u", 20), ("a", 21), ("a", None), ("a", 30), ("a", 31)], 1)]
    told = sections.timed_sections(spark.createDataFrame(rows, "session_id string, line_no int, who string, at timestamp, section_no int"), "session_id", "line_no", "who", "at")
    assert [r.section_no for r in told.orderBy("line_no").collect()] == [1, 1, 2, 2, 3, 3, 3, 4]


def test_occurrences_are_matched_in_order(spark):
    first = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3)], "key string, no int")
    second = spark.createDataFrame([("k", 9), ("k", 5), ("j", 1)], "key string, no int")
    got = {r.no: r.matched for r in sections.matched_occurrences(first, second, ["key"], "no").collect()}
    assert got == {1: 5, 2: 9, 3: None}


def test_more_queries_than_two_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(100, None), (101, [1.0, 2.0]), (102, [float("nan")] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {(r.query_id, r.vec_id, r["rank"], r.score) for r in R.dense_topk(vectors, vectors.filter("vec_id < 40"), 5).collect()}
    monkeypatch.setattr(R, "MAX_QUERIES_PER_BLOCK", 7)
    monkeypatch.setattr(R, "SCORES_AT_ONCE", 50)
    cut = {(r.query_id, r.vec_id, r["rank"], r.score) for r in R.dense_topk(vectors, vectors.filter("vec_id < 40"), 5).collect()}
    assert whole == cut and len(whole) == 200


def test_phrases_are_held_word_by_word(spark):
    docs = spark.createDataFrame([(1, "A Unit-test, of things; unit  test"), (2, "unit of test"), (3, None), (4, "unittest"), (5, "new new york")], "doc_id long, text string")
    phrases = spark.createDataFrame([("unit test",), ("UNIT",), ("new york",), ("new new",), ("--",), (None,)], "phrase string")
    got = sorted((r.doc_id, r.phrase) for r in R.phrase_hits(docs, phrases).collect())
    assert got == [(1, "UNIT"), (1, "unit test"), (2, "UNIT"), (5, "new new"), (5, "new york")]


def test_thresholds_and_areas_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(float(s), bool(p)) for s, p in zip(np.round(rng.lognormal(size=300) ** 3, 2), rng.random(300) < 0.4)] + [(None, True)]
    scored = spark.createDataFrame(rows, "score double, positive boolean")
    known = [r for r in rows if r[0] is not None]
    pos, neg = sorted(s for s, p in known if p), [s for s, p in known if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(metrics.auc(scored, "score", "positive").first().auc - want) < 1e-6
    told = metrics.threshold_keeping(scored, "score", "positive", 0.9).first()
    threshold = pos[int(len(pos) * 0.1 + 1e-9)]
    assert told.threshold == threshold and abs(told.passed - sum(s >= threshold for s in neg) / len(neg)) < 1e-6


def test_a_bootstrap_interval_holds_the_mean(spark):
    rng = np.random.default_rng(2)
    pairs = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))], "id long, a double, b double")
    told = metrics.paired_bootstrap(pairs, 400).first()
    assert told.low < told.mean < told.high and metrics.paired_bootstrap(pairs, 400).first() == told


def test_upserts_keep_one_of_several_rows(spark):
    from sparkloom.operators import store

    old = spark.createDataFrame([(1, 5), (2, 5)], "k int, v int")
    assert sorted(map(tuple, store.upsert(old, spark.createDataFrame([(1, 7), (1, 9), (3, None)], "k int, v int"), ["k"]).collect())) == [(1, 9), (2, 5), (3, None)]


@pytest.fixture
def repository(tmp_path):
    def git(*args, date="2024-03-01T10:00:00+02:00"):
        env = {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "HOME": str(tmp_path), "PATH": "/usr/bin:/bin"}
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.test", "-C", str(tmp_path), *args], check=True, capture_output=True, env=env)

    git("init", "-q")
    for n, (name, text) in enumerate((("a.txt", "one\n"), ("b/c.txt", "two\n"), ("big.txt", "x" * 70_000))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", f"subject {n}\n\nbody of {name}", date=f"2024-03-0{n + 1}T10:00:00+02:00")
    return str(tmp_path)


def test_git_commits_come_in_batches(spark, repository):
    from sparkloom.sources.workspace import GitLog

    spark.dataSource.register(GitLog)
    rows = spark.read.format("git_log").load(repository).orderBy("author_date").collect()
    assert [r.message.split("\n")[0] for r in rows] == ["subject 0", "subject 1", "subject 2"]
    assert rows[0].diff.startswith("diff --git") and "+one" in rows[0].diff and "b/c.txt" in rows[1].stat
    assert rows[2].diff.startswith("[diff of 70,") and rows[0].path == f"commits/2024-03-01-{rows[0].commit_sha[:12]}"
    one = spark.read.format("git_log").option("pathspecs", "b").load(repository).collect()
    assert [r.message.split("\n")[0] for r in one] == ["subject 1"]
    assert spark.read.format("git_log").option("maxCommits", "2").load(repository).count() == 2
    Path(repository, "a.txt").write_text("one\nmore\n")
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.test", "-C", repository, "stash", "-q"], check=True)
    (stash,) = spark.read.format("git_log").option("stashes", "true").load(repository).collect()
    assert "+more" in stash.diff and "a.txt" in stash.stat and stash.path.startswith("stashes/")


def test_walks_read_ignore_files(spark, tmp_path):
    from sparkloom.sources import workspace

    for name, text in ((".gitignore", "*.log\nout/\n"), ("a.log", "x"), ("b.py", "x"), ("sub/.gitignore", "!keep.log\n*.py\n"), ("sub/keep.log", "x"), ("sub/c.py", "x"), ("out/d.py", "x"), (".git/info/exclude", "b.py\n"), ("big.txt", "y" * 400), ("none.txt", ""), ("deep/a/b/c/e.md", "x"), ("node_modules/m/x.js", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "link.md").symlink_to(tmp_path / "deep/a/b/c/e.md")
    walked = workspace.walk(spark, str(tmp_path), max_bytes=300, max_document_bytes=300)
    got = {r.relative_path: r.reason for r in walked.collect()}
    assert got == {
        ".gitignore": None, "a.log": "ignored", "b.py": "ignored", "sub/.gitignore": None, "sub/keep.log": None, "sub/c.py": "ignored",
        "big.txt": "over the size cap", "none.txt": "empty file", "deep/a/b/c/e.md": None, "link.md": "link",
    }
    # directories that no rule could open again are not entered
    assert "out/d.py" not in got and "node_modules/m/x.js" not in got
    again = {r.relative_path for r in workspace.walk(spark, str(tmp_path), exclude=["!out/d.py"]).filter("reason is null").collect()}
    assert "out/d.py" in again
    assert workspace.walk(spark, str(tmp_path), use_ignore_files=False).filter("relative_path = 'a.log'").first().reason is None


def test_pdf_files_that_cannot_be_read_fail_alone(spark):
    from sparkloom.queries.pipeline import _pdf
    from sparkloom.sources import extract

    good = _pdf("words (in brackets) of a page", "Head")
    rows = [("a.pdf", good), ("b.pdf", good[:-6]), ("c.pdf", good.replace(b"trailer <<", b"trailer << /Encrypt 9 0 R")), ("d.pdf", b""), ("e.pdf", b"%PDF %%EOF")]
    got = {r.path: (r.text, r.error) for r in extract.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.pdf"] == ("Head\nwords (in brackets) of a page", None)
    assert got["b.pdf"][1] == got["d.pdf"][1] == "failed: ValueError" and got["c.pdf"][1] == "unreadable: PermissionError" and got["e.pdf"] == ("", None)
