import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import globs
from sparkloom.functions import text as X


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("HTTPServer", ["httpserver", "http", "server"]),
        ("base64Encode", ["base64encode", "base", "64", "encode"]),
        ("HTTP2Server", ["http2server", "http", "2", "server"]),
        ("RefreshAsync refresh", ["refreshasync", "refresh", "async", "refresh"]),
        ("a-b_c", ["a", "b", "c"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert spark.range(1).select(X.tokenize(F.lit(text)).alias("t")).first().t == want


def test_terms_leave_out_stop_words_and_lengths(spark):
    got = spark.range(1).select(X.terms(F.lit("The x of " + "y" * 65 + " token")).alias("t")).first().t
    assert got == ["token"]
    assert spark.range(1).select(X.terms(F.lit(None).cast("string")).alias("t")).first().t is None


def test_hash_is_fnv1a(spark):
    def fnv(word):
        value = 2166136261
        for b in word.encode():
            value = (value ^ b) * 16777619 & 0xFFFFFFFF
        return value & 0x7FFFFFFF

    words = ["token", "éaux", "日本", "👍", "x" * 64]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.term_hash(F.col("w")).alias("h")).collect()
    assert all(r.h == fnv(r.w) for r in rows)


def test_phrases(spark):
    assert X.phrase_pattern("  ") is None
    for bad in ("?!", "x" * 501):
        with pytest.raises(X.PhraseRefused):
            X.phrase_pattern(bad)
    hit = lambda p, t: spark.range(1).select(F.lit(t).rlike(X.phrase_pattern(p)).alias("h")).first().h
    assert hit("in the case", "This is IN-the\n Case of") and not hit("in the case", "within the case") and not hit("in the case", "in case the")


def test_paths(spark):
    row = spark.range(1).select(X.path_prefixes(F.lit(".\\Src//A/b.cs")).alias("p"), X.under_prefix(F.lit("src/ab/c"), F.lit("src/a")).alias("no"), X.under_prefix(F.lit("x"), F.lit("")).alias("yes")).first()
    assert row.p == ["src", "src/a", "src/a/b.cs"] and not row.no and row.yes


def test_languages(spark):
    rows = spark.createDataFrame([("a/B.TSX",), ("Dockerfile.dev",), (".env",), ("x.weird",), (".eslintrc.json",)], "p string").select(X.language_of(F.col("p")).alias("l")).collect()
    assert [r.l for r in rows] == ["typescript", "dockerfile", "text", "text", "json"]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        ("*.cs", "a/b.cs", True), ("/a.cs", "b/a.cs", False), ("src/*.cs", "src/x/a.cs", False), ("src/**/a.cs", "src/x/y/a.cs", True), ("**/a", "a", True),
        ("bin/", "bin", False), ("bin/", "x/bin/y", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[]x]", "]", True), ("[!a]", "b", True), ("[a-", "[a-", True), ("docs", "docs/x/y", True),
    ],
)
def test_globs(spark, glob, path, want):
    assert bool(re.fullmatch(globs.translate(glob), path)) == want


def test_last_rule_wins_and_unusable_ones_say_nothing(spark):
    rules = ["*.md", "!keep.md", "# note", "[z-a]", "[[:alpha:]]"]
    assert globs.RuleSet(rules).excludes("a/x.md") and not globs.RuleSet(rules).excludes("a/keep.md")
    rows = spark.createDataFrame([("a\\x.md",), ("Keep.md",)], "p string").select(globs.excluded(F.col("p"), rules).alias("e")).collect()
    assert [r.e for r in rows] == [True, False]


def _slow(glob, path):
    """Backtracking matcher over characters, for patterns without classes."""
    body = glob.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")

    def match(p, t):
        if not p:
            return not t or t[0] == "/"
        if p.startswith("**/"):
            return match(p[3:], t) or any(match(p, t[i + 1 :]) for i, c in enumerate(t) if c == "/" and i)
        if p[0] == "*":
            return match(p[1:], t) or bool(t) and t[0] != "/" and match(p, t[1:])
        return bool(t) and (p[0] == "?" and t[0] != "/" or p[0] == t[0]) and match(p[1:], t[1:])

    starts = [0] if anchored else [0] + [i + 1 for i, c in enumerate(path) if c == "/"]
    return any(match(body, path[s:]) for s in starts)


def test_globs_against_a_slow_matcher():
    rng = random.Random(5)
    for _ in range(3000):
        glob = "".join(rng.choice("ab*?/") for _ in range(rng.randint(1, 6)))
        path = "/".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 4)))
        if "//" in glob or "**" in glob or glob.strip("/") == "" or glob.endswith("/"):
            continue
        assert bool(re.fullmatch(globs.translate(glob), path)) == _slow(glob, path), (glob, path)
