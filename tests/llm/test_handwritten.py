from sparkloom.llm import handwritten as hw

FILES = "file_id long, source_id string, relative_path string, file_text string, dir string, rules int"
HAND = "def settle(a, b):\n    total = a + b\n    if total > 3:\n        return total\n    raise ValueError(a)\n"
PACKED = "var " + ",".join(f"a{i}=function(b){{return b*{i}}}" for i in range(60)) + ";\n"


def declared(spark, files, globs=()):
    rows = spark.createDataFrame([(i, s, p, t, "x", 1) for i, (s, p, t) in enumerate(files)], FILES)
    sources = spark.createDataFrame(list(globs), "source_id string, exclude_globs array<string>")
    return {r.file_id: r.declared for r in hw.declared_files(rows, sources).collect()}


def test_attribute_files_are_parsed():
    text = "# note\n*.pb.go linguist-generated=true\nlib/** linguist-vendored\nlib/own/** -linguist-vendored\n*.txt text\n*.x linguist-generated=false\n"
    assert [d for _, d in hw.attribute_rules(text)] == [True, True, False, False]
    assert hw.attribute_rules(None) == []


def test_rules_of_deeper_directories_and_later_lines_come_first(spark):
    files = [
        ("s", ".gitattributes", "*.go linguist-generated\n"),
        ("s", "pkg/.gitattributes", "*.go -linguist-generated\nout/*.go linguist-generated\n"),
        ("s", "a.go", ""), ("s", "pkg\\a.go", ""), ("s", "pkg/out/a.go", ""), ("s", "pkg/a.py", ""), ("t", "a.go", ""), ("s", None, ""), (None, "a.go", ""),
    ]
    assert declared(spark, files) == {2: True, 3: False, 4: True}


def test_attribute_files_outrank_the_globs_of_their_source(spark):
    files = [("s", "./Vendor/x.js", ""), ("s", "vendor/README.md", ""), ("s", "gen/.gitattributes", "* -linguist-generated\n"), ("s", "gen/x.js", ""), ("t", "vendor/x.js", "")]
    globs = [("s", ["vendor/", "!vendor/README.md", "gen/", None]), ("t", None), (None, ["vendor/"])]
    # a rule of the root says "gen/" and one of the directory takes it back, its own file included
    assert declared(spark, files, globs) == {0: True, 1: False, 2: False, 3: False}


def classify(spark, files, globs=()):
    rows = spark.createDataFrame([(i, s, p, t, "x", 1) for i, (s, p, t) in enumerate(files)], FILES)
    return {r.file_id: r for r in hw.classify(rows, spark.createDataFrame(list(globs), "source_id string, exclude_globs array<string>")).collect()}


def test_patterns_are_mined_and_applied_to_sources_that_declare_nothing(spark):
    told = [("s", f"bundle/f{i}.js", PACKED) for i in range(8)]
    plain = [("t", f"src/f{i}.py", HAND) for i in range(8)]
    hidden = [("t", "bundle/odd.ts", HAND)]
    got = classify(spark, told + plain + hidden)
    assert not got[16].is_produced  # 8 of 9 files are not enough by themselves …
    got = classify(spark, told + plain + hidden, [("s", ["bundle/"])])
    assert got[16].is_produced and got[16].pattern == "dir:bundle"  # … but where declarations name the pattern
    assert not any(got[i].is_produced for i in range(8, 16))
    got = classify(spark, told + plain + hidden, [("s", ["bundle/"]), ("t", ["!bundle/odd.ts"])])
    assert not got[16].is_produced  # a rule takes the file back


def test_a_glob_over_handwritten_files_is_not_believed(spark):
    files = [("s", f"legacy/f{i}.py", HAND + f"# {i}\n") for i in range(12)]
    assert not any(r.is_produced for r in classify(spark, files, [("s", ["legacy/**"])]).values())


def test_empty_and_null_files(spark):
    got = classify(spark, [("s", None, None), (None, "a.py", ""), ("s", "b.js", PACKED)])
    assert {i: r.is_produced for i, r in got.items()} == {0: False, 1: False, 2: True}
    assert classify(spark, [("s", "a", "b")][:0] or [("s", "a.py", HAND)])[0].is_produced is False
