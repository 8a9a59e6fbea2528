from sparkloom.llm import handwritten as hand
from sparkloom.llm import subjects as subj

FILES = "file_id long, source_id string, relative_path string, file_text string, marks int, pattern string"
HAND = "def trim(locker, limit=391):\n    kept = []\n    for item in locker.items():\n        if item.size > limit:\n            continue\n        kept.append(item.release(15))\n    return sorted(kept)\n"


def classify(spark, rows, globs=()):
    files = spark.createDataFrame([(i, s, p, t, 0, "x") for i, s, p, t in rows], FILES)
    sources = spark.createDataFrame([(s, g, "x") for s, g in globs], "source_id string, exclude_globs array<string>, marks string")
    return {r.file_id: r for r in hand.classify(files, sources).collect()}


def library(n):
    """Functions no other file has."""
    return "\n".join(f"def walk_{n}_{i}(plot, limit={100 + 7 * i + n}):\n    kept = plot.items_{n}({i})\n    return kept.trim({i}, {n})\n" for i in range(8))


def test_what_content_tells(spark):
    numbers = "module.exports = [\n" + ",\n".join(", ".join(str(i * j % 977) for j in range(20)) for i in range(30)) + "\n];\n"
    packed = "function a(b,c){return b?c.d(12):null}for(var e=0;f<g.length;h++)i.j=99;" * 20
    stub = "\n".join(f"_X.fields_by_number[{i}]._options = None\n_X.fields_by_number[{i}]._start = {i * 7}" for i in range(20))
    rows = [
        (1, "s", "a/hand.py", HAND), (2, "s", "a/g.py", "# Code generated by x-gen v1. DO NOT EDIT.\n" + HAND), (3, "s", "a/d.js", numbers), (4, "s", "a/m.js", packed), (5, "s", "a/p.py", stub),
        (6, "s", "a/banner.py", "BANNER = 'Code generated by x. DO NOT EDIT.'\n" + HAND), (7, "s", "a/c.yaml", "\n".join(f"k{i}:\n  limit: {i}" for i in range(30))), (8, "s", "vendor/q/q.py", "# q v1.2.3 | (c) 2007 the q authors | MIT license\n" + HAND),
        (9, "s", "a/table.py", HAND + "ROW = '" + ",".join(map(str, range(200))) + "'\n"), (10, "s", "x/generated_report.py", HAND),
    ]
    got = {k for k, r in classify(spark, rows).items() if r.is_produced}
    assert got == {2, 3, 4, 5, 8}


def test_copies_without_their_notice(spark):
    kept = "# lib v1.2.3 | (c) 2007 the lib authors | MIT license\n" + library(1)
    patched = library(1).replace(")\n", ")  # patched 1.2.4\n", 3)
    got = classify(spark, [(1, "s", "vendor/lib/a.py", kept), (2, "t", "src/other.py", patched), (3, "t", "src/own.py", library(2)), (4, "t", "src/hand.py", HAND)])
    assert {k for k, r in got.items() if r.is_produced} == {1, 2} and got[2].copy_share >= hand.COPY_SHARE


def test_believed_patterns_reach_sources_that_declare_nothing(spark):
    rows = [(i, "s", f"gen/f{i}.py", "# @generated from x.schema\n" + HAND) for i in range(25)] + [(99, "t", "gen/f99.py", HAND), (100, "t", "src/f.py", HAND)]
    got = classify(spark, rows, [("s", ["gen/", "!gen/f3.py"])])
    assert got[99].is_produced and got[99].pattern and not got[100].is_produced
    assert got[1].declared and not got[3].declared and not got[99].declared


def test_odd_rows(spark):
    got = classify(spark, [(1, None, None, None), (1, "s", "a.py", ""), (2, "s", "b.min.js", "x"), (None, "s", "c.py", HAND)], [("s", None)])
    assert not any(r.is_produced for r in got.values()) and set(got) == {1, 2, None}
    assert classify(spark, []) == {}


AREAS = [("sport", ["goalkeeper", "penalty kick"]), ("law", ["plaintiff", "court ruling"]), ("software", ["unit test"])]
SPORT = ["The goalkeeper saved a penalty kick near the town.", "A goalkeeper met the referee after the match.", "The referee gave one more penalty kick today."]
LAW = ["The plaintiff waited for a court ruling in spring.", "Every court ruling named one plaintiff and a clerk.", "A tribunal read the court ruling to the plaintiff."]


def shares(spark, docs, labels=()):
    documents = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, subject string, share double")
    areas = spark.createDataFrame([(*a, 1) for a in AREAS], "subject string, sample_terms array<string>, doc_id int")
    known = spark.createDataFrame([(n, *x, "a") for n, x in enumerate(labels)], "label_id int, doc_id long, subject string, text string")
    return {(r.doc_id, r.subject): r.share for r in subj.subject_shares(documents, areas, known).collect()}


def test_subjects_by_share(spark):
    docs = [(1, " ".join(SPORT)), (2, " ".join(LAW)), (3, " ".join(SPORT) + "\n\n" + " ".join(LAW)), (4, " ".join(SPORT * 4) + "\n\n" + LAW[0]), (5, None), (6, " \n"), (7, "The letter lay on the table for many days.")]
    got = set(shares(spark, docs))
    assert got == {(1, "sport"), (2, "law"), (3, "sport"), (3, "law"), (4, "sport")}


def test_code_counts_as_software_beside_its_prose(spark):
    code = "\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(12))
    got = set(shares(spark, [(1, " ".join(SPORT) + "\n\n" + code), (2, "commit " + "a" * 40 + "\nauthor X\n\n" + " ".join(LAW))]))
    assert got == {(1, "software"), (1, "sport"), (2, "software"), (2, "law")}


def test_labels_spread_to_words_they_do_not_name(spark):
    docs = [(i, f"The velodrome hosted a criterium number {'abc'[i % 3]} again. A peloton crossed the velodrome at noon.") for i in range(12)]
    assert shares(spark, docs) == {}
    got = shares(spark, docs, [(i, "sport") for i in range(5)] + [(0, "sport"), (None, "law"), (3, "unknown"), (777, "law")])
    assert {d for d, s in got if s == "sport"} == set(range(12)) and {s for _, s in got} == {"sport"}


def test_one_wrong_label_is_overruled(spark):
    docs = [(i, " ".join(SPORT)) for i in range(9)] + [(i, " ".join(LAW)) for i in range(9, 18)]
    labels = [(i, "sport") for i in range(1, 8)] + [(0, "law")] + [(i, "law") for i in range(9, 16)]
    got = set(shares(spark, docs, labels))
    assert (0, "sport") in got and (0, "law") not in got


def test_empty_tables(spark):
    assert shares(spark, []) == {}
