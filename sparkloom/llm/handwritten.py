"""Generated, minified, third-party and data files among source files.

Declarations come first. Attribute files (``.gitattributes`` with ``linguist-generated`` or ``linguist-vendored``) among
the files, and the exclude globs of their sources, are parsed into rules, each at its directory. For every directory the
rules above it are put in order, deeper directories before higher ones and later lines before earlier ones, and the first
that matches a file says whether it is declared. Declarations are incomplete and wrong in places, and most sources make
none, so equivalent patterns are mined from them: directory names, endings of file names, and lines of comments. A
pattern is believed if the files it matches are known for what they are by other evidence: nearly all of them, or
most of them where declarations name the pattern too. Believed patterns apply to all sources, also to those that
declare nothing, and what they tell is evidence for the next round of mining. A file that a rule takes back
(``!``, ``-linguist-generated``) is not told by its path.

The evidence that patterns are held against is in the content: a generator's notice in a comment, lines nearly all of one
or two shapes, code packed without white space, literals without logic, a library's banner. Copies of a library whose
banner was lost share their lines with copies that kept it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import globs
from sparkloom.operators import rules
from sparkloom.runtime import broadcast_if_small, cut_lineage

PACKED_SHARE = 0.5
SHAPE_ONE, SHAPE_TWO = 0.55, 0.85
LITERAL_SHARE, LITERAL_LEAST = 0.6, 300
COPY_SHARE, COPY_LINES = 0.6, 4
#: Share of a pattern's files that other evidence must tell, alone and where declarations name it; and files it must match.
BELIEVED, BELIEVED_DECLARED, BELIEVED_FILES = 0.95, 0.8, 8
#: Share of a pattern's files that a source must declare to name it.
DECLARED_SHARE = 0.9
#: Rounds of mining: patterns found in one are evidence in the next.
ROUNDS = 2

# fixed values: words of generators' notices in four languages, languages of configuration, attributes
_NOTICE = re.compile(
    r"(?im)^[ \t]*(?://|#|/\*+!?|--|;|\*|<!--)[ \t]*(?:<auto-?generated|@generated\b|auto-?generated\b|(?:code |file )?generated (?:by|from)\b|this file (?:was|is) (?:automatically )?(?:created|generated|produced)\b|.*\bautomatisch (?:erzeugt|generiert)|.*\bgénéré automatiquement|.*\bgenerado autom)"
)
_LIBRARY = re.compile(r"(?m)^[ \t]*(?://|#|/\*+!?|--|;|\*)[ \t]*([\w.@/-]+) v?\d+\.\d+(?:\.\d+)?(?: \| \(c\)| - Copyright| \*/)")
ATTRIBUTE_FILE = ".gitattributes"
ATTRIBUTES = ("linguist-generated", "linguist-vendored")
_CONFIGURATION = frozenset("yaml yml json env ini sh bash toml xml cfg conf properties md txt".split())
_COMMENT = ("//", "#", "/*", "*", "--")
_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
_NAME = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")
_LITERAL = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`|[-\d.,\s\[\]{}:]+")
_LOGIC = re.compile(r"\b(?:if|for|while|return|def|func|function|continue|raise|throw|foreach|switch|new)\b")
_PATCH = re.compile(r"[ \t]*(?://|#)[^\"']*$")


def extension(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    if name.startswith(".env"):
        return "env"
    return name.rsplit(".", 1)[-1] if "." in name else ""


def content_marks(path: str, text: str) -> list[str]:
    """What the content shows, of ``generated``, ``library``, ``packed``, ``uniform`` and ``literals``."""
    marks = []
    if _NOTICE.search(text):
        marks.append("generated")
    if _LIBRARY.search(text):
        marks.append("library")
    if extension(path) in _CONFIGURATION:
        return marks
    bare_lines = (line.strip() for line in text.replace("\r", "\n").split("\n"))
    body = [line for line in bare_lines if line and not line.startswith(_COMMENT)]
    whole = sum(map(len, body))
    if not whole:
        return marks
    packed = literal = logic = 0
    shapes: Counter = Counter()
    for line in body:
        without = _STRING.sub('"', line)
        if len(without) > 200 and without.count(" ") < 0.12 * len(without):
            packed += len(line)
        shape = _NAME.sub("a", _NUMBER.sub("0", without))
        if "a" in shape or "0" in shape or '"' in shape:
            shapes[shape] += 1
        logic += bool(_LOGIC.search(without))
        literal += sum(len(m.group()) for m in _LITERAL.finditer(line))
    if packed >= PACKED_SHARE * whole:
        marks.append("packed")
    total = sum(shapes.values())
    if total >= 6:
        top = shapes.most_common(2)
        if top[0][1] >= SHAPE_ONE * total or logic <= 0.5 * total and sum(n for _, n in top) >= SHAPE_TWO * total:
            marks.append("uniform")
    if whole >= LITERAL_LEAST and literal >= LITERAL_SHARE * whole and (logic <= 1 or logic < 0.1 * len(body)):
        marks.append("literals")
    return marks


def telling_lines(text: str) -> list[str]:
    """The distinct lines by which copies of a file know each other: long, with names and a number, trailing notes cut."""
    found = set()
    for line in text.replace("\r", "\n").split("\n"):
        line = _PATCH.sub("", line).strip()
        if len(line) > 24 and line[0] not in "/#*'\"" and any(c.isdigit() for c in line) and '"' not in line and "'" not in line:
            found.add(line)
    return sorted(found)


_WORDS = re.compile(r"[^\W\d_]+")


def comment_phrases(text: str) -> list[str]:
    """The words of each comment line before the first line of code and after the last."""
    lines = [line.strip() for line in text.replace("\r", "\n").split("\n")]
    lines = [line for line in lines if line]
    found = set()
    for side in (lines, lines[::-1]):
        for line in side:
            if not line.startswith((*_COMMENT, ";", "<!--")):
                break
            words = _WORDS.findall(line.lower())
            if len(words) > 1:
                found.add(" ".join(words))
    return sorted(f"say:{phrase}" for phrase in found)


def path_patterns(path: str) -> list[str]:
    """Candidate patterns of a path: its directory names and the endings of its file name; long numbers and hashes say nothing."""
    parts = [p for p in path.replace("\\", "/").lower().split("/") if p not in ("", ".")]
    if not parts:
        return []
    name = parts[-1]
    ends = {name[i:] for i, c in enumerate(name) if c in "._-" and i and sum(d.isdigit() for d in name[i:]) < 2}
    return sorted({f"dir:{p}" for p in parts[:-1]} | {f"end:{e}" for e in ends})


def attribute_rules(text: str | None) -> list[tuple[str, bool]]:
    """(regular expression, declares) of the lines of an attribute file that say whether files are generated or vendored."""
    found = []
    for line in (text or "").replace("\r", "\n").split("\n"):
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        rule = globs.usable(parts[0])
        for word in parts[1:]:
            name, _, value = word.lstrip("-!").partition("=")
            if rule and name in ATTRIBUTES:
                found.append((rule[1], word[0] not in "-!" and value.lower() not in ("false", "0")))
    return found


def declared_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, declared) of every file that a rule matches: what the first rule of its directory's order says.

    An attribute file outranks its source's globs, and the globs those of nothing: sources and paths that are null declare nothing.
    """
    placed = files.select("file_id", F.col("source_id").alias("scope"), rules.folded_path(F.col("relative_path")).alias("path"), "file_text")
    placed = placed.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    rule = "array<struct<rule:string,says:boolean>>"
    schema = pa.schema([("scope", pa.string()), ("dir", pa.string()), ("rank", pa.int32()), ("rules", pa.list_(pa.struct([("rule", pa.string()), ("says", pa.bool_())])))])

    def parse(parsed: Callable[[object], list[tuple[str, bool]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = [[{"rule": r, "says": d} for r, d in parsed(x)] for x in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(told, schema.field(3).type)], schema=schema)

        return run

    kinds = f"scope string, dir string, rank int, rules {rule}"
    attributes = placed.filter(F.col("path").rlike(rf"(?:^|/)\{ATTRIBUTE_FILE}$")).select("scope", "dir", F.lit(1).alias("rank"), "file_text").mapInArrow(parse(attribute_rules), kinds)
    stated = sources.select(F.col("source_id").alias("scope"), F.lit("").alias("dir"), F.lit(0).alias("rank"), "exclude_globs").filter("scope is not null and size(exclude_globs) > 0")
    rows = attributes.unionByName(stated.mapInArrow(parse(rules.parsed_lines), kinds))
    found = cut_lineage(rows.select("scope", F.col("dir").alias("base"), "rank", F.posexplode("rules").alias("no", "r")).select("scope", "base", "rank", "no", "r.*"))
    return rules.decided(placed, found, "file_id").groupBy("file_id").agg(F.max("verdict").alias("declared"))


def _features(files: DataFrame) -> DataFrame:
    """(file_id, source_id, marks, patterns, lines hashed to longs) of every file: the one pass over the texts."""
    schema = pa.schema([("file_id", pa.int64()), ("source_id", pa.string()), ("marks", pa.list_(pa.string())), ("patterns", pa.list_(pa.string())), ("lines", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for file_id, source, path, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                path, text = path or "", text or ""
                patterns = path_patterns(path) + comment_phrases(text)
                for column, value in zip(out, (file_id, source, content_marks(path, text), patterns, telling_lines(text))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    kinds = "file_id long, source_id string, marks array<string>, patterns array<string>, lines array<string>"
    found = files.select("file_id", "source_id", "relative_path", "file_text").mapInArrow(run, kinds)
    return found.withColumn("lines", F.transform("lines", lambda x: F.xxhash64(x)))


def _mined(told: DataFrame) -> DataFrame:
    """(pattern, precision) of the believed patterns, from (source_id, declared, is_told, by_content, patterns)."""
    # a bare extension is a language: what other patterns told, or that a source declares all its files of one, says nothing of it
    bare = F.col("pattern").rlike(r"^end:\.\w+$")
    each = told.select("source_id", F.coalesce("declared", F.lit(False)).alias("declared"), "is_told", "by_content", F.explode("patterns").alias("pattern"))
    each = each.withColumn("is_told", F.when(bare, F.col("by_content")).otherwise(F.col("is_told")))
    by_source = each.groupBy("pattern", "source_id").agg(F.count("*").alias("files"), F.count_if("is_told").alias("told"), F.count_if("declared").alias("declared"))
    names = F.col("declared") >= DECLARED_SHARE * F.col("files")
    by_pattern = by_source.groupBy("pattern").agg(F.sum("files").alias("files"), F.sum("told").alias("told"), F.max(names & (F.col("declared") > 0)).alias("named"))
    by_pattern = by_pattern.withColumn("precision", F.col("told") / F.col("files"))
    named = F.col("named") & ~bare
    bar = F.when(named, BELIEVED_DECLARED).otherwise(BELIEVED)
    return by_pattern.filter((F.col("files") >= BELIEVED_FILES) & (F.col("precision") >= bar)).select("pattern", "precision")


def classify(files: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per file: file_id, declared, marks, copy_share, pattern (a believed one, or null), is_produced.

    Every file_id comes out once; of repeated ids all marks count. Null and empty texts have no marks by
    content, null paths none by path; null globs declare nothing; ``declared`` is null where no rule matches.
    """
    # texts are read once: what follows works on hashes and short patterns
    rows = cut_lineage(_features(files))
    lines = rows.select("file_id", F.array_contains("marks", "library").alias("is_library"), F.size("lines").alias("n"), F.explode("lines").alias("line"))
    known = lines.filter("is_library").select("line").distinct()
    shared = (
        lines.filter(f"not is_library and n >= {COPY_LINES}")
        .join(broadcast_if_small(known, 500_000), "line", "left_semi")
        .groupBy("file_id")
        .agg(F.count("*").alias("hits"), F.max("n").alias("n"))
        .select("file_id", (F.col("hits") / F.col("n")).alias("copy_share"))
    )
    declared = declared_files(files, sources)
    told = rows.drop("lines").join(shared, "file_id", "left").join(declared, "file_id", "left").withColumn("copy_share", F.coalesce("copy_share", F.lit(0.0)))
    told = cut_lineage(told.withColumn("is_told", (F.size("marks") > 0) | (F.col("copy_share") >= COPY_SHARE)).withColumn("by_content", F.col("is_told")).withColumn("pattern", F.lit(None).cast("string")))
    for _ in range(ROUNDS):
        believed = _mined(told)
        matched = told.select("file_id", F.coalesce("declared", F.lit(True)).alias("by_path"), F.explode("patterns").alias("found"))
        # a file that a rule takes back is not told by its path
        matched = matched.filter(F.col("by_path") | F.col("found").startswith("say:")).join(broadcast_if_small(believed.withColumnRenamed("pattern", "found"), 200_000), "found")
        best = matched.groupBy("file_id").agg(F.max_by("found", F.struct("precision", "found")).alias("found"))
        told = told.join(best, "file_id", "left").withColumn("pattern", F.coalesce("pattern", "found")).withColumn("is_told", F.col("is_told") | F.col("found").isNotNull()).drop("found")
    return told.groupBy("file_id").agg(
        F.max("declared").alias("declared"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("marks")))).alias("marks"),
        F.max("copy_share").alias("copy_share"),
        F.max("pattern").alias("pattern"),
        F.max("is_told").alias("is_produced"),
    )
