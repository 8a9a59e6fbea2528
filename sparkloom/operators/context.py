"""Context for a reader: chunks of files in order, neighbours of hits, passages put together, blocks under a budget.

Everything is DataFrames. A passage is one file's lines among the hits and neighbours of one question, so the groups
gathered here are bounded by what a question may return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.presentation import CONTEXT_CHARS, DISCLOSURE, HEADER_ALLOWANCE, MIN_PARTIAL

MAX_POINTS = 250_000
OVERLAP_MOST = 8192


def fixed_chunks(files: DataFrame, key: str, text: str, size: int = 20, step: int = 16) -> DataFrame:
    """``files`` with chunk_index, start_line, end_line (from 1) and content: windows of ``size`` lines, one every ``step``."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    cut = files.filter(F.length(text) > 0).withColumn("_lines", lines)
    count = F.greatest(F.lit(1), F.ceil((F.size("_lines") - (size - step)) / F.lit(step))).cast("int")
    rows = cut.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), count - 1)))
    first = F.col("chunk_index") * step + 1
    return rows.select(
        *(c for c in files.columns if c != text), "chunk_index", first.alias("start_line"),
        F.least(first + size - 1, F.size("_lines")).alias("end_line"), F.array_join(F.slice("_lines", first, size), "\n").alias("content"),
    )


def points_per_file(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Chunks per file; null (unknown) for a file of more than ``MAX_POINTS``."""
    counted = chunks.groupBy(*key).agg(F.count("*").alias("points"))
    return counted.withColumn("points", F.when(F.col("points") <= MAX_POINTS, F.col("points")))


def with_neighbours(hits: DataFrame, chunks: DataFrame, group: list[str], file: list[str], reach: int) -> DataFrame:
    """Chunks within ``reach`` of a hit in the same file, each once per ``group``: an equality join on the places about each hit."""
    places = hits.select(*group, *file, F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index"))
    return places.distinct().join(chunks, [*file, "chunk_index"])


def passages(pieces: DataFrame, group: list[str], file: list[str]) -> DataFrame:
    """One row per file of a group: its pieces in line order, lines that were said left out, gaps disclosed.

    Columns: group, file, start_line, end_line, gaps, text. A piece within what was said adds nothing.
    """
    order = Window.partitionBy(*group, *file).orderBy("start_line", "chunk_index")
    through = F.coalesce(F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = pieces.withColumn("_through", through).filter(F.col("end_line") > F.col("_through"))
    skipped = F.greatest(F.col("_through") - F.col("start_line") + 1, F.lit(0))
    body = F.split("content", "\n", -1)
    shown = F.array_join(F.slice(body, skipped + 1, F.greatest(F.size(body) - skipped, F.lit(0))), "\n")
    gap = (F.col("_through") > 0) & (F.col("start_line") > F.col("_through") + 1)
    note = F.concat(F.lit("… lines "), F.col("_through") + 1, F.lit("-"), F.col("start_line") - 1, F.lit(" not indexed …\n"))
    said = F.concat(F.when(gap, note).otherwise(""), shown)
    parts = fresh.select(*group, *file, "start_line", "end_line", gap.cast("int").alias("_gap"), F.struct("start_line", "chunk_index", said.alias("said")).alias("_said"))
    return parts.groupBy(*group, *file).agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("_gap").alias("gaps"),
        F.array_join(F.transform(F.array_sort(F.collect_list("_said")), lambda s: s["said"]), "\n").alias("text"),
    )


def spend(candidates: DataFrame, group: list[str], order: list[str], chars: str, budget: int = CONTEXT_CHARS) -> DataFrame:
    """``candidates`` with ``decision`` (used, partial or dropped) and ``shown``, the characters that fit.

    Blocks are taken in order while they fit; one that does not is passed over for smaller ones, and the first that may
    be cut takes what is left. The candidates of one group, a question's passages, are folded as one array.
    """
    entry = F.struct(*order, F.col(chars).cast("int").alias("chars"))
    sorted_ = F.array_sort(F.collect_list(entry))
    start = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("cut"), F.array().cast("array<struct<decision:string,shown:int>>").alias("out"))

    def step(acc: Column, one: Column) -> Column:
        cost, room = one["chars"] + HEADER_ALLOWANCE, acc["left"] - HEADER_ALLOWANCE - DISCLOSURE
        fits, may = cost <= acc["left"], ~acc["cut"] & (room >= MIN_PARTIAL)
        told = F.struct(
            F.when(fits, "used").when(may, "partial").otherwise("dropped").alias("decision"), F.when(fits, one["chars"]).when(may, room).otherwise(F.lit(0)).cast("int").alias("shown")
        )
        return F.struct(
            F.when(fits, acc["left"] - cost).when(may, F.lit(0)).otherwise(acc["left"]).cast("int").alias("left"),
            (acc["cut"] | (~fits & may)).alias("cut"),
            F.concat(acc["out"], F.array(told)).alias("out"),
        )

    told = candidates.groupBy(*group).agg(sorted_.alias("_all")).withColumn("_out", F.aggregate("_all", start, step, lambda acc: acc["out"]))
    return told.select(*group, F.explode(F.arrays_zip("_all", "_out")).alias("z")).select(*group, *(F.col(f"z._all.{c}") for c in order), F.col("z._all.chars"), "z._out.*")


def cut_to_lines(text: Column, budget: int, line_numbers: bool = True) -> Column:
    """``text`` cut at the last line end within the budget; without line numbers at a word, if lines would waste more than half. "" if nothing fits."""
    ceiling = F.least(F.lit(budget), F.length(text) - 1)
    head = F.substring(text, F.lit(1), ceiling + 1)
    line = F.length(F.regexp_extract(head, r"(?s)^.*\n", 0)) - 1
    word = F.length(F.regexp_extract(head, r"(?s)^.* ", 0)) - 1
    by_line = F.when(line > 0, F.substring(text, F.lit(1), line)).otherwise("")
    if not line_numbers:
        by_line = F.when((line < F.floor(ceiling / 2)) & (word > line), F.substring(text, F.lit(1), word)).otherwise(by_line)
    return F.when(text.isNull(), text).when(F.lit(budget <= 0), "").when(F.length(text) <= budget, text).otherwise(by_line)


def location(path: Column, start_line: Column, end_line: Column, unit_no: Column) -> Column:
    """``path:line``, ``path:first-last``, or ``path#page=n`` with the unit's name by format."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    anchor = F.when(extension == "epub", "chapter").when(extension.isin("pptx", "ppt"), "slide").otherwise("page")
    lines = F.when(start_line == end_line, F.concat(path, F.lit(":"), start_line.cast("string"))).otherwise(F.concat(path, F.lit(":"), start_line.cast("string"), F.lit("-"), end_line.cast("string")))
    return F.when(unit_no.isNotNull(), F.concat(path, F.lit("#"), anchor, F.lit("="), unit_no.cast("string"))).otherwise(lines)


def header(place: Column, unit_no: Column, start_line: Column, end_line: Column, corpus: Column, root: Column, section: Column) -> Column:
    """A block's header: its location, the lines behind a unit, corpus and source root, and the section."""
    lines = F.when(unit_no.isNotNull() & start_line.isNotNull(), F.concat(F.lit(" · lines "), start_line.cast("string"), F.lit("-"), end_line.cast("string"))).otherwise("")
    within = F.when(F.length(root) > 0, F.concat(F.lit(" · in "), root)).otherwise("")
    named = F.when(F.length(section) > 0, F.concat(F.lit(" · "), section)).otherwise("")
    return F.concat(place, lines, F.lit(" (corpus: "), corpus, within, F.lit(")"), named)


def halves(text: Column) -> tuple[Column, Column]:
    """A chunk too long for a model in two: at the last line end before the middle, else the last space, else the middle."""
    middle = F.floor(F.length(text) / 2).cast("int")
    head = F.substring(text, F.lit(1), middle)
    line, word = F.length(F.regexp_extract(head, r"(?s)^.+\n", 0)) - 1, F.length(F.regexp_extract(head, r"(?s)^.+ ", 0)) - 1
    at = F.when(line > 0, line).when(word > 0, word).otherwise(middle)
    first, second = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    return F.regexp_replace(first, r"\n+$", ""), F.regexp_replace(second, r"^\n+", "")


def shared_ends(left: Column, right: Column) -> Column:
    """How many characters the end of ``left`` and the beginning of ``right`` have in common, the longest run up to 8,192."""
    most = F.least(F.length(left), F.length(right), F.lit(OVERLAP_MOST))
    lengths = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    same = F.filter(lengths, lambda n: F.substring(left, F.length(left) - n + 1, n) == F.substring(right, F.lit(1), n))
    return F.coalesce(F.array_max(same), F.lit(0))


def heading_trails(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, level, trail) of every ATX heading: its own name behind those of the levels above it, fenced code aside.

    A heading of a lower level number ends all deeper ones. Windows run over the headings of one text.
    """
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    rows = texts.filter(F.length(text) > 0).select(key, F.posexplode(lines).alias("_at", "_line"))
    fence = F.col("_line").rlike(r"^ {0,3}(```|~~~)")
    marks = rows.filter(fence | F.col("_line").rlike(r"^ {0,3}#{1,6}[ \t]+")).withColumn("_fence", fence.cast("int"))
    upto = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    open_ = marks.withColumn("_open", F.sum("_fence").over(upto) % 2).filter("_fence = 0 and _open = 0")
    parts = open_.withColumn("level", F.length(F.regexp_extract("_line", r"^ {0,3}(#{1,6})", 1)))
    name = F.regexp_replace(F.regexp_extract("_line", r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*$", 1), r"[ \t]+#+$", "")
    parts = parts.withColumn("name", name)
    last = lambda n: F.last(F.when(F.col("level") == n, F.struct("_at", "name")), True).over(upto)
    for n in range(1, 7):
        parts = parts.withColumn(f"_h{n}", last(n))
    # a heading above counts while no heading of a lower level came after it
    trail, floor = [], F.lit(-1)
    for n in range(1, 7):
        at = F.col(f"_h{n}._at")
        trail.append(F.when((F.lit(n) <= F.col("level")) & (at > floor), F.col(f"_h{n}.name")))
        floor = F.greatest(floor, F.coalesce(at, F.lit(-1)))
    return parts.select(key, (F.col("_at") + 1).alias("line_no"), "level", F.concat_ws(" > ", *trail).alias("trail"))
