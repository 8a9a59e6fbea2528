"""Splitting oversized items at natural boundaries by dynamic programming.

A piece ends at one of the item's boundaries, and the next one begins ``overlap`` characters before that end.
Over the boundary positions e(1) < … < e(m) = length the programme minimises

    sum of penalty(e(i)) + BALANCE * ((e(i) - e(i-1) - target) / stride) ** 2

where no piece is longer than the limit, stride = limit - overlap and target is the equal share of the fewest
pieces that can do. Penalties rank the boundaries: starts of definitions and headings or the set's own
pattern, blank lines, line ends, sentence ends, word ends, and last a cut inside a word.

The positions are all natural boundaries of the item: pattern starts, blank lines, line ends and sentence ends. Where a
stretch of ``1 / CELLS`` of a stride holds none, its last word end is one, or else a safe place inside a word, so that a
stride always holds a place to cut, even in text without any space. Every pair of positions within reach is weighed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import broadcast_if_small

CELLS = 10
BALANCE = 1.5
DEFAULT_SIZE, DEFAULT_OVERLAP, DEFAULT_MODE = 256, 32, "blank-line"
MAX_BROADCAST_SETS = 50_000
#: Positions within reach beyond which they are weighed as one array.
DENSE = 48

STRONG, BLANK_LINE, LINE, SENTENCE, WORD, INSIDE = 0.0, 0.2, 0.7, 1.0, 2.0, 6.0
_OPENING = re.compile(
    r"(?m)^(?=[ \t]{0,8}(?:(?:public|private|protected|internal|export|async|def|class|func|function|interface|struct|enum|namespace|package|module)\b|#{1,6} |\\(?:sub)*section\b|<h[1-6]\b|=+ ?\S))"
)
_SENTENCE_ENDS = (". ", "? ", "! ", "。", "！", "？")


def pattern_starts(text: str, mode: str | None, pattern: str | None) -> list[int]:
    """Where the mode's own pattern says a part begins; an unusable pattern gives none."""
    if mode == "custom" and pattern:
        try:
            found = re.compile(pattern, re.MULTILINE).finditer(text)
            starts = (text.rfind("\n", 0, m.start() + (m.group().startswith("\n"))) + 1 for m in found)
            return sorted({s for s in starts if 0 < s < len(text)})
        except re.error:
            return []
    if mode == "language-aware":
        return [m.start() for m in _OPENING.finditer(text) if m.start()]
    return []


def _safe(text: str, at: int, low: int) -> int:
    """Move a cut inside a word back from between a line end's two characters or before a combining mark."""
    while at > low + 1 and (text[at - 1 : at + 1] == "\r\n" or 0x300 <= ord(text[at]) <= 0x36F or ord(text[at]) in (0x200D, 0xFE0F)):
        at -= 1
    return at


def positions(text: str, begin: int, end: int, cell: int, mode: str | None, starts: list[int]) -> tuple[list[int], list[float]]:
    """The boundary positions of ``text[begin:end]`` after ``begin``, ascending, and their penalties; the last is ``end``."""
    cost: dict[int, float] = {}
    find = text.find
    for mark in _SENTENCE_ENDS[:3] if text.isascii() else _SENTENCE_ENDS:
        at = find(mark, begin, end)
        while at >= 0:
            cost[at + len(mark)] = SENTENCE
            at = find(mark, at + 1, end)
    at = find("\n", begin, end)
    while at >= 0:
        blank = mode != "none" and at > begin and text[at - 1] == "\n"
        cost[at + 1] = BLANK_LINE if blank else LINE
        at = find("\n", at + 1, end)
    for at in starts[bisect_left(starts, begin + 1) : bisect_left(starts, end)]:
        cost[at] = STRONG
    cost.pop(end, None)
    places, costs, low = [], [], begin
    for at in [*sorted(cost), end]:
        while at - low > cell:
            high = low + cell
            word = text.rfind(" ", low, high) + 1
            places.append(word or _safe(text, high, low))
            costs.append(WORD if word else INSIDE)
            low = places[-1]
        places.append(at)
        costs.append(cost.get(at, 0.0))
        low = at
    return places, costs


def best_cuts(text: str, begin: int, end: int, limit: int, overlap: int, mode: str | None, starts: list[int]) -> list[int]:
    """The ends of the pieces of ``text[begin:end]``; the last is ``end``."""
    length = end - begin
    if length <= limit:
        return [end]
    stride = limit - overlap
    places, costs = positions(text, begin, end, max(1, stride // CELLS), mode, starts)
    return [places[j] for j in cheapest_path(places, costs, begin, limit, overlap)]


def cheapest_path(places: list[int], costs: list[float], begin: int, limit: int, overlap: int) -> list[int]:
    """Indexes of the positions that the programme cuts at, in order."""
    stride, length = limit - overlap, places[-1] - begin
    pieces = max(2, math.ceil((length - overlap) / stride))
    target, scale = (length - overlap) / pieces, BALANCE / (stride * stride)
    total, back, first = [], [], 0
    for j, here in enumerate(places):
        best, via = math.inf, -1
        if here - begin <= limit:
            size = here - begin - overlap - target
            best = size * size * scale
        while here - places[first] > stride:
            first += 1
        if j - first > DENSE:
            sizes = here - target - np.array(places[first:j])
            values = np.array(total[first:j]) + sizes * sizes * scale
            at = int(values.argmin())
            if values[at] < best:
                best, via = float(values[at]), first + at
        else:
            ahead = here - target
            for i in range(first, j):
                size = ahead - places[i]
                value = total[i] + size * size * scale
                if value < best:
                    best, via = value, i
        total.append(best + costs[j])
        back.append(via)
    path, j = [], len(places) - 1
    while j >= 0:
        path.append(j)
        j = back[j]
    return path[::-1]


def pieces_of(text: str, begin: int, end: int, limit: int, overlap: int, mode: str | None = None, starts: list[int] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an item: within the limit, together the item, each overlap exactly as given."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    cuts = best_cuts(text, begin, end, limit, overlap, mode, starts or [])
    return list(zip([begin, *(c - overlap for c in cuts[:-1])], cuts))


def items_of(length: int, units: list[dict] | None, unit_aware: bool) -> list[tuple[int, int, int]]:
    """(unit_no, begin, end): the units in (start_offset, unit_no) order, or the whole text as unit 0."""
    marks = sorted(
        (min(max(u["start_offset"], 0), length), u["unit_no"]) for u in units or () if u and u["start_offset"] is not None and u["unit_no"] is not None
    )
    if not unit_aware or not marks:
        return [(0, 0, length)]
    ends = [m[0] for m in marks[1:]] + [length]
    items = [(no, begin, end) for (begin, no), end in zip(marks, ends)]
    return [(0, 0, marks[0][0])] * (marks[0][0] > 0) + items


def effective_sets(chunk_sets: DataFrame) -> DataFrame:
    """Each set with its null settings taken from its corpus's default set (of several the lowest id), then from constants."""
    settings = ["chunk_set_id", "corpus_id", "chunk_size", "chunk_overlap", "boundary_mode", "custom_pattern", "unit_aware", "is_default", "chars_per_token"]
    chunk_sets = chunk_sets.select(*settings)
    base = chunk_sets.filter("is_default").groupBy("corpus_id").agg(
        F.min(F.struct("chunk_set_id", "chunk_size", "chunk_overlap", "boundary_mode", "custom_pattern")).alias("base")
    )

    def own(name: str, last) -> F.Column:
        return F.coalesce(F.col(name), F.col(f"base.{name}"), F.lit(last)).alias(name)

    return chunk_sets.join(broadcast_if_small(base, MAX_BROADCAST_SETS), "corpus_id", "left").select(
        "chunk_set_id",
        "corpus_id",
        own("chunk_size", DEFAULT_SIZE),
        own("chunk_overlap", DEFAULT_OVERLAP),
        own("boundary_mode", DEFAULT_MODE),
        F.coalesce(F.col("custom_pattern"), F.when(F.col("boundary_mode").isNull(), F.col("base.custom_pattern"))).alias("custom_pattern"),
        F.coalesce("unit_aware", F.lit(False)).alias("unit_aware"),
        F.coalesce("chars_per_token", F.lit(4.0)).alias("chars_per_token"),
    )


def split_texts(texts: DataFrame, chunk_sets: DataFrame, with_text: bool = False) -> DataFrame:
    """The pieces of every item of ``texts`` (text_id, corpus_id, body, units) over the limit of a set of its corpus.

    Columns: chunk_set_id, text_id, unit_no, piece_no (from 1), start_offset, end_offset (code points into the
    body) and, if asked for, text. The limit is chunk_size * chars_per_token characters; an item at or under
    it gives no rows. Null and empty bodies and texts without a set give none; units without an offset or a
    number are ignored, and offsets beyond the text count as its end. Repeated text_ids are repeated items.
    """
    sets = (
        effective_sets(chunk_sets)
        .groupBy("corpus_id")
        .agg(F.collect_list(F.struct("chunk_set_id", "chunk_size", "chunk_overlap", "boundary_mode", "custom_pattern", "unit_aware", "chars_per_token")).alias("sets"))
    )
    rows = (
        texts.select("text_id", "corpus_id", "body", "units")
        .filter(F.length("body") > 0)
        .join(broadcast_if_small(sets, MAX_BROADCAST_SETS), "corpus_id")
        .select("text_id", "body", F.col("units").cast("array<struct<unit_no:int,start_offset:int,unit_label:string>>").alias("units"), "sets")
    )
    names = ["chunk_set_id", "text_id", "unit_no", "piece_no", "start_offset", "end_offset"] + ["text"] * with_text
    schema = pa.schema(
        [("chunk_set_id", pa.string()), ("text_id", pa.int64()), ("unit_no", pa.int32()), ("piece_no", pa.int32()), ("start_offset", pa.int32()), ("end_offset", pa.int32())]
        + [("text", pa.string())] * with_text
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text_id, body, units, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                known: dict[tuple, list[int]] = {}
                for s in own:
                    limit = math.floor(s["chunk_size"] * s["chars_per_token"] + 1e-9)
                    if len(body) <= limit:
                        continue
                    overlap = math.floor(s["chunk_overlap"] * s["chars_per_token"] + 1e-9)
                    key = (s["boundary_mode"], s["custom_pattern"])
                    if key not in known:
                        known[key] = pattern_starts(body, *key)
                    for unit_no, begin, end in items_of(len(body), units, s["unit_aware"]):
                        if end - begin <= limit:
                            continue
                        for no, (a, b) in enumerate(pieces_of(body, begin, end, limit, overlap, key[0], known[key]), 1):
                            row = (s["chunk_set_id"], text_id, unit_no, no, a, b) + ((body[a:b],) if with_text else ())
                            for column, value in zip(out, row):
                                column.append(value)
                if len(out[0]) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    kinds = "chunk_set_id string, text_id long, unit_no int, piece_no int, start_offset int, end_offset int" + ", text string" * with_text
    return rows.mapInArrow(run, kinds)


def oversized_items(texts: DataFrame, chunk_sets: DataFrame) -> DataFrame:
    """(chunk_set_id, text_id, unit_no) of every item that had to be split: its first piece stands for it."""
    return split_texts(texts, chunk_sets).filter("piece_no = 1").select("chunk_set_id", "text_id", "unit_no")
