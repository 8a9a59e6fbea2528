"""Sections of a conversation by speaker and by time, and messages matched by their occurrence."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECTION_MINUTES = 10


def timed_sections(rows: DataFrame, session: str, order: str, speaker: str, at: str, minutes: int = SECTION_MINUTES) -> DataFrame:
    """``rows`` (session, order, speaker) with section_no: a new section at a change of speaker, or ``minutes`` after its first row.

    The time runs from the section's own start, so a section is found by going through the session in order; rows pass
    by one at a time and only the open section is held. Rows without a time never end one.
    """
    schema = pa.schema([(session, pa.string()), (order, pa.int32()), (speaker, pa.string()), ("section_no", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, who, since, number = object(), None, None, 0
        for batch in batches:
            numbers = []
            for own, name, when in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if own != key:
                    key, who, since, number = own, None, None, 0
                late = when is not None and since is not None and when - since >= timedelta(minutes=minutes)
                if name != who or late or number == 0:
                    number, who, since = number + 1, name, when
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(numbers, pa.int64())], schema=schema)

    ordered = rows.select(session, F.col(order).cast("int").alias(order), speaker, at).repartition(session).sortWithinPartitions(session, order)
    return ordered.mapInArrow(run, f"{session} string, {order} int, {speaker} string, section_no long")


def matched_occurrences(first: DataFrame, second: DataFrame, by: list[str], order: str) -> DataFrame:
    """``first`` with ``matched``: the row of ``second`` that is the same occurrence of the same key, null if it never came."""
    window = Window.partitionBy(*by).orderBy(order)
    numbered = second.select(*by, F.col(order).alias("matched")).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("matched")))
    return first.withColumn("_n", F.row_number().over(window)).join(numbered, [*by, "_n"], "left").drop("_n")
