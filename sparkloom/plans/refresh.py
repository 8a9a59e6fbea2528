"""One incremental run over a folder: list, compare, read what changed, cut it into chunks, and put that on record.

What is done is kept by the ledger: a file is an item, its content hash with the chunking fingerprint the version. A file
whose size and time are those on record is settled and not read; one whose hash is the same is not processed again. Chunks go
to the lease's own path and count only once it is committed, so a run that dies leaves its files pending and a retry
overwrites what it wrote. Files that vanished become items too. A file whose extraction failed is tried again by the next
runs, ``TRIES`` times; one that cannot be read at all settles until it changes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import chunker
from sparkloom.operators.ledger import Lease, WorkLedger
from sparkloom.runtime import cut_lineage
from sparkloom.sources import extract, workspace

GONE = "gone"
TRIES = 3
LEASE_MINUTES = 60
CHUNKS = "relative_path string, chunk_index int, start_line int, end_line int, section string, symbols array<string>, content string, token long"
FILES = "relative_path string, length long, modified timestamp, version string, error string, token long"


@dataclass
class Chunking:
    size: int = 256
    overlap: int = 32
    mode: str = "language-aware"
    chars_per_token: float = 4.0

    def fingerprint(self) -> str:
        return f"{self.size}|{self.overlap}|{self.mode}|{self.chars_per_token}|x{extract.EXTRACTOR_VERSION}"


@dataclass
class Outcome:
    token: int | None = None
    counts: dict[str, int] = field(default_factory=dict)


class Corpus:
    """The chunks of one folder, kept up to date in a shared folder."""

    def __init__(self, spark: SparkSession, root: str, folder: str, chunking: Chunking | None = None, **walk):
        self.spark, self.root, self.folder, self.chunking, self.walk = spark, root.rstrip("/"), folder.rstrip("/"), chunking or Chunking(), walk
        self.book = WorkLedger(spark, f"{self.folder}/ledger")

    def _outputs(self, part: str, kinds: str) -> DataFrame:
        """Rows of every lease's output that are the latest on record for their file."""
        done = self.book.done()
        tokens = [r.token for r in done.select("token").distinct().collect()]  # one a run
        paths = [f"{self.book.folder}/output/token={t}/{part}" for t in tokens]
        if not paths:
            return self.spark.createDataFrame([], kinds)
        rows = self.spark.read.schema(kinds).parquet(*paths)
        return rows.join(done.select(F.col("item").alias("relative_path"), "token"), ["relative_path", "token"], "left_semi")

    def chunks(self) -> DataFrame:
        """The chunks of all files on record."""
        return self._outputs("chunks", CHUNKS)

    def files(self) -> DataFrame:
        """What is on record of each file; files that vanished are not on it."""
        return self._outputs("files", FILES).filter(F.col("version") != GONE)

    def _read(self, listed: DataFrame) -> DataFrame:
        root = self.root.removeprefix("file://")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 32) for i in range(0, batch.num_rows, 32)):
                    contents = []
                    for path in part.column(0).to_pylist():
                        try:
                            with open(os.path.join(root, path), "rb") as file:
                                contents.append(file.read())
                        except OSError:  # gone or closed since it was listed
                            contents.append(None)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], [*part.schema.names, "content"])

        return listed.mapInArrow(run, "relative_path string, length long, modified timestamp, content binary")

    def refresh(self, holder: str, now: datetime, until: datetime | None = None) -> Outcome:
        """One run. Counts: listed, settled, same content, indexed, failed, deleted."""
        walked = workspace.walk(self.spark, self.root, **self.walk).filter("reason is null").select("relative_path", "length", "modified")
        listed = cut_lineage(walked)
        known = cut_lineage(self.files())
        retried = (F.col("error").startswith("failed")) & ~F.col("version").endswith(f"!{TRIES - 1}")
        fresh_print = F.col("version").contains(self.chunking.fingerprint())
        settled = known.filter(~F.coalesce(retried, F.lit(False)) & fresh_print).select("relative_path", "length", "modified")
        unsettled = listed.join(settled, ["relative_path", "length", "modified"], "left_anti")
        read = self._read(unsettled.select("relative_path", "length", "modified")).filter("content is not null")
        tries = known.select("relative_path", F.col("version").alias("_was"), F.when(F.col("error").startswith("failed"), F.coalesce(F.regexp_extract("version", r"!(\d+)$", 1).try_cast("int"), F.lit(0)) + 1).alias("_try"))
        base = F.concat(F.sha2("content", 256), F.lit("|" + self.chunking.fingerprint()))
        same = F.col("_was").startswith(base) & (F.col("_try") <= TRIES - 1)
        version = F.when(same, F.concat(base, F.lit("!"), F.col("_try"))).otherwise(base)
        read = cut_lineage(read.join(tries, "relative_path", "left").withColumn("version", version).drop("_was", "_try"))
        gone = known.select("relative_path").join(listed, "relative_path", "left_anti")
        items = read.select(F.col("relative_path").alias("item"), "version").unionByName(gone.select(F.col("relative_path").alias("item"), F.lit(GONE).alias("version")))
        lease, leased = self.book.lease(items, holder, now, until or now + timedelta(minutes=LEASE_MINUTES))
        work = leased.select(F.col("item").alias("relative_path"), F.col("version").alias("_version"))
        counts = self._process(lease, read.join(work, "relative_path").drop("_version"), work.filter(F.col("_version") == GONE).select("relative_path"))
        self.book.commit(lease)
        total, open_, told = listed.count(), unsettled.count(), read.count()
        return Outcome(lease.token, {"listed": total, "settled": total - open_, "same content": told - counts["indexed"] - counts["failed"], **counts})

    def _process(self, lease: Lease, files: DataFrame, gone: DataFrame) -> dict[str, int]:
        out = self.book.output_path(lease)
        told = extract.extract(files.select(F.col("relative_path").alias("path"), "content"))
        texts = cut_lineage(told.select(F.col("path").alias("relative_path"), "text", "error", X.language_of(F.col("path")).alias("language")))
        how = self.chunking
        cut = chunker.chunk_texts(texts.filter("text is not null"), "relative_path", "text", "language", how.size, how.overlap, how.mode, how.chars_per_token)
        token = F.lit(lease.token).cast("long").alias("token")
        cut.select(F.col("key").alias("relative_path"), "chunk_index", "start_line", "end_line", "section", "symbols", "content", token).write.mode("overwrite").parquet(f"{out}/chunks")
        state = files.select("relative_path", "length", "modified", "version").join(texts.select("relative_path", "error"), "relative_path").select("*", token)
        none = gone.select("relative_path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"), F.lit(GONE).alias("version"), F.lit(None).cast("string").alias("error"), token)
        state.unionByName(none).write.mode("overwrite").parquet(f"{out}/files")
        written = self.spark.read.schema(FILES).parquet(f"{out}/files")
        row = written.agg(F.count_if((F.col("version") != GONE) & F.col("error").isNull()).alias("a"), F.count_if(F.col("error").isNotNull()).alias("b"), F.count_if(F.col("version") == GONE).alias("c")).first()
        return {"indexed": row.a, "failed": row.b, "deleted": row.c}
