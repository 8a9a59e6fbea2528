"""Session helpers shared by every operator: sessions, tables, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


DEAL_ROWS = "spark.sparkloom.dealRows"


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "sparkloom") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(DEAL_ROWS, "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Tables whose rows are expensive to work on. A session on one machine deals the rows of their single files out over its cores.
TEXT_TABLES = frozenset(("documents", "source_files", "git_documents", "extracted_texts", "transcript_records", "embeddings"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies. Only a session made by :func:`local_session` deals text tables out: there they are one file each."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES and spark.conf.get(DEAL_ROWS, "false") == "true":
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine may leave the setting out; it gets a temporary folder, removed when Python ends.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that a lost executor costs one read, not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by_key(df: DataFrame, key: str, then: Callable[[DataFrame], DataFrame] = lambda laid: laid) -> DataFrame:
    """:func:`cut_lineage` of ``then(df)`` with ``df`` partitioned by ``key``; groupings and joins by it then need no shuffle.

    A plan made adaptively forgets how its result is partitioned, so this one is made without.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(then(df.repartition(width, key)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows.

    Beyond the bound the frame comes back unhinted, and Spark joins it by shuffling both sides.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def collect_bounded(df: DataFrame, max_rows: int) -> list | None:
    """Rows of a side that must be small; None if it has more than ``max_rows`` rows."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
