"""Processing only new or changed records: a work-item ledger.

Every file that a job lists is a work item. An item is *pending* when its content hash is not the one on
record, *leased* while a job works on it, and *done* once that job has committed. A job holds its lease under
a fencing token, its place in the source's order of jobs. If the job ends any way other than ``Succeeded`` its
leases expire and the items return to pending, so that the next job, with a higher token, gets them again.
Only a commit moves the record; a writer whose token is lower than the record's is stale and is refused.

Two forms share these rules:

* :func:`replay` reads the whole history of walks and progress reports and rebuilds the ledger as it stood
  when each job began, with window functions over each file's own history.
* :class:`WorkLedger` is the live form in a shared folder. What becomes of a lease is one atomic file, so that of a
  commit and a revocation only one can win; output paths derive from the token, so a retried task overwrites its own
  output and nothing else.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.runtime import broadcast_if_small

COMMITTED = "Succeeded"
#: Last words of jobs that still hold their leases.
HOLDING = ("Running", "Queued")
MAX_BROADCAST_JOBS = 200_000


def file_key(path: Column) -> Column:
    """A file's path with ``/`` as its only separator."""
    return F.regexp_replace(path, r"\\", "/")


def jobs_in_order(progress: DataFrame) -> DataFrame:
    """One row per job: its last word, its fencing token and the commits of its source before it.

    The report with the highest seq_no is a job's last word (of equal seq_no the highest report_id). Jobs of
    a source are ordered by (started_at, job_id); ``token`` counts jobs and ``commits_before`` the committed
    ones before this job. Rows without a job_id are dropped. Null states count as not committed.
    """
    last = (
        progress.filter(F.col("job_id").isNotNull())
        .select("job_id", "source_id", "job_state", "started_at", "files_skipped", "files_total", "seq_no", "report_id")
        .groupBy("job_id")
        .agg(
            F.max(F.struct("seq_no", "report_id", "source_id", "job_state", "files_total", "files_skipped")).alias("w"),
            F.min("started_at").alias("started_at"),
        )
        .select(
            "job_id",
            F.col("w.source_id").alias("job_source"),
            "started_at",
            F.col("w.job_state").alias("job_state"),
            F.coalesce(F.col("w.job_state") == COMMITTED, F.lit(False)).alias("committed"),
            F.col("w.files_total").alias("files_total"),
            F.col("w.files_skipped").alias("files_skipped"),
        )
    )
    order = Window.partitionBy("job_source").orderBy("started_at", "job_id")
    done = F.col("committed").cast("int")
    return last.withColumn("token", F.row_number().over(order)).withColumn(
        "commits_before", F.sum(done).over(order.rowsBetween(Window.unboundedPreceding, 0)) - done
    )


def replay(candidates: DataFrame, progress: DataFrame) -> DataFrame:
    """The ledger's entry for each file of each job, as it stood when the job began.

    Columns: job_id, candidate_id, source_id, path, token, job_state, sha256, recorded_sha256, recorded_token,
    is_case, item_state. A job holds its items under ``token``; the record of an item is the write of the highest
    committed token below that, so a late writer with a lower token never replaces a later one's. ``item_state`` is
    where the item stands after the job's last word: ``done`` (nothing to do, or committed under a token above the
    record's), ``leased`` (a case of a job that still runs) or ``pending`` (a case whose job ended without a commit,
    so that its lease expired).

    Of a file's rows in one job the lowest candidate_id counts, whenever it landed. Hashes compare in lower
    case. A null hash is never a case and leaves the record as it is. A file that a committed job did not list
    is forgotten. Rows with a null job_id, source_id or path cannot be placed and are left out; jobs without
    progress reports start at their first row's recorded_at and never committed. Empty tables give no rows.
    """
    jobs = jobs_in_order(progress)
    listed = (
        candidates.filter(F.col("job_id").isNotNull() & F.col("source_id").isNotNull() & F.col("relative_path").isNotNull())
        .select(
            "job_id",
            "source_id",
            file_key(F.col("relative_path")).alias("path"),
            "candidate_id",
            F.lower("sha256").alias("sha256"),
            "recorded_at",
        )
        .groupBy("job_id", "source_id", "path")
        .agg(F.min(F.struct("candidate_id", "sha256")).alias("first"), F.min("recorded_at").alias("seen_at"))
        .select("job_id", "source_id", "path", "first.candidate_id", "first.sha256", "seen_at")
    )
    jobs = broadcast_if_small(jobs.drop("files_total", "files_skipped", "job_source"), MAX_BROADCAST_JOBS)
    placed = listed.join(jobs, "job_id", "left").select(
        "job_id",
        "candidate_id",
        "source_id",
        "path",
        "sha256",
        F.coalesce("started_at", "seen_at").alias("started_at"),
        F.coalesce("committed", F.lit(False)).alias("committed"),
        F.coalesce("commits_before", F.lit(0)).alias("commits_before"),
        "token",
        "job_state",
    )
    by_file = Window.partitionBy("source_id", "path").orderBy("started_at", "job_id")
    upto, before = by_file.rowsBetween(Window.unboundedPreceding, 0), by_file.rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("committed")
    # commits without a gap between them share `run`: the number of the commit less its place among the file's commits
    entries = placed.withColumn(
        "run", F.when(done, F.col("commits_before") + 1 - F.sum(done.cast("int")).over(upto))
    )
    entries = entries.withColumn(
        "last_commit", F.last(F.when(done, F.struct(F.col("commits_before").alias("no"), "run")), True).over(before)
    ).withColumn(
        "last_hash", F.last(F.when(done & F.col("sha256").isNotNull(), F.struct("run", "sha256", "token")), True).over(before)
    )
    on_record = (F.col("last_commit.no") + 1 == F.col("commits_before")) & (F.col("last_hash.run") == F.col("last_commit.run"))
    entries = entries.withColumn("recorded_sha256", F.when(on_record, F.col("last_hash.sha256")))
    entries = entries.withColumn("recorded_token", F.when(on_record, F.col("last_hash.token")))
    case = F.col("sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("recorded_sha256"))
    newer = F.col("recorded_token").isNull() | (F.col("token") > F.col("recorded_token"))
    state = (
        F.when(~case | (done & newer), "done").when(F.coalesce(F.col("job_state").isin(*HOLDING), F.lit(False)), "leased").otherwise("pending")
    )
    return entries.select(
        "job_id",
        "candidate_id",
        "source_id",
        "path",
        "token",
        "job_state",
        "sha256",
        "recorded_sha256",
        "recorded_token",
        case.alias("is_case"),
        state.alias("item_state"),
    )


def to_process(candidates: DataFrame, progress: DataFrame) -> DataFrame:
    """(job_id, candidate_id) of each file a job must process, once each."""
    return replay(candidates, progress).filter("is_case").select("job_id", "candidate_id")


def skip_audit(candidates: DataFrame, progress: DataFrame) -> DataFrame:
    """Per job: files listed, to process, unchanged and without a hash, beside the files_skipped its last report states.

    ``skips_match`` is null for jobs that did not commit, whose counts are those of an unfinished run.
    """
    counted = (
        replay(candidates, progress)
        .groupBy("job_id")
        .agg(
            F.count("*").alias("files_listed"),
            F.count_if("is_case").alias("files_to_process"),
            F.count_if(~F.col("is_case") & F.col("sha256").isNotNull()).alias("files_unchanged"),
            F.count_if(F.col("sha256").isNull()).alias("files_without_hash"),
        )
    )
    jobs = jobs_in_order(progress).select("job_id", "job_state", "files_total", "files_skipped", "committed")
    return jobs.join(counted, "job_id", "left").select(
        "job_id",
        "job_state",
        F.coalesce("files_listed", F.lit(0)).alias("files_listed"),
        F.coalesce("files_to_process", F.lit(0)).alias("files_to_process"),
        F.coalesce("files_unchanged", F.lit(0)).alias("files_unchanged"),
        F.coalesce("files_without_hash", F.lit(0)).alias("files_without_hash"),
        F.col("files_skipped").cast("long").alias("files_skipped"),
        F.when(F.col("committed"), F.coalesce("files_unchanged", F.lit(0)) == F.col("files_skipped")).alias("skips_match"),
    )


class StaleWriter(RuntimeError):
    """The writer's lease was revoked or given up: its fencing token no longer stands."""


@dataclass(frozen=True)
class Lease:
    token: int
    holder: str
    expires_at: datetime
    attempt: str


EVENTS = T.StructType(
    [
        T.StructField("item", T.StringType(), False),
        T.StructField("version", T.StringType()),
        T.StructField("token", T.LongType(), False),
    ]
)
COMMIT, REVOKED, GIVEN_UP = "committed", "revoked", "given up"


class WorkLedger:
    """A live ledger in a shared folder.

    Layout: ``items/<attempt>`` holds the items of a lease, written before ``leases/<token>``, the small file that
    grants it and names the attempt; ``verdicts/<token>`` says what became of it; ``renewals`` holds heartbeats as file
    names; ``snapshots/<token>`` names a folded table of all that was done up to that token. Tokens grow by one.
    Every such file is created whole and only if absent (a hard link on a local disk, a rename that refuses to
    overwrite elsewhere; a store without such a rename will not do). States follow from the files alone:

    * done: the item's version equals the one of the highest committed token that covers it;
    * leased: covered by a lease without a verdict;
    * pending: neither.

    An expired lease is revoked, by its verdict, before its items are given out again; a holder commits by the same
    file, so never both. A holder that finds its items under a lower token that it had not seen gives its lease up.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._local = self._fs.getUri().getScheme() == "file"
        for part in ("leases", "items", "verdicts", "renewals", "snapshots"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    def _names(self, part: str) -> list[str]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}")))
        return sorted(n for n in names if not n.startswith((".", "_")))

    def _create(self, name: str, text: str) -> bool:
        """Create a file with its whole content, or report that it exists: write aside, then link or rename."""
        aside, final = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}")
        out = self._fs.create(aside)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._local:
                os.link(aside.toUri().getPath(), final.toUri().getPath())
                return True
            options = self._jvm.org.apache.hadoop.fs.Options.Rename
            none = self.spark.sparkContext._gateway.new_array(options, 1)
            none[0] = options.NONE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, final, none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        finally:
            self._fs.delete(aside, False)

    def _texts(self, names: list[str]) -> dict[str, str]:
        """The contents of several small files, in one job."""
        if not names:
            return {}
        rows = self.spark.read.text([f"{self.folder}/{n}" for n in names], wholetext=True).select(F.input_file_name().alias("at"), "value").collect()
        return {r["at"].rsplit("/", 1)[-1]: r["value"] for r in rows}

    def verdicts(self) -> dict[int, str]:
        return {int(n): v for n, v in self._texts([f"verdicts/{n}" for n in self._names("verdicts")]).items()}

    def leases(self, tokens: set[int] | None = None) -> dict[int, Lease]:
        """The leases of ``tokens``, or all, with their latest heartbeat."""
        wanted = [n for n in self._names("leases") if tokens is None or int(n) in tokens]
        beats: dict[int, datetime] = {}
        for name in self._names("renewals"):
            token, micros = name.split("-")
            at = datetime(1970, 1, 1) + timedelta(microseconds=int(micros))
            beats[int(token)] = max(at, beats.get(int(token), at))
        found = {}
        for name, text in self._texts([f"leases/{n}" for n in wanted]).items():
            holder, until, attempt = text.split("\t")
            token = int(name)
            found[token] = Lease(token, holder, max(datetime.fromisoformat(until), beats.get(token, datetime.min)), attempt)
        return found

    def _items(self, leases: list[Lease]) -> DataFrame:
        if not leases:
            return self.spark.createDataFrame([], EVENTS)
        tokens = F.create_map(*(x for one in leases for x in (F.lit(one.attempt), F.lit(one.token).cast("long"))))
        rows = self.spark.read.schema("item string, version string").parquet(*[f"{self.folder}/items/{one.attempt}" for one in leases])
        attempt = F.regexp_extract(F.input_file_name(), "/items/([^/]+)/", 1)
        return rows.select("item", "version", tokens[attempt].alias("token"))

    def done(self) -> DataFrame:
        """(item, version, token) on record: the version of the highest committed token, from the last snapshot on."""
        verdicts = self.verdicts()
        upto, folded = 0, self.spark.createDataFrame([], EVENTS)
        names = self._names("snapshots")
        if names:
            upto = int(names[-1])
            at = self._texts([f"snapshots/{names[-1]}"])[names[-1]]
            folded = self.spark.read.schema(EVENTS).parquet(f"{self.folder}/items/{at}")
        fresh = {t for t, v in verdicts.items() if v == COMMIT and t > upto}
        rows = folded.unionByName(self._items(list(self.leases(fresh).values()))) if fresh else folded
        return rows.groupBy("item").agg(F.max(F.struct("token", "version")).alias("r")).select("item", "r.version", "r.token")

    def fold(self) -> int:
        """Fold all that is done into one table, up to the last token below which every lease has its verdict."""
        verdicts, upto = self.verdicts(), 0
        while upto + 1 in verdicts:
            upto += 1
        if upto and f"{upto:012d}" not in self._names("snapshots"):
            attempt = f"fold-{uuid.uuid4().hex}"
            self.done().filter(F.col("token") <= upto).write.parquet(f"{self.folder}/items/{attempt}")
            self._create(f"snapshots/{upto:012d}", attempt)
        return upto

    def _open(self) -> dict[int, Lease]:
        """Leases without a verdict."""
        told = set(map(int, self._names("verdicts")))
        return self.leases({int(n) for n in self._names("leases")} - told)

    def pending(self, listing: DataFrame, now: datetime) -> DataFrame:
        """Rows of ``listing`` (item, version) that are neither done nor leased; of repeated items the least version counts."""
        held = self._items([one for one in self._open().values() if one.expires_at > now]).select("item").distinct()
        record = self.done().select("item", F.col("version").alias("recorded"))
        fresh = listing.groupBy("item").agg(F.min("version").alias("version")).join(record, "item", "left")
        fresh = fresh.filter(F.col("version").isNotNull() & ~F.col("version").eqNullSafe(F.col("recorded")))
        return fresh.join(held, "item", "left_anti").drop("recorded")

    def lease(self, listing: DataFrame, holder: str, now: datetime, until: datetime) -> tuple[Lease, DataFrame]:
        """Lease what is pending; the items are written first and read back from there."""
        while True:
            for one in self._open().values():
                if one.expires_at <= now:
                    self._create(f"verdicts/{one.token:012d}", REVOKED)
            known = {int(n) for n in self._names("leases")}
            attempt = uuid.uuid4().hex
            self.pending(listing, now).select("item", "version").write.parquet(f"{self.folder}/items/{attempt}")
            token = max([0, *known]) + 1
            while not self._create(f"leases/{token:012d}", f"{holder}\t{until.isoformat()}\t{attempt}"):
                token += 1
            mine = Lease(token, holder, until, attempt)
            unseen = self.leases({int(n) for n in self._names("leases") if int(n) < token} - known)
            lost = {t for t, v in self.verdicts().items() if v != COMMIT}
            rivals = [one for t, one in unseen.items() if t not in lost]
            if not rivals or not self._items(rivals).join(self._items([mine]), "item", "left_semi").limit(1).count():
                return mine, self._items([mine])
            self._create(f"verdicts/{token:012d}", GIVEN_UP)

    def renew(self, lease: Lease, until: datetime) -> None:
        """A heartbeat: the lease now runs until ``until``, unless it was revoked."""
        if self.verdicts().get(lease.token, COMMIT) != COMMIT:
            raise StaleWriter(f"token {lease.token} of {lease.holder} no longer stands")
        self._create(f"renewals/{lease.token:012d}-{int((until - datetime(1970, 1, 1)) / timedelta(microseconds=1))}", "")

    def output_path(self, lease: Lease) -> str:
        """Where a lease's output goes: the same place on every retry."""
        return f"{self.folder}/output/token={lease.token}"

    def commit(self, lease: Lease) -> None:
        """Make the lease's items done; refuse a holder whose lease was revoked. A repeated commit changes nothing."""
        if not self._create(f"verdicts/{lease.token:012d}", COMMIT) and self.verdicts()[lease.token] != COMMIT:
            raise StaleWriter(f"token {lease.token} of {lease.holder} no longer stands")
