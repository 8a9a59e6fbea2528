"""Relational operators of the catalogue: listings, roll-ups, reconciliation, ownership, configuration.

Frames come in with the columns of the test tables and their documented nulls; every operator keeps rows with
null optional columns and drops only rows without the key it works by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import globs as G
from sparkloom.functions import text as X
from sparkloom.operators.ledger import file_key, jobs_in_order
from sparkloom.runtime import broadcast_if_small

TEXT_CAP, DOCUMENT_CAP = 262_144, 536_870_912
DOCUMENT_TYPES = ("pdf", "docx", "pptx", "epub")
DEFAULT_INCLUDE = "**"
USABLE_CONTEXT = 0.9


def current_files(candidates: DataFrame) -> DataFrame:
    """The last known state of every file: of its rows the one with the highest candidate_id."""
    return (
        candidates.filter(F.col("source_id").isNotNull() & F.col("relative_path").isNotNull())
        .groupBy("source_id", file_key(F.col("relative_path")).alias("path"))
        .agg(F.max(F.struct("candidate_id", "corpus_id", "size_bytes", "modified_ticks", F.lower("sha256").alias("sha256"), "extractor")).alias("r"))
        .select("source_id", "path", "r.*")
    )


def file_status(files: DataFrame, sources: DataFrame) -> DataFrame:
    """files with a status: Skipped over the source's size cap, Failed without a hash, Empty at size 0, else Indexed."""
    caps = broadcast_if_small(sources.select("source_id", "max_file_bytes"))
    cap = F.coalesce("max_file_bytes", F.lit(TEXT_CAP))
    status = (
        F.when(F.col("size_bytes") > cap, "Skipped").when(F.col("sha256").isNull(), "Failed").when(F.col("size_bytes") == 0, "Empty").otherwise("Indexed")
    )
    return files.join(caps, "source_id", "left").withColumn("status", status).drop("max_file_bytes")


def corpus_summary(files: DataFrame) -> DataFrame:
    """Per corpus the files by status, pivoted, skipped and empty together."""
    pivoted = files.groupBy("corpus_id").pivot("status", ["Indexed", "Failed", "Skipped", "Empty"]).count()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pivoted.select("corpus_id", zero("Indexed").alias("indexed"), zero("Failed").alias("failed"), (zero("Skipped") + zero("Empty")).alias("skipped"))


def file_list(files: DataFrame, name: str, statuses: tuple[str, ...], offset: int, limit: int) -> DataFrame:
    """A page of files whose path contains ``name`` in any ASCII case, largest first, then by path and id."""
    wanted = files.filter(F.lower("path").contains(name.lower()) & F.col("status").isin(*statuses))
    return wanted.orderBy(F.desc_nulls_last("size_bytes"), "path", "candidate_id").offset(offset).limit(limit)


def library(texts: DataFrame) -> DataFrame:
    """One row per stored blob with its attachments nested, in the order of their names."""
    attachment = F.struct("file_name", "text_id", "corpus_id")
    return texts.groupBy("blob_sha256").agg(
        F.count("*").alias("attachments"),
        F.countDistinct("corpus_id").alias("corpora"),
        F.max(F.coalesce("extracted_chars", F.lit(0))).alias("chars"),
        F.array_sort(F.collect_list(attachment)).alias("nested"),
    )


def source_choice(files: DataFrame) -> DataFrame:
    """For each path in several sources the one that reads use: most bytes, ties to the lower id."""
    each = files.groupBy("path", "source_id").agg(F.sum(F.coalesce("size_bytes", F.lit(0))).alias("weight"))
    best = each.groupBy("path").agg(F.count("*").alias("sources"), F.max_by("source_id", F.struct("weight", F.lit(0))).alias("heaviest"), F.max("weight").alias("weight"))
    tied = each.join(best.filter("sources > 1").select("path", "sources", "weight"), ["path", "weight"])
    return tied.groupBy("path", "sources").agg(F.min("source_id").alias("source_id"))


def coverage_gaps(sources: DataFrame) -> DataFrame:
    """Parents that hold two sources or more and are not beneath such a parent or a source themselves."""
    roots = sources.filter("root_path is not null").select("source_id", F.lower("root_path").alias("root"))
    parents = roots.withColumn("parent", F.regexp_replace("root", "/[^/]*$", "")).groupBy("parent").agg(F.count("*").alias("sources")).filter("sources >= 2")
    above = parents.select("parent", "sources", F.explode(F.transform(X.path_prefixes(F.col("parent")), lambda p: F.concat(F.lit("/"), p))).alias("ancestor")).filter("ancestor <> parent")
    covering = parents.select(F.col("parent").alias("ancestor")).unionByName(roots.select(F.col("root").alias("ancestor"))).distinct()
    covered = above.join(covering, "ancestor", "left_semi").select("parent").distinct()
    return parents.join(covered, "parent", "left_anti")


def last_two_commits(progress: DataFrame) -> DataFrame:
    """(job_id, job_source, recency): the last committed job of each source is 1, the one before it 2."""
    order = Window.partitionBy("job_source").orderBy(F.desc("started_at"), F.desc("job_id"))
    done = jobs_in_order(progress).filter("committed").withColumn("recency", F.row_number().over(order))
    return done.filter("recency <= 2").select("job_id", "job_source", "recency")


def vanished_files(candidates: DataFrame, progress: DataFrame) -> DataFrame:
    """Files that the commit before the last one listed and the last one did not."""
    marks = broadcast_if_small(last_two_commits(progress))
    listed = candidates.select("job_id", "source_id", file_key(F.col("relative_path")).alias("path")).join(marks, "job_id")
    seen = listed.filter("recency = 1").select("source_id", "path")
    return listed.filter("recency = 2").select("source_id", "path").distinct().join(seen, ["source_id", "path"], "left_anti")


def unsettled_files(candidates: DataFrame, progress: DataFrame) -> DataFrame:
    """Files of the last commit whose (size, ticks) differ from those of the commit before, or were unknown."""
    marks = broadcast_if_small(last_two_commits(progress))
    key = ["source_id", "path", "size_bytes", "modified_ticks"]
    listed = candidates.select("job_id", "source_id", file_key(F.col("relative_path")).alias("path"), "size_bytes", "modified_ticks").join(marks, "job_id")
    settled = listed.filter("recency = 2 and modified_ticks > 0 and size_bytes is not null").select(*key)
    return listed.filter("recency = 1").select(*key).distinct().join(settled, key, "left_anti")


def reconcile(candidates: DataFrame, progress: DataFrame) -> DataFrame:
    """Files counted per job against what the job reported: matches, differs, unreported or unlisted."""
    counted = candidates.select("job_id", "source_id", file_key(F.col("relative_path")).alias("path")).distinct().groupBy("job_id").agg(F.count("*").alias("listed"))
    said = jobs_in_order(progress).filter("committed").select("job_id", F.col("files_total").cast("long").alias("reported"))
    outcome = (
        F.when(F.col("reported").isNull(), "unreported").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") == F.col("reported"), "matches").otherwise("differs")
    )
    return counted.join(said, "job_id", "full_outer").select("job_id", "listed", "reported", outcome.alias("outcome"))


def configuration_diff(here: DataFrame, there: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Outcome of importing ``there`` over ``here`` by natural key, without doing it."""
    a = here.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("a"))
    b = there.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("b"))
    outcome = F.when(F.col("a").isNull(), "create").when(F.col("b").isNull(), "remove").when(F.col("a") == F.col("b"), "same").otherwise("update")
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"))


def owners(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Who indexes each absolute path: the source with the longest root above it, equal roots to the lower id."""
    roots = sources.filter("root_path is not null").select(F.col("source_id").alias("owner"), F.lower("root_path").alias("root"))
    at = files.join(broadcast_if_small(sources.select("source_id", "root_path")), "source_id").filter("root_path is not null")
    whole = F.concat_ws("/", "root_path", "path")
    spread = at.select("candidate_id", F.explode(F.transform(X.path_prefixes(whole), lambda p: F.concat(F.lit("/"), p))).alias("root"))
    best = spread.join(broadcast_if_small(roots), "root").groupBy("candidate_id").agg(F.min(F.struct((-F.length("root")).alias("n"), "owner")).alias("r"))
    return best.select("candidate_id", "r.owner")


def effective_filters(sources: DataFrame) -> DataFrame:
    """Globs of each source, its own, else those of its corpus (the lowest source_id that states any), else the default; empty is a statement."""
    stated = sources.filter("exclude_globs is not null").groupBy("corpus_id").agg(F.min(F.struct("source_id", "exclude_globs")).alias("c"))
    origin = F.when(F.col("exclude_globs").isNotNull(), "source").when(F.col("c").isNotNull(), "corpus").otherwise("default")
    globs = F.coalesce("exclude_globs", "c.exclude_globs", F.array(F.lit(DEFAULT_INCLUDE)))
    return sources.join(broadcast_if_small(stated), "corpus_id", "left").select("source_id", origin.alias("origin"), F.array_join(globs, "|").alias("globs"))


def chunk_settings(sets: DataFrame, context_tokens: int) -> DataFrame:
    """Sizes that a model's context allows: nine tenths of it at most, the overlap below the size."""
    base = sets.filter("is_default").select("corpus_id", F.col("chunk_size").alias("bs"), F.col("chunk_overlap").alias("bo"))
    size = F.coalesce("chunk_size", "bs", F.lit(256))
    fitted = F.least(size, F.greatest(F.lit(1), F.floor(F.lit(USABLE_CONTEXT * context_tokens)).cast("int")))
    overlap = F.least(F.coalesce("chunk_overlap", "bo", F.lit(32)), fitted - 1)
    return sets.join(broadcast_if_small(base), "corpus_id", "left").select("chunk_set_id", fitted.alias("size"), overlap.alias("overlap"), F.floor(fitted * F.col("chars_per_token")).cast("int").alias("budget"))


def triage(candidates: DataFrame) -> DataFrame:
    """Why a candidate is not read, the first reason that holds, null if it is: plumbing, ignored, unreadable, empty, too large."""
    path = F.lower(file_key(F.col("relative_path")))
    extension = F.regexp_extract(path, r"\.([^./]*)$", 1)
    cap = F.when(extension.isin(*DOCUMENT_TYPES), DOCUMENT_CAP).otherwise(TEXT_CAP)
    reason = (
        F.when(path.rlike(r"(^|/)\.git(/|$)"), "git plumbing")
        .when(G.excluded(path, G.ALWAYS_EXCLUDE), "ignored")
        .when(F.col("sha256").isNull(), "unreadable")
        .when(F.col("size_bytes") == 0, "empty file")
        .when(F.col("size_bytes") > cap, "over the size cap")
    )
    return candidates.select("candidate_id", reason.alias("reason"))


def newest_or_held(commits: DataFrame, newest: int, held: DataFrame) -> DataFrame:
    """One row per path (the lowest id), of each source the newest N and those already held."""
    one = commits.withColumn("_n", F.row_number().over(Window.partitionBy("source_id", "relative_path").orderBy("git_doc_id"))).filter("_n = 1").drop("_n")
    # the newest of a source are cut to their number before the shuffle; what is held needs no order
    order = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("author_date"), "git_doc_id")
    first = one.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= newest).drop("_r")
    rest = one.join(held.select("git_doc_id").distinct(), "git_doc_id", "left_semi").join(first.select("git_doc_id"), "git_doc_id", "left_anti")
    return first.unionByName(rest)
