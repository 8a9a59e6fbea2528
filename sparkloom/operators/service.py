"""What the service about the catalogue computes: scopes, listings with states, refresh plans, facts, housekeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators.catalog import file_status, last_two_commits
from sparkloom.operators.ledger import file_key
from sparkloom.runtime import broadcast_if_small

DUE_HOURS = 24
LOG_CHARS = 500


def resolve_scopes(arguments: DataFrame, argument: str, sets: DataFrame) -> DataFrame:
    """(argument, corpus_id, chunk_set_id, error) of ``corpus`` or ``corpus:set`` arguments.

    A corpus alone means its default set (the lowest id of several). An unknown corpus or set is an error that names
    it and never widens the scope. Blank and null arguments are errors too.
    """
    named = F.trim(F.coalesce(argument, F.lit("")))
    asked = arguments.select(argument).distinct().select(argument, F.split(named, ":", 2)[0].alias("_corpus"), F.get(F.split(named, ":", 2), F.lit(1)).alias("_set"))
    corpora = sets.filter("corpus_id is not null").select(F.col("corpus_id").alias("_corpus")).distinct().withColumn("_known", F.lit(True))
    wanted = sets.groupBy(F.col("corpus_id").alias("_corpus"), F.col("set_name").alias("_set")).agg(F.min("chunk_set_id").alias("_named"))
    base = sets.filter("is_default").groupBy(F.col("corpus_id").alias("_corpus")).agg(F.min("chunk_set_id").alias("_default"))
    found = asked.join(broadcast_if_small(corpora), "_corpus", "left").join(broadcast_if_small(wanted), ["_corpus", "_set"], "left").join(broadcast_if_small(base), "_corpus", "left")
    one = F.when(F.col("_set").isNull(), F.col("_default")).otherwise(F.col("_named"))
    error = (
        F.when(F.col("_corpus") == "", "no corpus named")
        .when(F.col("_known").isNull(), F.concat(F.lit("unknown corpus "), F.col("_corpus")))
        .when(one.isNull() & F.col("_set").isNull(), F.concat(F.lit("no default set in "), F.col("_corpus")))
        .when(one.isNull(), F.concat(F.lit("unknown set "), F.col("_set"), F.lit(" in "), F.col("_corpus")))
    )
    return found.select(argument, F.when(error.isNull(), F.col("_corpus")).alias("corpus_id"), F.when(error.isNull(), one).alias("chunk_set_id"), error.alias("error"))


def with_roots(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``files`` with the root and the whole path of each, for citations; unknown sources keep the relative path."""
    roots = broadcast_if_small(sources.select("source_id", "root_path"))
    whole = F.concat(F.regexp_replace(F.coalesce("root_path", F.lit("")), "/+$", ""), F.when(F.col("root_path").isNotNull(), "/").otherwise(""), F.col("path"))
    return files.join(roots, "source_id", "left").withColumn("whole_path", whole)


def listed_files(candidates: DataFrame, progress: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listing, state): the files of each source's newest walk, and those of its last committed job with their status."""
    key = ["source_id", F.col("path")]
    rows = candidates.filter("job_id is not null and source_id is not null and relative_path is not null").withColumn("path", file_key(F.col("relative_path")))
    each = rows.groupBy("job_id", *key).agg(F.min(F.struct("candidate_id", "size_bytes", "modified_ticks", F.lower("sha256").alias("sha256"))).alias("r"), F.max("recorded_at").alias("seen_at"))
    each = each.select("job_id", "source_id", "path", "r.*", "seen_at")
    newest = each.groupBy("source_id", "path").agg(F.max(F.struct("seen_at", "job_id", "candidate_id", "size_bytes", "modified_ticks", "sha256")).alias("r")).select("source_id", "path", "r.candidate_id", "r.size_bytes", "r.modified_ticks", "r.sha256")
    marks = broadcast_if_small(last_two_commits(progress).filter("recency = 1").select("job_id"))
    return newest, file_status(each.join(marks, "job_id", "left_semi"), sources).select("source_id", "path", "size_bytes", "modified_ticks", "sha256", "status")


def listing_with_states(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Every file with its state; a file without one is Pending."""
    known = state.select("source_id", "path", F.col("status"))
    return listing.select("source_id", "path").join(known, ["source_id", "path"], "left").withColumn("status", F.coalesce("status", F.lit("Pending")))


def refresh_plan(listing: DataFrame, state: DataFrame, gone: bool = True) -> DataFrame:
    """(source_id, path, action) of an incremental run.

    ``settled``: size and ticks as on record, ticks known; ``same content``: only the hash had to be compared;
    ``index``: new or changed; ``unreadable``: no hash, so nothing to read; ``delete``: on record and not listed.
    """
    old = state.select("source_id", "path", F.col("size_bytes").alias("_size"), F.col("modified_ticks").alias("_ticks"), F.col("sha256").alias("_sha"), F.lit(True).alias("_known"))
    both = listing.withColumn("_listed", F.lit(True)).join(old, ["source_id", "path"], "full_outer" if gone else "left")
    settled = F.col("_known") & (F.col("modified_ticks") > 0) & (F.col("modified_ticks") == F.col("_ticks")) & (F.col("size_bytes") == F.col("_size")) & F.col("_sha").isNotNull()
    action = (
        F.when(F.col("_listed").isNull(), "delete")
        .when(F.coalesce(settled, F.lit(False)), "settled")
        .when(F.col("sha256").isNull(), "unreadable")
        .when(F.col("sha256") == F.col("_sha"), "same content")
        .otherwise("index")
    )
    return both.select("source_id", "path", action.alias("action"))


def swept(listing: DataFrame, state: DataFrame) -> DataFrame:
    """What a sweep adds without reading anything: listed files without a state, as Pending."""
    return listing.select("source_id", "path").join(state.select("source_id", "path"), ["source_id", "path"], "left_anti").withColumn("status", F.lit("Pending"))


def cache_misses(texts: DataFrame, key: str, cached: DataFrame, version: int) -> DataFrame:
    """``texts`` that the cache cannot answer: no row, an older version, or a stored length that is not the recorded one."""
    good = cached.filter((F.col("version") >= version) & (F.col("stored_chars") == F.col("recorded_chars"))).select(key).distinct()
    return texts.join(good, key, "left_anti")


def backfilled_prefixes(rows: DataFrame, path: str, prefixes: str) -> DataFrame:
    """``rows`` with ``prefixes`` computed where it is null; a second run changes nothing."""
    return rows.withColumn(prefixes, F.coalesce(prefixes, X.path_prefixes(F.col(path))))


def due_for_refresh(jobs: DataFrame, now: str, hours: int = DUE_HOURS) -> DataFrame:
    """(job_source, last_started) of sources without a running job whose last one began ``hours`` ago or more."""
    each = jobs.groupBy("job_source").agg(F.max("started_at").alias("last_started"), F.count_if(F.col("job_state").isin("Running", "Queued")).alias("open"))
    return each.filter((F.col("open") == 0) & (F.col("last_started") <= F.to_timestamp(F.lit(now)) - F.make_dt_interval(hours=F.lit(hours)))).drop("open")


def latest_reports(progress: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` reports of each job, repeats counted once: what a listener that drops the oldest still holds."""
    each = progress.groupBy("job_id", "seq_no").agg(F.max("report_id").alias("report_id"))
    order = Window.partitionBy("job_id").orderBy(F.desc("seq_no"))
    return each.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def active(tokens: DataFrame, revoked: str, expires: str, now: str) -> DataFrame:
    """Tokens neither revoked nor expired; without an expiry they last."""
    at = F.to_timestamp(F.lit(now))
    return tokens.filter(F.col(revoked).isNull() & (F.col(expires).isNull() | (F.col(expires) > at)))


def facts(rows: DataFrame, sets: Sequence[Sequence[str]], measures: dict[str, Column]) -> DataFrame:
    """Counts along several groupings in one pass: the columns a row is not grouped by are null."""
    columns = list(dict.fromkeys(c for one in sets for c in one))
    spread = rows.groupingSets([[F.col(c) for c in one] for one in sets], *columns)
    return spread.agg(*(m.alias(n) for n, m in measures.items()))


def cut_text(text: Column, most: int = LOG_CHARS) -> Column:
    return F.substring(text, 1, most)


def cut_list(names: Column, most: int) -> Column:
    """A comma separated list cut at a whole name, with ``,…`` to say names are missing."""
    head = F.regexp_extract(F.substring(names, 1, most - 1), r"(?s)^(.+),", 1)
    return F.when(F.length(names) <= most, names).when(head != "", F.concat(head, F.lit(",…"))).otherwise(F.concat(F.substring(names, 1, most - 1), F.lit("…")))


def promoted(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """``sets`` with the chosen set of each corpus as its only default; corpora without a choice keep theirs."""
    choice = broadcast_if_small(chosen.select("corpus_id", F.col("chunk_set_id").alias("_chosen")))
    joined = sets.join(choice, "corpus_id", "left")
    return joined.withColumn("is_default", F.when(F.col("_chosen").isNotNull(), F.col("chunk_set_id") == F.col("_chosen")).otherwise(F.col("is_default"))).drop("_chosen")


def memo_hits(asked: DataFrame, key: list[str], at: str, order: str, minutes: int) -> DataFrame:
    """``asked`` with ``is_hit``: whether the same key was asked within ``minutes`` before, so that a cache that renews on use answers."""
    window = Window.partitionBy(*key).orderBy(at, order)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(window).cast("timestamp"))
    return asked.withColumn("is_hit", F.coalesce(gap <= minutes * 60_000_000, F.lit(False)))


def sources_at_root(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """(asked, found, error): the sources at each root or beneath it in any case, or an error that lists the roots there are."""
    roots = sources.filter("root_path is not null").select("source_id", F.explode(F.transform(X.path_prefixes(F.col("root_path")), lambda p: F.concat(F.lit("/"), p))).alias("_root"))
    named = asked.withColumn("_root", F.lower(F.regexp_replace("asked", "/+$", "")))
    found = named.join(roots, "_root").groupBy("asked").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("found"))
    # the roots of a service are a stated list of one row a source
    every = sources.filter("root_path is not null").agg(F.array_join(F.array_sort(F.collect_set("root_path")), ", ").alias("_every"))
    told = asked.join(found, "asked", "left").join(F.broadcast(every))
    error = F.when(F.col("found").isNull(), F.concat(F.lit("no source at "), F.col("asked"), F.lit("; roots: "), F.col("_every")))
    return told.select("asked", "found", error.alias("error"))


#: Templates by model family and purpose; families without one are embedded as they are.
TEMPLATES = {
    "lex-embed": {"query": "search_query: {text}", "document": "search_document: {text}"},
}


def framed_for(model: Column, purpose: Column, text: Column, templates: dict[str, dict[str, str]] = TEMPLATES) -> Column:
    """``text`` in the template of the model's family (its name before ``:``) for the purpose."""
    family = F.split(model, ":", 2)[0]
    told = text
    for name, by_purpose in templates.items():
        for kind, template in by_purpose.items():
            told = F.when((family == name) & (purpose == kind), F.replace(F.lit(template), F.lit("{text}"), text)).otherwise(told)
    return told
