"""Queries of scopes, listings, refreshes and housekeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import globs
from sparkloom.functions import text as X
from sparkloom.operators import catalog as C
from sparkloom.operators import context as K
from sparkloom.operators import rules, sections
from sparkloom.operators import service as V
from sparkloom.operators.ledger import jobs_in_order
from sparkloom.queries import retrieval as RQ
from sparkloom.queries.catalogue import _DIFF, _FILES, config_diff
from sparkloom.queries.passages import _CH, _chunks
from sparkloom.runtime import broadcast_if_small, table

PRUNE_RULES = ["vendor/", "node_modules/", "obj/", "tests/", "!vendor/quillo/keep/", "!/tests/data/**"]


def scope_resolution(spark, d):
    """Every corpus, every set by name, and names that do not exist."""
    sets = table(spark, d, "chunk_sets")
    asked = sets.select(F.explode(F.array("corpus_id", F.concat_ws(":", "corpus_id", "set_name"), F.concat("corpus_id", F.lit("x")), F.concat("corpus_id", F.lit(":x")), F.lit(" "))).alias("argument"))
    return V.resolve_scopes(asked, "argument", sets)


def scoped_chunks(spark, d):
    """Chunks of two corpora in one language, under one section, that define a symbol: every condition of a scope at once."""
    roots = table(spark, d, "sources").filter("corpus_id in ('co1', 'co3', 'co6')").select("source_id", "corpus_id")
    rows = _chunks(spark, d).join(roots, "source_id").filter((F.col("code_language") == "python") & F.col("source_id").isin("so01SGDGHB", "so02YGHEVW", "so03SJFHBQ", "so06KZWDBD"))
    return rows.filter(F.exists(X.symbols_of(F.col("code_language"), F.col("content")), lambda s: F.length(s) > 6)).select("file_id", "chunk_index")


def file_roots(spark, d):
    return V.with_roots(C.current_files(table(spark, d, "walk_candidates")), table(spark, d, "sources")).select("candidate_id", "whole_path")


def _listed(spark, d):
    return V.listed_files(table(spark, d, "walk_candidates"), table(spark, d, "job_progress"), table(spark, d, "sources"))


def file_states(spark, d):
    listing, state = _listed(spark, d)
    return V.listing_with_states(listing, state)


def refresh_actions(spark, d):
    listing, state = _listed(spark, d)
    return V.refresh_plan(listing, state)


def swept_files(spark, d):
    listing, state = _listed(spark, d)
    return V.swept(listing, state)


def library_states(spark, d):
    """Per blob its attachments, the text each gave, and the sets of its corpus, nested in the order of their names."""
    sets = table(spark, d, "chunk_sets").groupBy("corpus_id").agg(F.array_join(F.array_sort(F.collect_list("chunk_set_id")), ",").alias("sets"))
    texts = table(spark, d, "extracted_texts").join(sets, "corpus_id", "left")
    one = F.concat_ws("/", "file_name", "corpus_id", F.coalesce("extracted_chars", F.lit(0)).cast("string"), F.coalesce("sets", F.lit("-")))
    return texts.groupBy("blob_sha256").agg(F.array_join(F.array_sort(F.collect_list(one)), "|").alias("nested"), F.countDistinct("corpus_id").alias("corpora"))


def cached_text_misses(spark, d):
    """Texts whose cached row has no length, or was written by an older extractor (of corpora co1 and co2)."""
    texts = table(spark, d, "extracted_texts")
    version = F.when(F.col("corpus_id").isin("co1", "co2"), 5).otherwise(6)
    cached = texts.select("text_id", version.alias("version"), F.length("body").alias("stored_chars"), F.col("extracted_chars").alias("recorded_chars"))
    return V.cache_misses(texts.select("text_id", "corpus_id"), "text_id", cached, 6)


def prefix_backfill(spark, d):
    files = table(spark, d, "source_files")
    stored = files.select("file_id", "relative_path", F.when(F.col("modified_ticks") % 2 == 0, X.path_prefixes(F.col("relative_path"))).alias("prefixes"))
    return V.backfilled_prefixes(stored, "relative_path", "prefixes").select("file_id", F.array_join("prefixes", "|").alias("prefixes"))


def due_sources(spark, d):
    jobs = jobs_in_order(table(spark, d, "job_progress"))
    return V.due_for_refresh(jobs, "2026-01-02 00:00:00").select("job_source", "last_started")


def report_tail(spark, d):
    return V.latest_reports(table(spark, d, "job_progress"), 3)


def search_history(spark, d):
    """The log filtered by user, kind and value, a page of it, and the total beside each row."""
    log = table(spark, d, "events").filter((F.col("user_id") % 10 == 3) & F.col("event_type").contains("ic") & (F.col("value") < 20))
    total = log.agg(F.count("*").alias("total"))
    return log.orderBy(F.desc("event_id")).limit(26).select("event_id", "event_type").join(F.broadcast(total))


def active_tokens(spark, d):
    """Events as tokens: an error revokes at once, a value says the days until expiry."""
    tokens = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"), (F.col("ts").cast("timestamp") + F.make_dt_interval(F.floor("value").cast("int"))).alias("expires_at"))
    return V.active(tokens, "revoked_at", "expires_at", "2024-01-20 00:00:00").select("event_id")


def proposal_facts(spark, d):
    """Chunks and files by source, by language and in all."""
    rows = _chunks(spark, d).select("source_id", F.coalesce("code_language", F.lit("?")).alias("language"), "file_id")
    return V.facts(rows, [["source_id"], ["language"], []], {"chunks": F.count("*"), "files": F.countDistinct("file_id")})


def log_cuts(spark, d):
    areas = table(spark, d, "subject_areas").select("subject", F.array_join("sample_terms", ",").alias("names"))
    return areas.select("subject", V.cut_list(F.col("names"), 40).alias("listed"), V.cut_text(F.col("names"), 25).alias("text"))


def json_settings(spark, d):
    """Globs of a source as JSON and back."""
    stored = table(spark, d, "sources").select("source_id", F.to_json("exclude_globs").alias("stored"))
    return stored.select("source_id", "stored", F.size(F.coalesce(F.from_json("stored", "array<string>"), F.array().cast("array<string>"))).alias("globs"))


def promoted_sets(spark, d):
    sets = table(spark, d, "chunk_sets")
    chosen = sets.filter("not is_default").groupBy("corpus_id").agg(F.max("chunk_set_id").alias("chunk_set_id"))
    return V.promoted(sets, chosen).select("chunk_set_id", "is_default")


def memo_lookups(spark, d):
    asked = V.memo_hits(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 300)
    return asked.groupBy("event_type").agg(F.count_if("is_hit").alias("hits"), F.count("*").alias("asked"))


def units_union(spark, d):
    """Units of work: commits, files and texts in one list."""
    commits = table(spark, d, "git_documents").groupBy("source_id", "relative_path").agg(F.min("git_doc_id").alias("unit_id")).select(F.lit("commit").alias("kind"), "unit_id", "relative_path")
    files = table(spark, d, "source_files").select(F.lit("file").alias("kind"), F.col("file_id").alias("unit_id"), "relative_path")
    texts = table(spark, d, "extracted_texts").select(F.lit("text").alias("kind"), F.col("text_id").alias("unit_id"), F.col("file_name").alias("relative_path"))
    return commits.unionByName(files).unionByName(texts)


def orphan_chunks(spark, d):
    """Chunks left after the sets of one corpus were deleted, without those that lost their set."""
    from sparkloom.operators import store

    sets = table(spark, d, "chunk_sets")
    chunks = table(spark, d, "extracted_texts").select("text_id", "corpus_id").join(sets.select("chunk_set_id", "corpus_id"), "corpus_id")
    left = store.without(sets, sets.filter("corpus_id = 'co1' or not unit_aware"), ["chunk_set_id"])
    return chunks.join(left.select("chunk_set_id"), "chunk_set_id", "left_semi").select("text_id", "chunk_set_id")


def delete_by_file(spark, d):
    from sparkloom.operators import store

    gone = table(spark, d, "source_files").filter("size_bytes is null").select("source_id", "file_id")
    return store.without(_chunks(spark, d).select("source_id", "file_id", "chunk_index"), gone, ["source_id", "file_id"])


def pruned_directories(spark, d):
    """Directories that a walk need not enter."""
    folded = F.regexp_replace(F.lower(F.regexp_replace("relative_path", r"\\", "/")), r"^(\./)+", "")
    dirs = table(spark, d, "source_files").select(F.regexp_extract(folded, "^(.*)/[^/]*$", 1).alias("dir")).filter("dir <> ''").distinct()
    return dirs.filter(globs.prunable(F.col("dir"), PRUNE_RULES))


def timed_sections(spark, d):
    """Sections of a session by speaker, and every ten minutes."""
    best = table(spark, d, "transcript_records").filter("session_id is not null and line_no is not null and rec_type in ('user', 'assistant')")
    best = best.groupBy("session_id", "line_no").agg(F.max_by(F.struct("rec_type", "recorded_at"), "record_id").alias("r")).select("session_id", "line_no", "r.*")
    told = sections.timed_sections(best, "session_id", "line_no", "rec_type", "recorded_at")
    return told.groupBy("session_id", "section_no").agg(F.min("line_no").alias("first_line"), F.count("*").alias("messages"))


def matched_messages(spark, d):
    """The n-th view of a user's beside their n-th click."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return sections.matched_occurrences(events.filter("event_type = 'view'"), events.filter("event_type = 'click'"), ["user_id"], "event_id").select("event_id", "matched")


def commit_parts(spark, d):
    """Where the message, the stat and the patch of a commit's document begin, and whether the patch is over 64 KiB."""
    docs = table(spark, d, "git_documents")
    patch = F.instr("body", "\ndiff --git ")
    before = F.when(patch > 0, F.substring(F.col("body"), F.lit(1), patch)).otherwise(F.col("body"))
    stat = F.length(F.regexp_extract(before, r"(?s)^(.*?\n)(?: [^\n]* \| +\d+[^\n]*\n)+ \d+ files? changed", 1))
    size = F.octet_length(F.substring(F.col("body"), patch + 1, F.length("body")))
    return docs.select("git_doc_id", F.when(stat > 0, stat).alias("stat_at"), F.when(patch > 0, patch).alias("diff_at"), F.coalesce((patch > 0) & (size > 65536), F.lit(False)).alias("over_limit"))


LAYERS = {"": ["vendor/", "*.min.js", "*.json"], "src": ["*.go", "!vendor/", "!keep.min.js"], "src/roster": ["!*.go"], "tests": ["!*.json"]}


def layered_ignores(spark, d):
    """Files that ignore files of several directories leave out."""
    rows = [("", base, 1, no, rule, says) for base, lines in LAYERS.items() for no, (rule, says) in enumerate(rules.parsed_lines(lines))]
    layers = spark.createDataFrame(rows, "scope string, base string, rank int, no int, rule string, says boolean")
    files = table(spark, d, "source_files").select("file_id", rules.folded_path(F.col("relative_path")).alias("path"), F.lit("").alias("scope"))
    return rules.decided(files, layers, "file_id").filter("verdict").select("file_id")


def lines_about(spark, d):
    """Lines 20 to 30 of every file that has them, from its chunks: those that touch the range, stitched and cut."""
    touching = _chunks(spark, d).filter("start_line <= 30 and end_line >= 20")
    whole = K.passages(touching, [], ["file_id"])
    shown = F.slice(F.split("text", "\n", -1), 20 - F.col("start_line") + 1, F.least(F.col("end_line"), F.lit(30)) - 19)
    return whole.select("file_id", F.array_join(shown, "\n").alias("shown"))


def sorted_files(spark, d):
    """The largest files, then by status, path and id: every order of a listing ends in path and id."""
    files = C.file_status(C.current_files(table(spark, d, "walk_candidates")), table(spark, d, "sources"))
    return files.orderBy("status", F.desc_nulls_last("size_bytes"), "path", "candidate_id").offset(20).limit(60).select("candidate_id", "status", "path")


def root_errors(spark, d):
    """Roots asked for, each with the sources at it or beneath it, or the roots there are."""
    asked = spark.createDataFrame([("/thimmorik",), ("/ULLPHALIN",), ("/nowhere",), ("/ullph",)], "asked string")
    return V.sources_at_root(asked, table(spark, d, "sources"))


def visible_jobs(spark, d):
    """Jobs of the corpora a caller may see that did something, newest first."""
    seen = table(spark, d, "sources").filter("corpus_id in ('co1', 'co2')").select(F.col("source_id").alias("job_source"))
    jobs = jobs_in_order(table(spark, d, "job_progress")).join(broadcast_if_small(seen), "job_source", "left_semi").filter("files_total > 0")
    return jobs.orderBy(F.desc("started_at"), F.desc("job_id")).limit(50).select("job_id", "job_state")


def corpus_headline(spark, d):
    """Files by state of each corpus beside its default set, Pending told apart."""
    listing, state = _listed(spark, d)
    states = V.listing_with_states(listing, state).join(broadcast_if_small(table(spark, d, "sources").select("source_id", "corpus_id")), "source_id")
    base = table(spark, d, "chunk_sets").filter("is_default").groupBy("corpus_id").agg(F.min("chunk_set_id").alias("default_set"))
    told = states.groupBy("corpus_id").agg(F.count_if(F.col("status") == "Indexed").alias("indexed"), F.count_if(F.col("status") == "Pending").alias("pending"), F.count_if(F.col("status") == "Failed").alias("failed"), F.count_if(F.col("status").isin("Skipped", "Empty")).alias("skipped"))
    return told.join(broadcast_if_small(base), "corpus_id", "left")


def sources_of_path(spark, d):
    """Sources in which each path occurs."""
    return C.current_files(table(spark, d, "walk_candidates")).groupBy("path").agg(F.countDistinct("source_id").alias("sources"))


def outcome_map(spark, d):
    """Outcomes of an import as one map, written as JSON."""
    counts = config_diff(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n"))))).alias("outcomes"))


def model_templates(spark, d):
    """Questions and passages framed for the family of a model, by purpose."""
    items = table(spark, d, "eval_items")
    model = F.when(F.col("suite").startswith("recall"), "lex-embed:v2").otherwise("plain")
    return items.select("item_id", V.framed_for(model, F.lit("query"), F.col("query_text")).alias("query"), F.length(V.framed_for(model, F.lit("document"), F.col("passage"))).alias("passage_chars"))


def delete_by_set(spark, d):
    from sparkloom.operators import store

    sets = table(spark, d, "chunk_sets")
    chunks = table(spark, d, "extracted_texts").select("text_id", "corpus_id").join(broadcast_if_small(sets.select("chunk_set_id", "corpus_id")), "corpus_id")
    return store.without(chunks, sets.filter("not is_default").select("chunk_set_id"), ["chunk_set_id"]).select("text_id", "chunk_set_id")


def commit_dates(spark, d):
    """The author's own date of a commit, with its offset from UTC."""
    stamp = F.regexp_extract("body", r"\ndate (\d{4}-\d{2}-\d{2})T[\d:]+(Z|[+-]\d{2}:\d{2})", 0)
    docs = table(spark, d, "git_documents").withColumn("stamp", stamp).filter("stamp <> ''")
    return docs.select("git_doc_id", F.substring("stamp", 7, 10).alias("day"), F.regexp_extract("stamp", "(Z|[+-][0-9:]+)$", 1).alias("offset"))


def unit_text(spark, d):
    """The text of each unit, from its start to the next one's."""
    texts = table(spark, d, "extracted_texts").filter("length(body) > 0").select("text_id", "body", F.explode("units").alias("u")).select("text_id", "body", "u.unit_no", "u.start_offset")
    order = Window.partitionBy("text_id").orderBy("start_offset", "unit_no")
    ends = texts.withColumn("stop", F.coalesce(F.lead("start_offset").over(order), F.length("body")))
    return ends.select("text_id", "unit_no", F.sha2(F.substring(F.col("body"), F.col("start_offset") + 1, F.col("stop") - F.col("start_offset")), 256).alias("sha256"))


_STATES = r"""
WITH jobs AS (SELECT job_id, arg_max(source_id, seq_no) AS job_source, arg_max(job_state, seq_no) AS state, min(started_at) AS started_at FROM job_progress GROUP BY job_id),
marks AS (SELECT job_id FROM jobs WHERE state = 'Succeeded' QUALIFY row_number() OVER (PARTITION BY job_source ORDER BY started_at DESC, job_id DESC) = 1),
rows_of AS (SELECT *, replace(relative_path, '\', '/') AS path FROM walk_candidates WHERE job_id IS NOT NULL AND source_id IS NOT NULL),
seen AS (SELECT *, max(recorded_at) OVER (PARTITION BY job_id, source_id, path) AS seen_at FROM rows_of),
one AS (SELECT job_id, source_id, path, candidate_id, size_bytes, modified_ticks, lower(sha256) AS sha256, seen_at FROM seen
  QUALIFY row_number() OVER (PARTITION BY job_id, source_id, path ORDER BY candidate_id) = 1),
listing AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY source_id, path ORDER BY seen_at DESC, job_id DESC, candidate_id DESC) = 1),
state AS (SELECT o.*, CASE WHEN size_bytes > coalesce(max_file_bytes, 262144) THEN 'Skipped' WHEN sha256 IS NULL THEN 'Failed' WHEN size_bytes = 0 THEN 'Empty' ELSE 'Indexed' END AS status
  FROM one o JOIN marks USING (job_id) LEFT JOIN sources USING (source_id))
"""
_P = "list_filter(string_split(lower(replace(relative_path, '\\', '/')), '/'), lambda s: s NOT IN ('', '.'))"

QUERIES = {
    f.__name__: f
    for f in (
        scope_resolution, scoped_chunks, file_roots, file_states, refresh_actions, swept_files, library_states, cached_text_misses, prefix_backfill, due_sources, report_tail,
        search_history, active_tokens, proposal_facts, log_cuts, json_settings, promoted_sets, memo_lookups, units_union, orphan_chunks, delete_by_file, pruned_directories,
        timed_sections, matched_messages, commit_parts, layered_ignores, lines_about, sorted_files, root_errors, visible_jobs, corpus_headline, sources_of_path, outcome_map,
        model_templates, delete_by_set, commit_dates, unit_text,
    )
}

SQL = {
    "scope_resolution": """
WITH a AS (SELECT DISTINCT unnest([corpus_id, corpus_id || ':' || set_name, corpus_id || 'x', corpus_id || ':x', ' ']) AS argument FROM chunk_sets),
p AS (SELECT argument, string_split(trim(argument), ':')[1] AS c, CASE WHEN contains(argument, ':') THEN string_split(trim(argument), ':')[2] END AS s FROM a),
r AS (SELECT argument, c, s, EXISTS (SELECT 1 FROM chunk_sets x WHERE x.corpus_id = c) AS known,
  CASE WHEN s IS NULL THEN (SELECT min(chunk_set_id) FROM chunk_sets x WHERE x.corpus_id = c AND is_default) ELSE (SELECT min(chunk_set_id) FROM chunk_sets x WHERE x.corpus_id = c AND x.set_name = s) END AS one FROM p),
e AS (SELECT *, CASE WHEN c = '' THEN 'no corpus named' WHEN NOT known THEN 'unknown corpus ' || c WHEN one IS NULL AND s IS NULL THEN 'no default set in ' || c WHEN one IS NULL THEN 'unknown set ' || s || ' in ' || c END AS error FROM r)
SELECT argument, CASE WHEN error IS NULL THEN c END AS corpus_id, CASE WHEN error IS NULL THEN one END AS chunk_set_id, error FROM e""",
    "scoped_chunks": "WITH "
    + _CH
    + r""" SELECT file_id, chunk_index FROM chunks JOIN sources s USING (source_id) WHERE s.corpus_id IN ('co1', 'co3', 'co6') AND code_language = 'python'
AND source_id IN ('so01SGDGHB', 'so02YGHEVW', 'so03SJFHBQ', 'so06KZWDBD') AND len(list_filter(regexp_extract_all(content, '(?m)^\s*(?:async\s+)?(?:def|class)\s+(\w+)', 1), lambda x: length(x) > 6)) > 0""",
    "file_roots": _FILES + "SELECT candidate_id, CASE WHEN root_path IS NULL THEN path ELSE rtrim(root_path, '/') || '/' || path END AS whole_path FROM files LEFT JOIN sources USING (source_id)",
    "file_states": _STATES + "SELECT l.source_id, l.path, coalesce(s.status, 'Pending') AS status FROM listing l LEFT JOIN state s ON s.source_id = l.source_id AND s.path = l.path",
    "refresh_actions": _STATES
    + """SELECT coalesce(l.source_id, s.source_id) AS source_id, coalesce(l.path, s.path) AS path, CASE WHEN l.path IS NULL THEN 'delete'
  WHEN coalesce(l.modified_ticks > 0 AND l.modified_ticks = s.modified_ticks AND l.size_bytes = s.size_bytes AND s.sha256 IS NOT NULL, false) THEN 'settled'
  WHEN l.sha256 IS NULL THEN 'unreadable' WHEN l.sha256 = s.sha256 THEN 'same content' ELSE 'index' END AS action
FROM listing l FULL JOIN state s ON s.source_id = l.source_id AND s.path = l.path""",
    "swept_files": _STATES + "SELECT source_id, path, 'Pending' AS status FROM listing l WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.source_id = l.source_id AND s.path = l.path)",
    "library_states": """
WITH s AS (SELECT corpus_id, string_agg(chunk_set_id, ',' ORDER BY chunk_set_id) AS sets FROM chunk_sets GROUP BY corpus_id)
SELECT blob_sha256, string_agg(one, '|' ORDER BY one) AS nested, count(DISTINCT corpus_id) AS corpora FROM (
  SELECT blob_sha256, t.corpus_id, concat_ws('/', file_name, t.corpus_id, CAST(coalesce(extracted_chars, 0) AS VARCHAR), coalesce(sets, '-')) AS one FROM extracted_texts t LEFT JOIN s ON s.corpus_id = t.corpus_id)
GROUP BY blob_sha256""",
    "cached_text_misses": "SELECT text_id, corpus_id FROM extracted_texts WHERE corpus_id IN ('co1', 'co2') OR NOT coalesce(length(body) = extracted_chars, false)",
    "prefix_backfill": f"WITH p AS (SELECT file_id, {_P} AS parts FROM source_files) SELECT file_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/')), '|') AS prefixes FROM p",
    "due_sources": """
WITH j AS (SELECT job_id, arg_max(source_id, seq_no) AS job_source, arg_max(job_state, seq_no) AS state, min(started_at) AS s FROM job_progress GROUP BY job_id)
SELECT job_source, max(s) AS last_started FROM j GROUP BY job_source HAVING count(*) FILTER (WHERE state IN ('Running', 'Queued')) = 0 AND max(s) <= TIMESTAMP '2026-01-01 00:00:00'""",
    "report_tail": "WITH r AS (SELECT job_id, seq_no, max(report_id) AS report_id FROM job_progress GROUP BY ALL) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq_no DESC) <= 3",
    "search_history": "WITH l AS (SELECT * FROM events WHERE user_id % 10 = 3 AND contains(event_type, 'ic') AND value < 20) SELECT event_id, event_type, (SELECT count(*) FROM l) AS total FROM l ORDER BY event_id DESC LIMIT 26",
    "active_tokens": "SELECT event_id FROM events WHERE event_type <> 'error' AND (value IS NULL OR ts + INTERVAL 1 DAY * CAST(floor(value) AS INTEGER) > TIMESTAMP '2024-01-20 00:00:00')",
    "proposal_facts": "WITH "
    + _CH
    + ", r AS (SELECT source_id, coalesce(code_language, '?') AS language, file_id FROM chunks) SELECT source_id, language, count(*) AS chunks, count(DISTINCT file_id) AS files FROM r GROUP BY GROUPING SETS ((source_id), (language), ())",
    "log_cuts": """
WITH n AS (SELECT subject, array_to_string(sample_terms, ',') AS names FROM subject_areas), h AS (SELECT *, regexp_extract(substr(names, 1, 39), '(?s)^(.+),', 1) AS head FROM n)
SELECT subject, CASE WHEN length(names) <= 40 THEN names WHEN head <> '' THEN head || ',…' ELSE substr(names, 1, 39) || '…' END AS listed, substr(names, 1, 25) AS text FROM h""",
    "json_settings": "SELECT source_id, CASE WHEN exclude_globs IS NOT NULL THEN CAST(to_json(exclude_globs) AS VARCHAR) END AS stored, CAST(coalesce(len(exclude_globs), 0) AS INTEGER) AS globs FROM sources",
    "promoted_sets": "WITH c AS (SELECT corpus_id, max(chunk_set_id) AS one FROM chunk_sets WHERE NOT is_default GROUP BY corpus_id) SELECT chunk_set_id, CASE WHEN one IS NOT NULL THEN chunk_set_id = one ELSE is_default END AS is_default FROM chunk_sets LEFT JOIN c USING (corpus_id)",
    "memo_lookups": """
WITH l AS (SELECT event_type, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 300 MINUTE, false) AS hit FROM events)
SELECT event_type, count(*) FILTER (WHERE hit) AS hits, count(*) AS asked FROM l GROUP BY event_type""",
    "units_union": """
SELECT 'commit' AS kind, min(git_doc_id) AS unit_id, relative_path FROM git_documents GROUP BY source_id, relative_path
UNION ALL SELECT 'file', file_id, relative_path FROM source_files UNION ALL SELECT 'text', text_id, file_name FROM extracted_texts""",
    "orphan_chunks": "SELECT text_id, chunk_set_id FROM extracted_texts JOIN chunk_sets s USING (corpus_id) WHERE NOT (corpus_id = 'co1' OR NOT unit_aware)",
    "delete_by_file": "WITH " + _CH + " SELECT c.source_id, c.file_id, chunk_index FROM chunks c JOIN source_files f ON f.file_id = c.file_id WHERE f.size_bytes IS NOT NULL",
    "pruned_directories": r"""
WITH f AS (SELECT regexp_replace(lower(replace(relative_path, '\', '/')), '^(\./)+', '') AS p FROM source_files),
d AS (SELECT DISTINCT regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir FROM f), x AS (SELECT dir FROM d WHERE dir <> '')
SELECT dir FROM x WHERE regexp_matches(dir || '/', '(^|/)(vendor|node_modules|obj|tests)/')
  AND NOT (starts_with(dir || '/', 'vendor/quillo/keep/') OR starts_with(dir || '/', 'tests/data/') OR starts_with('vendor/quillo/keep/', dir || '/') OR starts_with('tests/data/', dir || '/'))""",
    "timed_sections": """
WITH RECURSIVE b AS (SELECT session_id, line_no, arg_max(rec_type, record_id) AS who, arg_max(coalesce(recorded_at, TIMESTAMP '1900-01-01'), record_id) AS t FROM transcript_records
  WHERE session_id IS NOT NULL AND line_no IS NOT NULL AND rec_type IN ('user', 'assistant') GROUP BY ALL),
n AS (SELECT session_id, line_no, who, CASE WHEN t > TIMESTAMP '1901-01-01' THEN t END AS t, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS k FROM b),
s AS (SELECT session_id, line_no, who, k, t AS since, CAST(1 AS BIGINT) AS section_no FROM n WHERE k = 1
  UNION ALL SELECT n.session_id, n.line_no, n.who, n.k,
    CASE WHEN n.who <> s.who OR coalesce(n.t - s.since >= INTERVAL 10 MINUTE, false) THEN n.t ELSE s.since END,
    s.section_no + CASE WHEN n.who <> s.who OR coalesce(n.t - s.since >= INTERVAL 10 MINUTE, false) THEN 1 ELSE 0 END
  FROM s JOIN n ON n.session_id = s.session_id AND n.k = s.k + 1)
SELECT session_id, section_no, min(line_no) AS first_line, count(*) AS messages FROM s GROUP BY session_id, section_no""",
    "layered_ignores": r"""
WITH f AS (SELECT file_id, regexp_replace(lower(replace(relative_path, '\', '/')), '^(\./)+', '') AS p FROM source_files),
r(base, no, rule, says) AS (VALUES """
    + ", ".join(f"('{base}', {no}, '{rule}', {says})" for base, lines in LAYERS.items() for no, (rule, says) in enumerate(rules.parsed_lines(lines)))
    + """), m AS (SELECT file_id, arg_max(says, (length(base), no)) AS says FROM f JOIN r ON (base = '' OR starts_with(p, base || '/')) AND regexp_full_match(CASE WHEN base = '' THEN p ELSE substr(p, length(base) + 2) END, rule) GROUP BY file_id)
SELECT file_id FROM m WHERE says""",
    "lines_about": "WITH "
    + _CH
    + " SELECT file_id, array_to_string(lines[20:30], chr(10)) AS shown FROM f WHERE len(lines) >= 20",
    "sorted_files": _FILES + "SELECT candidate_id, status, path FROM files ORDER BY status, size_bytes DESC NULLS LAST, path, candidate_id LIMIT 60 OFFSET 20",
    "root_errors": """
WITH a(asked) AS (VALUES ('/thimmorik'), ('/ULLPHALIN'), ('/nowhere'), ('/ullph')),
m AS (SELECT asked, string_agg(source_id, ',' ORDER BY source_id) AS found FROM a JOIN sources ON lower(root_path) = lower(asked) OR starts_with(lower(root_path), lower(asked) || '/') GROUP BY asked)
SELECT asked, found, CASE WHEN found IS NULL THEN 'no source at ' || asked || '; roots: ' || (SELECT string_agg(DISTINCT root_path, ', ' ORDER BY root_path) FROM sources) END AS error FROM a LEFT JOIN m USING (asked)""",
    "visible_jobs": """
WITH j AS (SELECT job_id, arg_max(source_id, seq_no) AS s, arg_max(job_state, seq_no) AS job_state, arg_max(files_total, seq_no) AS n, min(started_at) AS t FROM job_progress GROUP BY job_id)
SELECT job_id, job_state FROM j WHERE n > 0 AND s IN (SELECT source_id FROM sources WHERE corpus_id IN ('co1', 'co2')) ORDER BY t DESC, job_id DESC LIMIT 50""",
    "corpus_headline": _STATES
    + """, b AS (SELECT s.corpus_id, coalesce(t.status, 'Pending') AS status FROM listing l JOIN sources s ON s.source_id = l.source_id LEFT JOIN state t ON t.source_id = l.source_id AND t.path = l.path),
e AS (SELECT corpus_id, min(chunk_set_id) AS default_set FROM chunk_sets WHERE is_default GROUP BY corpus_id)
SELECT corpus_id, count(*) FILTER (WHERE status = 'Indexed') AS indexed, count(*) FILTER (WHERE status = 'Pending') AS pending, count(*) FILTER (WHERE status = 'Failed') AS failed,
  count(*) FILTER (WHERE status IN ('Skipped', 'Empty')) AS skipped, any_value(default_set) AS default_set FROM b LEFT JOIN e USING (corpus_id) GROUP BY corpus_id""",
    "sources_of_path": _FILES + "SELECT path, count(DISTINCT source_id) AS sources FROM files GROUP BY path",
    "outcome_map": _DIFF + "SELECT '{' || string_agg('\"' || outcome || '\":' || n, ',' ORDER BY outcome) || '}' AS outcomes FROM (SELECT outcome, count(*) AS n FROM o GROUP BY outcome)",
    "model_templates": """
SELECT item_id, CASE WHEN suite LIKE 'recall%' THEN 'search_query: ' || query_text ELSE query_text END AS query, CAST(length(CASE WHEN suite LIKE 'recall%' THEN 'search_document: ' || passage ELSE passage END) AS INTEGER) AS passage_chars FROM eval_items""",
    "delete_by_set": "SELECT text_id, chunk_set_id FROM extracted_texts JOIN chunk_sets USING (corpus_id) WHERE is_default",
    "commit_dates": r"""
WITH s AS (SELECT git_doc_id, regexp_extract(body, '\ndate (\d{4}-\d{2}-\d{2})T[\d:]+(Z|[+-]\d{2}:\d{2})', 1) AS day, regexp_extract(body, '\ndate (\d{4}-\d{2}-\d{2})T[\d:]+(Z|[+-]\d{2}:\d{2})', 2) AS "offset" FROM git_documents)
SELECT * FROM s WHERE day <> ''""",
    "unit_text": """
WITH u AS (SELECT text_id, body, unnest(units) AS u FROM extracted_texts WHERE length(body) > 0),
e AS (SELECT text_id, body, u.unit_no AS unit_no, u.start_offset AS lo, coalesce(lead(u.start_offset) OVER (PARTITION BY text_id ORDER BY u.start_offset, u.unit_no), length(body)) AS hi FROM u)
SELECT text_id, unit_no, sha256(substr(body, lo + 1, hi - lo)) AS sha256 FROM e""",
    "matched_messages": """
WITH n AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)
SELECT v.event_id, c.event_id AS matched FROM n v LEFT JOIN n c ON c.user_id = v.user_id AND c.k = v.k AND c.event_type = 'click' WHERE v.event_type = 'view'""",
    "commit_parts": r"""
WITH p AS (SELECT git_doc_id, body, instr(body, chr(10) || 'diff --git ') AS patch FROM git_documents),
s AS (SELECT *, length(regexp_extract(CASE WHEN patch > 0 THEN substr(body, 1, patch) ELSE body END, '(?s)^(.*?\n)(?: [^\n]* \| +\d+[^\n]*\n)+ \d+ files? changed', 1)) AS stat FROM p)
SELECT git_doc_id, CAST(CASE WHEN stat > 0 THEN stat END AS INTEGER) AS stat_at, CAST(CASE WHEN patch > 0 THEN patch END AS INTEGER) AS diff_at, coalesce(patch > 0 AND octet_length(encode(substr(body, patch + 1))) > 65536, false) AS over_limit FROM s""",
}
