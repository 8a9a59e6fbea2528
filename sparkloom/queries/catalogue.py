"""Queries of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import globs as G
from sparkloom.functions import text as X
from sparkloom.operators import catalog as C
from sparkloom.runtime import broadcast_if_small, table


def _files(spark, d):
    return C.file_status(C.current_files(table(spark, d, "walk_candidates")), table(spark, d, "sources"))


def corpus_summary(spark, d):
    return C.corpus_summary(_files(spark, d))


def files_per_source(spark, d):
    return _files(spark, d).groupBy("source_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def file_list(spark, d):
    page = C.file_list(_files(spark, d), "Ledger", ("Indexed", "Failed"), 10, 50)
    return page.select("candidate_id", "path", "size_bytes", "status")


def library_nested(spark, d):
    nested = C.library(table(spark, d, "extracted_texts"))
    return nested.select("blob_sha256", "attachments", "corpora", "chars", F.array_join(F.col("nested.file_name"), "|").alias("names"))


def source_choice(spark, d):
    return C.source_choice(_files(spark, d).withColumn("path", F.element_at(F.split("path", "/"), 2)))


def coverage_gaps(spark, d):
    return C.coverage_gaps(table(spark, d, "sources").withColumn("root_path", F.concat(F.lit("/w/"), F.element_at(F.split("root_path", "/"), -1), F.lit("/"), F.col("source_id"))))


def vanished_files(spark, d):
    return C.vanished_files(table(spark, d, "walk_candidates"), table(spark, d, "job_progress"))


def incremental_antijoin(spark, d):
    return C.unsettled_files(table(spark, d, "walk_candidates"), table(spark, d, "job_progress"))


def reconcile_full_outer(spark, d):
    return C.reconcile(table(spark, d, "walk_candidates"), table(spark, d, "job_progress"))


def config_diff(spark, d):
    sets = table(spark, d, "chunk_sets")
    there = sets.filter("chunk_size is not null").withColumn("boundary_mode", F.coalesce("boundary_mode", F.lit("none")))
    return C.configuration_diff(sets.filter("unit_aware"), there, "chunk_set_id", ["chunk_size", "chunk_overlap", "boundary_mode"])


def import_outcomes(spark, d):
    return config_diff(spark, d).groupBy("outcome").agg(F.count("*").alias("sets"))


def shadowed_owner(spark, d):
    return C.owners(_files(spark, d), table(spark, d, "sources")).groupBy("owner").agg(F.count("*").alias("files"))


def filter_inheritance(spark, d):
    return C.effective_filters(table(spark, d, "sources"))


def chunk_settings(spark, d):
    return C.chunk_settings(table(spark, d, "chunk_sets"), 300)


def triage_reasons(spark, d):
    return C.triage(table(spark, d, "walk_candidates"))


def newest_or_held(spark, d):
    commits = table(spark, d, "git_documents")
    return C.newest_or_held(commits, 5, commits.filter("git_doc_id % 10 = 0")).select("git_doc_id")


def latest_measurement(spark, d):
    last = table(spark, d, "job_progress").groupBy("source_id").agg(F.max_by(F.struct("chunks_written", "job_state"), F.struct("reported_at", "report_id")).alias("m"))
    return last.select("source_id", "m.chunks_written", "m.job_state")


def duplicate_names(spark, d):
    return table(spark, d, "extracted_texts").groupBy(F.lower(F.regexp_extract("file_name", "^[A-Za-z]+", 0)).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def sources_at_path(spark, d):
    return _files(spark, d).groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.countDistinct("source_id").alias("sources"))


def content_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(X.content_hash(F.col("text")).alias("sha")).agg(F.count("*").alias("files"), F.min("doc_id").alias("first_file")).filter("files > 1 and sha is not null")


def chunk_ids(spark, d):
    texts = table(spark, d, "extracted_texts").select("text_id", "corpus_id", "file_name", F.explode("units.unit_no").alias("unit_no"))
    return texts.select("text_id", "unit_no", X.chunk_id(F.col("corpus_id"), F.col("text_id").cast("string"), F.col("file_name"), F.col("unit_no")).alias("chunk_id"))


def fingerprint_sha256(spark, d):
    """Every setting, model and version that a chunk depends on: a change of any one of the fourteen re-indexes."""
    sets = table(spark, d, "chunk_sets").select("corpus_id", "chunk_set_id", "chunk_size", "chunk_overlap", "chars_per_token", "boundary_mode", "custom_pattern", "unit_aware")
    joined = table(spark, d, "extracted_texts").join(broadcast_if_small(sets), "corpus_id")
    return joined.select("text_id", "chunk_set_id", X.fingerprint(F.col("blob_sha256"), F.col("file_name")).alias("fingerprint"))


def collection_stats(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("points"), F.max(F.size("embedding")).alias("dimensions"), F.countDistinct("label").alias("labels"))


_FILES = r"""
WITH latest AS (
  SELECT source_id, replace(relative_path, '\', '/') AS path, candidate_id, corpus_id, size_bytes, modified_ticks, lower(sha256) AS sha256
  FROM walk_candidates QUALIFY row_number() OVER (PARTITION BY source_id, replace(relative_path, '\', '/') ORDER BY candidate_id DESC) = 1),
files AS (
  SELECT l.*, CASE WHEN size_bytes > coalesce(max_file_bytes, 262144) THEN 'Skipped' WHEN sha256 IS NULL THEN 'Failed' WHEN size_bytes = 0 THEN 'Empty' ELSE 'Indexed' END AS status
  FROM latest l LEFT JOIN sources USING (source_id))
"""
_LAST = r"""
WITH j AS (SELECT job_id, arg_max(source_id, seq_no) AS job_source, arg_max(job_state, seq_no) AS state, min(started_at) AS started_at, arg_max(files_total, seq_no) AS files_total FROM job_progress GROUP BY job_id),
marks AS (SELECT job_id, row_number() OVER (PARTITION BY job_source ORDER BY started_at DESC, job_id DESC) AS recency FROM j WHERE state = 'Succeeded'),
listed AS (SELECT recency, source_id, replace(relative_path, '\', '/') AS path, size_bytes, modified_ticks FROM walk_candidates JOIN marks USING (job_id) WHERE recency <= 2)
"""
_DIFF = """
WITH a AS (SELECT * FROM chunk_sets WHERE unit_aware),
b AS (SELECT chunk_set_id, chunk_size, chunk_overlap, coalesce(boundary_mode, 'none') AS boundary_mode FROM chunk_sets WHERE chunk_size IS NOT NULL),
o AS (SELECT coalesce(a.chunk_set_id, b.chunk_set_id) AS chunk_set_id, CASE WHEN a.chunk_set_id IS NULL THEN 'create' WHEN b.chunk_set_id IS NULL THEN 'remove'
  WHEN a.chunk_size IS NOT DISTINCT FROM b.chunk_size AND a.chunk_overlap IS NOT DISTINCT FROM b.chunk_overlap AND a.boundary_mode IS NOT DISTINCT FROM b.boundary_mode THEN 'same' ELSE 'update' END AS outcome
  FROM a FULL JOIN b ON a.chunk_set_id = b.chunk_set_id)
"""

QUERIES = {
    f.__name__: f
    for f in (
        corpus_summary, files_per_source, file_list, library_nested, source_choice, coverage_gaps, vanished_files, incremental_antijoin, reconcile_full_outer,
        config_diff, import_outcomes, shadowed_owner, filter_inheritance, chunk_settings, triage_reasons, newest_or_held, latest_measurement, duplicate_names,
        sources_at_path, content_duplicates, chunk_ids, fingerprint_sha256, collection_stats,
    )
}

SQL = {
    "corpus_summary": _FILES + "SELECT corpus_id, count(*) FILTER (WHERE status = 'Indexed') AS indexed, count(*) FILTER (WHERE status = 'Failed') AS failed, count(*) FILTER (WHERE status IN ('Skipped', 'Empty')) AS skipped FROM files GROUP BY corpus_id",
    "files_per_source": _FILES + "SELECT source_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files GROUP BY source_id",
    "file_list": _FILES + "SELECT candidate_id, path, size_bytes, status FROM files WHERE contains(lower(path), 'ledger') AND status IN ('Indexed', 'Failed') ORDER BY size_bytes DESC NULLS LAST, path, candidate_id LIMIT 50 OFFSET 10",
    "library_nested": "SELECT blob_sha256, count(*) AS attachments, count(DISTINCT corpus_id) AS corpora, max(coalesce(extracted_chars, 0)) AS chars, string_agg(file_name, '|' ORDER BY file_name, text_id) AS names FROM extracted_texts GROUP BY blob_sha256",
    "source_choice": _FILES + ", e AS (SELECT string_split(path, '/')[2] AS path, source_id, sum(coalesce(size_bytes, 0)) AS w FROM files GROUP BY ALL), r AS (SELECT *, count(*) OVER (PARTITION BY path) AS sources, row_number() OVER (PARTITION BY path ORDER BY w DESC, source_id) AS n FROM e) SELECT path, sources, source_id FROM r WHERE n = 1 AND sources > 1",
    "coverage_gaps": """
WITH r AS (SELECT source_id, lower('/w/' || list_last(string_split(root_path, '/')) || '/' || source_id) AS root FROM sources WHERE root_path IS NOT NULL),
p AS (SELECT regexp_replace(root, '/[^/]*$', '') AS parent, count(*) AS sources FROM r GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT parent AS a FROM p UNION SELECT root FROM r)
SELECT parent, sources FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE starts_with(p.parent, c.a || '/'))""",
    "vanished_files": _LAST + "SELECT source_id, path FROM listed WHERE recency = 2 EXCEPT SELECT source_id, path FROM listed WHERE recency = 1",
    "incremental_antijoin": _LAST + "SELECT DISTINCT source_id, path, size_bytes, modified_ticks FROM listed l WHERE recency = 1 AND NOT EXISTS (SELECT 1 FROM listed k WHERE k.recency = 2 AND k.modified_ticks > 0 AND k.source_id = l.source_id AND k.path = l.path AND k.size_bytes = l.size_bytes AND k.modified_ticks = l.modified_ticks)",
    "reconcile_full_outer": _LAST
    + r""", counted AS (SELECT job_id, count(*) AS listed FROM (SELECT DISTINCT job_id, source_id, replace(relative_path, '\', '/') FROM walk_candidates) GROUP BY job_id),
said AS (SELECT job_id, CAST(files_total AS BIGINT) AS reported FROM j WHERE state = 'Succeeded')
SELECT job_id, listed, reported, CASE WHEN reported IS NULL THEN 'unreported' WHEN listed IS NULL THEN 'unlisted' WHEN listed = reported THEN 'matches' ELSE 'differs' END AS outcome FROM counted FULL JOIN said USING (job_id)""",
    "config_diff": _DIFF + "SELECT chunk_set_id, outcome FROM o",
    "import_outcomes": _DIFF + "SELECT outcome, count(*) AS sets FROM o GROUP BY outcome",
    "shadowed_owner": _FILES + """, a AS (SELECT candidate_id, lower(s.root_path || '/' || path) AS p FROM files JOIN sources s USING (source_id) WHERE s.root_path IS NOT NULL),
b AS (SELECT candidate_id, arg_min(source_id, (-length(root_path), source_id)) AS owner FROM a JOIN sources ON root_path IS NOT NULL AND starts_with(p, lower(root_path) || '/') GROUP BY candidate_id)
SELECT owner, count(*) AS files FROM b GROUP BY owner""",
    "filter_inheritance": """
WITH c AS (SELECT corpus_id, arg_min(exclude_globs, source_id) AS g FROM sources WHERE exclude_globs IS NOT NULL GROUP BY corpus_id)
SELECT source_id, CASE WHEN exclude_globs IS NOT NULL THEN 'source' WHEN g IS NOT NULL THEN 'corpus' ELSE 'default' END AS origin,
  array_to_string(coalesce(exclude_globs, g, ['**']), '|') AS globs FROM sources LEFT JOIN c USING (corpus_id)""",
    "chunk_settings": """
WITH b AS (SELECT corpus_id, chunk_size AS bs, chunk_overlap AS bo FROM chunk_sets WHERE is_default),
s AS (SELECT c.*, least(coalesce(chunk_size, bs, 256), 270) AS size, coalesce(chunk_overlap, bo, 32) AS o FROM chunk_sets c LEFT JOIN b USING (corpus_id))
SELECT chunk_set_id, CAST(size AS INTEGER) AS size, CAST(least(o, size - 1) AS INTEGER) AS overlap, CAST(floor(size * chars_per_token) AS INTEGER) AS budget FROM s""",
    "triage_reasons": r"""
WITH p AS (SELECT *, lower(replace(relative_path, '\', '/')) AS p FROM walk_candidates), e AS (SELECT *, regexp_extract(p, '\.([^./]*)$', 1) AS ext FROM p)
SELECT candidate_id, CASE WHEN regexp_matches(p, '(^|/)\.git(/|$)') THEN 'git plumbing'
{ignored}
  WHEN sha256 IS NULL THEN 'unreadable' WHEN size_bytes = 0 THEN 'empty file'
  WHEN size_bytes > CASE WHEN ext IN ('pdf', 'docx', 'pptx', 'epub') THEN 536870912 ELSE 262144 END THEN 'over the size cap' END AS reason FROM e""".replace("{ignored}", "  WHEN " + " OR ".join(f"regexp_full_match(p, '{G.usable(rule)[1]}')" for rule in G.ALWAYS_EXCLUDE) + " THEN 'ignored'"),
    "newest_or_held": """
WITH one AS (SELECT * FROM git_documents QUALIFY row_number() OVER (PARTITION BY source_id, relative_path ORDER BY git_doc_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY author_date DESC NULLS LAST, git_doc_id) AS n FROM one)
SELECT git_doc_id FROM r WHERE n <= 5 OR git_doc_id % 10 = 0""",
    "latest_measurement": "SELECT source_id, arg_max(chunks_written, (reported_at, report_id)) AS chunks_written, arg_max(job_state, (reported_at, report_id)) AS job_state FROM job_progress GROUP BY source_id",
    "duplicate_names": "SELECT lower(regexp_extract(file_name, '^[A-Za-z]+')) AS name, count(*) AS n FROM extracted_texts GROUP BY 1 HAVING count(*) > 1",
    "sources_at_path": _FILES + "SELECT string_split(path, '/')[1] AS folder, count(DISTINCT source_id) AS sources FROM files GROUP BY 1",
    "content_duplicates": "SELECT sha256(text) AS sha, count(*) AS files, min(doc_id) AS first_file FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "chunk_ids": """
WITH u AS (SELECT text_id, corpus_id, file_name, unnest(units).unit_no AS unit_no FROM extracted_texts),
h AS (SELECT *, sha256(concat_ws('|', corpus_id, CAST(text_id AS VARCHAR), file_name, CAST(unit_no AS VARCHAR))) AS x FROM u)
SELECT text_id, unit_no, substr(x,7,2) || substr(x,5,2) || substr(x,3,2) || substr(x,1,2) || '-' || substr(x,11,2) || substr(x,9,2) || '-' || substr(x,15,2) || '5' || substr(x,14,1) || '-'
  || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(x,17,1)), 1) || substr(x,18,1) || substr(x,19,2) || '-' || substr(x,21,12) AS chunk_id FROM h""",
    "fingerprint_sha256": f"""
SELECT text_id, chunk_set_id, sha256(concat_ws('|', blob_sha256, coalesce(CAST(chunk_size AS VARCHAR), ''), coalesce(CAST(chunk_overlap AS VARCHAR), ''), CAST(chars_per_token AS VARCHAR), coalesce(boundary_mode, ''), coalesce(custom_pattern, ''),
  CAST(unit_aware AS VARCHAR), 'false', 'false', 'none', 'none', 'traw', 'x6', CASE WHEN regexp_matches(lower(file_name), '\\.(md|markdown)$') THEN 'c2m' ELSE 'c2' END)) AS fingerprint
FROM extracted_texts JOIN chunk_sets USING (corpus_id)""",
    "collection_stats": "SELECT count(*) AS points, CAST(max(len(embedding)) AS INTEGER) AS dimensions, count(DISTINCT label) AS labels FROM embeddings",
}
