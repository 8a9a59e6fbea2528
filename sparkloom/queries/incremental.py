"""Queries of the work-item ledger."""

from __future__ import annotations

from sparkloom.operators import ledger
from sparkloom.runtime import table


def p2_found(spark, d):
    return ledger.to_process(table(spark, d, "walk_candidates"), table(spark, d, "job_progress"))


def p2_skip_audit(spark, d):
    return ledger.skip_audit(table(spark, d, "walk_candidates"), table(spark, d, "job_progress"))


def p2_ledger_states(spark, d):
    entries = ledger.replay(table(spark, d, "walk_candidates"), table(spark, d, "job_progress"))
    return entries.groupBy("job_id", "item_state").count().withColumnRenamed("count", "items")


_ENTRIES = r"""
WITH jobs AS (
  SELECT job_id, arg_max(source_id, seq_no) AS job_source, arg_max(job_state, seq_no) AS job_state,
         arg_max(files_skipped, seq_no) AS files_skipped, min(started_at) AS started_at
  FROM job_progress WHERE job_id IS NOT NULL GROUP BY job_id),
placed AS (
  SELECT *, coalesce(job_state = 'Succeeded', false) AS committed,
         count(*) FILTER (WHERE job_state = 'Succeeded') OVER (PARTITION BY job_source ORDER BY started_at, job_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS commits_before
  FROM jobs),
listed AS (
  SELECT job_id, source_id, replace(relative_path, '\', '/') AS path, min(candidate_id) AS candidate_id,
         arg_min(coalesce(lower(sha256), ''), candidate_id) AS h
  FROM walk_candidates GROUP BY ALL),
rows_of AS (
  SELECT l.job_id, l.source_id, l.path, l.candidate_id, nullif(l.h, '') AS sha256, p.job_state, p.committed, p.commits_before, p.started_at
  FROM listed l JOIN placed p USING (job_id)),
-- runs of commits that list the file without a gap; of each commit the hash then on record
commits AS (
  SELECT source_id, path, commits_before + 1 AS no, sha256,
         commits_before + 1 - row_number() OVER (PARTITION BY source_id, path ORDER BY started_at, job_id) AS run,
  FROM rows_of WHERE committed),
record AS (
  SELECT source_id, path, no, last_value(sha256 IGNORE NULLS) OVER (PARTITION BY source_id, path, run ORDER BY no
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS recorded FROM commits),
entries AS (
  SELECT r.*, c.recorded, r.sha256 IS NOT NULL AND r.sha256 IS DISTINCT FROM c.recorded AS is_case
  FROM rows_of r LEFT JOIN record c ON c.source_id = r.source_id AND c.path = r.path AND c.no = r.commits_before)
"""

QUERIES = {"p2_found": p2_found, "p2_skip_audit": p2_skip_audit, "p2_ledger_states": p2_ledger_states}

SQL = {
    "p2_found": _ENTRIES + "SELECT job_id, candidate_id FROM entries WHERE is_case",
    "p2_skip_audit": _ENTRIES
    + """
SELECT p.job_id, p.job_state, count(e.job_id) AS files_listed, count(*) FILTER (WHERE e.is_case) AS files_to_process,
       count(*) FILTER (WHERE NOT e.is_case AND e.sha256 IS NOT NULL) AS files_unchanged,
       count(*) FILTER (WHERE e.job_id IS NOT NULL AND e.sha256 IS NULL) AS files_without_hash,
       CAST(p.files_skipped AS BIGINT) AS files_skipped,
       CASE WHEN p.committed THEN count(*) FILTER (WHERE NOT e.is_case AND e.sha256 IS NOT NULL) = p.files_skipped END AS skips_match
FROM placed p LEFT JOIN entries e ON e.job_id = p.job_id GROUP BY p.job_id, p.job_state, p.files_skipped, p.committed""",
    "p2_ledger_states": _ENTRIES
    + """
SELECT job_id, CASE WHEN NOT is_case OR committed THEN 'done' WHEN job_state IN ('Running', 'Queued') THEN 'leased' ELSE 'pending' END AS item_state, count(*) AS items
FROM entries GROUP BY ALL""",
}
