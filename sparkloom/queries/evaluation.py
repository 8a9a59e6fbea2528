"""Queries of retrieval quality, the search log, and texts by line, unit and section."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import blocks, chunker, metrics
from sparkloom.operators import retrieval as R
from sparkloom.queries import retrieval as RQ
from sparkloom.runtime import broadcast_if_small, table
from sparkloom.streaming import search_log as log


def _first_right(spark, d):
    """Rank of the first neighbour with the question's label, in lists of ten that leave the question out."""
    vectors = table(spark, d, "embeddings")
    hits = R.dense_topk(vectors, vectors.filter("vec_id % 100 = 0"), 11).filter("vec_id <> query_id")
    hits = hits.join(broadcast_if_small(vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))), "query_id")
    return hits.join(vectors.select("vec_id", "label"), "vec_id").groupBy("query_id", "wanted").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("rank"))


def hit_at_k_mrr(spark, d):
    return metrics.quality(_first_right(spark, d), ["wanted"])


def sweep_grouping_sets(spark, d):
    runs = table(spark, d, "job_progress").filter("files_total > 0").select("phase", "job_state", "corpus_id", (F.col("files_done") / F.col("files_total")).alias("done"))
    return metrics.sweep(runs, ["phase", "job_state", "corpus_id"], "done")


def auc_rank_sum(spark, d):
    scored = table(spark, d, "events").select("value", (F.col("event_type") == "purchase").alias("positive"))
    return metrics.auc(scored, "value", "positive")


def wilson_interval(spark, d):
    counted = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return counted.select("event_type", low.alias("low"), high.alias("high"))


def bootstrap_interval(spark, d):
    pairs = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), (F.length("passage") / 700).alias("a"), (F.length("query_text") / 40).alias("b"))
    return metrics.paired_bootstrap(pairs)


def threshold_search(spark, d):
    scored = table(spark, d, "events").select("value", (F.col("event_type") == "purchase").alias("positive"))
    return metrics.threshold_keeping(scored, "value", "positive", 0.9)


def score_gap(spark, d):
    return metrics.score_gaps(RQ.keyword_list(spark, d, 10), "item_id")


def topk_overlap(spark, d):
    keyword, dense = RQ._by_document(spark, d, 40)
    return metrics.overlap(keyword, dense, "query_id", "chunk_id")


def chunk_documents(spark, d):
    chunks = chunker.chunk_texts(table(spark, d, "source_files"), "file_id", "file_text", "code_language")
    return chunks.select("key", "chunk_index", "start_line", "end_line", F.size("symbols").alias("symbols"), F.length("content").alias("chars"))


def log_keyset(spark, d):
    return log.page(table(spark, d, "events"), "event_id", 900, 50).select("event_id", "user_id", "event_type")


def log_oldest(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("oldest"), F.count("*").alias("n"))


def log_retained(spark, d):
    return log.retained(table(spark, d, "events"), "ts", "2024-01-31 00:00:00", 7).select("event_id")


def log_windows(spark, d):
    return log.per_window(table(spark, d, "events"), "ts", "event_type", "6 hours")


def log_sessions(spark, d):
    return log.sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes")


def neighbour_units(spark, d):
    """Each unit with its neighbours' numbers in reading order."""
    units = table(spark, d, "extracted_texts").select("text_id", F.explode("units").alias("u")).select("text_id", "u.unit_no", "u.start_offset")
    order = Window.partitionBy("text_id").orderBy("start_offset", "unit_no")
    return units.select("text_id", "unit_no", F.lag("unit_no").over(order).alias("before"), F.lead("unit_no").over(order).alias("after"))


def offset_to_unit(spark, d):
    """The unit that holds each section's start: the last one that begins at or before it."""
    texts = table(spark, d, "extracted_texts").filter("units is not null and sections is not null")
    marks = texts.select("text_id", "units", F.explode("sections").alias("s"))
    held = F.array_max(F.transform(F.filter("units", lambda u: u["start_offset"] <= F.col("s.start_offset")), lambda u: F.struct(u["start_offset"], u["unit_no"])))
    return marks.select("text_id", "s.section_name", "s.start_offset", held["unit_no"].alias("unit_no"))


def git_sections(spark, d):
    """Length of every named section of a commit document, to the next section or the end."""
    docs = table(spark, d, "git_documents").filter("sections is not null")
    marks = docs.select("git_doc_id", F.length("body").alias("n"), F.explode("sections").alias("s")).select("git_doc_id", "n", "s.*")
    order = Window.partitionBy("git_doc_id").orderBy("start_offset")
    return marks.select("git_doc_id", "section_name", (F.coalesce(F.lead("start_offset").over(order), F.col("n")) - F.col("start_offset")).alias("chars"))


def transcript_sections(spark, d):
    """Sections of a session by change of speaker, with the lines each covers."""
    rows = table(spark, d, "transcript_records").filter("rec_type in ('user', 'assistant')").groupBy("session_id", "line_no").agg(F.max_by("rec_type", "record_id").alias("rec_type"))
    return blocks.runs(rows, "session_id", "line_no", "rec_type").groupBy("session_id", F.col("run").alias("section_no")).agg(
        F.first("rec_type").alias("speaker"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )


def stitch_gaps(spark, d):
    """Where the lines of a session's records break off: each gap after the line before it."""
    rows = table(spark, d, "transcript_records").select("session_id", "line_no").distinct()
    seen = blocks.with_previous(rows, "session_id", "line_no", "line_no").withColumn("through", F.coalesce("previous", F.lit(0)))
    return seen.filter("line_no > through + 1").select("session_id", (F.col("through") + 1).alias("gap_from"), (F.col("line_no") - 1).alias("gap_to"))


def line_window(spark, d):
    """Lines 3 to 5 of every file, clamped."""
    lines = F.split(F.regexp_replace("file_text", "\r\n?", "\n"), "\n", -1)
    return table(spark, d, "source_files").filter(F.size(lines) >= 3).select("file_id", F.array_join(F.slice(lines, 3, 3), "\n").alias("shown"))


def commit_paths(spark, d):
    """The path a commit is stored under: its date and the first twelve signs of its hash."""
    docs = table(spark, d, "git_documents").filter("author_date is not null")
    return docs.select("git_doc_id", F.concat(F.lit("commits/"), F.date_format("author_date", "yyyy-MM-dd"), F.lit("-"), F.substring("commit_sha", 1, 12)).alias("path"))


_RIGHT = "WITH " + RQ._DENSE + """,
f AS (SELECT query_id, a.label AS wanted, min(CASE WHEN b.label = a.label THEN rank END) AS rank FROM dense JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = dense.vec_id
  WHERE rank <= 11 AND dense.vec_id <> query_id GROUP BY ALL)
"""

QUERIES = {
    f.__name__: f
    for f in (
        hit_at_k_mrr, sweep_grouping_sets, auc_rank_sum, wilson_interval, bootstrap_interval, threshold_search, score_gap, topk_overlap, chunk_documents, log_keyset, log_oldest,
        log_retained, log_windows, log_sessions, neighbour_units, offset_to_unit, git_sections, transcript_sections, stitch_gaps, line_window, commit_paths,
    )
}

SQL = {
    "hit_at_k_mrr": _RIGHT + "SELECT wanted, count(*) AS questions, round(avg(coalesce(CAST(rank <= 1 AS DOUBLE), 0)), 6) AS hit_1, round(avg(coalesce(CAST(rank <= 3 AS DOUBLE), 0)), 6) AS hit_3, round(avg(coalesce(CAST(rank <= 5 AS DOUBLE), 0)), 6) AS hit_5, round(avg(coalesce(1.0 / CAST(rank AS DOUBLE), 0)), 6) AS mrr, count(*) FILTER (WHERE rank IS NULL) AS misses FROM f GROUP BY wanted",
    "sweep_grouping_sets": "SELECT phase, job_state, corpus_id, round(avg(x), 6) AS mean, round(max(x), 6) AS best, round(min(x), 6) AS worst FROM (SELECT *, CAST(files_done AS DOUBLE) / files_total AS x FROM job_progress WHERE files_total > 0) GROUP BY GROUPING SETS ((phase), (job_state), (corpus_id))",
    "auc_rank_sum": """
WITH c AS (SELECT value, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type <> 'purchase') AS n FROM events WHERE value IS NOT NULL GROUP BY value),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM b""",
    "wilson_interval": """
WITH c AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE value > 50) / CAST(count(*) AS DOUBLE) AS p FROM events GROUP BY event_type)
SELECT event_type, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
  round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM c""",
    "bootstrap_interval": """
WITH q AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, length(passage) / 700 - length(query_text) / 40 AS d FROM eval_items), n AS (SELECT count(*) AS n FROM q),
draws AS (SELECT r, CAST(('0x' || substr(md5('7-' || r || '-' || j), 1, 8)) AS BIGINT) % n AS k FROM n, range(5000) t(r), (SELECT unnest(range(n)) AS j FROM n)),
m AS (SELECT r, round(avg(d), 9) AS m FROM draws JOIN q USING (k) GROUP BY r), o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS spot FROM m)
SELECT (SELECT round(avg(d), 6) FROM q) AS mean, round(max(m) FILTER (WHERE spot = 125), 6) AS low, round(max(m) FILTER (WHERE spot = 4875), 6) AS high FROM o""",
    "threshold_search": """
WITH e AS (SELECT value, event_type = 'purchase' AS positive FROM events WHERE value IS NOT NULL),
p AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM e WHERE positive),
t AS (SELECT value AS threshold FROM p WHERE k = CAST(floor(n * (1 - 0.9) + 1e-9) AS BIGINT))
SELECT threshold, round(count(*) FILTER (WHERE positive AND value >= threshold) / CAST(count(*) FILTER (WHERE positive) AS DOUBLE), 6) AS kept,
  round(count(*) FILTER (WHERE NOT positive AND value >= threshold) / CAST(count(*) FILTER (WHERE NOT positive) AS DOUBLE), 6) AS passed FROM e, t GROUP BY threshold""",
    "score_gap": RQ._KEYWORD + "SELECT item_id, max(score) FILTER (WHERE rank = 1) AS top, round(max(score) FILTER (WHERE rank = 1) - coalesce(max(score) FILTER (WHERE rank = 2), 0), 6) AS gap, count(*) AS hits FROM keyword WHERE rank <= 10 GROUP BY item_id",
    "topk_overlap": RQ._LISTS + ", a AS (SELECT query_id, list(chunk_id) AS a FROM lists WHERE list = 1 AND rank <= 5 GROUP BY 1), b AS (SELECT query_id, list(chunk_id) AS b FROM lists WHERE list = 2 AND rank <= 5 GROUP BY 1) SELECT query_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared FROM a JOIN b USING (query_id)",
    "log_keyset": "SELECT event_id, user_id, event_type FROM events WHERE event_id < 900 ORDER BY event_id DESC LIMIT 51",
    "log_oldest": "SELECT event_type, min(ts) AS oldest, count(*) AS n FROM events GROUP BY event_type",
    "log_retained": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'",
    "log_windows": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "log_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, no""",
    "neighbour_units": "WITH u AS (SELECT text_id, unnest(units) AS u FROM extracted_texts) SELECT text_id, u.unit_no AS unit_no, lag(u.unit_no) OVER w AS before, lead(u.unit_no) OVER w AS after FROM u WINDOW w AS (PARTITION BY text_id ORDER BY u.start_offset, u.unit_no)",
    "offset_to_unit": """
WITH s AS (SELECT text_id, units, unnest(sections) AS s FROM extracted_texts WHERE units IS NOT NULL AND sections IS NOT NULL)
SELECT text_id, s.section_name AS section_name, s.start_offset AS start_offset,
  list_sort(list_transform(list_filter(units, lambda u: u.start_offset <= s.start_offset), lambda u: (u.start_offset, u.unit_no)), 'DESC')[1][2] AS unit_no FROM s""",
    "git_sections": "WITH s AS (SELECT git_doc_id, length(body) AS n, unnest(sections) AS s FROM git_documents WHERE sections IS NOT NULL) SELECT git_doc_id, s.section_name AS section_name, CAST(coalesce(lead(s.start_offset) OVER (PARTITION BY git_doc_id ORDER BY s.start_offset), n) - s.start_offset AS INTEGER) AS chars FROM s",
    "transcript_sections": """
WITH r AS (SELECT session_id, line_no, arg_max(rec_type, record_id) AS t FROM transcript_records WHERE rec_type IN ('user', 'assistant') GROUP BY ALL),
c AS (SELECT *, CASE WHEN lag(t) OVER w = t THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY session_id ORDER BY line_no)),
n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_no FROM c)
SELECT session_id, section_no, any_value(t) AS speaker, min(line_no) AS first_line, max(line_no) AS last_line FROM n GROUP BY session_id, section_no""",
    "stitch_gaps": """
WITH r AS (SELECT DISTINCT session_id, line_no FROM transcript_records),
t AS (SELECT *, coalesce(max(line_no) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS through FROM r)
SELECT session_id, CAST(through + 1 AS INTEGER) AS gap_from, CAST(line_no - 1 AS INTEGER) AS gap_to FROM t WHERE line_no > through + 1""",
    "line_window": r"WITH l AS (SELECT file_id, string_split(regexp_replace(file_text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM source_files) SELECT file_id, array_to_string(lines[3:5], chr(10)) AS shown FROM l WHERE len(lines) >= 3",
    "commit_paths": "SELECT git_doc_id, 'commits/' || strftime(author_date, '%Y-%m-%d') || '-' || substr(commit_sha, 1, 12) AS path FROM git_documents WHERE author_date IS NOT NULL",
}
