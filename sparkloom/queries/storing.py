"""Queries of the store and of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import store
from sparkloom.operators.ledger import jobs_in_order
from sparkloom.runtime import broadcast_if_small, table


def upsert_chunks(spark, d):
    """Texts of one half replaced by shorter ones: the row count stays, the replaced rows change."""
    rows = table(spark, d, "extracted_texts").select("text_id", "corpus_id", F.coalesce("extracted_chars", F.lit(0)).alias("chars"))
    fresh = rows.filter("text_id % 2 = 0").withColumn("chars", F.lit(1))
    return store.upsert(rows, fresh, ["text_id"])


def delete_by_corpus(spark, d):
    gone = table(spark, d, "chunk_sets").filter("is_default and chunk_size < 100").select("corpus_id")
    return store.without(table(spark, d, "extracted_texts").select("text_id", "corpus_id"), gone, ["corpus_id"])


def jobs_page(spark, d):
    """Jobs newest first, those that did not succeed."""
    jobs = jobs_in_order(table(spark, d, "job_progress")).filter("not committed")
    return jobs.orderBy(F.desc("started_at"), F.desc("job_id")).limit(40).select("job_id", "job_state")


def framed_queries(spark, d):
    items = table(spark, d, "eval_items")
    template = F.when(F.col("suite").startswith("recall"), "task: search | query: {text}")
    return items.select("item_id", store.framed(template, F.col("query_text")).alias("framed"))


def canary_check(spark, d):
    """Each vector against the one of its label with the lowest id."""
    vectors = table(spark, d, "embeddings")
    first = broadcast_if_small(vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("recorded")))
    return vectors.join(first, "label").filter(store.same_model(F.col("embedding"), F.col("recorded"), 0.5)).select("vec_id")


QUERIES = {f.__name__: f for f in (upsert_chunks, delete_by_corpus, jobs_page, framed_queries, canary_check)}

SQL = {
    "upsert_chunks": "SELECT text_id, corpus_id, CASE WHEN text_id % 2 = 0 THEN 1 ELSE coalesce(extracted_chars, 0) END AS chars FROM extracted_texts",
    "delete_by_corpus": "SELECT text_id, corpus_id FROM extracted_texts WHERE corpus_id NOT IN (SELECT corpus_id FROM chunk_sets WHERE is_default AND chunk_size < 100)",
    "jobs_page": "WITH j AS (SELECT job_id, arg_max(job_state, seq_no) AS job_state, min(started_at) AS s FROM job_progress GROUP BY job_id) SELECT job_id, job_state FROM j WHERE job_state <> 'Succeeded' ORDER BY s DESC, job_id DESC LIMIT 40",
    "framed_queries": "SELECT item_id, CASE WHEN suite LIKE 'recall%' THEN 'task: search | query: ' || query_text ELSE query_text END AS framed FROM eval_items",
    "canary_check": "WITH f AS (SELECT label, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS r FROM embeddings GROUP BY label) SELECT vec_id FROM embeddings JOIN f USING (label) WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), r) >= 0.5",
}
