"""Keyword, dense and fused ranking over a table of chunks.

A chunk is a row with an id and a text; the operators name these columns in their arguments. Scores are doubles,
ties go to the smaller id. Rankings use ``row_number() <= k``, which Spark cuts to k rows a query before the
shuffle, so no query gathers all its matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.runtime import broadcast_if_small, collect_bounded, cut_by_key, cut_lineage

RRF_K = 2
DBSF_DEGENERATE = 0.5
MAX_QUERIES_PER_BLOCK = 20_000
SCORES_AT_ONCE = 8_000_000
PREFETCH_FACTOR, PREFETCH_MOST = 4, 800
OVER_FETCH_FACTOR, OVER_FETCH_MOST = 16, 400


def postings(chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf). Chunks without a term have no rows."""
    return X.term_rows(chunks, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


def keyword_scores(
    chunks: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query: str = "query_text", collection: str | None = None
) -> DataFrame:
    """(query_key, key, score): the sum over shared terms of qtf * tf * ln(1 + (N - df + 0.5) / (df + 0.5)).

    N and df count the chunks of the whole collection, or of each value of the column ``collection``, which then
    comes out too. Only occurrences of query terms leave the scan. They are laid out by chunk once, so that scores are
    summed, and the best of each query kept, before anything is shuffled again.
    """
    asked = postings(queries, query_key, query).withColumnRenamed("tf", "qtf")
    wanted = asked.select("term").distinct()
    by = [collection] if collection else []
    rows = X.term_rows(chunks, key, text, by).join(broadcast_if_small(wanted, 500_000), "term", "left_semi")
    held = cut_by_key(rows, key, lambda laid: laid.groupBy(key, *by, "term").agg(F.count("*").alias("tf")))
    df = held.groupBy(*by, "term").agg(F.count("*").alias("df"))
    total = chunks.groupBy(*by).agg(F.count("*").alias("n"))
    # without a collection the total is one row; with one it joins by it
    idf = df.join(broadcast_if_small(total), by) if by else df.join(F.broadcast(total))
    idf = idf.select(*by, "term", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = asked.join(idf, "term").select(query_key, *by, "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    return held.join(broadcast_if_small(weights, 500_000), [*by, "term"]).groupBy(query_key, *by, key).agg(F.sum(F.col("weight") * F.col("tf")).alias("score"))


def phrase_hits(chunks: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", phrase: str = "phrase") -> DataFrame:
    """(key, phrase) of every chunk that holds a phrase: its words next to each other and in order, in any case.

    Words are runs of letters and digits. Each text is split once; only occurrences of the phrases' words are joined,
    and a phrase is held where all its words count up to one start. Phrases without a word match nothing.
    """
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    stated = phrases.select(phrase).filter(F.col(phrase).isNotNull()).distinct().withColumn("_w", runs(F.col(phrase)))
    parts = stated.select(phrase, F.size("_w").alias("_n"), F.posexplode("_w").alias("_i", "_word"))
    seen = chunks.select(key, F.posexplode(runs(F.col(text))).alias("_at", "_word"))
    starts = seen.join(broadcast_if_small(parts, 500_000), "_word").groupBy(key, phrase, (F.col("_at") - F.col("_i")).alias("_start"), "_n").agg(F.count("*").alias("_k"))
    return starts.filter("_k = _n").select(key, phrase).distinct()


def top_k(scores: DataFrame, k: int, query_key: str, key: str, score: str = "score", digits: int = 6) -> DataFrame:
    """The k best rows of every query with their rank. Scores are rounded first, so that rank and value agree."""
    rounded = scores.withColumn(score, F.round(score, digits))
    order = Window.partitionBy(query_key).orderBy(F.desc(score), F.asc(key))
    return rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query_key, key, score, rank): exact cosine of a stated query set against all rows, in blocks of queries.

    Rows whose vector is null, of another length than the query's, zero or not finite score 0. Each partition keeps its
    k best a query before anything is shuffled. Queries are numbered and cut into blocks by their number.
    """
    stated = queries.select(F.col(key).alias("q"), vector).filter(F.col("q").isNotNull())
    first = collect_bounded(stated, MAX_QUERIES_PER_BLOCK)
    if first is not None:
        return top_k(_dense_block(vectors, first, k, key, vector, query_key), k, query_key, key)
    numbered = cut_lineage(stated.withColumn("_no", F.monotonically_increasing_id()))
    blocks = -(-numbered.count() // MAX_QUERIES_PER_BLOCK)
    # numbers run on within each partition, so that every block takes its even share of each
    found = None
    for block in range(blocks):
        rows = numbered.filter(F.pmod("_no", F.lit(blocks)) == block).drop("_no").collect()
        one = top_k(_dense_block(vectors, rows, k, key, vector, query_key), k, query_key, key)
        found = one if found is None else found.unionByName(one)
    return found


def _dense_block(vectors: DataFrame, stated: list, k: int, key: str, vector: str, query_key: str) -> DataFrame:
    """(query_key, key, score): of each slice of vectors the k best for every query of the block."""
    by_width: dict[int, list] = {}
    for row in stated:
        by_width.setdefault(len(row[vector] or ()), []).append(row)

    def unit(rows: list, width: int) -> np.ndarray:
        block = np.zeros((len(rows), max(width, 1)))
        for i, row in enumerate(rows):
            if row is not None and len(row) == width and np.isfinite(row).all():
                block[i, :width] = row
        norms = np.linalg.norm(block, axis=1, keepdims=True)
        return np.divide(block, norms, out=np.zeros_like(block), where=norms > 0)

    asked = [(width, np.array([r.q for r in rows], np.int64), unit([r[vector] for r in rows], width)) for width, rows in by_width.items()]
    sent = vectors.sparkSession.sparkContext.broadcast(asked)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for width, ids, mine in sent.value:
                # one slice of scores takes at most SCORES_AT_ONCE numbers
                step = max(k, SCORES_AT_ONCE // len(ids))
                for at in range(0, len(whole), step):
                    frame = whole.iloc[at : at + step]
                    scores = np.round(mine @ unit(list(frame[vector]), width).T, 6)
                    keys = frame[key].to_numpy()
                    order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :k]
                    yield pd.DataFrame({query_key: np.repeat(ids, order.shape[1]), key: keys[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

    return vectors.select(key, vector).filter(F.col(key).isNotNull()).mapInPandas(run, f"{query_key} long, {key} long, score double")


def rrf(lists: list[DataFrame], query_key: str, key: str) -> DataFrame:
    """Reciprocal rank fusion: the sum over lists of 1 / (2 + rank from 0)."""
    every = None
    for one in lists:
        part = one.select(query_key, key, (F.lit(1.0) / (RRF_K + F.col("rank") - 1)).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(query_key, key).agg(F.sum("part").alias("score"))


def dbsf(lists: list[DataFrame], query_key: str, key: str) -> DataFrame:
    """Distribution-based fusion: each list's scores as (s - (mean - 3 sd)) / (6 sd), summed; 0.5 where sd is 0 or undefined."""
    every = None
    for one in lists:
        over = Window.partitionBy(query_key)
        mean, sd = F.avg("score").over(over), F.stddev_samp("score").over(over)
        norm = F.when(sd > 0, (F.col("score") - (mean - 3 * sd)) / (6 * sd)).otherwise(DBSF_DEGENERATE)
        part = one.select(query_key, key, norm.alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(query_key, key).agg(F.sum("part").alias("score"))


def distinct_by_title(hits: DataFrame, query_key: str, root: str, path: str, key: str) -> DataFrame:
    """The best hit of every document of a query: a document is a source root and a path without its extension."""
    stem = F.regexp_replace(F.col(path), r"\.[^./\\]*$", "")
    order = Window.partitionBy(query_key, root, stem).orderBy(F.desc("score"), F.asc(key))
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def prefetch_limit(limit: int) -> int:
    return min(PREFETCH_FACTOR * limit, PREFETCH_MOST)


def over_fetch_limit(limit: int) -> int:
    return min(OVER_FETCH_FACTOR * limit, OVER_FETCH_MOST)
