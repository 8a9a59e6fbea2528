"""The search of a caller: scope, filters, two rankings, fusion, one hit per document, a window on each.

The plan is declared once over frames and left to Catalyst. Filters come before ranking, payload columns join
after it. Chunks need chunk_id, corpus_id, chunk_set_id, source_id, file_path and content; optional columns are
language, symbols, section and source_root. Vectors need chunk_id and dense.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from sparkloom.functions import text as X
from sparkloom.operators import presentation
from sparkloom.operators import retrieval as R

MAX_LIMIT, MAX_WINDOW = 50, 100_000


class EmptyScope(ValueError):
    """A search names no corpus; it never means all of them."""


@dataclass
class SearchRequest:
    query: str
    corpora: list[str]
    chunk_sets: list[str] = field(default_factory=list)
    mode: str = "hybrid"
    limit: int = 10
    vector: list[float] | None = None
    source_ids: list[str] = field(default_factory=list)
    path_prefix: str | None = None
    language: str | None = None
    symbol: str | None = None
    section: str | None = None
    phrase: str | None = None
    fusion: str = "dbsf"
    collapse_titles: bool = True
    max_chars: int = presentation.WINDOW_CHARS


def scoped(chunks: DataFrame, request: SearchRequest) -> DataFrame:
    """The chunks a request may see. An empty scope is an error; a blank phrase or prefix is no condition."""
    if not request.corpora:
        raise EmptyScope("no corpus in scope")
    rows = chunks.filter(F.col("corpus_id").isin(request.corpora))
    if request.chunk_sets:
        rows = rows.filter(F.col("chunk_set_id").isin(request.chunk_sets))
    if request.source_ids:
        rows = rows.filter(F.col("source_id").isin(request.source_ids))
    if request.language:
        rows = rows.filter(F.col("language") == request.language)
    if request.section:
        rows = rows.filter(F.col("section") == request.section)
    if request.symbol:
        rows = rows.filter(F.array_contains("symbols", request.symbol))
    if request.path_prefix and request.path_prefix.strip():
        rows = rows.filter(X.under_prefix(F.col("file_path"), F.lit(request.path_prefix)))
    pattern = X.phrase_pattern(request.phrase)
    return rows.filter(F.col("content").rlike(pattern)) if pattern else rows


def search(spark: SparkSession, chunks: DataFrame, request: SearchRequest, vectors: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(hits, notes). Hits: rank, chunk_id, score, the payload and ``shown``; notes say what was degraded or ignored."""
    notes: list[str] = []
    X.phrase_pattern(request.phrase)  # refuse before anything is read
    text = request.query if request.query.strip() else request.phrase or ""
    limit = max(1, min(request.limit, MAX_LIMIT))
    wanted = R.over_fetch_limit(limit) if request.collapse_titles else limit
    within = scoped(chunks, request)
    mode = request.mode
    if mode != "keyword" and (vectors is None or request.vector is None):
        notes.append("no query vector: answered by keyword")
        mode = "keyword"
    asked = spark.createDataFrame([(0, text)], "query_id long, query string")
    lists = []
    if mode in ("hybrid", "keyword"):
        scores = R.keyword_scores(within, asked, "chunk_id", "content", "query_id", "query")
        lists.append(R.top_k(scores, R.prefetch_limit(wanted), "query_id", "chunk_id"))
    if mode in ("hybrid", "semantic"):
        question = spark.createDataFrame([(0, [float(x) for x in request.vector])], "chunk_id long, dense array<float>")
        lists.append(R.dense_topk(vectors.join(within.select("chunk_id"), "chunk_id", "left_semi"), question, R.prefetch_limit(wanted), "chunk_id", "dense"))
    if len(lists) == 2:
        ranked = R.top_k((R.rrf if request.fusion == "rrf" else R.dbsf)(lists, "query_id", "chunk_id"), wanted, "query_id", "chunk_id")
    else:
        ranked = lists[0].filter(F.col("rank") <= wanted)
    hits = ranked.select("query_id", "chunk_id", "score").join(within, "chunk_id")
    if request.collapse_titles:
        root = "source_root" if "source_root" in chunks.columns else "source_id"
        hits = R.distinct_by_title(hits.withColumn("_corpus_root", F.concat_ws("|", "corpus_id", root)), "query_id", "_corpus_root", "file_path", "chunk_id").drop("_corpus_root")
    hits = R.top_k(hits, limit, "query_id", "chunk_id")
    budget = max(0, min(request.max_chars, MAX_WINDOW))
    words = frozenset(w for w in re.findall(r"[^\W_]+", text.lower()) if w not in X.STOP_WORDS)
    marks = re.findall(r"[^\W_]+", request.phrase or "")
    phrase = re.compile(r"(?i)\b" + r"[\W_]+".join(map(re.escape, marks)) + r"\b") if marks else None
    # at most fifty rows reach this
    shown = udf(lambda content: None if content is None else presentation.window(content, budget, words, phrase), "string", useArrow=True)
    return hits.withColumn("shown", shown("content")).drop("query_id").orderBy("rank"), notes
