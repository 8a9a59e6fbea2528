"""Queries of terms, ranking, fusion and filters. Documents stand for chunks, held-out items for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import globs
from sparkloom.functions import text as X
from sparkloom.operators import retrieval as R
from sparkloom.runtime import broadcast_if_small, table

STOP = "('" + "','".join(X.STOP_WORDS) + "')"

#: Terms of a text in SQL: RE2 has no look-around, so each boundary is marked twice, as matches do not overlap.
_MARK = "run"
for _p in (r"([^\p{Lu}|])(\p{Lu})", r"(\p{Nd})([^\p{Nd}|])", r"([^\p{Nd}|])(\p{Nd})", r"(\p{Lu})(\p{Lu}\p{Ll})"):
    for _ in range(2):
        _MARK = f"regexp_replace({_MARK}, '{_p}', '\\1|\\2', 'g')"


def terms_cte(name: str, source: str, key: str, text: str) -> str:
    return f"""
{name}_runs AS (SELECT {key}, unnest(regexp_extract_all({text}, '[\\p{{L}}\\p{{Nd}}]+')) AS run FROM {source}),
{name}_parts AS (SELECT {key}, run, string_split({_MARK}, '|') AS parts FROM {name}_runs),
{name} AS (SELECT * FROM (SELECT {key}, lower(run) AS term FROM {name}_parts
  UNION ALL SELECT {key}, lower(unnest(parts)) FROM {name}_parts WHERE len(parts) > 1)
  WHERE length(term) BETWEEN 2 AND 64 AND term NOT IN {STOP})"""


_DOC_TERMS = terms_cte("t", "documents", "doc_id", "text")
_KEYWORD = f"""
WITH {_DOC_TERMS},
held AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
{terms_cte("q", "eval_items", "item_id", "query_text")},
asked AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM held GROUP BY term),
scores AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf), 6) AS score FROM held JOIN asked USING (term) JOIN idf USING (term) GROUP BY ALL),
keyword AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)"""


def keyword_list(spark, d, k):
    scores = R.keyword_scores(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return R.top_k(scores, k, "item_id", "doc_id")


def tokenize_terms(spark, d):
    docs = table(spark, d, "documents").filter("doc_id is not null")
    return docs.select("doc_id", F.coalesce(F.size(X.terms(F.col("text"))), F.lit(0)).alias("terms"), F.coalesce(F.size(F.array_distinct(X.terms(F.col("text")))), F.lit(0)).alias("distinct_terms"))


def term_frequency(spark, d):
    held = R.postings(table(spark, d, "documents"))
    return held.groupBy("doc_id").agg(F.sum("tf").alias("terms"), F.max("tf").alias("most"), F.max_by("term", F.struct("tf", "term")).alias("top_term"))


def document_frequency(spark, d):
    return R.postings(table(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def fnv1a_hash(spark, d):
    """The hash of every term of the corpus."""
    return X.term_rows(table(spark, d, "documents"), "doc_id", "text").select("term").distinct().select("term", X.term_hash(F.col("term")).alias("hash"))


def keyword_topk(spark, d):
    return keyword_list(spark, d, 10)


def _dense(spark, d, k):
    vectors = table(spark, d, "embeddings")
    return R.dense_topk(vectors, vectors.filter("vec_id % 100 = 0"), k)


def cosine_topk(spark, d):
    return _dense(spark, d, 10)


def _by_document(spark, d, k):
    """Both lists of the same questions: vector n is paired with document n, question q with vector 100 (q - 1)."""
    keyword = keyword_list(spark, d, k).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), "score", "rank")
    dense = _dense(spark, d, k).select((F.col("query_id") / 100 + 1).cast("long").alias("query_id"), F.col("vec_id").alias("chunk_id"), "score", "rank")
    return keyword, dense


def hybrid_rrf(spark, d):
    fused = R.rrf(list(_by_document(spark, d, R.prefetch_limit(10))), "query_id", "chunk_id")
    return R.top_k(fused, 10, "query_id", "chunk_id")


def hybrid_dbsf(spark, d):
    fused = R.dbsf(list(_by_document(spark, d, R.prefetch_limit(10))), "query_id", "chunk_id")
    return R.top_k(fused, 10, "query_id", "chunk_id")


_DENSE = """
unit AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dense_scores AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score
  FROM unit a, unit b WHERE a.vec_id % 100 = 0),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM dense_scores)"""

_LISTS = (
    _KEYWORD
    + ","
    + _DENSE
    + """,
lists AS (
  SELECT 1 AS list, item_id AS query_id, doc_id AS chunk_id, score, rank FROM keyword WHERE rank <= 40
  UNION ALL SELECT 2, query_id // 100 + 1, vec_id, score, rank FROM dense WHERE rank <= 40)"""
)

_FUSED = """,
fused AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM parts GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fused) WHERE rank <= 10"""


def distinct_title(spark, d):
    hits = keyword_list(spark, d, R.over_fetch_limit(10)).join(table(spark, d, "documents").select("doc_id", "source", "relative_path"), "doc_id")
    hits = hits.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("title", F.regexp_replace("relative_path", r"[-.][^/\\]*$", ""))
    best = R.distinct_by_title(hits, "item_id", "source", "title", "doc_id").drop("rank", "title")
    return R.top_k(best, 10, "item_id", "doc_id").select("item_id", "doc_id", "score", "rank")


def collection_merge_topk(spark, d):
    """Each language is a collection with its own statistics, null one of its own; the lists of all are merged by score, then cut."""
    docs = table(spark, d, "documents").withColumn("collection", F.coalesce(F.lower(F.trim("lang")), F.lit("")))
    scores = R.keyword_scores(docs, table(spark, d, "eval_items"), collection="collection")
    # a document is in one collection, so that the ten best of all collections are among the ten best of each
    return R.top_k(scores.drop("collection"), 10, "item_id", "doc_id")


_MERGED = f"""
WITH docs AS (SELECT doc_id, text, coalesce(lower(trim(lang)), '') AS collection FROM documents),
{_DOC_TERMS},
held AS (SELECT t.doc_id, collection, term, count(*) AS tf FROM t JOIN docs USING (doc_id) GROUP BY ALL),
{terms_cte("q", "eval_items", "item_id", "query_text")},
asked AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
total AS (SELECT collection, count(*) AS n FROM docs GROUP BY 1),
idf AS (SELECT collection, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM held JOIN total USING (collection) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf), 6) AS score FROM held JOIN asked USING (term) JOIN idf USING (collection, term) GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores) WHERE rank <= 10"""


def phrase_filter(spark, d):
    """Documents that hold the phrase of some subject's sample terms, words adjacent and in order."""
    phrases = table(spark, d, "subject_areas").select(F.explode("sample_terms").alias("phrase"))
    return R.phrase_hits(table(spark, d, "documents"), phrases)


def phrase_locator(spark, d):
    """Where the first match of one phrase begins, and how long it is."""
    pattern = X.phrase_pattern("kinds of")
    docs = table(spark, d, "documents").select("doc_id", "text")
    hit = F.regexp_substr("text", F.lit(pattern))
    return docs.filter(F.col("text").rlike(pattern)).select("doc_id", F.regexp_instr("text", F.lit(pattern)).alias("position"), F.length(hit).alias("length"))


def scope_filter(spark, d):
    """Texts of the corpora that have a default chunk set of 256 tokens or more: an EXISTS as a semi-join."""
    sets = table(spark, d, "chunk_sets").filter("is_default and chunk_size >= 256")
    return table(spark, d, "extracted_texts").join(broadcast_if_small(sets), "corpus_id", "left_semi").select("text_id", "corpus_id")


def path_prefix_filter(spark, d):
    files = table(spark, d, "source_files")
    return files.filter(X.under_prefix(F.col("relative_path"), F.lit("./SRC/"))).select("file_id", F.size(X.path_prefixes(F.col("relative_path"))).alias("depth"))


def language_filter(spark, d):
    files = table(spark, d, "source_files").select("file_id", X.language_of(F.col("relative_path")).alias("language"))
    return files.filter("language in ('python', 'go', 'text')")


def symbol_index(spark, d):
    """Names defined per file, by the language of its path; a symbol filter is array_contains on them."""
    names = X.symbols_of(X.language_of(F.col("relative_path")), F.col("file_text"))
    return table(spark, d, "source_files").select("file_id", F.explode(names).alias("symbol"))


def _symbols_sql() -> str:
    parts = []
    for language, pattern in X.SYMBOLS.items():
        pattern = pattern if pattern.startswith("(?m)") else "(?m)" + pattern
        one = f"regexp_extract_all(file_text, '{pattern}', 1)"
        if "|" in pattern and pattern.count("(\\w+)") == 2:
            one = f"list_transform(list_zip({one}, regexp_extract_all(file_text, '{pattern}', 2)), lambda x: CASE WHEN x[1] <> '' THEN x[1] ELSE x[2] END)"
        endings = ", ".join(f"'{e}'" for e in X.LANGUAGES[language])
        parts.append(f"WHEN ext IN ({endings}) THEN {one}")
    return "CASE " + " ".join(parts) + " ELSE [] END"


def source_root_filter(spark, d):
    """Sources at a root path or beneath it, whatever the case."""
    root = F.lower("root_path")
    wanted = F.lit("/thimmorik")
    return table(spark, d, "sources").filter((root == wanted) | root.startswith(F.concat(wanted, F.lit("/")))).select("source_id", "root_path")


def glob_filter(spark, d):
    """Files that one rule list excludes, the last match winning."""
    rules = ["node_modules/", "**/vendor/**", "*.min.js", "*_pb2.py", "src/*/*.cs", "!vendor/quillo/", "Generated/"]
    return table(spark, d, "source_files").filter(globs.excluded(F.col("relative_path"), rules)).select("file_id")


_P = "'/' || lower(replace(relative_path, '\\', '/'))"

QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, term_frequency, document_frequency, fnv1a_hash, keyword_topk, cosine_topk, hybrid_rrf, hybrid_dbsf, distinct_title,
        collection_merge_topk, phrase_filter, phrase_locator, scope_filter, path_prefix_filter, language_filter, symbol_index, source_root_filter, glob_filter,
    )
}

SQL = {
    "tokenize_terms": f"WITH {_DOC_TERMS} SELECT d.doc_id, CAST(count(term) AS INTEGER) AS terms, CAST(count(DISTINCT term) AS INTEGER) AS distinct_terms FROM documents d LEFT JOIN t USING (doc_id) WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id",
    "term_frequency": f"WITH {_DOC_TERMS}, held AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT doc_id, CAST(sum(tf) AS BIGINT) AS terms, max(tf) AS most, arg_max(term, (tf, term)) AS top_term FROM held GROUP BY doc_id",
    "document_frequency": f"WITH {_DOC_TERMS}, held AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM held GROUP BY term",
    "fnv1a_hash": f"""WITH {_DOC_TERMS}, w AS (SELECT DISTINCT term FROM t),
b AS (SELECT term, list_transform(range(1, octet_length(encode(term)) + 1), lambda i: CAST(('0x' || substr(hex(encode(term)), 2 * i - 1, 2)) AS BIGINT)) AS bytes FROM w)
SELECT term, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), bytes), lambda a, x: (xor(a, x) * 16777619) & 4294967295) & 2147483647 AS hash FROM b""",
    "keyword_topk": _KEYWORD + "SELECT * FROM keyword WHERE rank <= 10",
    "cosine_topk": "WITH " + _DENSE + " SELECT * FROM dense WHERE rank <= 10",
    "hybrid_rrf": _LISTS + ", parts AS (SELECT query_id, chunk_id, 1.0 / CAST(1 + rank AS DOUBLE) AS part FROM lists)" + _FUSED,
    "hybrid_dbsf": _LISTS
    + """, marked AS (SELECT *, avg(score) OVER w AS mu, stddev_samp(score) OVER w AS sd FROM lists WINDOW w AS (PARTITION BY list, query_id)),
parts AS (SELECT query_id, chunk_id, CASE WHEN sd > 0 THEN (score - (mu - 3 * sd)) / (6 * sd) ELSE 0.5 END AS part FROM marked)"""
    + _FUSED,
    "distinct_title": _KEYWORD
    + r""", hits AS (SELECT k.*, coalesce(source, '') AS src, regexp_replace(relative_path, '[-.][^/\\]*$', '') AS title FROM keyword k JOIN documents USING (doc_id) WHERE rank <= 160),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY item_id, src, title ORDER BY score DESC, doc_id) = 1)
SELECT * FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM best) x WHERE x.rank <= 10""",
    "collection_merge_topk": _MERGED,
    "phrase_filter": r"""
WITH p AS (SELECT DISTINCT unnest(sample_terms) AS phrase FROM subject_areas),
w AS (SELECT phrase, regexp_extract_all(lower(phrase), '[\p{L}\p{N}]+') AS ws FROM p),
parts AS (SELECT phrase, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
r AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
seen AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM r),
starts AS (SELECT doc_id, phrase, pos - i AS start, n, count(*) AS k FROM seen JOIN parts USING (word) GROUP BY ALL)
SELECT DISTINCT doc_id, phrase FROM starts WHERE k = n""",
    "phrase_locator": r"""
WITH m AS (SELECT doc_id, text, regexp_extract(text, '(?i)(^|[^\p{L}\p{N}])(kinds[^\p{L}\p{N}]+of)($|[^\p{L}\p{N}])', 2) AS hit, regexp_extract(text, '(?is)^(.*?)(^|[^\p{L}\p{N}])kinds[^\p{L}\p{N}]+of($|[^\p{L}\p{N}])', 1) AS ahead,
  regexp_extract(text, '(?is)^.*?(^|[^\p{L}\p{N}])kinds[^\p{L}\p{N}]+of($|[^\p{L}\p{N}])', 1) AS sep FROM documents
  WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])kinds[^\p{L}\p{N}]+of($|[^\p{L}\p{N}])'))
SELECT doc_id, CAST(length(ahead) + length(sep) + 1 AS INTEGER) AS position, CAST(length(hit) AS INTEGER) AS length FROM m""",
    "scope_filter": "SELECT text_id, corpus_id FROM extracted_texts t WHERE EXISTS (SELECT 1 FROM chunk_sets c WHERE c.corpus_id = t.corpus_id AND is_default AND chunk_size >= 256)",
    "path_prefix_filter": r"""
WITH p AS (SELECT file_id, list_filter(string_split(lower(replace(relative_path, '\', '/')), '/'), lambda s: s NOT IN ('', '.')) AS parts FROM source_files)
SELECT file_id, CAST(len(parts) AS INTEGER) AS depth FROM p WHERE parts[1] = 'src'""",
    "language_filter": r"""
WITH n AS (SELECT file_id, regexp_extract(replace(relative_path, '\', '/'), '[^/]*$') AS name FROM source_files),
l AS (SELECT file_id, CASE WHEN lower(name) LIKE 'dockerfile%' THEN 'dockerfile' WHEN name LIKE '.%' AND instr(name[2:], '.') = 0 THEN 'text'
  WHEN regexp_extract(lower(name), '\.([^.]*)$', 1) IN ('py', 'pyi') THEN 'python' WHEN regexp_extract(lower(name), '\.([^.]*)$', 1) = 'go' THEN 'go'
  WHEN regexp_extract(lower(name), '\.([^.]*)$', 1) IN ("""
    + ",".join(f"'{e}'" for name, es in X.LANGUAGES.items() if name != "text" for e in es)
    + """) THEN 'other' ELSE 'text' END AS language FROM n)
SELECT file_id, language FROM l WHERE language IN ('python', 'go', 'text')""",
    "symbol_index": r"""
WITH n AS (SELECT file_id, file_text, regexp_extract(replace(relative_path, '\', '/'), '[^/]*$') AS name FROM source_files),
e AS (SELECT *, CASE WHEN lower(name) LIKE 'dockerfile%' OR name LIKE '.%' AND instr(name[2:], '.') = 0 THEN '' ELSE regexp_extract(lower(name), '\.([^.]*)$', 1) END AS ext FROM n),
f AS (SELECT file_id, {names} AS names FROM e),
u AS (SELECT file_id, unnest(names) AS symbol, generate_subscripts(names, 1) AS place FROM f),
g AS (SELECT file_id, symbol, min(place) AS place FROM u WHERE symbol <> '' GROUP BY ALL)
SELECT file_id, symbol FROM g QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY place) <= 32""".replace("{names}", _symbols_sql()),
    "source_root_filter": "SELECT source_id, root_path FROM sources WHERE lower(root_path) = '/thimmorik' OR lower(root_path) LIKE '/thimmorik/%'",
    "glob_filter": rf"""
WITH p AS (SELECT file_id, lower(replace(relative_path, '\', '/')) AS p FROM source_files)
SELECT file_id FROM p WHERE CASE
  WHEN regexp_full_match(p, '(?:.*/)?generated/.*') THEN true
  WHEN regexp_full_match(p, 'vendor/quillo/.*') THEN false
  WHEN regexp_full_match(p, 'src/[^/]*/[^/]*\.cs(?:/.*)?') THEN true
  WHEN regexp_full_match(p, '(?:.*/)?[^/]*_pb2\.py(?:/.*)?') OR regexp_full_match(p, '(?:.*/)?[^/]*\.min\.js(?:/.*)?') THEN true
  WHEN regexp_full_match(p, '(?:[^/]+/)*vendor/.+') OR regexp_full_match(p, '(?:.*/)?node_modules/.*') THEN true ELSE false END""",
}
