"""Whole pipelines: a search request, and extraction of pages and transcripts."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.operators import presentation
from sparkloom.plans.search import SearchRequest, search
from sparkloom.queries import retrieval as RQ
from sparkloom.runtime import table
from sparkloom.sources import extract


def _chunks(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.lower(F.trim("lang")).alias("corpus_id"), F.lit("cs1").alias("chunk_set_id"), F.col("source").alias("source_id"),
        F.coalesce("relative_path", F.lit("")).alias("file_path"), F.coalesce("text", F.lit("")).alias("content"),
    )


def search_hybrid(spark, d):
    """One hybrid request over the English documents; vector n is paired with document n."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"))
    asked = vectors.filter("chunk_id = 7").first()
    hits, _ = search(spark, _chunks(spark, d), SearchRequest("unit test of the query planner", ["en"], vector=list(asked.dense)), vectors)
    return hits.select("rank", "chunk_id", "score")


def search_phrase(spark, d):
    """A keyword request behind an exact phrase and a path prefix."""
    request = SearchRequest("database index and memory leak", ["en"], mode="keyword", phrase="unit test", path_prefix="docs", collapse_titles=False, limit=20)
    hits, _ = search(spark, _chunks(spark, d), request)
    return hits.select("rank", "chunk_id", "score")


def html_text(spark, d):
    """The documents that are pages, as text."""
    pages = table(spark, d, "documents").filter("text like '<html>%'").select(F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), F.col("text").cast("binary").alias("content"))
    return extract.extract(pages).select("path", "text", "title", "error")


def transcript_render(spark, d):
    """Every session's records as one conversation text with sections."""
    rows = table(spark, d, "transcript_records").filter("session_id is not null and message is not null")
    line = F.to_json(F.struct(F.col("rec_type").alias("type"), F.try_parse_json("message").alias("message"), F.col("is_meta").alias("isMeta"), F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    ordered = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "record_id", line.alias("line")))).alias("lines"))
    files = ordered.select(F.concat("session_id", F.lit(".jsonl")).alias("path"), F.array_join("lines.line", "\n").cast("binary").alias("content"))
    return extract.extract(files).select("path", F.length("text").alias("chars"), F.size("units").alias("sections"))


def decode_text(spark, d):
    """Bytes of every code file, some with a byte order mark and some not UTF-8, read as UTF-8 or else Latin-1, and their hash."""
    plain = F.encode("file_text", "UTF-8")
    content = F.when(F.col("file_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(F.col("file_id") % 3 == 1, F.concat(plain, F.unhex(F.lit("E9")))).otherwise(plain)
    files = table(spark, d, "source_files").select("file_id", content.alias("content"))
    return files.select("file_id", F.length(extract.decode_text(F.col("content"))).alias("chars"), F.sha2("content", 256).alias("sha256"))


def _archive(kind: str, passage: str, label: str) -> bytes:
    """A small document of the kind that holds the label and the passage."""
    w, a, p = "http://w", "http://a", "http://p"
    first, second = escape(label), escape(passage)
    parts = {
        "docx": {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>{first}</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>{second}</w:t></w:r></w:p></w:body></w:document>'},
        "pptx": {
            "ppt/slides/slide1.xml": f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><a:p><a:r><a:t>{first}</a:t></a:r></a:p></p:sld>',
            "ppt/slides/slide2.xml": f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><a:p><a:r><a:t>{second}</a:t></a:r></a:p></p:sld>',
            "ppt/notesSlides/notesSlide2.xml": f'<p:notes xmlns:p="{p}" xmlns:a="{a}"><a:p><a:r><a:t>said aside</a:t></a:r></a:p></p:notes>',
        },
        "epub": {
            "book.opf": '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
            "a.xhtml": f"<html><body><p>{second}</p></body></html>",
            "b.xhtml": f"<html><head><title>t</title></head><body><h1>{first}</h1></body></html>",
        },
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name, text in parts[kind].items():
            archive.writestr(name, text)
    return held.getvalue()


def _pdf(passage: str, label: str) -> bytes:
    """Two pages, the second packed, with page numbers; line ends only where words end."""
    sure = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    first = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (" + sure(label) + b") Tj 0 -14 Td (1) Tj ET"
    second = zlib.compress(b"BT /F1 12 Tf 72 700 Td [(" + sure(passage) + b")] TJ T* (2) Tj ET")
    parts = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>",
        b"<< /Length %d >>\nstream\n" % len(first) + first + b"\nendstream", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(second) + second + b"\nendstream",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, part) for n, part in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def pdf_pages(spark, d):
    """Two-page PDF files made of the held-out items with ASCII passages: pages as units, without their numbers."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = [(f"{i}.pdf", _pdf(text, label)) for i, label, text in zip(*(batch.column(c).to_pylist() for c in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    passage = F.trim(F.regexp_replace("passage", r"\s+", " "))
    items = table(spark, d, "eval_items").select("item_id", F.coalesce("suite", F.lit("")), passage.alias("passage")).filter(~F.col("passage").rlike(r"[^\x20-\x7e]"))
    told = extract.extract(items.mapInArrow(run, "path string, content binary"))
    return told.select("path", "text", F.array_join(F.transform("units", lambda u: F.concat_ws("@", u["unit_label"], u["start_offset"].cast("string"))), "|").alias("units"), "error")


def _documents_of(spark, d, kinds):
    """(path, content): every held-out item as a document of each kind."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = [(f"{i}.{kind}", _archive(kind, text, label)) for i, label, text in zip(*(batch.column(c).to_pylist() for c in range(3))) for kind in kinds]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    items = table(spark, d, "eval_items").select("item_id", F.coalesce("suite", F.lit("")), F.trim(F.regexp_replace(F.coalesce("passage", F.lit("")), r"\s+", " ")))
    return items.mapInArrow(run, "path string, content binary")


def archive_texts(spark, d):
    """Word, slide and book documents made of the held-out items, as text with their units."""
    told = extract.extract(_documents_of(spark, d, ("docx", "pptx", "epub")))
    return told.select("path", "text", F.array_join(F.transform("units", lambda u: F.concat_ws("@", u["unit_label"], u["start_offset"].cast("string"))), "|").alias("units"))


def html_blocks(spark, d):
    """Pages made of the held-out items: blocks as lines, white space collapsed, scripts and styles left out, the title apart."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("passage", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>"), "suite", F.lit("</title><style>p{x:1}</style></head><body><h1>"), "suite", F.lit("</h1><script>if(a<b){c()}</script><p>\n "), escaped, F.lit("\n</p><ul><li>one<li>two</ul></body></html>"))
    pages = table(spark, d, "eval_items").select(F.concat(F.col("item_id").cast("string"), F.lit(".html")).alias("path"), F.encode(page, "UTF-8").alias("content"))
    return extract.extract(pages).select("path", "text", "title", "error")


def extraction_failures(spark, d):
    """Code files under endings that promise an archive: each fails alone, with its reason; the others are read."""
    ending = F.when(F.col("file_id") % 4 == 0, ".docx").when(F.col("file_id") % 4 == 1, ".epub").otherwise(".txt")
    files = table(spark, d, "source_files").select(F.concat(F.col("file_id").cast("string"), ending).alias("path"), F.encode("file_text", "UTF-8").alias("content"))
    return extract.extract(files).select("path", "error", F.length("text").alias("chars"))


def without_nul(spark, d):
    """Texts with a NUL put in after their third character come out without it."""
    docs = table(spark, d, "documents").filter("length(text) > 3")
    spoilt = F.concat(F.encode(F.substring("text", 1, 3), "UTF-8"), F.unhex(F.lit("00")), F.encode(F.expr("substring(text, 4)"), "UTF-8"))
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), spoilt.alias("content"))
    return extract.extract(files).select("path", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))


def sniffed_logs(spark, d):
    """Records that are told as a chat log by their content, behind a line that is none, whatever a file is called."""
    record = F.to_json(F.struct(F.col("rec_type").alias("type"), F.try_parse_json("message").alias("message")))
    rows = table(spark, d, "transcript_records").select("record_id", F.concat(F.lit("not a record\n\n"), record, F.lit("\n")).alias("text"))
    return rows.filter(extract.is_chat_log(F.col("text"))).select("record_id")


def result_windows(spark, d):
    """What is shown of each question's best document: within the budget, lines of the text, or a marked cut."""
    budget = 400
    hits = RQ.keyword_list(spark, d, 1).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").join(table(spark, d, "eval_items").select("item_id", "query_text"), "item_id")

    @F.pandas_udf("string")
    def shown(texts: pd.Series, questions: pd.Series) -> pd.Series:
        words = [frozenset(re.findall(r"[^\W_]+", q.lower())) for q in questions]
        return pd.Series([presentation.window(t, budget, w) for t, w in zip(texts, words)])

    told = hits.select("item_id", "text", shown("text", "query_text").alias("shown"))
    bare = F.regexp_replace("shown", "^…\n?|\n?…$", "")
    return told.select("item_id", (F.length(bare) <= F.greatest(F.lit(budget), F.lit(0))).alias("fits"), F.col("text").contains(bare).alias("is_part"), (F.length("text") > budget).alias("is_cut"))


QUERIES = {
    f.__name__: f
    for f in (
        search_hybrid, search_phrase, html_text, transcript_render, decode_text, archive_texts, pdf_pages, html_blocks, extraction_failures, without_nul, sniffed_logs, result_windows,
    )
}

_SCOPED = r"""scoped AS (SELECT doc_id, text, source, relative_path FROM documents WHERE lower(trim(lang)) = 'en' {condition}),
asked_text AS (SELECT 0 AS query_id, '{query}' AS query),
{doc_terms},
held AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
{query_terms},
asked AS (SELECT term, count(*) AS qtf FROM q GROUP BY ALL),
idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM scoped) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM held GROUP BY term),
scores AS (SELECT doc_id, round(sum(qtf * idf * tf), 6) AS score FROM held JOIN asked USING (term) JOIN idf USING (term) GROUP BY ALL),
keyword AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)"""


def _scoped(query: str, condition: str) -> str:
    return (
        "WITH "
        + _SCOPED.replace("{condition}", condition).replace("{query}", query)
        .replace("{doc_terms}", RQ.terms_cte("t", "scoped", "doc_id", "text")).replace("{query_terms}", RQ.terms_cte("q", "asked_text", "query_id", "query"))
    )


SQL = {
    "search_phrase": _scoped(
        "database index and memory leak",
        r"""AND list_filter(string_split(lower(replace(coalesce(relative_path, ''), '\', '/')), '/'), lambda s: s NOT IN ('', '.'))[1] = 'docs'
  AND regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])unit[^\p{L}\p{N}]+test($|[^\p{L}\p{N}])')""",
    )
    + " SELECT rank, doc_id AS chunk_id, score FROM keyword WHERE rank <= 20",
    "search_hybrid": _scoped("unit test of the query planner", "")
    + r""", v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN scoped ON doc_id = vec_id),
ds AS (SELECT vec_id, round(list_cosine_similarity(v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score FROM v),
dense AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ds),
lists AS (SELECT 1 AS list, doc_id, score FROM keyword WHERE rank <= 640 UNION ALL SELECT 2, vec_id, score FROM dense WHERE rank <= 640),
marked AS (SELECT *, avg(score) OVER (PARTITION BY list) AS mu, stddev_samp(score) OVER (PARTITION BY list) AS sd FROM lists),
fused AS (SELECT doc_id, round(sum(CASE WHEN sd > 0 THEN (score - (mu - 3 * sd)) / (6 * sd) ELSE 0.5 END), 6) AS score FROM marked GROUP BY doc_id),
top AS (SELECT * FROM fused QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 160),
best AS (SELECT doc_id, score FROM top JOIN scoped USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY coalesce(source, ''), regexp_replace(coalesce(relative_path, ''), '\.[^./\\]*$', '') ORDER BY score DESC, doc_id) = 1)
SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id AS chunk_id, score FROM best QUALIFY rank <= 10""",
    "archive_texts": """
WITH p AS (SELECT item_id, coalesce(suite, '') AS s, trim(regexp_replace(coalesce(passage, ''), '\\s+', ' ', 'g')) AS t FROM eval_items)
SELECT item_id || '.docx' AS path, s || chr(10) || t AS text, '' AS units FROM p
UNION ALL SELECT item_id || '.pptx', s || chr(10) || t || chr(10) || '[notes]' || chr(10) || 'said aside', 'slide 1@0|slide 2@' || (length(s) + 1) FROM p
UNION ALL SELECT item_id || '.epub', s || chr(10) || t, 'chapter 1@0|chapter 2@' || (length(s) + 1) FROM p""",
    "pdf_pages": """
WITH p AS (SELECT item_id, coalesce(suite, '') AS s, trim(regexp_replace(passage, '\\s+', ' ', 'g')) AS t FROM eval_items)
SELECT item_id || '.pdf' AS path, s || chr(10) || t AS text, 'page 1@0|page 2@' || (length(s) + 1) AS units, CAST(NULL AS VARCHAR) AS error FROM p WHERE NOT regexp_matches(t, '[^\\x20-\\x7e]')""",
    "html_blocks": """
SELECT item_id || '.html' AS path, suite || chr(10) || trim(regexp_replace(coalesce(passage, ''), '\\s+', ' ', 'g')) || chr(10) || 'one' || chr(10) || 'two' AS text, suite AS title, CAST(NULL AS VARCHAR) AS error FROM eval_items""",
    "extraction_failures": """
SELECT file_id || CASE file_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.epub' ELSE '.txt' END AS path, CASE WHEN file_id % 4 < 2 THEN 'unreadable: BadZipFile' END AS error,
  CAST(CASE WHEN file_id % 4 >= 2 THEN length(file_text) END AS INTEGER) AS chars FROM source_files""",
    "without_nul": "WITH b AS (SELECT doc_id, CASE WHEN starts_with(text, chr(65279)) THEN substr(text, 2) ELSE text END AS t FROM documents WHERE length(text) > 3) SELECT doc_id || '.txt' AS path, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS sha256 FROM b",
    "sniffed_logs": "SELECT record_id FROM transcript_records WHERE rec_type IN ('user', 'assistant') AND json_valid(message)",
    "result_windows": RQ._KEYWORD + "SELECT k.item_id, true AS fits, true AS is_part, length(text) > 400 AS is_cut FROM keyword k JOIN documents USING (doc_id) WHERE k.rank = 1",
    "decode_text": r"""
WITH b AS (SELECT file_id, file_text, CASE WHEN file_id % 3 = 0 THEN '\xEF\xBB\xBF'::BLOB || encode(file_text) WHEN file_id % 3 = 1 THEN encode(file_text) || '\xE9'::BLOB ELSE encode(file_text) END AS bytes FROM source_files)
SELECT file_id, CAST(CASE WHEN file_id % 3 = 1 THEN octet_length(bytes) ELSE length(file_text) END AS INTEGER) AS chars, sha256(bytes) AS sha256 FROM b""",
}
