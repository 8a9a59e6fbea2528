"""Queries of chunks in their files and of what a reader is shown. Source files in windows of twenty lines stand for chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import chunker
from sparkloom.operators import context as K
from sparkloom.queries import retrieval as RQ
from sparkloom.runtime import table


def _chunks(spark, d):
    return K.fixed_chunks(table(spark, d, "source_files").select("source_id", "file_id", "relative_path", "code_language", "file_text"), "file_id", "file_text")


def file_chunks(spark, d):
    """Every file's chunks in order."""
    return _chunks(spark, d).select("file_id", "chunk_index", "start_line", "end_line", F.length("content").alias("chars")).orderBy("file_id", "chunk_index")


def file_points(spark, d):
    return K.points_per_file(_chunks(spark, d), ["source_id", "file_id"])


def _hits(spark, d):
    chunks = _chunks(spark, d)
    return chunks, chunks.filter(F.lower("content").contains("ledger"))


def neighbour_chunks(spark, d):
    """Chunks within one of a chunk that names a ledger."""
    chunks, hits = _hits(spark, d)
    return K.with_neighbours(hits, chunks, [], ["file_id"], 1).select("file_id", "chunk_index")


def stitched_passages(spark, d):
    """Per file the hits and their neighbours as one passage."""
    chunks, hits = _hits(spark, d)
    return K.passages(K.with_neighbours(hits, chunks, [], ["file_id"], 1), [], ["file_id"])


def context_blocks(spark, d):
    """What of each question's ten best documents fits a context of 8,000 characters."""
    hits = RQ.keyword_list(spark, d, 10).join(table(spark, d, "documents").select("doc_id", F.length("text").alias("chars")), "doc_id")
    return K.spend(hits, ["item_id"], ["rank", "doc_id"], "chars").drop("rank")


def cut_lines(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.length(K.cut_to_lines(F.col("text"), 400)).alias("by_line"), F.length(K.cut_to_lines(F.col("text"), 400, False)).alias("by_word"))


def citations(spark, d):
    """Headers of code chunks and of document units."""
    none = F.lit(None)
    code = _chunks(spark, d).join(table(spark, d, "sources").select("source_id", "corpus_id", "root_path"), "source_id")
    place = K.location(F.col("relative_path"), F.col("start_line"), F.col("end_line"), none.cast("int"))
    first = code.select("file_id", F.col("chunk_index").alias("part"), K.header(place, none.cast("int"), F.col("start_line"), F.col("end_line"), F.col("corpus_id"), F.coalesce("root_path", F.lit("")), F.lit("")).alias("header"))
    units = table(spark, d, "extracted_texts").select("text_id", "corpus_id", "file_name", F.explode("units").alias("u")).select("*", "u.*")
    place = K.location(F.col("file_name"), none.cast("int"), none.cast("int"), F.col("unit_no"))
    second = units.select(F.col("text_id").alias("file_id"), F.col("unit_no").alias("part"), K.header(place, F.col("unit_no"), none.cast("int"), none.cast("int"), F.col("corpus_id"), F.lit(""), F.coalesce("unit_label", F.lit(""))).alias("header"))
    return first.unionByName(second)


def heading_trail(spark, d):
    return K.heading_trails(table(spark, d, "documents"), "doc_id", "text")


def halved_chunks(spark, d):
    first, second = K.halves(F.col("content"))
    return _chunks(spark, d).filter(F.length("content") > 600).select("file_id", "chunk_index", F.length(first).alias("first_chars"), F.length(second).alias("second_chars"))


def text_overlaps(spark, d):
    """What neighbouring pieces of a text, cut every 120 characters with 40 said again, are found to share."""
    texts = table(spark, d, "extracted_texts").filter("length(body) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.length("body"), F.lit(1)), F.lit(120))
    pieces = texts.select("text_id", "body", F.posexplode(starts).alias("piece_no", "start"))
    at = lambda start: F.substring("body", start, F.lit(160))
    pairs = pieces.filter("piece_no > 0").select("text_id", "piece_no", at(F.col("start") - 120).alias("a"), at(F.col("start")).alias("b"))
    return pairs.select("text_id", "piece_no", K.shared_ends(F.col("a"), F.col("b")).alias("shared"))


def chunk_coherence(spark, d):
    """Per language: chunks, and the shares that begin at a boundary line, hold one, or hold none."""
    first = F.element_at(F.split("content", "\n", -1), 1)
    begins, holds = F.lit(False), F.lit(False)
    for language, pattern in chunker.BOUNDARIES.items():
        begins = F.when(F.col("code_language") == language, first.rlike(pattern)).otherwise(begins)
        holds = F.when(F.col("code_language") == language, F.col("content").rlike("(?m)" + pattern)).otherwise(holds)
    told = _chunks(spark, d).select("code_language", begins.cast("double").alias("b"), holds.cast("double").alias("h"), F.length("content").alias("n"))
    return told.groupBy("code_language").agg(
        F.count("*").alias("chunks"), F.round(F.avg("b"), 6).alias("begin_at_boundary"), F.round(F.avg("h"), 6).alias("hold_boundary"), F.round(F.avg("n"), 3).alias("mean_chars")
    )


def chunk_cover(spark, d):
    """Per file, from the chunker: first and last line, lines that no chunk covers, and chunks over the budget that are not one long line."""
    size = 96
    chunks = chunker.chunk_texts(table(spark, d, "source_files"), "file_id", "file_text", "code_language", size, 12)
    order = Window.partitionBy("key").orderBy("chunk_index")
    through = F.coalesce(F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = chunks.withColumn("_gap", F.greatest(F.col("start_line") - through - 1, F.lit(0)))
    over = (F.length("content") > size * 4) & (F.col("start_line") < F.col("end_line"))
    return told.groupBy(F.col("key").cast("long").alias("file_id")).agg(F.min("start_line").alias("first_line"), F.sum("_gap").alias("uncovered"), F.count_if(over).alias("over_budget"))


def media_types(spark, d):
    files = table(spark, d, "source_files").select("file_id", X.language_of(F.col("relative_path")).alias("language"))
    return files.select("file_id", X.media_type(F.col("language")).alias("media_type"))


def boundary_lines(spark, d):
    """Boundary and blank lines of every file, by its language."""
    lines = F.split(F.regexp_replace("file_text", "\r\n?", "\n"), "\n", -1)
    files = table(spark, d, "source_files").select("file_id", F.coalesce("code_language", F.lit("")).alias("language"), F.explode(lines).alias("line"))
    found = F.col("line").rlike(chunker.BLANK)
    for language, pattern in chunker.BOUNDARIES.items():
        found = F.when(F.col("language") == language, F.col("line").rlike(pattern)).otherwise(found)
    return files.groupBy("file_id").agg(F.count_if(found).alias("boundaries"), F.count_if(F.col("line").rlike(chunker.BLANK)).alias("blank"))


_CH = r"""
f AS (SELECT source_id, file_id, relative_path, code_language, string_split(regexp_replace(file_text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM source_files WHERE length(file_text) > 0),
i AS (SELECT *, unnest(range(greatest(1, CAST(ceil((len(lines) - 4) / 16.0) AS BIGINT)))) AS i FROM f),
chunks AS (SELECT source_id, file_id, relative_path, code_language, CAST(i AS INTEGER) AS chunk_index, CAST(i * 16 + 1 AS INTEGER) AS start_line,
  CAST(least(i * 16 + 20, len(lines)) AS INTEGER) AS end_line, array_to_string(lines[i * 16 + 1 : i * 16 + 20], chr(10)) AS content FROM i)"""
_NEAR = (
    "WITH "
    + _CH
    + """, hits AS (SELECT file_id, chunk_index FROM chunks WHERE contains(lower(content), 'ledger')),
near AS (SELECT DISTINCT c.* FROM chunks c JOIN hits h ON c.file_id = h.file_id AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1)"""
)


def _by_language(expression: str, otherwise: str) -> str:
    whens = " ".join(f"WHEN '{name}' THEN " + expression.replace("{p}", pattern.replace("'", "''")) for name, pattern in chunker.BOUNDARIES.items())
    return f"CASE code_language {whens} ELSE {otherwise} END"


QUERIES = {
    f.__name__: f
    for f in (
        file_chunks, file_points, neighbour_chunks, stitched_passages, context_blocks, cut_lines, citations, heading_trail, halved_chunks, text_overlaps, chunk_coherence,
        chunk_cover, media_types, boundary_lines,
    )
}

SQL = {
    "file_chunks": "WITH " + _CH + " SELECT file_id, chunk_index, start_line, end_line, CAST(length(content) AS INTEGER) AS chars FROM chunks",
    "file_points": "WITH " + _CH + " SELECT source_id, file_id, count(*) AS points FROM chunks GROUP BY ALL",
    "neighbour_chunks": _NEAR + " SELECT file_id, chunk_index FROM near",
    "stitched_passages": _NEAR
    + """, t AS (SELECT *, coalesce(max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS through FROM near),
s AS (SELECT *, CASE WHEN through > 0 AND start_line > through + 1 THEN 1 ELSE 0 END AS gap, string_split(content, chr(10))[greatest(through - start_line + 1, 0) + 1 :] AS shown FROM t WHERE end_line > through)
SELECT file_id, min(start_line) AS start_line, max(end_line) AS end_line, CAST(sum(gap) AS BIGINT) AS gaps,
  string_agg(CASE WHEN gap = 1 THEN '… lines ' || (through + 1) || '-' || (start_line - 1) || ' not indexed …' || chr(10) ELSE '' END || array_to_string(shown, chr(10)), chr(10) ORDER BY start_line, chunk_index) AS text
FROM s GROUP BY file_id""",
    "context_blocks": RQ._KEYWORD.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, c AS (SELECT k.item_id, k.doc_id, k.rank, CAST(length(text) AS INTEGER) AS chars FROM keyword k JOIN documents USING (doc_id) WHERE k.rank <= 10),
step AS (
  SELECT item_id, CAST(0 AS INTEGER) AS rank, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS INTEGER) AS chars, 8000 AS left_over, false AS cut, '' AS decision, CAST(0 AS INTEGER) AS shown FROM (SELECT DISTINCT item_id FROM c)
  UNION ALL
  SELECT c.item_id, c.rank, c.doc_id, c.chars,
    CASE WHEN c.chars + 80 <= s.left_over THEN s.left_over - c.chars - 80 WHEN NOT s.cut AND s.left_over - 144 >= 300 THEN 0 ELSE s.left_over END,
    s.cut OR (c.chars + 80 > s.left_over AND s.left_over - 144 >= 300),
    CASE WHEN c.chars + 80 <= s.left_over THEN 'used' WHEN NOT s.cut AND s.left_over - 144 >= 300 THEN 'partial' ELSE 'dropped' END,
    CAST(CASE WHEN c.chars + 80 <= s.left_over THEN c.chars WHEN NOT s.cut AND s.left_over - 144 >= 300 THEN s.left_over - 144 ELSE 0 END AS INTEGER)
  FROM step s JOIN c ON c.item_id = s.item_id AND c.rank = s.rank + 1)
SELECT item_id, doc_id, chars, decision, shown FROM step WHERE rank > 0""",
    "cut_lines": r"""
WITH h AS (SELECT doc_id, text, length(text) AS n, least(400, length(text) - 1) AS top FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, length(regexp_extract(substr(text, 1, top + 1), '(?s)^.*\n')) - 1 AS line, length(regexp_extract(substr(text, 1, top + 1), '(?s)^.* ')) - 1 AS word FROM h)
SELECT doc_id, CAST(CASE WHEN n <= 400 THEN n WHEN line > 0 THEN line ELSE 0 END AS INTEGER) AS by_line,
  CAST(CASE WHEN n <= 400 THEN n WHEN line < top // 2 AND word > line THEN word WHEN line > 0 THEN line ELSE 0 END AS INTEGER) AS by_word FROM p""",
    "citations": "WITH "
    + _CH
    + r""" SELECT file_id, chunk_index AS part, relative_path || ':' || start_line || CASE WHEN start_line = end_line THEN '' ELSE '-' || end_line END || ' (corpus: ' || corpus_id
  || CASE WHEN length(coalesce(root_path, '')) > 0 THEN ' · in ' || root_path ELSE '' END || ')' AS header FROM chunks JOIN sources USING (source_id)
UNION ALL SELECT text_id, u.unit_no, file_name || '#' || CASE WHEN lower(file_name) LIKE '%.epub' THEN 'chapter' WHEN lower(file_name) LIKE '%.pptx' OR lower(file_name) LIKE '%.ppt' THEN 'slide' ELSE 'page' END
  || '=' || u.unit_no || ' (corpus: ' || corpus_id || ')' || CASE WHEN length(coalesce(u.unit_label, '')) > 0 THEN ' · ' || u.unit_label ELSE '' END
FROM (SELECT text_id, file_name, corpus_id, unnest(units) AS u FROM extracted_texts)""",
    "heading_trail": r"""
WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE length(text) > 0),
r AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM l),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^ {0,3}(```|~~~)') THEN 1 ELSE 0 END AS fence FROM r WHERE regexp_matches(line, '^ {0,3}(```|~~~)|^ {0,3}#{1,6}[ \t]+')),
o AS (SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 AS inside FROM m),
h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^ {0,3}(#{1,6})', 1)) AS level,
  regexp_replace(regexp_extract(line, '^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*$', 1), '[ \t]+#+$', '') AS name FROM o WHERE fence = 0 AND inside = 0),
-- the headings above one are those before it that no heading of a lower or the same level follows
a AS (SELECT x.doc_id, x.line_no, x.level, y.line_no AS spot, y.name FROM h x JOIN h y ON x.doc_id = y.doc_id AND y.line_no <= x.line_no AND (y.level < x.level OR y.line_no = x.line_no)
  WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.doc_id = x.doc_id AND z.line_no > y.line_no AND z.line_no <= x.line_no AND z.level <= y.level))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(level AS INTEGER) AS level, string_agg(name, ' > ' ORDER BY spot) AS trail FROM a GROUP BY doc_id, line_no, level""",
    "halved_chunks": "WITH "
    + _CH
    + r""", m AS (SELECT *, length(content) // 2 AS mid FROM chunks WHERE length(content) > 600),
p AS (SELECT *, length(regexp_extract(substr(content, 1, mid), '(?s)^.+\n')) - 1 AS line, length(regexp_extract(substr(content, 1, mid), '(?s)^.+ ')) - 1 AS word FROM m),
a AS (SELECT *, CASE WHEN line > 0 THEN line WHEN word > 0 THEN word ELSE mid END AS spot FROM p)
SELECT file_id, chunk_index, CAST(length(regexp_replace(substr(content, 1, spot), '\n+$', '')) AS INTEGER) AS first_chars, CAST(length(regexp_replace(substr(content, spot + 1), '^\n+', '')) AS INTEGER) AS second_chars FROM a""",
    "text_overlaps": """
WITH s AS (SELECT text_id, body, unnest(range(1, length(body) + 1, 120)) AS start FROM extracted_texts WHERE length(body) > 0),
p AS (SELECT text_id, CAST((start - 1) // 120 AS INTEGER) AS piece_no, substr(body, start - 120, 160) AS a, substr(body, start, 160) AS b FROM s WHERE start > 1)
SELECT text_id, piece_no, CAST(coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda n: substr(a, length(a) - n + 1, n) = substr(b, 1, n))), 0) AS INTEGER) AS shared FROM p""",
    "chunk_coherence": "WITH "
    + _CH
    + f", t AS (SELECT code_language, {_by_language(chr(39).join(['regexp_matches(string_split(content, chr(10))[1], ', '{p}', ')']), 'false')} AS b, {_by_language(chr(39).join(['regexp_matches(content, ', '(?m){p}', ')']), 'false')} AS h, length(content) AS n FROM chunks)"
    + " SELECT code_language, count(*) AS chunks, round(avg(CAST(b AS DOUBLE)), 6) AS begin_at_boundary, round(avg(CAST(h AS DOUBLE)), 6) AS hold_boundary, round(avg(n), 3) AS mean_chars FROM t GROUP BY code_language",
    "chunk_cover": r"""
WITH f AS (SELECT file_id, string_split(regexp_replace(file_text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM source_files WHERE length(file_text) > 0)
SELECT file_id, CAST(1 AS INTEGER) AS first_line, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS over_budget FROM f WHERE length(trim(array_to_string(lines, ' '))) > 0""",
    "boundary_lines": r"WITH f AS (SELECT file_id, coalesce(code_language, '') AS code_language, unnest(string_split(regexp_replace(file_text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM source_files)"
    + f" SELECT file_id, count(*) FILTER (WHERE {_by_language(chr(39).join(['regexp_matches(line, ', '{p}', ')']), chr(39).join(['regexp_matches(line, ', chr(94) + chr(92) + 's*$', ')']))}) AS boundaries, count(*) FILTER (WHERE regexp_matches(line, '^\\s*$')) AS blank FROM f GROUP BY file_id",
    "media_types": RQ.SQL["language_filter"].replace("SELECT file_id, language FROM l WHERE language IN ('python', 'go', 'text')", "SELECT 1").split("l AS (")[0].rstrip().rstrip(",")
    + ", e AS (SELECT file_id, name, CASE WHEN lower(name) LIKE 'dockerfile%' OR name LIKE '.%' AND instr(name[2:], '.') = 0 THEN '' ELSE regexp_extract(lower(name), '\\.([^.]*)$', 1) END AS ext FROM n)"
    + " SELECT file_id, CASE "
    + " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in X.LANGUAGES[language])}) THEN '{kind}'" for language, kind in X.MEDIA_TYPES.items())
    + " ELSE 'text/plain' END AS media_type FROM e",
}
