"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.llm import conversations as conv
from sparkloom.llm import encode as enc
from sparkloom.llm import credentials, handwritten, leakage, markup, splitting, subjects
from sparkloom.runtime import broadcast_if_small, table


def p1_found(spark, d):
    return conv.conversations(table(spark, d, "transcript_records"), with_text=False).select("session_id", "turn_no", "record_id")


def p1_reply_trees(spark, d):
    """Per kept session: its messages, its trees and the size of the largest."""
    turns = conv.conversations(table(spark, d, "transcript_records"), with_text=False)
    trees = turns.groupBy("session_id", "tree_root").agg(F.count("*").alias("n"))
    return trees.groupBy("session_id").agg(F.sum("n").alias("messages"), F.count("*").alias("trees"), F.max("n").alias("largest_tree"))


def p3_found(spark, d):
    told = handwritten.classify(table(spark, d, "source_files"), table(spark, d, "sources"))
    return told.filter("is_produced").select("file_id")


def p3_evidence(spark, d):
    """Files by what marks them, beside what the sources' own globs say."""
    told = handwritten.classify(table(spark, d, "source_files"), table(spark, d, "sources"))
    by = F.when(F.size("marks") > 0, F.array_join("marks", "+")).when(F.col("pattern").isNotNull(), "path").when(F.col("is_produced"), "copy").otherwise("none")
    return told.groupBy(by.alias("evidence"), "declared").agg(F.count("*").alias("files"))


def p4_found(spark, d):
    return splitting.oversized_items(table(spark, d, "extracted_texts"), table(spark, d, "chunk_sets"))


def p4_pieces(spark, d):
    """Per set: the items split, the characters their pieces cover, each once, and the pieces that break the limit or the overlap."""
    sets = splitting.effective_sets(table(spark, d, "chunk_sets"))
    pieces = splitting.split_texts(table(spark, d, "extracted_texts"), table(spark, d, "chunk_sets"))
    chars = lambda name: F.floor(F.col(name) * F.col("chars_per_token") + F.lit(1e-9))
    # each piece beside the one before it in its item: a shuffle by item, of offsets alone
    order = Window.partitionBy("chunk_set_id", "text_id", "unit_no").orderBy("piece_no")
    pieces = pieces.withColumn("before", F.lag("end_offset").over(order))
    limit, overlap = chars("chunk_size"), F.least(chars("chunk_overlap"), chars("chunk_size") - 1)
    return (
        pieces.join(broadcast_if_small(sets, splitting.MAX_BROADCAST_SETS), "chunk_set_id")
        .groupBy("chunk_set_id")
        .agg(
            F.count_if(F.col("piece_no") == 1).alias("items"),
            F.sum(F.col("end_offset") - F.coalesce("before", "start_offset")).cast("long").alias("covered"),
            F.count_if(F.col("end_offset") - F.col("start_offset") > limit).alias("too_long"),
            F.count_if(F.col("before") - F.col("start_offset") != overlap).alias("wrong_overlap"),
        )
    )


def _texts_with_code(spark, d):
    return [table(spark, d, name) for name in ("source_files", "git_documents", "extracted_texts")]


def p5_found(spark, d):
    """Lines, each once, on which a credential begins."""
    return credentials.places(*_texts_with_code(spark, d)).select("record_table", "record_id", "line_no").distinct()


def p5_masked(spark, d):
    return credentials.redact(*_texts_with_code(spark, d))


def p6_found(spark, d):
    return markup.markup_kinds(table(spark, d, "extracted_texts"))


def p6_clean(spark, d):
    """Every text without its markup, sections moved along."""
    told = markup.clean_texts(table(spark, d, "extracted_texts"))
    return told.select("text_id", F.array_join("markup", ",").alias("markup"), "clean_body", F.size("sections").alias("sections"), F.size("structure").alias("parts"))


def p7_ids(spark, d):
    return enc.encode(table(spark, d, "documents"))


def p8_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leaks_by_suite(spark, d):
    """Per suite: items leaked and documents that leak them."""
    items = table(spark, d, "eval_items")
    found = leakage.leaks(table(spark, d, "documents"), items)
    per_item = found.groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(per_item, "item_id").groupBy("suite").agg(F.count("*").alias("items_leaked"), F.sum("n").alias("documents"))


def p9_found(spark, d):
    shares = subjects.subject_shares(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))
    return shares.select("doc_id", "subject")


def p9_composition(spark, d):
    """The corpus by subject: documents, and documents of that subject alone."""
    shares = subjects.subject_shares(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))
    each = shares.groupBy("doc_id").agg(F.collect_list("subject").alias("all"))
    return each.select(F.explode("all").alias("subject"), (F.size("all") == 1).alias("alone")).groupBy("subject").agg(
        F.count("*").alias("documents"), F.count_if("alone").alias("alone")
    )


_P1_SQL = r"""
WITH best AS (
  SELECT * FROM transcript_records WHERE session_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_id, line_no ORDER BY record_id DESC) = 1),
shaped AS (
  SELECT session_id, line_no, record_id, coalesce(is_meta, false) AS is_meta, json_valid(message) AS readable,
         lower(coalesce(rec_type, CASE WHEN json_valid(message) THEN message ->> '$.role' END)) AS who,
         CASE WHEN NOT json_valid(message) THEN NULL
              WHEN json_type(message, '$.content') = 'VARCHAR' THEN message ->> '$.content'
              WHEN json_type(message, '$.content') = 'ARRAY' THEN array_to_string(list_transform(list_filter(
                   from_json(json_extract(message, '$.content'), '[{"type":"VARCHAR","text":"VARCHAR"}]'),
                   lambda b: b.type = 'text' AND b.text IS NOT NULL), lambda b: b.text), chr(10)) END AS said
  FROM best),
lines AS (
  SELECT *, CASE WHEN who IN ('user', 'human') THEN 'user' WHEN who IN ('assistant', 'ai', 'model') THEN 'assistant' END AS speaker,
         regexp_replace(regexp_replace(regexp_replace(said, '<system-reminder>.*?</system-reminder>', '', 'gs'),
           '<local-command-stdout>.*?</local-command-stdout>', '', 'gs'), '<ide_selection>.*?</ide_selection>', '', 'gs') AS text
  FROM shaped),
marked AS (
  SELECT *, speaker IS NOT NULL AND NOT coalesce(readable, false) AS broken,
         speaker IS NOT NULL AND NOT is_meta AND coalesce(regexp_matches(text, '\S'), false) AS is_message FROM lines),
sound AS (
  SELECT session_id FROM marked GROUP BY session_id
  HAVING count(*) = max(line_no) AND min(line_no) = 1 AND NOT bool_or(broken)
     AND arg_min(speaker, line_no) FILTER (WHERE is_message) = 'user' AND arg_max(speaker, line_no) FILTER (WHERE is_message) = 'assistant')
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS INTEGER) AS turn_no, record_id
FROM marked JOIN sound USING (session_id) WHERE is_message"""

_P4_SQL = r"""
WITH base AS (SELECT * FROM chunk_sets WHERE is_default),
sets AS (
  SELECT s.chunk_set_id, s.corpus_id, coalesce(s.chunk_size, b.chunk_size, 256) * s.chars_per_token AS most, s.unit_aware
  FROM chunk_sets s LEFT JOIN base b USING (corpus_id)),
marks AS (
  SELECT text_id, unnest(units).unit_no AS unit_no, unnest(units).start_offset AS start_offset FROM extracted_texts WHERE length(body) > 0),
units AS (
  SELECT text_id, unit_no, start_offset AS lo,
         lead(start_offset) OVER (PARTITION BY text_id ORDER BY start_offset, unit_no) AS hi FROM marks),
items AS (
  SELECT text_id, corpus_id, false AS by_unit, 0 AS unit_no, length(body) AS n FROM extracted_texts
  UNION ALL SELECT t.text_id, corpus_id, true, 0, coalesce(min(u.lo), length(any_value(body)))
    FROM extracted_texts t LEFT JOIN units u USING (text_id) GROUP BY t.text_id, corpus_id
  UNION ALL SELECT text_id, corpus_id, true, unit_no, coalesce(hi, length(body)) - lo FROM extracted_texts JOIN units USING (text_id))
SELECT chunk_set_id, text_id, unit_no FROM items JOIN sets ON sets.corpus_id = items.corpus_id AND sets.unit_aware = items.by_unit
WHERE n > most"""

_P4_PIECES = _P4_SQL.replace("SELECT chunk_set_id, text_id, unit_no FROM items", "SELECT chunk_set_id, count(*) AS items, CAST(sum(n) AS BIGINT) AS covered, 0::BIGINT AS too_long, 0::BIGINT AS wrong_overlap FROM items") + " GROUP BY chunk_set_id"

QUERIES = {
    "p1_found": p1_found,
    "p1_reply_trees": p1_reply_trees,
    "p3_found": p3_found,
    "p3_evidence": p3_evidence,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_masked": p5_masked,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_leaks_by_suite": p8_leaks_by_suite,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

SQL = {"p1_found": _P1_SQL, "p4_found": _P4_SQL, "p4_pieces": _P4_PIECES}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
