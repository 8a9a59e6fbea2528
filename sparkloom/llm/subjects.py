"""Subject areas of documents by label propagation.

The graph joins documents through the informative terms their sentences share. It is kept in its factored form, sentence
to term and term to sentence: two sentences are as alike as the terms between them weigh, and no pair is ever written
out, however many documents share a term. An edge is verified: a term joins sentences only while its labels are
concentrated on one subject and it stands in ``MIN_TERM_DOCUMENTS`` documents or more.

Seeds are the hand labels of documents and the sample terms of subjects. A hand label is trusted unless the document's own
verified edges contradict it. Each round is two DataFrame joins:

* a sentence takes the subjects of its terms (edges joined with the terms' labels, summed by sentence); a sentence of a
  trusted document is clamped to the document's labels;
* a term takes the subjects of its sentences (edges back from the sentences, summed by term).

Rounds go on until hardly a term changes sides. Then sentences vote within paragraphs and a document keeps every subject
that at least a fifth of it is about; trusted documents keep their labels as they are. Program code and commits count
as software beside the subjects of their prose.

The graph is written once, partitioned by row, so that sums by sentence, paragraph and document need no shuffle; only
partial sums by term travel. The vocabulary comes from a bounded number of labelled documents and does not grow between
rounds: terms learned from reached documents gave subjects to documents of filler alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.runtime import broadcast_if_small, cut_by_key, cut_lineage

#: Rounds go on until the terms whose leading subject changed hold at most this share of all edges; MAX_ROUNDS only guards against a flip-flop.
SETTLED = 0.001
MAX_ROUNDS = 20
#: Labelled documents from which the vocabulary is taken at most; more are thinned by a hash of doc_id.
MAX_SEED_DOCUMENTS = 20_000
MIN_TERM_DOCUMENTS = 3
CONCENTRATION = 0.5
#: What a term is taken to hold of a subject it never meets, in documents or sentences.
NONE = 0.02
SURE = 0.6
#: A label is trusted while its subject has the first share by the document's own edges, and no other one more than the second; only sentences this sure speak against a label.
TRUSTED_LEAST, TRUSTED_OTHER, TRUST_SURE = 0.08, 0.33, 0.98
#: A fifth, less what filler sentences take: they are counted in but belong to no subject of their own.
SHARE = 0.165
CODE_SHARE = 0.2
CODE_SUBJECT = "software"
MAX_BROADCAST_LABELS = 1_000_000
MAX_BROADCAST_TERMS = 2_000_000

_CODE_LINE = re.compile(
    r"[{};]\s*$|^\s*(?:def|class|import|from|return|if|for|func|var|const|let|export|public|private|package|using|namespace|elif|else|continue|raise|try|\}|\)|#include|diff --git|index [0-9a-f]{6,}|--- |\+\+\+ |@@ |[+-]\s{2,})|=>|:=|\)\s*:\s*$|^\s*[\w.]+\(.*\)\s*$|^\s*[\w.\[\]']+ \+?= "
)
_COMMIT = re.compile(r"\s*commit [0-9a-f]{40}\b")
_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]*>")
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_FULL = re.compile(r"[.!?][\"”)*_]*$")
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str) -> tuple[list[tuple[int, str, int]], bool]:
    """((paragraph, sentence, weight)…, is_code): prose sentences weigh 1, titles and scraps 0."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _TAG.sub("\n\n", text)
    found, code, whole = [], 0, 0
    for number, paragraph in enumerate(_PARAGRAPH.split(text)):
        prose = []
        for line in paragraph.split("\n"):
            bare = line.strip()
            whole += len(bare)
            if bare and not bare.startswith('{"') and _CODE_LINE.search(line):
                code += len(bare)
            else:
                prose.append(bare)
        for sentence in _SENTENCE.split(" ".join(prose)):
            if sentence:
                found.append((number, sentence, int(bool(_FULL.search(sentence)) and sentence.count(" ") > 2)))
    return found, bool(_COMMIT.match(text)) or code >= CODE_SHARE * max(whole, 1)


def terms(sentence: str) -> list[str]:
    """Lower-case words and pairs of words."""
    words = _WORD.findall(sentence.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _seed_terms(documents: DataFrame, labels: DataFrame, places: dict[str, int]) -> DataFrame:
    """(term, n, v0…): documents with the term, and their labels, shared equally among a document's subjects."""
    width = len(places)
    schema = pa.schema([("term", pa.string()), ("n", pa.float64()), *((f"v{i}", pa.float64()) for i in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[float]] = defaultdict(lambda: [0.0] * (width + 1))
        for batch in batches:
            for text, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [places[s] for s in names]
                here = set()
                for _, sentence, _ in sentences(text)[0]:
                    here.update(terms(sentence))
                for term in here:
                    row = sums[term]
                    row[width] += 1
                    for i in own:
                        row[i] += 1 / len(own)
        rows = list(sums.items())
        for start in range(0, len(rows), 50_000):
            part = rows[start : start + 50_000]
            columns = [pa.array([t for t, _ in part]), pa.array([v[width] for _, v in part], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([v[i] for _, v in part], pa.float64()) for i in range(width)], schema=schema)

    seeded = documents.select("doc_id", "text").filter("length(text) > 0").join(labels, "doc_id").select("text", "subjects")
    counted = seeded.mapInArrow(run, "term string, n double, " + ", ".join(f"v{i} double" for i in range(width)))
    return counted.groupBy("term").agg(F.sum("n").alias("n"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(width)))


def _labels(sums: DataFrame, width: int) -> DataFrame:
    """(term, n, side, a0…) of the terms that may join sentences, from (term, n, v0…): log affinities, and the leading subject."""
    sides = ", ".join(f"v{i}" for i in range(width))
    led = sums.selectExpr("*", f"array_max(array({sides})) AS top", f"({' + '.join(f'v{i}' for i in range(width))} + {NONE * width}) / {width} AS mean")
    led = led.filter(f"n >= {MIN_TERM_DOCUMENTS} AND top >= {CONCENTRATION} * n AND top > 0")
    return led.selectExpr("term", "n", f"cast(array_position(array({sides}), top) - 1 AS int) AS side", *(f"ln((v{i} + {NONE}) / mean) AS a{i}" for i in range(width)))


def _graph(documents: DataFrame, vocabulary: list[str], labels: DataFrame) -> DataFrame:
    """One row per document: uid, doc_id, is_code, labels, and its sentences with paragraph, weight and the terms they are joined by."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)
    sentence = pa.struct([("p", pa.int32()), ("w", pa.int32()), ("t", pa.list_(pa.int32()))])
    schema = pa.schema([("doc_id", pa.int64()), ("is_code", pa.bool_()), ("sents", pa.list_(sentence))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(sent.value)}
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                codes, paras, weights, edges = [], [], [], []
                by_doc, by_sentence = [0], [0]
                for text in part.column(1).to_pylist():
                    found, is_code = sentences(text)
                    for para, sentence_text, weight in found:
                        words = _WORD.findall(sentence_text.lower())
                        known, covered = set(), set()
                        for at, (a, b) in enumerate(zip(words, words[1:])):
                            pair = number.get(f"{a} {b}")
                            if pair is not None:
                                known.add(pair)
                                covered.update((at, at + 1))
                        known.update(number[w] for at, w in enumerate(words) if at not in covered and w in number)
                        paras.append(para)
                        weights.append(weight)
                        edges += sorted(known)
                        by_sentence.append(len(edges))
                    by_doc.append(len(paras))
                    codes.append(is_code)
                ints = lambda x: pa.array(x, pa.int32())
                inner = pa.StructArray.from_arrays([ints(paras), ints(weights), pa.ListArray.from_arrays(ints(by_sentence), ints(edges))], fields=list(sentence))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.bool_()), pa.ListArray.from_arrays(ints(by_doc), inner)], schema=schema)

    rows = documents.select("doc_id", "text").filter("length(text) > 0 and doc_id is not null")
    parsed = rows.mapInArrow(run, "doc_id long, is_code boolean, sents array<struct<p:int,w:int,t:array<int>>>")
    return cut_by_key(parsed.join(labels, "doc_id", "left").withColumn("uid", F.monotonically_increasing_id()), "uid")


def _scored(graph: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """``graph`` with ``told``, (sno, a) of each sentence with a verified edge: the sum of its terms' labels.

    Edges meet the terms' labels in a join; the sums by sentence and by row need no shuffle, as the graph is partitioned by row.
    """
    edges = graph.selectExpr("uid", "posexplode(sents) AS (sno, s)").selectExpr("uid", "sno", "explode(s.t) AS term")
    sides = [f"a{i}" for i in range(width)]
    joined = edges.join(broadcast_if_small(labels.select("term", *sides), MAX_BROADCAST_TERMS), "term")
    sums = joined.groupBy("uid", "sno").agg(*(F.sum(x).alias(x) for x in sides))
    told = sums.groupBy("uid").agg(F.collect_list(F.struct("sno", F.array(*sides).alias("a"))).alias("told"))
    return graph.join(told, "uid", "left")


class _Sentences:
    """The sentences of a batch of scored rows (sents, trusted, told) as arrays."""

    def __init__(self, sents: pa.ListArray, trusted: pa.ListArray, told: pa.ListArray, width: int):
        self.per_doc = np.asarray(sents.value_lengths().fill_null(0))
        flat = sents.flatten()
        self.paras, self.weights = np.asarray(flat.field("p")), np.asarray(flat.field("w"))
        terms = flat.field("t")
        self.degrees, self.terms = np.asarray(terms.value_lengths().fill_null(0)), np.asarray(terms.flatten())
        self.doc = np.repeat(np.arange(len(sents)), self.per_doc)
        starts = np.cumsum(self.per_doc) - self.per_doc
        scores = np.zeros((len(self.paras), width))
        has = np.zeros(len(self.paras), bool)
        found = told.flatten()
        if len(found):
            at = np.repeat(starts, np.asarray(told.value_lengths().fill_null(0))) + np.asarray(found.field("sno"))
            scores[at] = np.asarray(found.field("a").flatten()).reshape(-1, width)
            has[at] = True
        closed = np.zeros((len(sents), width), bool)
        for row, own in enumerate(trusted.to_pylist()):
            if own:
                closed[row] = True
                closed[row, own] = False
        scores[closed[self.doc]] = -np.inf
        shares = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-1e300)) * has[:, None]
        whole = shares.sum(axis=1, keepdims=True)
        #: A distribution over subjects for each sentence; all 0 where it has no verified edge.
        self.told = np.divide(shares, whole, out=np.zeros_like(shares), where=whole > 0)


def _moved(scored: DataFrame, size: int, width: int) -> DataFrame:
    """(term, n, v0…): the subjects of the sentences that each term joins, summed within the partition, then by term."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.float64()), *((f"v{i}", pa.float64()) for i in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((size, width)), np.zeros(size)
        for batch in batches:
            rows = _Sentences(*batch.columns, width)
            if not len(rows.terms):
                continue
            by_edge = np.repeat(rows.told, rows.degrees, axis=0)
            for i in range(width):
                sums[:, i] += np.bincount(rows.terms, by_edge[:, i], size)
            counts += np.bincount(rows.terms, minlength=size)
        at = np.nonzero(counts)[0]
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])] + [pa.array(sums[part, i]) for i in range(width)], schema=schema)

    kinds = "term int, n double, " + ", ".join(f"v{i} double" for i in range(width))
    found = scored.select("sents", "trusted", "told").mapInArrow(run, kinds)
    return found.groupBy("term").agg(F.sum("n").alias("n"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(width)))


def _settled(graph: DataFrame, labels: DataFrame, fixed: DataFrame, size: int, width: int) -> DataFrame:
    """The terms' labels after as many rounds as it takes until hardly a term changes sides; ``fixed`` terms keep theirs."""
    for _ in range(MAX_ROUNDS):
        moved = _labels(_moved(_scored(graph, labels, width), size, width), width)
        # a table of at most the vocabulary, which the seeds bound
        moved = cut_lineage(moved.join(F.broadcast(fixed.select("term")), "term", "left_anti").unionByName(fixed))
        both = moved.join(labels.select("term", F.col("side").alias("was")), "term", "left")
        changed = both.agg(F.sum(F.when(~F.col("was").eqNullSafe(F.col("side")), F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("n")).first()
        labels = moved
        if (changed.c or 0) <= SETTLED * max(changed.n or 0, 1):
            break
    return labels


def _shares(graph: DataFrame, labels: DataFrame, width: int, rest: list[str], least: float = SURE) -> DataFrame:
    """(rest…, shares): sentences vote within paragraphs, paragraphs within the document."""
    kinds = [f for f in graph.schema.fields if f.name in rest]
    out = T.StructType([*kinds, T.StructField("shares", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Sentences(*batch.columns[:3], width)
            result = np.zeros((batch.num_rows, width))
            if len(rows.paras):
                best = rows.told.argmax(axis=1)
                sure = rows.told[np.arange(len(best)), best] > least
                _, para = np.unique(rows.doc.astype(np.int64) << 32 | rows.paras, return_inverse=True)
                owner = np.zeros(para.max() + 1, np.int64)
                owner[para] = rows.doc
                votes = np.zeros((len(owner), width))
                np.add.at(votes, (para[sure], best[sure]), rows.weights[sure])
                whole = np.bincount(para, rows.weights, len(owner))
                named = votes.sum(axis=1)
                # sentences of no subject go with those of their paragraph
                votes *= np.divide(whole, named, out=np.zeros_like(whole), where=named > 0)[:, None]
                np.add.at(result, owner, votes)
                result /= np.maximum(np.bincount(owner, whole, batch.num_rows), 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, result.size + 1, width, np.int32)), pa.array(result.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], lists], [f.name for f in out])

    return _scored(graph, labels, width).select("sents", "trusted", "told", *(f.name for f in kinds)).mapInArrow(run, out)


def _trusted(graph: DataFrame, labels: DataFrame, width: int, code_at: int) -> DataFrame:
    """(uid, trusted) of the labelled documents whose own edges do not contradict their labels."""
    labelled = graph.filter("labels IS NOT NULL").withColumn("trusted", F.lit(None).cast("array<int>"))
    own = _shares(labelled, labels, width, ["uid", "is_code", "labels"], TRUST_SURE)
    own = own.selectExpr("uid", "labels", f"transform(shares, (x, i) -> if(is_code AND i = {code_at}, 1D, x)) AS shares")
    fits = f"""forall(shares, x -> x = 0) OR (forall(labels, l -> shares[l] >= {TRUSTED_LEAST})
        AND forall(sequence(0, {width - 1}), i -> array_contains(labels, i) OR shares[i] <= {TRUSTED_OTHER}))"""
    return own.filter(fits).select("uid", F.col("labels").alias("trusted"))


def subject_shares(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, share) of every subject that a document keeps.

    ``share`` is the part of its prose sentences, filler of the same paragraphs included; code keeps software
    with share 1. A document whose hand labels are trusted keeps these subjects and no others, with the share its
    sentences give them. Null, empty and blank texts and documents without doc_id have no rows; labels of unknown
    documents or subjects are ignored, repeated ones count once; without any subject the result is empty.
    Each row is a document of its own, also where doc_ids repeat.
    """
    spark = documents.sparkSession
    # the subjects that exist are a stated list
    stated = sorted((r.subject, r.sample_terms or []) for r in areas.select("subject", "sample_terms").filter(F.col("subject").isNotNull()).distinct().collect())
    merged: dict[str, list[str]] = {}
    for name, samples in stated:
        merged.setdefault(name, []).extend(s for s in samples if s)
    subjects, width = list(merged), len(merged)
    empty = "doc_id long, subject string, share double"
    if not width:
        return spark.createDataFrame([], empty)
    known = labels.filter(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull())
    by_doc = known.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    count = by_doc.count()
    thin = max(1, math.ceil(count / MAX_SEED_DOCUMENTS))
    fitted = by_doc.filter(F.pmod(F.xxhash64("doc_id"), F.lit(thin)) == 0) if thin > 1 else by_doc
    places = {s: i for i, s in enumerate(subjects)}
    sums = _seed_terms(documents, broadcast_if_small(fitted, 2 * MAX_SEED_DOCUMENTS), places)
    # the seed documents are bounded, and so are their terms
    learned = _labels(sums, width).toPandas()
    sides = [f"a{i}" for i in range(width)]
    values = dict(zip(learned["term"], learned[sides].to_numpy(np.float64))) if len(learned) else {}
    stated_terms: dict[str, np.ndarray] = {}
    for i, name in enumerate(subjects):
        for sample in merged[name]:
            # a longer sample is seen through its pairs of words
            for term in [sample.lower()] if len(sample.split()) < 3 else [t for t in terms(sample) if " " in t]:
                stated_terms.setdefault(term, np.zeros(width))[i] = 5.0
    for term, v in stated_terms.items():
        values[term] = np.log((v + NONE) / (v.sum() + NONE * width) * width)
    if not values:
        return spark.createDataFrame([], empty)
    vocabulary = sorted(values)
    table = np.stack([values[t] for t in vocabulary])
    frame = pd.DataFrame({"term": np.arange(len(vocabulary), dtype=np.int32), "n": 0.0, "side": table.argmax(axis=1).astype(np.int32), **{x: table[:, i] for i, x in enumerate(sides)}})
    frame["is_fixed"] = [t in stated_terms for t in vocabulary]
    start = cut_lineage(spark.createDataFrame(frame, "term int, n double, side int, " + ", ".join(f"{x} double" for x in sides) + ", is_fixed boolean"))
    fixed, start = start.filter("is_fixed").drop("is_fixed"), start.drop("is_fixed")
    place = F.create_map(*(x for s, i in places.items() for x in (F.lit(s), F.lit(i))))
    allowed = by_doc.select("doc_id", F.transform("subjects", lambda s: place[s]).alias("labels"))
    graph = _graph(documents, vocabulary, broadcast_if_small(allowed, MAX_BROADCAST_LABELS))
    code_at = places.get(CODE_SUBJECT, -1)
    trusted = broadcast_if_small(cut_lineage(_trusted(graph, start, width, code_at)), MAX_BROADCAST_LABELS)
    graph = graph.join(trusted, "uid", "left")
    settled = _settled(graph, start, fixed, len(vocabulary), width)
    votes = _shares(graph, settled, width, ["doc_id", "is_code", "trusted"])
    names = F.array(*map(F.lit, subjects))
    kept = votes.selectExpr(
        "doc_id",
        f"""filter(transform(shares, (x, i) -> struct(i AS subject, if(is_code AND i = {code_at}, 1D, x) AS share)),
            k -> if(trusted IS NOT NULL, array_contains(trusted, k.subject), k.share >= {SHARE})) AS kept""",
    )
    return kept.selectExpr("doc_id", "inline(kept)").select("doc_id", F.element_at(names, F.col("subject") + 1).alias("subject"), "share")
