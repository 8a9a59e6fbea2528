"""Evaluation texts leaking into training text: pigeonhole seeds and Myers' bit-parallel distance, in words.

A document leaks an item if it holds at least ``MIN_WORDS`` consecutive words of the item's passage with at
most one word in ``WORDS_PER_ERROR`` altered, added or dropped. Such a stretch of 21 words has at most three
errors, and four pieces share its 18 or more right words: one piece of five words at least is exact. So all
runs of ``SEED_WORDS`` words of the passages are looked up in every document, by hashes of word numbers over
whole batches. By the q-gram lemma a leak holds two such runs or more on neighbouring diagonals; where that is
so, windows of the passage are verified against the words around with Myers' algorithm, whose bit vectors are
as long as the window.

Words are compared without case, punctuation, accents, compatibility forms, look-alike letters, invisible
characters, markup and line prefixes; a word that a line break cuts in two is joined again where the join, and
not both halves, is a word of some passage.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
WORDS_PER_ERROR = 7
SEED_WORDS = 5
DIAGONAL_SLACK = 4
#: Items per pass. A larger set is searched in blocks of this many, each a pass over the documents.
ITEMS_PER_BLOCK = 20_000
#: The same by the length of their passages, which bounds what travels to the workers.
CHARS_PER_BLOCK = 100_000_000
#: Tokens a worker keeps; beyond it the store starts anew, which costs time and changes no result.
MAX_KEPT_TOKENS = 2_000_000

# fixed values: Cyrillic and Greek letters drawn like Latin ones
LOOKALIKES = str.maketrans("асеорхуіјѕԁһкмтвнαονρτυκι", "aceopxyijsdhkmtbhaovptuki")

_TAG = re.compile(r"</?(?:b|i|em|strong|span|a|font|code|u|sub|sup|small|mark)\b[^<>]*>|&shy;", re.I)
_BLOCK_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_LINK = re.compile(r"!?\[([^\[\]]*)\](?:\([^()\s]*\)|\[[^\[\]]*\])")
_WIKI = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_TEMPLATE = re.compile(r"\{\{[\w ]+\|")
_LATEX = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{")
_ESCAPED_BREAK = re.compile(r"\\[nrt](?![a-z])|\\[nrt](?=[a-zà-ÿ]+\b)")
_PREFIX_NUMBER = re.compile(r"(?m)^[ \t]*\d{1,6}[ \t]*[:|.)\]][ \t]")
_HYPHENS = "-‐‑­"


def unmarked(text: str) -> str:
    """``text`` without the markup that can stand between or around words."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _BLOCK_TAG.sub(" ", _TAG.sub("", text))
    if "[" in text:
        text = _WIKI.sub(r"\1", _LINK.sub(r"\1", text))
    if "{{" in text:
        text = _TEMPLATE.sub("", text)
    if "\\" in text:
        text = _ESCAPED_BREAK.sub("\n", _LATEX.sub("", text))
    return _PREFIX_NUMBER.sub("", text)


def plain_word(token: str) -> str:
    """The letters and digits of a token in one form; "" if it has none."""
    if not token.isascii():
        token = unicodedata.normalize("NFKD", token)
    token = token.casefold()
    if not token.isascii():
        token = token.translate(LOOKALIKES)
    return "".join(c for c in token if c.isalnum())


class Passages:
    """The items' passages as word numbers, their seeds and their bit masks."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.number: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.words: list[list[int]] = []
        for _, passage in items:
            plain = (plain_word(t) for t in unmarked(passage or "").split())
            self.words.append([self.number.setdefault(w, len(self.number)) for w in plain if w])
        self.masks: list[dict[int, int]] = []
        runs, owner, place = [], [], []
        for item, words in enumerate(self.words):
            masks: dict[int, int] = {}
            for at, word in enumerate(words):
                masks[word] = masks.get(word, 0) | 1 << at
            self.masks.append(masks)
            if len(words) >= MIN_WORDS and self.ids[item] is not None:
                for at in range(len(words) - SEED_WORDS + 1):
                    runs.append(words[at : at + SEED_WORDS])
                    owner.append(item)
                    place.append(at)
        table = np.array(runs, np.int64).reshape(-1, SEED_WORDS)
        hashes = self.hashed(table.T)
        order = np.argsort(hashes, kind="stable")
        self.seeds, self.owner, self.place = hashes[order], np.array(owner, np.int64)[order], np.array(place, np.int64)[order]
        self.tokens: dict[str, int] = {}

    @staticmethod
    def hashed(columns) -> np.ndarray:
        value = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            value = value * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1)
            value ^= value >> np.uint64(29)
        return value

    def word_numbers(self, text: str) -> list[int]:
        """The document's words as numbers, -1 for words of no passage."""
        if len(self.tokens) > MAX_KEPT_TOKENS:
            self.tokens.clear()
        known, number = self.tokens, self.number
        found: list[int] = []
        carried = None  # the last token of the line before
        for line in unmarked(text).splitlines():
            tokens = line.split()
            if carried is not None:
                head = next((k for k, t in enumerate(tokens) if plain_word(t)), None)
                if head is None:
                    continue
                left, right = plain_word(carried.rstrip(_HYPHENS)), plain_word(tokens[head])
                if found and left + right in number and not (left in number and right in number):
                    found[-1] = number[left + right]
                    tokens = tokens[head + 1 :]
                carried = None
            for token in tokens:
                at = known.get(token)
                if at is None:
                    plain = plain_word(token)
                    at = known[token] = number.get(plain, -1) if plain else -2
                if at != -2:
                    found.append(at)
                    carried = token
        return found

    def matches(self, item: int, words: list[int], low: int, high: int, first: int, last: int) -> tuple[int, int, int] | None:
        """(start, length, errors) of a passage window near seeds first..last that words[low:high] hold, or None."""
        passage, masks, text = self.words[item], self.masks[item], words[low:high]
        length, here = len(passage), set(text)
        # a window whose words are not nearly all at hand, wherever they stand, cannot be within its budget
        present = [0, *accumulate(w in here for w in passage)]
        for size in (MIN_WORDS, MIN_WORDS + 1, *range(4 * WORDS_PER_ERROR, length + 1, WORDS_PER_ERROR)):
            allowed = size // WORDS_PER_ERROR
            if size - allowed > len(text):
                break
            full, top = (1 << size) - 1, 1 << (size - 1)
            for start in range(max(0, first - size + SEED_WORDS), min(length - size, last) + 1):
                if present[start + size] - present[start] < size - allowed:
                    continue
                if present[start] == present[start + 1] or present[start + size] == present[start + size - 1]:
                    continue  # a stretch begins and ends with words that are held
                plus, minus, score = full, 0, size
                for word in text:
                    eq = (masks.get(word, 0) >> start) & full
                    xv = eq | minus
                    xh = (((eq & plus) + plus) ^ plus) | eq
                    ph, mh = minus | (full & ~(xh | plus)), plus & xh
                    if ph & top:
                        score += 1
                    elif mh & top:
                        score -= 1
                    ph, mh = (ph << 1) & full, (mh << 1) & full
                    plus, minus = mh | (full & ~(xv | ph)), ph & xv
                    if score <= allowed:
                        return start, size, score
        return None

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(index of the text, item, start, length, errors) of every leak."""
        if not len(self.seeds):
            return
        words = [self.word_numbers(t) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words])
        flat = np.fromiter((i for w in words for i in w), np.int64, int(sizes.sum()))
        if len(flat) < SEED_WORDS:
            return
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        columns = [flat[k : len(flat) - SEED_WORDS + 1 + k] for k in range(SEED_WORDS)]
        usable = owner[: len(columns[0])] == owner[SEED_WORDS - 1 :]
        for column in columns:
            usable &= column >= 0
        at = np.nonzero(usable)[0]
        hashes = self.hashed([c[at] for c in columns])
        left, right = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
        counts = right - left
        hit = np.nonzero(counts)[0]
        counts = counts[hit]
        spread = np.repeat(left[hit] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        place, item, where = self.place[spread], self.owner[spread], np.repeat(at[hit], counts)
        doc = owner[where]
        where = where - (ends - sizes)[doc]
        diagonal = where - place
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal, place, where = (a[order] for a in (doc, item, diagonal, place, where))
        # groups of hits of one document and item whose diagonals follow closely
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > DIAGONAL_SLACK)
        starts = np.nonzero(new)[0]
        stops = np.append(starts[1:], len(doc))
        done: set[tuple[int, int]] = set()
        for a, b in zip(starts[stops - starts >= 2], stops[stops - starts >= 2]):
            pair = int(doc[a]), int(item[a])
            if pair in done:
                continue
            for c, e in _clusters(np.sort(place[a:b])):
                low = max(0, int(diagonal[a]) + c - MIN_WORDS - 8)
                high = int(diagonal[b - 1]) + e + SEED_WORDS + MIN_WORDS + 8
                found = self.matches(pair[1], words[pair[0]], low, high, c, e)
                if found:
                    done.add(pair)
                    yield *pair, *found
                    break


def _clusters(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of at least two seeds that one window could hold together."""
    start = 0
    for k in range(1, len(places) + 1):
        if k == len(places) or places[k] - places[k - 1] > MIN_WORDS:
            if k - start >= 2:
                yield int(places[start]), int(places[k - 1])
            start = k


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, passage_start, passage_words, errors) of every document that holds part of an item's passage.

    passage_start and passage_words give a stretch found, in words from 0, not the longest; errors its edit
    distance. Null and empty texts and passages leak nothing, nor do passages under ``MIN_WORDS`` words or
    items without an id. Items that share a passage are all reported, and so is every copy of a document.
    The documents are read where they lie: no shuffle, and only the stated items travel.
    """
    stated = items.select("item_id", "passage").filter(F.col("item_id").isNotNull() & F.col("passage").isNotNull())
    size = stated.agg(F.count("*").alias("n"), F.sum(F.length("passage")).alias("chars")).first()
    blocks = max(1, -(-size.n // ITEMS_PER_BLOCK), -(-(size.chars or 0) // CHARS_PER_BLOCK))
    found = None
    for block in range(blocks):
        part = stated.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else stated
        rows = [(r.item_id, r.passage) for r in part.collect()]
        one = _one_block(documents, rows)
        found = one if found is None else found.unionByName(one)
    return found


_BUILT: dict[int, Passages] = {}


def _built(number: int, rows: list[tuple[int, str]]) -> Passages:
    """The passages of a broadcast, built once a worker; the one before is let go."""
    if number not in _BUILT:
        _BUILT.clear()
        _BUILT[number] = Passages(rows)
    return _BUILT[number]


def _one_block(documents: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().int, rows))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage_start", pa.int32()), ("passage_words", pa.int32()), ("errors", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = _built(*sent.value)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                keys = part.column(0).to_pylist()
                rows = [(keys[t], passages.ids[i], s, n, e) for t, i, s, n, e in passages.find(part.column(1).to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = "doc_id long, item_id long, passage_start int, passage_words int, errors int"
    return documents.select("doc_id", "text").filter("text is not null").mapInArrow(run, kinds)
