"""Encoding a corpus with a public byte-level BPE by walking a trie of its distinct words.

A byte-pair encoding has a prefix property: the encoding of a string is the encoding of some shorter prefix
followed by one last token, and a sequence of tokens is the encoding of its bytes exactly if every two
neighbours are the encoding of theirs. So each node of a trie of words needs one state, its last token; the
children of a node go on from the states on the path to it, and a prefix that many words share is encoded
once. Words come in sorted order, which is a depth-first walk of the trie: the path common with the word
before stays on the stack, and only the nodes beyond it are new.

Every worker keeps the words it has met, so that a batch costs its new words plus one look-up a word.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words a worker keeps; beyond it the store starts anew, which costs time and changes no result.
MAX_KEPT_WORDS = 2_000_000

# fixed values: Unicode's White_Space characters, as the public pattern's \s reads them
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE = frozenset(re.findall(f"[{_SPACE}]", "".join(map(chr, range(0x3001)))))
LONGEST_KEPT_CHUNK = 32


@lru_cache(1)
def splitter() -> re.Pattern:
    r"""The public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`` for ``re``.

    The general categories become character classes, built once from ``unicodedata``.
    """

    def ranges(first: str) -> str:
        parts, start, last = [], None, None
        for code in range(sys.maxunicode + 1):
            if unicodedata.category(chr(code))[0] == first:
                if start is None:
                    start = code
                last = code
            elif start is not None:
                parts.append((start, last))
                start = None
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts)

    letter, number = ranges("L"), ranges("N")
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


def chunks(text: str) -> list[str]:
    """The text cut before every single space between two characters that are not white space.

    The pattern always starts a word there and never reaches over such a place, so that chunks can be split,
    encoded and remembered one by one.
    """
    pieces = text.split(" ")
    found, now = [], pieces[0]
    ends_well = bool(now) and now[-1] not in WHITE
    for piece in pieces[1:]:
        if piece:
            if ends_well and piece[0] not in WHITE:
                found.append(now)
                now = " " + piece
            else:
                now += " " + piece
            ends_well = piece[-1] not in WHITE
        else:
            now += " "
            ends_well = False
    found.append(now)
    return found


class TrieEncoder:
    """Encodes words over one vocabulary of byte ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.valid: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by the definition: again and again join the neighbours of lowest rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _agrees(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their bytes."""
        known = self.valid.get((left, right))
        if known is None:
            known = self.valid[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def learn(self, words: Iterable[str]) -> None:
        """Encode new words: one depth-first walk over their trie."""
        new = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        ranks, longest = self.ranks, self.longest
        path = b""
        last: list[int] = []  # last[i]: last token of the encoding of path[: i + 1]
        size: list[int] = []  # its length in bytes
        for data, word in new:
            whole = ranks.get(data)
            shared, most = 0, min(len(path), len(data))
            while shared < most and path[shared] == data[shared]:
                shared += 1
            del last[shared:], size[shared:]
            for end in range(shared + 1, len(data) + 1):
                for start in range(max(0, end - longest), end):
                    token = ranks.get(data[start:end])
                    if token is not None and (start == 0 or self._agrees(last[start - 1], token)):
                        last.append(token)
                        size.append(end - start)
                        break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
            path = data
            if whole is not None and last and last[-1] == whole:
                self.words[word] = (whole,)
                continue
            ids, at = [], len(data)
            while at:
                ids.append(last[at - 1])
                at -= size[at - 1]
            self.words[word] = tuple(reversed(ids))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; null and empty texts have no ids."""
        known = self.chunks
        if len(known) > MAX_KEPT_WORDS or len(self.words) > MAX_KEPT_WORDS:
            known.clear()
            self.words.clear()
        if len(self.valid) > MAX_KEPT_WORDS:
            self.valid.clear()
        cut = [chunks(t) if t else [] for t in texts]
        fresh = set().union(*cut)
        fresh.difference_update(known)
        find = splitter().findall
        split = {c: find(c) for c in fresh}
        missing = set().union(*split.values())
        missing.difference_update(self.words)
        self.learn(missing)
        words, rare = self.words, {}
        for chunk, parts in split.items():
            to = known if len(chunk) <= LONGEST_KEPT_CHUNK else rare
            to[chunk] = words[parts[0]] if len(parts) == 1 else tuple(i for p in parts for i in words[p])
        offsets, ids = np.zeros(len(texts) + 1, np.int32), []
        for i, parts in enumerate(cut):
            for chunk in parts:
                ids += known[chunk] if chunk in known else rare[chunk]
            offsets[i + 1] = len(ids)
        return offsets, np.array(ids, np.int32)


@lru_cache(2)
def encoder(vocabulary: str) -> TrieEncoder:
    with open(vocabulary, "rb") as file:
        pairs = (line.split() for line in file)
        return TrieEncoder({base64.b64decode(token): int(rank) for token, rank in pairs})


def encode(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens.

    Null and empty texts have an empty list. Special tokens' strings in a text are ordinary text. Rows with
    equal or null keys are kept as they are. ``vocabulary`` is the path of a rank file; it goes to the workers with
    the job, so that only the driver must be able to read it. There is no shuffle.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(SparkFiles.get(name))
        for batch in batches:
            # lists of a batch share one buffer of 32-bit offsets: keep slices well under its limit
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                offsets, ids = tool.encode_batch(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
