"""Rebuilding conversations from message rows.

Interleaved threads of a session are disentangled by reply links. Every message looks for its parent among all messages
before it, however far back: the message just before, the last one of each speaker and of its own agent, and the last
one with each tool-call id, name or word it holds. Each candidate is scored by the time between the two, the places
between them, what the message mentions of it (tool-call ids and names) and the words they share; the likeliest is the
parent, or none if all are out of the question. That is judged without the place, which the message just before always
has: time and change of speaker count for the same agent only and fade with silence, and with ids, names and words
they must reach ``ROOT_BELOW``. The links form trees.

A session's conversation is its forest: it must open with a root of the user's and close with a leaf of the assistant's.
What comes out is every message of such a session in line order, with its parent, its tree and the score of its link.
An exact check leaves out sessions with holes in their line numbers or unreadable records.

Nothing here holds a session in one task. Sessions are judged with aggregates, and numbered and linked in blocks of
``BLOCK`` lines. Of the messages before a block, those that hold one of its ids, names or words last come along, so that
links reach as far as they must; trees that cross blocks are joined by doubling pointers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import broadcast_if_small, cut_lineage

BLOCK = 1024
ROOT_BELOW = 0.18
TIME_SCALE_S = 900.0
#: The silence after which a message counts half as going on with the thread: without shared words, names or ids the same agent's thread breaks after one to two hours.
SILENCE_S = 3600.0
#: Words below which a message is too short for a shared one to say much.
SHORT = 4
MAX_BROADCAST_SESSIONS = 500_000

# fixed values: speaker spellings and the spans that hosts inject into messages
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "ai", "model")
INJECTED = ("system-reminder", "local-command-stdout", "ide_selection")

_SPANS = "(?s)<(" + "|".join(INJECTED) + r")>.*?</\1>"
_BLANK = r"^[\s   -​    　﻿]*$"


def _speaker(name: Column) -> Column:
    name = F.lower(F.trim(name))
    return F.when(name.isin(*USER_ROLES), "user").when(name.isin(*ASSISTANT_ROLES), "assistant").otherwise(name)


def parsed_records(records: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per (session_id, line_no): the record with the highest record_id, its speaker, what links go by and, if asked for, its spoken text.

    ``is_broken`` marks user and assistant records whose message is null or not valid JSON. ``is_message``
    marks those that are not is_meta and have text left once injected spans are removed. A record with
    neither rec_type nor a readable role has no speaker and is neither. Rows without a session are left out;
    a session with a null line_no is judged broken later. Equal record_ids settle by the greater row.
    """
    message = F.try_parse_json("message")
    content = F.try_variant_get(message, "$.content", "variant")
    # arrays of blocks; a damaged or foreign shape gives null
    blocks = F.from_json(F.col("content_json"), "array<struct<type string, text string, id string, tool_use_id string>>")
    shaped = (
        records.filter(F.col("session_id").isNotNull())
        .select("session_id", "line_no", "record_id", "rec_type", "message", "is_meta", "recorded_at", "agent_id")
        .withColumn("_v", message)
        .withColumn("role", F.try_variant_get("_v", "$.role", "string"))
        .withColumn("kind", F.schema_of_variant(F.try_variant_get("_v", "$.content", "variant")))
        .withColumn("content_json", F.when(F.col("kind").startswith("ARRAY"), F.to_json(F.try_variant_get("_v", "$.content", "variant"))))
        .withColumn("content_text", F.when(F.col("kind") == "STRING", F.try_variant_get("_v", "$.content", "string")))
        .withColumn("is_readable", F.col("_v").isNotNull())
        .drop("_v", "message")
        .withColumn("blocks", blocks)
    )
    said = F.coalesce(
        F.col("content_text"),
        F.array_join(F.expr("transform(filter(blocks, b -> b.type = 'text' and b.text is not null), b -> b.text)"), "\n"),
    )
    speaker = _speaker(F.coalesce("rec_type", "role"))
    is_turn = F.coalesce(speaker.isin("user", "assistant"), F.lit(False))
    text = F.trim(F.regexp_replace(said, _SPANS, ""))
    shaped = shaped.select(
        "session_id",
        "line_no",
        "record_id",
        F.when(is_turn, speaker).alias("speaker"),
        (is_turn & ~F.col("is_readable")).alias("is_broken"),
        (is_turn & ~F.coalesce("is_meta", F.lit(False)) & F.coalesce(~text.rlike(_BLANK), F.lit(False))).alias("is_message"),
        text.alias("text"),
        "recorded_at",
        "agent_id",
        F.expr("filter(transform(blocks, b -> b.id), x -> x is not null)").alias("calls"),
        F.expr("filter(transform(blocks, b -> b.tool_use_id), x -> x is not null)").alias("answers"),
    )
    # what only messages need is dropped from the others before anything is shuffled; words, names and ids travel as hashes
    hashed = lambda x: F.transform(F.array_distinct(x), lambda w: F.hash(w))
    shaped = (
        shaped.withColumn("words", hashed(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0))))
        .withColumn("names", hashed(F.regexp_extract_all(F.col("text"), F.lit(r"(?<=[\p{Ll},] )\p{Lu}[\p{Ll}]{3,}"), F.lit(0))))
        .withColumn("calls", hashed(F.col("calls")))
        .withColumn("answers", hashed(F.col("answers")))
    )
    for name in ("text", "words", "names", "calls", "answers"):
        shaped = shaped.withColumn(name, F.when(F.col("is_message"), F.col(name)))
    if not with_text:
        shaped = shaped.drop("text")
    row = F.struct("record_id", *[c for c in shaped.columns if c not in ("session_id", "line_no", "record_id")])
    return shaped.groupBy("session_id", "line_no").agg(F.max(row).alias("r")).select("session_id", "line_no", "r.*")


def whole_sessions(lines: DataFrame) -> DataFrame:
    """The exact check: session_ids whose lines are 1, 2, 3 … without holes or broken records, with a message."""
    return (
        lines.groupBy("session_id")
        .agg(
            F.count("*").alias("n"),
            F.count("line_no").alias("numbered"),
            F.min("line_no").alias("first"),
            F.max("line_no").alias("last"),
            F.count_if("is_broken").alias("broken"),
            F.count_if("is_message").alias("messages"),
        )
        .filter("n = numbered and first = 1 and last = n and broken = 0 and messages > 0")
        .select("session_id")
    )


def _numbered(messages: DataFrame) -> DataFrame:
    """turn_no by line order, counted block by block; ``_blocks`` is the session's number of blocks."""
    messages = messages.withColumn("_block", F.floor((F.col("line_no") - 1) / BLOCK))
    sums = messages.groupBy("session_id", "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("session_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("session_id")
    sums = sums.select("session_id", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.count("*").over(every).alias("_blocks"))
    within = Window.partitionBy("session_id", "_block").orderBy("line_no")
    return (
        messages.withColumn("_rank", F.row_number().over(within))
        .join(sums, ["session_id", "_block"])
        .withColumn("turn_no", (F.col("_before") + F.col("_rank")).cast("int"))
        .drop("_rank", "_before")
    )


_LINKED_BY = ["turn_no", "speaker", "agent_id", "recorded_at", "words", "names", "calls", "answers"]


def _guests(turns: DataFrame) -> DataFrame:
    """Rows of ``turns`` once more under each later block that they are the last message before it to share a key with.

    Keys are speakers, agents, ids, names and words. Only sessions of several blocks have guests.
    """
    long = turns.filter("_blocks > 1")
    none = F.array().cast("array<int>")
    held = lambda name, sign, gives=True: F.transform(F.coalesce(name, none), lambda x: F.struct(F.concat(F.lit(sign), x.cast("string")).alias("key"), F.lit(gives).alias("gives")))
    one = lambda name, sign: F.array(F.struct(F.concat(F.lit(sign), F.coalesce(name, F.lit(""))).alias("key"), F.lit(True).alias("gives")))
    keys = F.concat(one("speaker", "s"), one("agent_id", "a"), held("words", "w"), held("names", "n"), held("calls", "c"), held("answers", "c", False))
    last = long.select("session_id", "_block", "turn_no", F.explode(keys).alias("k")).groupBy("session_id", "k.key", "_block").agg(F.max(F.when(F.col("k.gives"), F.col("turn_no"))).alias("last"))
    # one row a block and key, in order of blocks
    before = Window.partitionBy("session_id", "key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    wanted = last.select("session_id", "_block", F.last("last", True).over(before).alias("turn_no")).filter("turn_no is not null").distinct()
    # the last message of the block before comes along too
    ends = long.groupBy("session_id", "_block").agg(F.max("turn_no").alias("turn_no")).select("session_id", (F.col("_block") + 1).alias("_block"), "turn_no")
    return wanted.unionByName(ends).distinct().join(long.drop("_block"), ["session_id", "turn_no"])


class _Thread:
    """The messages of a session so far and, for each key, the last one that has it."""

    def __init__(self) -> None:
        self.last: dict = {}
        self.rows: dict[int, tuple] = {}
        self.before: int | None = None

    def parent(self, row: tuple) -> tuple[int | None, float | None]:
        """(turn_no, score) of the likeliest parent."""
        turn, speaker, agent, at, words, names, calls, answers = row
        last, keys = self.last, {self.before}
        keys.add(last.get(("a", agent)))
        for other in ("user", "assistant"):
            keys.add(last.get(("s", other)))
        for sign, values in (("w", words), ("n", names), ("c", answers)):
            for value in values:
                keys.add(last.get((sign, value)))
        keys.discard(None)
        best, found = None, None
        for candidate in keys:
            _, who, whose, when, its_words, its_names, its_calls, _ = self.rows[candidate]
            gap = None if at is None or when is None else abs(at - when)
            alternates = speaker != who
            same_agent = agent == whose
            # a named agent says more than none; two names that differ speak against a link
            agents = 0.10 if agent is None and whose is None else 0.20 if same_agent else 0.0 if agent is None or whose is None else -0.20
            least = min(len(words), len(its_words))
            shared = len(words & its_words) / max(least, SHORT) if least else 0.0
            mentions = 0.60 * (not answers.isdisjoint(its_calls)) + 0.15 * (not names.isdisjoint(its_names))
            unbroken = 0.6 if gap is None else 1.0 / (1.0 + gap / SILENCE_S)
            if same_agent * (0.35 + 0.15 * alternates) * unbroken + mentions + 0.70 * shared < ROOT_BELOW:
                continue
            score = 0.15 * (0.3 if gap is None else exp(-gap / TIME_SCALE_S)) + 0.40 / (turn - candidate) + 0.10 * alternates + agents + mentions + 0.80 * shared
            if best is None or (score, candidate) > best:
                best, found = (score, candidate), candidate
        return (None, None) if found is None else (found, best[0])

    def add(self, row: tuple) -> None:
        turn, speaker, agent, _, words, names, calls, _ = row
        self.rows[turn] = row
        self.before = turn
        self.last["a", agent] = self.last["s", speaker] = turn
        for sign, values in (("w", words), ("n", names), ("c", calls)):
            for value in values:
                self.last[sign, value] = turn


_LINKS = pa.schema(
    [("session_id", pa.string()), ("_block", pa.int64()), ("turn_no", pa.int32()), ("line_no", pa.int32()), ("record_id", pa.int64()), ("speaker", pa.string()),
     ("parent_turn", pa.int32()), ("link_score", pa.float64()), ("local_root", pa.int32())]
)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents, and the root or the message of an earlier block that they lead to; rows come by session, block and turn."""
    key, thread, roots = None, _Thread(), {}
    for batch in batches:
        out: list[list] = [[] for _ in _LINKS]
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for session, block, own, line, record, turn, speaker, agent, at, *sets in zip(*columns):
            if (session, block) != key:
                key, thread, roots = (session, block), _Thread(), {}
            row = (turn, speaker, agent, at, *(frozenset(x or ()) for x in sets))
            if own:
                parent, score = thread.parent(row)
                root = turn if parent is None else roots.get(parent, parent)
                roots[turn] = root
                for column, value in zip(out, (session, block, turn, line, record, speaker, parent, score, root)):
                    column.append(value)
            thread.add(row)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _LINKS)], schema=_LINKS)


def reply_links(turns: DataFrame, blocks: bool = True) -> DataFrame:
    """(session_id, _block, turn_no, line_no, record_id, speaker, parent_turn, link_score, local_root) of every message.

    ``blocks`` says whether any session has more than one. parent_turn is null for a root; local_root is the root, or the message of an earlier block that the links lead to.
    """
    columns = ["session_id", "_block", "_own", "line_no", "record_id", *_LINKED_BY]
    own = turns.withColumn("_own", F.lit(True))
    both = own.select(*columns)
    if blocks:
        both = both.unionByName(_guests(turns).withColumn("_own", F.lit(False)).select(*columns))
    both = both.withColumn("recorded_at", F.unix_micros(F.col("recorded_at").cast("timestamp")) / 1e6)
    ordered = both.repartition("session_id", "_block").sortWithinPartitions("session_id", "_block", "turn_no")
    kinds = "session_id string, _block long, turn_no int, line_no int, record_id long, speaker string, parent_turn int, link_score double, local_root int"
    return ordered.mapInArrow(_linked, kinds)


def link_trees(linked: DataFrame) -> DataFrame:
    """``linked`` with tree_root, the turn_no of the root of the message's tree, by doubling pointers across blocks."""
    first = linked.filter("_block > 0").groupBy("session_id", "_block").agg(F.min("turn_no").alias("_start"))
    crossing = linked.join(first, ["session_id", "_block"]).filter(F.col("local_root") < F.col("_start"))
    ends = crossing.select("session_id", F.col("local_root").alias("turn_no")).distinct()
    slots = linked.join(ends, ["session_id", "turn_no"], "left_semi").select("session_id", "turn_no", F.col("local_root").alias("to"))
    slots = cut_lineage(slots)
    while True:
        onward = slots.select("session_id", F.col("turn_no").alias("to"), F.col("to").alias("_onward"))
        stepped = slots.join(onward, ["session_id", "to"], "left").select("session_id", "turn_no", F.coalesce("_onward", "to").alias("_next"), "to")
        if not stepped.filter("_next <> to").limit(1).count():
            break
        slots = cut_lineage(stepped.select("session_id", "turn_no", F.col("_next").alias("to")))
    roots = slots.select("session_id", F.col("turn_no").alias("local_root"), F.col("to").alias("_root"))
    joined = linked.join(broadcast_if_small(roots, MAX_BROADCAST_SESSIONS), ["session_id", "local_root"], "left")
    return joined.withColumn("tree_root", F.coalesce("_root", "local_root")).drop("_root", "local_root", "_block")


def forests(trees: DataFrame) -> DataFrame:
    """session_ids whose forest opens with a root of the user's and closes with a leaf of the assistant's."""
    at = F.struct("turn_no", "speaker")
    told = trees.groupBy("session_id").agg(F.min(F.when(F.col("tree_root") == F.col("turn_no"), at)).alias("opens"), F.min("turn_no").alias("first"), F.max(at).alias("closes"))
    return told.filter("opens.turn_no = first and opens.speaker = 'user' and closes.speaker = 'assistant'").select("session_id")


def conversations(records: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per message of each kept session, in conversation order.

    Columns: session_id, turn_no, line_no, record_id, speaker, parent_turn, link_score, tree_root and, with text,
    text, recorded_at, agent_id. Dropped: sessions with holes in their line numbers, with unreadable user or
    assistant records, without messages, not opened by the user or not closed by the assistant. Repeated
    (session_id, line_no) rows count once. An empty table gives no rows.
    """
    # records are read and parsed once
    lines = cut_lineage(parsed_records(records, with_text))
    whole = broadcast_if_small(whole_sessions(lines), MAX_BROADCAST_SESSIONS)
    messages = lines.filter("is_message").join(whole, "session_id", "left_semi")
    turns = _numbered(messages.drop("is_broken", "is_message", "text"))
    # where every session is one block nothing crosses, and nothing need be looked for beyond
    blocks = bool(messages.filter(F.col("line_no") > BLOCK).limit(1).count())
    linked = cut_lineage(reply_links(turns, blocks))
    trees = link_trees(linked) if blocks else linked.withColumnRenamed("local_root", "tree_root").drop("_block")
    kept = trees.join(broadcast_if_small(forests(trees), MAX_BROADCAST_SESSIONS), "session_id", "left_semi")
    columns = ["session_id", "turn_no", "line_no", "record_id", "speaker", "parent_turn", "link_score", "tree_root"]
    if not with_text:
        return kept.select(*columns)
    return kept.join(messages.select("session_id", "line_no", "text", "recorded_at", "agent_id"), ["session_id", "line_no"]).select(*columns, "text", "recorded_at", "agent_id")
