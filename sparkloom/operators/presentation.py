"""What a reader sees of a hit: a window on its text, a stitched passage, a context under a budget."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WINDOW_CHARS, CONTEXT_CHARS = 1500, 8000
HEADER_ALLOWANCE, MIN_PARTIAL, DISCLOSURE = 80, 300, 64
ELISION = "…"


def window(text: str, budget: int = WINDOW_CHARS, terms: frozenset[str] | set[str] = frozenset(), phrase: re.Pattern | None = None) -> str:
    """Whole lines round the phrase, else round the line with most terms, else the head; cut sides are marked.

    A budget of 0 or less, and a text within it, change nothing. One long line is cut on characters.
    """
    if budget <= 0 or len(text) <= budget:
        return text
    lines = text.split("\n")
    found = phrase.search(text) if phrase else None
    if found:
        low = text.count("\n", 0, found.start())
        high = text.count("\n", 0, found.end())
        at = found.start()
    else:
        scores = [sum(w in terms for w in re.findall(r"[^\W_]+", line.lower())) for line in lines] if terms else [0]
        low = high = scores.index(max(scores)) if max(scores) else 0
        at = sum(len(x) + 1 for x in lines[:low])
    used = sum(len(x) + 1 for x in lines[low : high + 1])
    if used > budget:
        start = max(0, min(at - budget // 4, len(text) - budget))
        cut = text[start : start + budget]
        return (ELISION if start else "") + cut + (ELISION if start + budget < len(text) else "")
    while True:
        before = len(lines[low - 1]) + 1 if low else None
        after = len(lines[high + 1]) + 1 if high + 1 < len(lines) else None
        choices = [c for c in (before, after) if c is not None and used + c <= budget]
        if not choices:
            break
        if before is not None and before == min(choices):
            low, used = low - 1, used + before
        else:
            high, used = high + 1, used + after
    shown = lines[low : high + 1]
    return "\n".join([ELISION] * (low > 0) + shown + [ELISION] * (high + 1 < len(lines)))


def line_window(text: str, low: int, high: int) -> tuple[str, int, int]:
    """Lines low..high (from 1, clamped) and the range really shown."""
    lines = text.split("\n")
    low, high = max(1, low), min(len(lines), high)
    return "\n".join(lines[low - 1 : high]), low, high


@dataclass
class Candidate:
    key: str
    location: str
    score: float
    text: str


@dataclass
class Context:
    text: str = ""
    used: list[str] = field(default_factory=list)
    partial: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


def assemble(candidates: list[Candidate], budget: int = CONTEXT_CHARS) -> Context:
    """Blocks in score order while they fit; one that does not is passed over for smaller ones, and one may be cut, last."""
    result, left, blocks, cut = Context(), budget, [], None
    for one in sorted(candidates, key=lambda c: (-c.score, c.key)):
        cost = len(one.text) + HEADER_ALLOWANCE
        if cost <= left:
            blocks.append(f"## {one.location}\n{one.text}")
            result.used.append(one.key)
            left -= cost
        elif cut is None and left - HEADER_ALLOWANCE - DISCLOSURE >= MIN_PARTIAL:
            room = left - HEADER_ALLOWANCE - DISCLOSURE
            shown = one.text[:room]
            end = shown.rfind("\n") if "\n" in shown else shown.rfind(" ")
            shown = shown[:end] if end > 0 else shown
            cut = f"## {one.location}\n{shown}\n{ELISION} {len(one.text) - len(shown)} characters left out"
            result.partial.append(one.key)
            left = 0
        else:
            result.dropped.append(one.key)
    result.text = "\n\n".join(blocks + [cut] * (cut is not None))
    return result
