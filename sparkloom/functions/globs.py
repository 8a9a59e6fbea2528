"""Ignore-file globs: translation to regular expressions and last-match-wins evaluation.

Rules: a leading ``!`` re-includes; a trailing ``/`` matches directories only; a ``/`` at the start or inside
anchors the pattern at its directory, else it matches at any depth; ``**`` spans directories, ``*`` and ``?``
stay within a segment; a match of a directory covers all beneath. In a class the first ``]`` is a member and
``/`` never matches; an unclosed ``[`` is literal; empty, reversed and POSIX classes make a rule unusable.
A ``#`` starts a comment and blank lines say nothing.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PATTERN = 500

# fixed values: what every walk leaves out unless a later rule takes it back
ALWAYS_EXCLUDE = [
    ".git", ".hg/", ".svn/", "node_modules/", "bin/", "obj/", ".vs/", ".idea/", ".vscode/",
    "target/", "dist/", "build/", "__pycache__/", ".venv/", "venv/",
    "*.exe", "*.dll", "*.pdb", "*.so", "*.dylib", "*.o", "*.obj", "*.a", "*.lib",
    "*.zip", "*.tar", "*.gz", "*.7z", "*.rar", "*.jar", "*.nupkg",
    "*.woff", "*.woff2", "*.ttf", "*.eot", "*.otf",
    "*.ico", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.bmp", "*.webp", "*.svg",
    "*.mp3", "*.mp4", "*.avi", "*.mov", "*.wav", "*.flac",
    "*.db", "*.sqlite", "*.sqlite3",
    "*.safetensors", "*.gguf", "*.bin", "*.pt", "*.pth", "*.pkl", "*.npy", "*.npz",
    "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
]


class UnusableGlob(ValueError):
    pass


def _class(glob: str, at: int) -> tuple[str, int] | None:
    """The regular expression of the class that opens at ``at`` and the place after it; None if unclosed."""
    end = at + 1
    negated = end < len(glob) and glob[end] in "!^"
    end += negated
    first, members = True, []
    while end < len(glob) and (first or glob[end] != "]"):
        first = False
        if glob.startswith("[:", end):
            raise UnusableGlob(f"POSIX class in {glob!r}")
        if glob[end] == "\\" and end + 1 < len(glob):
            end += 1
        members.append(glob[end])
        end += 1
    if end >= len(glob):
        return None
    text, i, parts = "".join(members), 0, []
    while i < len(text):
        if i + 2 < len(text) and text[i + 1] == "-":
            if text[i] > text[i + 2]:
                raise UnusableGlob(f"reversed range in {glob!r}")
            parts.append(f"{re.escape(text[i])}-{re.escape(text[i + 2])}")
            i += 3
        else:
            parts.append(re.escape(text[i]))
            i += 1
    if not parts:
        raise UnusableGlob(f"empty class in {glob!r}")
    return "(?!/)[" + "^" * negated + "".join(parts) + "]", end + 1


@lru_cache(4096)
def translate(glob: str) -> str:
    """A regular expression over a whole path relative to the rule's directory, case folded by the caller."""
    if len(glob) > MAX_PATTERN:
        raise UnusableGlob("pattern too long")
    body = glob.strip()
    directory = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif body[i:] == "**" and (i == 0 or body[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif c == "*":
            while i < len(body) and body[i] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (found := _class(body, i)):
            out.append(found[0])
            i = found[1]
        else:
            out.append(re.escape(c))
            i += 1
    start = "" if anchored else "(?:.*/)?"
    return start + "".join(out) + ("/.*" if directory else "(?:/.*)?")


def usable(line: str) -> tuple[bool, str] | None:
    """(re-includes, regular expression) of a rule line; None for comments, blanks and unusable rules."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    again = line.startswith("!")
    try:
        return again, translate(line.removeprefix("!").lower())
    except UnusableGlob:
        return None


def excluded(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches ``path`` excludes it, as one built-in expression."""
    folded = F.lower(F.regexp_replace(path, r"\\", "/"))
    verdict = F.lit(False)
    for line in rules:
        rule = usable(line)
        if rule:
            verdict = F.when(folded.rlike(f"^(?:{rule[1]})$"), F.lit(not rule[0])).otherwise(verdict)
    return verdict


class RuleSet:
    """The same in Python, for operators that walk paths anyway."""

    def __init__(self, rules: list[str] | None):
        self.rules = [(again, re.compile(pattern, re.S)) for line in rules or [] if (r := usable(line)) for again, pattern in [r]]

    def excludes(self, path: str) -> bool:
        path = path.replace("\\", "/").removeprefix("./").lower()
        for again, pattern in reversed(self.rules):
            if pattern.fullmatch(path):
                return not again
        return False


def literal_prefix(glob: str) -> str:
    """The deepest path a glob surely lies under: its text up to the last ``/`` before the first wildcard."""
    body = glob.strip().removeprefix("!").removeprefix("/").rstrip("/")
    wild = next((i for i, c in enumerate(body) if c in "*?["), None)
    if wild is None:
        return body
    return body[:wild].rpartition("/")[0]


def may_reinclude_beneath(directory: Column, rules: list[str]) -> Column:
    """Whether a ``!`` rule could take back something beneath a directory, so that it must be walked though it is excluded."""
    folded = F.lower(F.regexp_replace(directory, r"\\", "/"))
    verdict = F.lit(False)
    for line in rules:
        line = line.strip().lower()
        if not line.startswith("!") or not usable(line):
            continue
        prefix = literal_prefix(line)
        if "/" not in line[1:].strip().rstrip("/") or not prefix:
            return F.lit(True)  # a rule for any depth
        verdict = verdict | (folded == prefix) | folded.startswith(prefix + "/") | F.lit(prefix).startswith(F.concat(folded, F.lit("/")))
    return verdict


def prunable(directory: Column, rules: list[str]) -> Column:
    """Whether a walk may leave a directory out with all beneath it."""
    return excluded(F.concat(directory, F.lit("/_")), rules) & excluded(F.concat(directory, F.lit("/")), rules) & ~may_reinclude_beneath(directory, rules)
