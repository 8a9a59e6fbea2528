"""Scanning a directory tree, and a repository's history, as tables."""

from __future__ import annotations

import os
import re
import subprocess
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.functions import globs
from sparkloom.operators import rules
from sparkloom.operators.catalog import DOCUMENT_CAP, DOCUMENT_TYPES, TEXT_CAP
from sparkloom.sources.extract import decode_text

BINARY_PROBE = 8192


IGNORE_FILES = (".gitignore", ".ignore")
MAX_IGNORE_BYTES = 1 << 20


class _Layers:
    """The rules about a path: what every walk leaves out, ignore files from the root downwards, and the exclude list."""

    def __init__(self, exclude: list[str], folder: str, use_ignore_files: bool):
        self.own = self._compiled(exclude)
        self.folder, self.reads = folder, use_ignore_files
        self.always = self._compiled(globs.ALWAYS_EXCLUDE)
        self.layers: dict[str, list] = {}
        self.lines = self._openings("", exclude)

    @staticmethod
    def _compiled(lines: list[str]) -> list[tuple[re.Pattern, bool]]:
        return [(re.compile(rule, re.S), says) for rule, says in rules.parsed_lines(lines)]

    @staticmethod
    def _openings(directory: str, lines: list[str]) -> list[str]:
        """The rules that take back, as globs from the root."""
        base, found = directory + "/" if directory else "", []
        for line in (x.strip()[1:] for x in lines if x.strip().startswith("!")):
            found.append(base + (line.lstrip("/") if "/" in line.rstrip("/") else "**/" + line))
        return found

    def enter(self, directory: str) -> None:
        """Read the ignore files of a directory, once; those above it must have been entered."""
        if directory in self.layers:
            return
        lines: list[str] = []
        names = ([".git/info/exclude"] if not directory else []) + list(IGNORE_FILES)
        for name in names if self.reads else ():
            at = os.path.join(self.folder, directory, name)
            if os.path.isfile(at) and os.path.getsize(at) <= MAX_IGNORE_BYTES:
                with open(at, "rb") as file:
                    lines += file.read().decode("utf-8", "replace").splitlines()
        self.layers[directory] = self._compiled(lines)
        self.lines += self._openings(directory, lines)

    def ignores(self, path: str) -> bool:
        folded = path.lower()
        for pattern, says in reversed(self.own):
            if pattern.fullmatch(folded):
                return says
        directory = path
        while directory:
            directory = directory.rpartition("/")[0]
            inner = folded[len(directory) + 1 :] if directory else folded
            for pattern, says in reversed(self.layers.get(directory, ())):
                if pattern.fullmatch(inner):
                    return says
        return next((says for pattern, says in reversed(self.always) if pattern.fullmatch(folded)), False)

    def may_prune(self, directory: str) -> bool:
        """Whether nothing beneath an ignored directory could be taken back by a rule known here."""
        folded = directory.lower()
        for line in self.lines:
            prefix = globs.literal_prefix(line.lower())
            if not prefix or prefix == folded or prefix.startswith(folded + "/") or folded.startswith(prefix + "/"):
                return False
        return self.ignores(directory + "/_")


class Workspace(DataSource):
    """``spark.read.format("workspace").load(folder)``: every file of a tree that all executors see, with the reason to skip it.

    Directories down to the second level are read apart. Ignored directories are not entered where no rule could take
    back anything beneath. Options: include and exclude (one glob a line), useIgnoreFiles, maxBytes, maxDocumentBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "relative_path string, length long, modified timestamp, content binary, reason string"

    def reader(self, schema) -> DataSourceReader:
        return _WorkspaceReader(self.options)


class _Folder(InputPartition):
    def __init__(self, directory: str, deep: bool):
        super().__init__((directory, deep))


class _WorkspaceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://").rstrip("/")
        self.include = [x for x in options.get("include", "").split("\n") if x]
        self.exclude = [x for x in options.get("exclude", "").split("\n") if x]
        self.ignore_files = str(options.get("useIgnoreFiles", "true")).lower() == "true"
        self.caps = int(options.get("maxBytes", TEXT_CAP)), int(options.get("maxDocumentBytes", DOCUMENT_CAP))

    def _inner(self, directory: str) -> list[str]:
        at = os.path.join(self.folder, directory)
        return sorted(f"{directory}/{e.name}" if directory else e.name for e in os.scandir(at) if e.is_dir(follow_symlinks=False))

    def partitions(self) -> list[InputPartition]:
        first = self._inner("")
        return [_Folder("", False)] + [_Folder(x, False) for x in first] + [_Folder(y, True) for x in first for y in self._inner(x)]

    def read(self, partition: InputPartition):
        directory, deep = partition.value
        layers = _Layers(self.exclude, self.folder, self.ignore_files)
        parts = directory.split("/") if directory else []
        for n in range(len(parts) + 1):
            layers.enter("/".join(parts[:n]))
            if n and layers.ignores("/".join(parts[:n]) + "/_") and layers.may_prune("/".join(parts[:n])):
                return
        included = rules.parsed_lines(self.include)
        wanted = [(re.compile(rule, re.S), says) for rule, says in included]
        stack = [directory]
        while stack:
            here = stack.pop()
            layers.enter(here)
            for entry in sorted(os.scandir(os.path.join(self.folder, here)), key=lambda e: e.name):
                path = f"{here}/{entry.name}" if here else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if deep and not layers.may_prune(path):
                        stack.append(path)
                    continue
                yield self._told(path, entry, layers, wanted)

    def _told(self, path: str, entry: os.DirEntry, layers: _Layers, wanted: list) -> tuple:
        size, at, content = None, None, None
        try:
            state = entry.stat(follow_symlinks=False)
            size, at = state.st_size, datetime.fromtimestamp(state.st_mtime)
            extension = path.rpartition(".")[2].lower()
            document = extension in DOCUMENT_TYPES
            if ".git" in path.split("/"):
                reason = "git plumbing"
            elif layers.ignores(path):
                reason = "ignored"
            elif wanted and not next((says for pattern, says in reversed(wanted) if pattern.fullmatch(path.lower())), False):
                reason = "not included"
            elif entry.is_symlink():
                reason = "link"
            elif not size:
                reason = "empty file"
            elif size > self.caps[document]:
                reason = "over the size cap"
            else:
                with open(entry.path, "rb") as file:
                    content = file.read()
                reason = "binary" if not document and b"\0" in content[:BINARY_PROBE] else None
                content = content if reason is None else None
        except OSError:
            reason = "unreadable"
        return path, size, at, content, reason


def walk(
    spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, use_ignore_files: bool = True, max_bytes: int = TEXT_CAP, max_document_bytes: int = DOCUMENT_CAP
) -> DataFrame:
    """Every file under ``root``: relative_path, length, modified, content and the first reason to skip it, null if it is read.

    Reasons, in order: git plumbing, ignored, not included, link, empty file, over the size cap, binary; unreadable where
    the file system refuses. What every walk leaves out may be taken back by an ignore file, an ignore file by one of a
    deeper directory, and all by the exclude list. An include list is a separate set a file must match. Only files that
    are kept come with their content.
    """
    spark.dataSource.register(Workspace)
    reader = spark.read.format("workspace").option("include", "\n".join(include or [])).option("exclude", "\n".join(exclude or []))
    reader = reader.option("useIgnoreFiles", str(use_ignore_files)).option("maxBytes", str(max_bytes)).option("maxDocumentBytes", str(max_document_bytes))
    return reader.load(root)


def read_texts(walked: DataFrame) -> DataFrame:
    """The files a walk keeps, decoded, with the hash of their bytes."""
    kept = walked.filter("reason is null")
    return kept.select("relative_path", "length", "modified", F.sha2("content", 256).alias("sha256"), decode_text(F.col("content")).alias("text"))


class _Commits(InputPartition):
    def __init__(self, hashes: list[str]):
        super().__init__(hashes)


class GitLog(DataSource):
    """``spark.read.format("git_log").load(repository)``: one row per commit, messages and patches read per batch of hashes.

    Options: ref, since (a day, from its UTC midnight), maxCommits, merges, pathspecs (one a line), and stashes, which
    reads the stashes instead.
    """

    BATCH = 100
    MAX_PATCH = 64 << 10

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "commit_sha string, author_date string, path string, message string, stat string, diff string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repository = options["path"]
        self.newest = int(options["maxCommits"]) if "maxCommits" in options else None
        self.merges = str(options.get("merges", "false")).lower() == "true"
        self.since = options.get("since")
        self.ref = options.get("ref", "HEAD")
        self.stashes = str(options.get("stashes", "false")).lower() == "true"
        self.pathspecs = [p for p in options.get("pathspecs", "").split("\n") if p]

    def _git(self, *arguments: str, given: str | None = None) -> str:
        return subprocess.run(["git", "-C", self.repository, *arguments], input=given, check=True, capture_output=True, text=True, errors="replace").stdout

    def partitions(self) -> list[InputPartition]:
        flags = [f"--max-count={self.newest}"] * (self.newest is not None) + ["--no-merges"] * (not self.merges) + [f"--since={self.since}T00:00:00Z"] * bool(self.since)
        if self.stashes:
            hashes = self._git("stash", "list", "--format=%H").split()
            return [_Commits(hashes[i : i + GitLog.BATCH]) for i in range(0, len(hashes), GitLog.BATCH)] or [_Commits([])]
        hashes = self._git("log", "--format=%H", *flags, self.ref, "--", *self.pathspecs).split()
        return [_Commits(hashes[i : i + GitLog.BATCH]) for i in range(0, len(hashes), GitLog.BATCH)] or [_Commits([])]

    def read(self, partition: InputPartition):
        """The commits of a batch by three git processes: messages, stats and patches, each split at a mark of its own."""
        if not partition.value:
            return
        mark, shas = f"\1{uuid.uuid4().hex}\1", "\n".join(partition.value)

        def told(*arguments: str) -> dict[str, str]:
            out = self._git("show", "--stdin", *arguments, given=shas)
            return dict(part.split("\0", 1) for part in out.split(mark)[1:])

        messages = told("-s", f"--format={mark}%H%x00%aI%x00%B")
        # a stash is a merge: against the commit it was made on
        parent = ["--first-parent", "-m"] * self.stashes
        stats = told("--stat", *parent, f"--format={mark}%H%x00")
        patches = told("--patch", *parent, f"--format={mark}%H%x00")
        kind = "stashes" if self.stashes else "commits"
        for sha in partition.value:
            date, message = messages[sha].split("\0", 1)
            patch = patches[sha].lstrip("\n")
            if len(patch.encode()) > GitLog.MAX_PATCH:
                patch = f"[diff of {len(patch.encode()):,} bytes not included: over the {GitLog.MAX_PATCH:,} byte limit]"
            yield sha, date, f"{kind}/{date[:10]}-{sha[:12]}", message.strip(), stats[sha].strip(), patch
