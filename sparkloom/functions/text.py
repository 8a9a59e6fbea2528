"""Terms, phrases, paths, languages and identities as built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that are no terms, and the lengths a term may have
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "by", "is", "are",
    "was", "were", "be", "been", "it", "its", "this", "that", "with", "as", "from",
    "how", "what", "why", "we", "you", "i", "do", "does", "did",
)
MIN_TERM, MAX_TERM = 2, 64

# fixed values: languages by file-name extension
LANGUAGES = {
    "csharp": ("cs", "csx"),
    "fsharp": ("fs", "fsx"),
    "vb": ("vb",),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "scala": ("scala",),
    "swift": ("swift",),
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "python": ("py", "pyi"),
    "ruby": ("rb",),
    "go": ("go",),
    "rust": ("rs",),
    "php": ("php",),
    "lua": ("lua",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh"),
    "sql": ("sql",),
    "css": ("css",),
    "scss": ("scss",),
    "less": ("less",),
    "shell": ("sh", "bash", "zsh"),
    "powershell": ("ps1", "psm1"),
    "html": ("html", "htm"),
    "razor": ("razor", "cshtml"),
    "vue": ("vue",),
    "svelte": ("svelte",),
    "markdown": ("md", "markdown"),
    "json": ("json", "jsonc"),
    "yaml": ("yml", "yaml"),
    "toml": ("toml",),
    "xml": ("xml", "csproj", "props", "targets"),
    "text": ("txt", "log"),
    "dockerfile": ("dockerfile",),
}

# fixed values: media types by language; all others are plain text
MEDIA_TYPES = {
    "csharp": "text/x-csharp",
    "typescript": "text/x-typescript",
    "javascript": "text/javascript",
    "python": "text/x-python",
    "markdown": "text/markdown",
    "html": "text/html",
    "json": "application/json",
    "yaml": "application/yaml",
    "sql": "application/sql",
}

# fixed values: definitions by language, group 1 and 2 hold the name
SYMBOLS = {
    "csharp": r"\b(?:class|struct|interface|enum|record)\s+(\w+)|\b(?:public|private|protected|internal)\s+(?:static\s+|async\s+|virtual\s+|override\s+|sealed\s+)*[\w<>\[\],\s]+?\s+(\w+)\s*\(",
    "typescript": r"\b(?:class|interface|type|enum)\s+(\w+)|\b(?:function|const|let)\s+(\w+)",
    "javascript": r"\b(?:class)\s+(\w+)|\b(?:function|const|let)\s+(\w+)",
    "python": r"(?m)^\s*(?:async\s+)?(?:def|class)\s+(\w+)",
    "go": r"(?m)^\s*(?:func|type)\s+(?:\([^)]*\)\s*)?(\w+)",
    "rust": r"(?m)^\s*(?:pub\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl)\s+(\w+)",
    "java": r"\b(?:class|interface|enum|record)\s+(\w+)|\b(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\],\s]+?\s+(\w+)\s*\(",
}
MAX_SYMBOLS = 32

_RUN = r"[\p{L}\p{Nd}]+"
_INNER = r"(?<=[^\p{Lu}])(?=\p{Lu})|(?<=\p{Nd})(?=[^\p{Nd}])|(?<=[^\p{Nd}])(?=\p{Nd})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
MAX_PHRASE = 500


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits, each followed by its parts where it is a compound."""
    runs = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))

    def spread(run: Column) -> Column:
        parts = F.split(run, _INNER)
        return F.when(F.size(parts) > 1, F.concat(F.array(F.lower(run)), F.transform(parts, F.lower))).otherwise(F.array(F.lower(run)))

    return F.flatten(F.transform(runs, spread))


def terms(text: Column) -> Column:
    """Tokens that count: of 2 to 64 characters and no stop word. Null text has null terms."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(tokenize(text), lambda t: F.length(t).between(MIN_TERM, MAX_TERM) & ~F.array_contains(stop, t))


def term_rows(frame: DataFrame, key: str, text: str, by: list[str] = ()) -> DataFrame:
    """(key, by…, term) for every occurrence: :func:`terms` spread out, step by step so that no lambda is interpreted."""
    runs = frame.select(key, *by, F.explode(F.regexp_extract_all(F.col(text), F.lit(_RUN), F.lit(0))).alias("_run"))
    parts = F.split("_run", _INNER)
    spread = runs.select(key, *by, F.explode(F.when(F.size(parts) > 1, F.concat(F.array("_run"), parts)).otherwise(F.array("_run"))).alias("_part"))
    return spread.select(key, *by, F.lower("_part").alias("term")).filter(F.length("term").between(MIN_TERM, MAX_TERM) & ~F.col("term").isin(*STOP_WORDS))


def term_hash(term: Column) -> Column:
    """FNV-1a over UTF-8 bytes, 32 bits, masked to 31: the same in every process."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.octet_length(term), F.lit(1)).cast("int")),
        lambda i: F.conv(F.substring(F.hex(F.encode(term, "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("long"),
    )
    step = lambda acc, b: (acc.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    start = F.lit(2166136261).cast("long")
    return F.when(F.octet_length(term) == 0, start).otherwise(F.aggregate(pairs, start, step)).bitwiseAND(F.lit(2147483647))


class PhraseRefused(ValueError):
    pass


def phrase_pattern(phrase: str | None) -> str | None:
    """A pattern for the phrase's words, adjacent and in order; None for a blank phrase, which filters nothing."""
    if phrase is None or not phrase.strip():
        return None
    if len(phrase) > MAX_PHRASE:
        raise PhraseRefused(f"a phrase has at most {MAX_PHRASE} characters")
    words = re.findall(r"[^\W_]+", phrase)
    if not words:
        raise PhraseRefused("a phrase needs a letter or a digit")
    return r"(?iu)(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(words) + r"(?![\p{L}\p{N}])"


def path_segments(path: Column) -> Column:
    """Lower-case segments of a path, separators made one, empty and ``.`` segments dropped."""
    parts = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/")
    return F.filter(parts, lambda p: (p != "") & (p != "."))


def path_prefixes(path: Column) -> Column:
    """Every prefix of whole segments, shortest first."""
    parts = path_segments(path)
    upto = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))
    return F.when(F.size(parts) > 0, F.transform(upto, lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def under_prefix(path: Column, prefix: Column) -> Column:
    """Whether ``path`` lies under ``prefix`` at a whole segment; a blank prefix is no condition."""
    wanted = F.array_join(path_segments(prefix), "/")
    return (wanted == "") | F.array_contains(path_prefixes(path), wanted)


def language_of(path: Column) -> Column:
    """The language of a file by its name."""
    name = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    verdict = F.lit("text")
    for language, extensions in LANGUAGES.items():
        verdict = F.when(extension.isin(*extensions), language).otherwise(verdict)
    return (
        F.when(F.lower(name).startswith("dockerfile"), "dockerfile")
        .when(name.startswith(".") & ~F.substring(name, 2, 10_000).contains("."), "text")
        .otherwise(verdict)
    )


def media_type(language: Column) -> Column:
    verdict = F.lit("text/plain")
    for name, kind in MEDIA_TYPES.items():
        verdict = F.when(language == name, kind).otherwise(verdict)
    return verdict


def symbols_of(language: Column, text: Column) -> Column:
    """Distinct names a text defines, in order, at most 32; empty for languages without a pattern."""
    verdict = F.array().cast("array<string>")
    for name, pattern in SYMBOLS.items():
        groups = re.compile(pattern).groups
        found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
        zipped = F.zip_with(found[0], found[1], lambda a, b: F.when(a != "", a).otherwise(b)) if groups == 2 else found[0]
        names = F.slice(F.array_distinct(F.filter(zipped, lambda s: s != "")), 1, MAX_SYMBOLS)
        verdict = F.when(language == name, names).otherwise(verdict)
    return verdict


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint(blob: Column, path: Column, sentence_aware: bool = False, heading_context: bool = False, provider: str = "none", model: str = "none", templates: str = "raw", extractor: int = 6, chunker: int = 2) -> Column:
    """What the chunks of a file depend on, hashed: its bytes, the set's columns, the model with its templates, and the versions.

    Markdown files have a chunker version of their own.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    version = F.when(F.lower(path).rlike(r"\.(md|markdown)$"), f"c{chunker}m").otherwise(f"c{chunker}")
    settings = [text(name) for name in ("chunk_size", "chunk_overlap", "chars_per_token", "boundary_mode", "custom_pattern", "unit_aware")]
    fixed = [str(sentence_aware).lower(), str(heading_context).lower(), provider, model, f"t{templates}", f"x{extractor}"]
    return F.sha2(F.concat_ws("|", F.coalesce(blob, F.lit("")), *settings, *map(F.lit, fixed), version), 256)


def chunk_id(set_id: Column, source_id: Column, path: Column, index: Column) -> Column:
    """The chunk's identity: its key's SHA-256 folded into a version-5 UUID, so that a re-run replaces it."""
    digest = F.sha2(F.concat_ws("|", set_id, source_id, path, index.cast("string")), 256)
    nibble = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    # the first three fields are little-endian
    pairs = [F.substring(digest, 2 * i + 1, 2) for i in range(16)]
    sixth = F.concat(F.lit("5"), F.substring(digest, 14, 1))
    eighth = F.concat(nibble, F.substring(digest, 18, 1))
    return F.concat(
        pairs[3], pairs[2], pairs[1], pairs[0], F.lit("-"), pairs[5], pairs[4], F.lit("-"), pairs[7], sixth, F.lit("-"), eighth, pairs[9], F.lit("-"), *pairs[10:]
    )
