"""Ignore and attribute rules in layers: which rule decides about a path.

A rule lies at a directory (``base``, "" for the root) of a ``scope`` such as a source. Of the rules that match a path the
one of the deepest directory decides, then of the highest rank, then the last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import globs
from sparkloom.runtime import broadcast_if_small

MAX_BROADCAST_RULES = 500_000


def folded_path(path: Column) -> Column:
    """A path as rules see it: lower case, ``/`` between segments, no leading ``./``."""
    return F.regexp_replace(F.lower(F.regexp_replace(path, r"\\", "/")), r"^(?:\./)+", "")


def parsed_lines(lines: list[str] | None) -> list[tuple[str, bool]]:
    """(regular expression, excludes) of the usable lines of an ignore file."""
    return [(rule[1], not rule[0]) for line in lines or [] if line and (rule := globs.usable(line))]


def with_verdict(files: DataFrame, rules: DataFrame, name: str = "verdict", path: str = "path", scope: str = "scope") -> DataFrame:
    """``files`` with what the rules say of each: ``path`` is folded, ``rules`` are (scope, base, rank, no, rule, says).

    The rules above each directory are put in order once; files meet the order of their directory in an equality join,
    and the first rule of it that matches decides. Where none does, or path or scope is null, the verdict is null.
    """
    placed = files.withColumn("_dir", F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("_dir", "/"))), lambda n: F.array_join(F.slice(F.split("_dir", "/"), 1, n), "/"))
    bases = F.array_distinct(F.when(F.col("_dir") == "", F.array(F.lit(""))).otherwise(above))
    dirs = placed.select(F.col(scope).alias("_scope"), "_dir").distinct().select("_scope", "_dir", F.explode(bases).alias("base"))
    layers = rules.select(F.col("scope").alias("_scope"), "base", "rank", "no", "rule", "says")
    order = F.struct((-F.length("base")).alias("depth"), (-F.col("rank")).alias("up"), (-F.col("no")).alias("back"), "base", "rule", "says")
    orders = dirs.join(broadcast_if_small(layers, MAX_BROADCAST_RULES), ["_scope", "base"]).groupBy("_scope", "_dir").agg(F.array_sort(F.collect_list(order)).alias("_rules"))
    at = placed.withColumn("_scope", F.col(scope)).join(broadcast_if_small(orders, MAX_BROADCAST_RULES), ["_scope", "_dir"], "left")
    held = f"filter(_rules, r -> rlike(substring({path}, if(r.base = '', 1, length(r.base) + 2)), concat('^(?:', r.rule, ')$')))"
    return at.withColumn(name, F.expr(f"get({held}, 0).says")).drop("_dir", "_scope", "_rules")


def decided(files: DataFrame, rules: DataFrame, key: str, path: str = "path", scope: str = "scope") -> DataFrame:
    """(key, verdict) of every file that a rule matches, as :func:`with_verdict` says."""
    return with_verdict(files.select(key, path, scope), rules, "verdict", path, scope).filter("verdict IS NOT NULL").select(key, "verdict")
