"""The chunk table as a store: idempotent upserts and deletes without a table format that has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` with the rows of ``fresh`` in place of those with the same key; a repeated run changes nothing."""
    kept = existing.join(fresh.select(*key).distinct(), key, "left_anti")
    rest = [c for c in existing.columns if c not in key]
    # of several rows with one key the greatest stays, so that a retry keeps the same one
    one = fresh.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, *(F.col(f"_r.{c}") for c in rest)) if rest else fresh.select(*key).distinct()
    return kept.unionByName(one)


def without(existing: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` less every row whose key is in ``gone``: by file, by set or by corpus, as the key says."""
    return existing.join(gone.select(*key).distinct(), key, "left_anti")


def replace_partitions(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Write ``rows``, replacing only the partitions they touch."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def framed(template: Column, text: Column) -> Column:
    """A model's template with the text in place of its mark; a null template is the text itself."""
    return F.coalesce(F.replace(template, F.lit("{text}"), text), text)


def same_model(measured: Column, recorded: Column, least: float = 0.999) -> Column:
    """Whether two vectors of one constant text come from one model: cosine at least ``least``; unequal lengths never do."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(dot(measured, measured) * dot(recorded, recorded))
    cosine = F.when((F.size(measured) == F.size(recorded)) & (norms > 0), dot(measured, recorded) / norms).otherwise(0.0)
    return F.coalesce(cosine >= least, F.lit(False))
