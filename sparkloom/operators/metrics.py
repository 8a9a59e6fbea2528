"""Retrieval quality: hits at k, reciprocal ranks, sweeps, abstention, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import broadcast_if_small, cut_lineage

CUTOFFS = (1, 3, 5)
RESAMPLES = 5000
MAX_QUESTIONS = 100_000


def quality(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``by``: questions, hit@1/3/5, mean reciprocal rank and misses of the first right rank (null: none)."""
    hits = [F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_{k}") for k in CUTOFFS]
    mrr = F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    return ranks.groupBy(*by).agg(F.count("*").alias("questions"), *hits, mrr, F.count_if(F.col("rank").isNull()).alias("misses"))


def sweep(runs: DataFrame, axes: list[str], value: str) -> DataFrame:
    """Mean, best and worst of ``value`` along every axis by itself, as one grouping-sets pass."""
    runs.createOrReplaceTempView("_sweep_runs")
    sets = ", ".join(f"({a})" for a in axes)
    names = ", ".join(f"CAST({a} AS STRING) AS {a}" for a in axes)
    return runs.sparkSession.sql(
        f"SELECT {names}, round(avg({value}), 6) AS mean, round(max({value}), 6) AS best, round(min({value}), 6) AS worst FROM _sweep_runs GROUP BY GROUPING SETS ({sets})"
    )


def _with_below(counts: DataFrame, score: str, count: str) -> DataFrame:
    """``counts`` (one row per score) with ``below``: the sum of ``count`` over all lower scores, run by range of scores.

    Ranges hold about as many scores each, however these are spread; one row a range is summed over all.
    """
    ranged = cut_lineage(counts.repartitionByRange(score).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(count).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(broadcast_if_small(sums), "_range")
    return joined.withColumn("below", F.col("_before") + F.coalesce(F.sum(count).over(within), F.lit(0))).drop("_range", "_before")


def auc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the curve by rank sums, ties counted half. Ranks come from counts per score, so equal scores may abound."""
    counts = scored.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = _with_below(counts, score, "n")
    pairs = below.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return pairs.select(F.round(F.col("s") / (F.col("p") * F.col("n")), 6).alias("auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def threshold_keeping(scored: DataFrame, score: str, positive: str, retention: float) -> DataFrame:
    """(threshold, kept, passed): the largest score that keeps ``retention`` of the positives, and the shares of positives and negatives it lets through."""
    known = scored.filter(F.col(score).isNotNull())
    counts = known.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    total = counts.agg(F.sum("p").alias("_p"), F.sum("n").alias("_n")).withColumn("_lose", F.floor(F.col("_p") * F.lit(1 - retention) + F.lit(1e-9)))
    # of the positives in order of score, the one after those that may be lost
    at = _with_below(counts, score, "p").join(F.broadcast(total)).filter((F.col("below") <= F.col("_lose")) & (F.col("below") + F.col("p") > F.col("_lose"))).select(F.col(score).alias("threshold"), "_p", "_n")
    over = known.join(F.broadcast(at)).filter(F.col(score) >= F.col("threshold"))
    told = over.groupBy("threshold", "_p", "_n").agg(F.count_if(positive).alias("kp"), F.count_if(~F.col(positive)).alias("kn"))
    return told.select("threshold", F.round(F.col("kp") / F.col("_p"), 6).alias("kept"), F.round(F.col("kn") / F.col("_n"), 6).alias("passed"))


def score_gaps(ranked: DataFrame, query_key: str) -> DataFrame:
    """Per question the best score, how far it lies above the second, and the hits it has."""
    score = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    return ranked.groupBy(query_key).agg(score(1).alias("top"), F.round(score(1) - F.coalesce(score(2), F.lit(0.0)), 6).alias("gap"), F.count("*").alias("hits"))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    p, n = successes / total, total.cast("double")
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.round((middle - spread) / scale, 6), F.round((middle + spread) / scale, 6)


def paired_bootstrap(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = 7) -> DataFrame:
    """(mean, low, high): mean difference a - b of paired questions, and the means of rank 2.5 % and 97.5 % of the resamples.

    Draw j of resample r is a question chosen by the MD5 of (seed, r, j), so that every run draws the same. Questions
    are a stated set of at most ``MAX_QUESTIONS``, numbered by id; the draws are spread over the cluster.
    """
    numbered = pairs.select("id", (F.col("a") - F.col("b")).alias("d")).filter(F.col("d").isNotNull())
    n = numbered.limit(MAX_QUESTIONS + 1).count()
    if n > MAX_QUESTIONS:
        raise ValueError(f"more than {MAX_QUESTIONS} questions to resample")
    ranked = numbered.withColumn("_k", F.row_number().over(Window.orderBy("id")) - 1)
    spark = pairs.sparkSession
    draws = spark.range(resamples).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("j"))
    digest = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("r").cast("string"), F.col("j").cast("string")).cast("binary")), 1, 8)
    draws = draws.select("r", (F.conv(digest, 16, 10).cast("long") % F.lit(max(n, 1))).cast("int").alias("_k"))
    means = draws.join(F.broadcast(ranked.select("_k", "d")), "_k").groupBy("r").agg(F.round(F.avg("d"), 9).alias("m"))
    order = F.row_number().over(Window.orderBy("m")) - 1  # one row a resample
    placed = means.select("m", order.alias("_at"))
    at = lambda share: F.max(F.when(F.col("_at") == int(resamples * share), F.col("m")))
    whole = ranked.agg(F.round(F.avg("d"), 9).alias("mean"))
    return placed.agg(F.round(at(0.025), 6).alias("low"), F.round(at(0.975), 6).alias("high")).join(F.broadcast(whole)).select(F.round("mean", 6).alias("mean"), "low", "high")


def overlap(left: DataFrame, right: DataFrame, query_key: str, key: str, k: int = 5) -> DataFrame:
    """How many of two lists' first k keys agree, per query."""
    a = left.filter(F.col("rank") <= k).groupBy(query_key).agg(F.collect_set(key).alias("a"))
    b = right.filter(F.col("rank") <= k).groupBy(query_key).agg(F.collect_set(key).alias("b"))
    return a.join(b, query_key).select(query_key, F.size(F.array_intersect("a", "b")).alias("shared"))
