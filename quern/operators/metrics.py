"""Retrieval quality: ranks, recall, reciprocal rank, confidence, agreement, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.runtime import broadcast_below, numbered


def best_ranks(scores: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rank): how many documents score strictly higher than the best relevant one; null without a score.

    ``scores`` has (query_id, row_id, score), ``relevant`` (query_id, row_id).
    """
    best = scores.join(relevant, ["query_id", "row_id"], "left_semi").groupBy("query_id").agg(F.max("score").alias("mark"))
    above = scores.join(broadcast_below(best, 1_000_000), "query_id").groupBy("query_id").agg(F.sum((F.col("score") > F.col("mark")).cast("long")).alias("rank"))
    return relevant.select("query_id").distinct().join(above, "query_id", "left")


def recall_mrr(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, r1, r5, r10, r20 (percent) and mrr; queries without a rank count 0."""
    at = lambda k: (100 * F.avg(F.coalesce((F.col("rank") < k).cast("double"), F.lit(0.0)))).alias(f"r{k}")
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n"), at(1), at(5), at(10), at(20), F.avg(F.coalesce(1 / (F.col("rank") + 1), F.lit(0.0))).alias("mrr"))


def bootstrap_interval(ranks: DataFrame, value, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(low, high): the 2.5 and 97.5 percentiles of the mean of ``value(rank)`` over resamples.

    A row's weight in a resample is a Poisson(1) draw from a hash of both, so
    nothing is gathered: each resample is one sum over all rows.
    """
    spark = ranks.sparkSession
    rows = ranks.select("query_id", value(F.col("rank")).alias("v"))
    u = X.uniform(F.col("query_id"), F.col("b"), seed)
    steps, total, p = [], 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        steps.append(total)
        p /= k
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    draws = rows.join(F.broadcast(spark.range(resamples).withColumnRenamed("id", "b")), F.lit(True)).withColumn("w", weight)  # a stated number of resamples
    means = draws.groupBy("b").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def coverage(queries: DataFrame, slots: DataFrame) -> DataFrame:
    """(n, covered): the percentage of queries that have a slot."""
    some = slots.select("query_id").distinct().withColumn("has", F.lit(1))
    return queries.select("query_id").join(some, "query_id", "left").agg(F.count("*").alias("n"), (100 * F.avg(F.coalesce("has", F.lit(0)))).alias("covered"))


def agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, agreement): the share of the first ``k`` that two ranked lists have in common."""
    top = lambda x: x.where(F.col("rank") <= k).select("query_id", "row_id")
    both = top(a).join(top(b), ["query_id", "row_id"]).groupBy("query_id").agg(F.count("*").alias("n"))
    return top(a).select("query_id").distinct().join(both, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / k).alias("agreement"))


def floor_percentiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """(q, value): the element at place floor(q * (n - 1)) of the ascending values, by rank without gathering them."""
    ranked = numbered(df.where(F.col(value).isNotNull()).select(F.col(value).alias("value")), ["value"], "place")
    n = ranked.agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(float(q),) for q in at], "q double").join(n, F.lit(True)).select("q", F.floor(F.col("q") * (F.col("n") - 1)).alias("place"))
    return ranked.join(F.broadcast(wanted), "place").select("q", "value")


def propose_gate(probes: DataFrame, relevant: DataFrame) -> DataFrame:
    """(exact, fallback_only): floors from the top scores of probes that must fail and of queries that must pass."""
    p = probes.agg(F.max("top").alias("p"))
    r = relevant.agg(F.min("top").alias("r"))
    return p.join(r, F.lit(True)).select(F.round(F.least(F.lit(0.3), F.coalesce(F.col("r") - 0.005, F.lit(0.3))), 3).alias("exact"), F.coalesce(F.round(F.col("p") + 0.01, 3), F.lit(0.635)).alias("fallback_only"))


def calibrate(asked: DataFrame, hits: DataFrame, relevant: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(floors, report) of the gate from sets of queries.

    ``asked`` has (set, query_id, must_fail), ``hits`` (query_id, row_id, score,
    rank, exact_slots) and ``relevant`` (query_id, row_id).  The floor of queries
    with a whole-word slot lies just below the least top score of those whose
    answer is among the first ``k``, 0.3 at most; that of fallback-only queries just
    above the best top score of a probe that must fail.  The report has, by set,
    how many queries there are, without a slot, of either kind, passed, and lost
    although the answer was among the first ``k``.
    """
    top = hits.groupBy("query_id").agg(F.max("score").alias("top"), F.max("exact_slots").alias("exact_slots"))
    rank = hits.join(relevant.select("query_id", "row_id").distinct(), ["query_id", "row_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    rows = asked.join(top, "query_id", "left").join(rank, "query_id", "left")
    whole, known = F.coalesce("exact_slots", F.lit(0)) > 0, F.col("top").isNotNull()
    answered = known & (F.coalesce("rank", F.lit(k + 1)) <= k)
    floors = rows.agg(
        F.round(F.least(F.lit(0.3), F.min(F.when(answered & whole & ~F.col("must_fail"), F.col("top") - 0.005))), 3).alias("exact"),
        F.coalesce(F.round(F.max(F.when(known & ~whole & F.col("must_fail"), F.col("top"))) + 0.01, 3), F.lit(0.635)).alias("fallback_only"),
    )
    passed = known & (F.col("top") >= F.when(whole, F.col("exact")).otherwise(F.col("fallback_only")))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    report = rows.join(F.broadcast(floors), F.lit(True)).groupBy("set").agg(F.count("*").alias("n"), n(~known).alias("no_slot"), n(known & whole).alias("exact"), n(known & ~whole).alias("fallback_only"), n(passed).alias("passed"), n(answered & ~passed).alias("lost"))  # one row
    return floors, report
