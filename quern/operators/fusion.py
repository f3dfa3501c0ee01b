"""Two ranked lists into one: the relevance gate, the fusion, and the whole search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import keyword
from quern.runtime import materialize

# The floors of the relevance gate.
GATE = {"exact": 0.3, "fallback_only": 0.635}


def gate(semantic: DataFrame, encoded: DataFrame | None = None, exact: float = GATE["exact"], fallback_only: float = GATE["fallback_only"]) -> DataFrame:
    """The lists whose best score reaches the floor: ``exact`` for queries with a whole-word slot, else ``fallback_only``.

    ``encoded`` has (query_id, exact_slots), if the lists themselves do not;
    without either every query counts as exact.
    """
    top = F.max("score").over(Window.partitionBy("query_id"))
    floor = F.lit(exact)
    if "exact_slots" in semantic.columns:
        floor = F.when(F.coalesce("exact_slots", F.lit(0)) > 0, exact).otherwise(fallback_only)
    elif encoded is not None:
        semantic = semantic.join(encoded.select("query_id", "exact_slots"), "query_id", "left")
        floor = F.when(F.coalesce("exact_slots", F.lit(0)) > 0, exact).otherwise(fallback_only)
    return semantic.withColumn("_top", top).where(F.col("_top") >= floor).drop("_top", "exact_slots")


def fuse(words: DataFrame, semantic: DataFrame, queries: DataFrame, corrected: DataFrame | None = None, k: int = 20) -> DataFrame:
    """(query_id, row_id, score, source, tier, rank): the leading list, then the other, each document once.

    ``words`` and ``semantic`` have (query_id, row_id, score, rank).  The keyword
    list leads if it is strong, the query was not corrected and it shares too
    little with the first ten semantic hits.
    """
    size = queries.select("query_id", F.size(X.words(F.col("text"))).alias("tokens"))
    if corrected is None:
        size = size.withColumn("corrected", F.lit(False))
    else:
        size = size.join(corrected.select("query_id", F.lit(True).alias("corrected")), "query_id", "left").fillna(False, ["corrected"])
    kw = words.groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    shared = semantic.where("rank <= 10").join(words.select("query_id", "row_id"), ["query_id", "row_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("shared"))
    strong = F.col("best") >= F.when(F.col("tokens") <= 3, 0.65).otherwise(0.9)
    distrust = ~F.col("corrected") & strong & (F.coalesce("shared", F.lit(0)) / F.least(F.lit(10), F.col("n")) < 0.3)
    lead = size.join(kw, "query_id", "left").join(shared, "query_id", "left").select("query_id", F.when(F.coalesce(distrust, F.lit(False)), "keyword").otherwise("semantic").alias("led"), (F.coalesce("n", F.lit(0)) > 0).alias("has_words"))
    both = words.withColumn("source", F.lit("keyword")).unionByName(semantic.withColumn("source", F.lit("semantic")), allowMissingColumns=True).select("query_id", "row_id", "score", "rank", "source")
    placed = both.join(lead, "query_id").withColumn("second", (F.col("source") != F.col("led")).cast("int"))
    once = placed.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "row_id").orderBy("second"))).where("_n = 1")
    some = semantic.select("query_id").distinct().withColumn("reached", F.lit(True))
    order = Window.partitionBy("query_id").orderBy("second", "rank")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(some, "query_id", "left")
    return ranked.select("query_id", "row_id", "score", "source", F.when(F.col("reached"), F.col("led")).otherwise("keyword").alias("tier"), "rank")


def search(queries: DataFrame, meta: DataFrame, terms: DataFrame, semantic=None, exact_mode: bool = False, allow_correction: bool = True, k: int = 20) -> DataFrame:
    """The whole search of a set of queries; ``semantic`` maps queries (query_id, text) to (query_id, row_id, score, rank[, exact_slots])."""
    words = materialize(keyword.keyword_search(queries, meta, terms, k))  # ``k`` rows a query, read several times
    if exact_mode:
        hits = words.where(F.col("score") >= keyword.LITERAL)
        return hits.select("query_id", "row_id", "score", F.lit("keyword").alias("source"), F.lit("keyword").alias("tier"), "rank")
    if semantic is None:
        return words.select("query_id", "row_id", "score", F.lit("keyword").alias("source"), F.lit("keyword").alias("tier"), "rank")
    fixed = materialize(keyword.correct(queries, meta, keyword.vocabulary(terms))) if allow_correction else None
    asked = queries if fixed is None else queries.join(fixed, "query_id", "left").select("query_id", F.coalesce("corrected", "text").alias("text"))
    return fuse(words, materialize(gate(semantic(asked))), queries, fixed, k)


def respond(queries: DataFrame, meta: DataFrame, terms: DataFrame, semantic=None, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, corrections, tags) of a set of queries: what a search page shows for each."""
    hits = search(queries, meta, terms, semantic, **how)
    fixed = keyword.correct(queries, meta, keyword.vocabulary(terms))
    return hits, fixed, keyword.match_tags(queries, keyword.tag_counts(meta))


class Tickets:
    """Numbers for searches in flight: an answer whose ticket is no longer the newest is stale and left out."""

    def __init__(self) -> None:
        self._newest = 0

    def take(self) -> int:
        self._newest += 1
        return self._newest

    def fresh(self, ticket: int) -> bool:
        return ticket == self._newest


def progressive(queries: DataFrame, meta: DataFrame, terms: DataFrame, semantic=None, tickets: Tickets | None = None, **how):
    """Yields ("keyword", hits) first and ("fused", hits) when the semantic side is there; nothing more once a newer search has a ticket."""
    tickets = tickets or Tickets()
    own = tickets.take()
    yield "keyword", search(queries, meta, terms, **how)
    if semantic is not None and not how.get("exact_mode") and tickets.fresh(own):
        fused = search(queries, meta, terms, semantic, **how)
        if tickets.fresh(own):
            yield "fused", fused
