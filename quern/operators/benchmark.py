"""Synthetic query variants and deterministic samples for retrieval benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X


def sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows by the order of an MD5: the sampling operator of the benchmark."""
    return df.withColumn("_h", X.draw(F.lit(1 << 48), F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def query_set(articles: DataFrame, every: int = 50) -> DataFrame:
    """(query_id, text): one query for each article whose row ``every`` divides, of six kinds in turn.

    Its title, its two keywords as they are, with the first letter's vowel
    moved on by one, with the first split, both merged, its first two tags; the
    title where an article lacks what a kind needs.
    """
    a = articles.where(F.col("row_id") % every == 0).withColumn("k", X.title_keywords(F.col("title")))
    kind = F.floor(F.col("row_id") / every) % 6
    x, y, gap = F.col("k")[0], F.col("k")[1], F.lit(" ")
    half = F.greatest(F.floor(F.length(x) / 2).cast("int"), F.lit(1))
    at = F.ascii(x) - 0xAC00
    other = F.when(at.between(0, 11171), F.concat(X.from_code((at + 28) % 11172 + 0xAC00), F.substring(x, F.lit(2), F.length(x)))).otherwise(x)
    made = F.when(kind == 1, F.concat(x, gap, y)).when(kind == 2, F.concat(other, gap, y)).when(kind == 3, F.concat(F.substring(x, F.lit(1), half), gap, F.substring(x, half + 1, F.length(x)), gap, y)).when(kind == 4, F.concat(x, y))
    tags = F.nullif(F.array_join(F.slice("tags", 1, 2), " "), F.lit(""))
    text = F.coalesce(F.when(kind == 5, tags).when((kind > 0) & (F.size("k") == 2), made), F.col("title"), F.lit(""))
    return a.select(F.col("row_id").alias("query_id"), text.alias("text"))


def variants(articles: DataFrame, seed: int = 7) -> DataFrame:
    """(article, variant, text): the two longest title words clean, with a typo, the first split, both merged."""
    k = articles.select(F.col("id").alias("article"), X.title_keywords(F.col("title")).alias("k")).where(F.size("k") == 2)
    a, b, gap = F.col("k")[0], F.col("k")[1], F.lit(" ")
    half = F.greatest(F.floor(F.length(a) / 2).cast("int"), F.lit(1))
    one = lambda name, text: F.struct(F.lit(name).alias("variant"), text.alias("text"))
    rows = F.array(
        one("clean", F.concat(a, gap, b)),
        one("typo", F.concat(X.inject_typo(a, F.concat(F.col("article"), F.lit(str(seed)))), gap, b)),
        one("split", F.concat(F.substring(a, F.lit(1), half), gap, F.substring(a, half + 1, F.length(a)), gap, b)),
        one("merged", F.concat(a, b)),
    )
    return k.select("article", F.inline(rows))
