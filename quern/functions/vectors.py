"""Vector functions: array<float> columns for single rows, numpy blocks for many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """At unit length; zero vectors stay. The norm is a variable of its own, or every element would work it out again."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(1.0)))[0]


def scale_of(v: Column) -> Column:
    """The largest magnitude over 127; 1 for zero vectors."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, top / 127).otherwise(1.0)


def quantize(v: Column, scale: Column) -> Column:
    """Half-even rounded to -127..127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x.cast("double") / scale))).cast("tinyint"))


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: (x * scale).cast("float"))


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the unit mean of each key's vectors; partial means are combined before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = df.where(F.col(vector).isNotNull()).groupBy(key).agg(Summarizer.mean(array_to_vector(F.col(vector))).alias("v"))
    return means.select(key, normalize(vector_to_array("v")).alias(vector))


def top_k(df: DataFrame, by: list[str], score: str, ties: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each ``by`` with their rank from 1; a literal bound lets each task cut before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
