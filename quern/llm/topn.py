"""Problem 6: the N highest-scoring items of every group under one tie rule.

Method: descending score bands.  Rows are split by score into bands and written
band by band; bands are processed from the top, groups that are already full are
anti-joined away, and what a band offers a group beyond its open places is cut
by an exact ranking (score descending, then item ascending).  A group of any
size is ranked from the first rows of each map task, so none is gathered.

Defined results: rows with a null group, item or score or a NaN score are left
out; a repeated (group, item) counts once with its highest score; ties go to the
smaller item; groups with fewer than N items keep all; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import materialize, scratch

#: Shares of all rows above each band's lower edge; the last band takes the rest.
SHARES = (0.08, 0.2, 0.45)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(group, item, score, rank) of the ``n`` best items of every group."""
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s")).where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    best = rows.groupBy("g", "i").agg(F.max("s").alias("s"))
    edges = rows.agg(F.percentile_approx("s", [1 - x for x in shares], 1000)).first()[0] or [] if shares else []
    band = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        band = F.when(F.col("s") >= edges[k], k).otherwise(band)
    at = scratch(spark)
    best.withColumn("band", band).write.partitionBy("band").option("compression", "zstd").parquet(at)
    banded = spark.read.schema("g " + dict(rows.dtypes)["g"] + ", i " + dict(rows.dtypes)["i"] + ", s double, band int").parquet(at)

    order = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc())
    taken, have = None, None
    for k in range(len(edges) + 1):
        offered = banded.where(F.col("band") == k).select("g", "i", "s")
        if have is not None:
            offered = offered.join(have.where(F.col("have") >= n).select("g"), "g", "left_anti")
        ranked = offered.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
        if have is not None:
            ranked = ranked.join(have, "g", "left").withColumn("r", F.col("r") + F.coalesce("have", F.lit(0))).where(F.col("r") <= n).drop("have")
        now = materialize(ranked.select("g", "i", "s", F.col("r").cast("int").alias("r")))
        taken = now if taken is None else taken.unionByName(now)
        have = taken.groupBy("g").agg(F.max("r").alias("have"))
    return taken.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias("rank"))
