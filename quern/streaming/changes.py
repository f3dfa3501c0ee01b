"""Change detection of a source, in batch and as a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.runtime import exists, materialize
from quern.sources.articles import ARTICLE

UNIT = "\x1f"


def row_digests(df: DataFrame, fields: list[str]) -> DataFrame:
    """(digest) of every row: SHA-256 of its fields as text; null differs from empty."""
    return df.select(F.sha2(F.concat_ws(UNIT, *(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields)), 256).alias("digest"))


def source_digest(df: DataFrame, fields: list[str]) -> DataFrame:
    """(n, digest) of a source whatever its order: the rows' digests are added up in four lanes of 60 bits.

    Sums are combined on the map side, so a task sends five numbers.
    """
    lane = lambda k: F.sum(F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    n = F.count("*")
    return row_digests(df, fields).agg(n.alias("n"), F.sha2(F.concat_ws("|", n.cast("string"), *(F.coalesce(lane(k), F.lit("0")) for k in range(4))), 256).alias("digest"))


def list_digest(df: DataFrame, value: str, order: str) -> DataFrame:
    """(digest): SHA-1 of a bounded list, one line each in its order: the fingerprint of a vocabulary."""
    return df.agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n")).alias("digest"))


def changed(df: DataFrame, fields: list[str], marker: str) -> bool:
    """Whether a source differs from what the marker file tells; the marker is written anew if so."""
    spark = df.sparkSession
    now = source_digest(df, fields).first()["digest"]
    was = spark.read.text(marker).first() if exists(spark, marker) else None
    if was is not None and was[0] == now:
        return False
    spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(marker)
    return True


def stamp(spark: SparkSession, path: str) -> str:
    """A cheap sign of a source file or folder: how many files, their bytes and the last change, without reading any."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    n = size = last = 0
    while files.hasNext():
        f = files.next()
        n, size, last = n + 1, size + f.getLen(), max(last, f.getModificationTime())
    return f"{n}-{size}-{last}"


def poll(spark: SparkSession, path: str, seen: str | None) -> tuple[str, bool]:
    """(sign, whether it differs from the one seen last); only then is a digest worth its scan."""
    now = stamp(spark, path)
    return now, now != seen


def new_articles(spark: SparkSession, path: str, at_once: int = 1000) -> DataFrame:
    """The stream of article files that arrive in a folder."""
    return spark.readStream.schema(ARTICLE).option("multiLine", True).option("maxFilesPerTrigger", at_once).json(path)


def keep_latest(stream: DataFrame, table: str, checkpoint: str, order: str = "updated", buckets: int = 64):
    """Upserts each batch of a stream into a Parquet table by id: of all rows of an id the one with the last ``order`` stays.

    The table lies in ``buckets`` by a hash of the id; a batch reads and writes
    the buckets that it touches.  Null comes before any time; among equal times
    the batch's row stays.  A batch that is run again gives the same table.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).withColumn("_batch", F.lit(1))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # ``buckets`` at the most
        if not touched:
            return
        if exists(spark, table):
            new = new.unionByName(spark.read.schema(new.drop("_batch").schema).parquet(table).where(F.col("bucket").isin(touched)).withColumn("_batch", F.lit(0)))
        last = Window.partitionBy("id").orderBy(F.col(order).desc_nulls_last(), F.col("_batch").desc(), F.xxhash64(*batch.columns))
        kept = materialize(new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_batch"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
