"""Session-level plumbing shared by every operator.

Lineage is cut by writing a Parquet table below the folder that the cluster
names in ``spark.checkpoint.dir``; all executors share that folder, so the
table outlives any one of them.  Only where the setting is absent (tests,
notebooks) does the engine pick a folder of its own.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parent.parent)
_made: list[str] = []
_SESSIONS: dict[str, SparkSession] = {}  # of the tables that stand


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver found it."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, shared by all executors."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
        at = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", at)
        _made.append(at)
    return at


def scratch(spark: SparkSession) -> str:
    """A path below ``shared_dir`` that nobody has used before."""
    at = f"{shared_dir(spark).rstrip('/')}/quern-{uuid.uuid4().hex}"
    _made.append(at)
    return at


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table."""
    at = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(at)
    _SESSIONS[at] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path stands on its store; a store that does not answer is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def sweep(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this driver has written so far, on any store; returns how many.

    For a long session, once the results that read them are written.
    """
    jvm, gone = spark.sparkContext._jvm, 0
    for at in [a for a in _made if a in _SESSIONS]:
        path = jvm.org.apache.hadoop.fs.Path(at)
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(at)
        del _SESSIONS[at]
    return gone


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with each row's place in the order of ``by``, from 0.

    Rows are range-partitioned once; each part is numbered by itself, from where
    the parts before it end, so nothing is sorted in one place.
    """
    parts = materialize(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_c"))
    before = sizes.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))  # one row for each part
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_from") + F.col("_own")).cast("long")).drop("_part", "_from", "_own")


def broadcast_below(df: DataFrame, max_rows: int) -> DataFrame:
    """Hints a broadcast only if a bounded count proves that ``df`` is small.

    The count stops after ``max_rows + 1`` rows; beyond the bound the frame is
    returned as it is and Spark shuffles it.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


@atexit.register
def _sweep() -> None:
    """At the end of the driver: through the session's file system while it answers, else what is local."""
    for spark in set(_SESSIONS.values()):
        try:
            if spark.sparkContext._jsc is not None:
                sweep(spark)
        except Exception:  # noqa: BLE001  # the session has ended
            break
    for at in _made:
        local = at.removeprefix("file://")
        if local.startswith("/") and "quern-" in local:
            shutil.rmtree(local, ignore_errors=True)
