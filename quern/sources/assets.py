"""Scans of index assets: raw int8 matrices, npz archives, graphs, term dictionaries, word lists, evaluation files."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.sinks import store

EVAL = "array<struct<text:string,relevant:array<string>>>"


def file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files that a path or pattern names, from the store's listing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for f in files.globStatus(at) or []:
        for x in files.listStatus(f.getPath()) if f.isDirectory() else [f]:
            if not x.isDirectory():
                out.append((x.getPath().toString(), x.getLen()))
    return sorted(out)


def read_bytes(path: str, first: int, n: int) -> bytes:
    """A stretch of a file on a local disk or a shared store."""
    files, at = store(path)
    with files.open_input_file(at) as f:
        return f.read_at(n, first)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_int8(spark: SparkSession, path: str, dim: int, scales: DataFrame | None = None, rows: int = 65_536) -> DataFrame:
    """(path, row_no, vector): rows of ``dim`` int8 numbers of each file, times their ``scales`` (row_no, scale) if given.

    A file is read in stretches of ``rows`` rows, each by whichever task gets it.
    A file whose length is no multiple of ``dim`` is an error.
    """
    parts = []
    for name, size in file_sizes(spark, path):
        if size % dim:
            raise ValueError(f"{name} has {size} bytes, no multiple of {dim}")
        parts += [(name, a, min(rows, size // dim - a)) for a in range(0, size // dim, rows)]
    plan = spark.createDataFrame(parts, "path string, first bigint, n bigint").repartition(max(1, min(len(parts), 10_000)))

    def run(batches):
        for b in batches:
            for p, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = np.frombuffer(read_bytes(p, first * dim, n * dim), np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([p] * n), pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(part))], names=["path", "row_no", "vector"])

    out = plan.mapInArrow(run, "path string, row_no bigint, vector array<tinyint>")
    if scales is None:
        return out
    return out.join(scales, "row_no").select("path", "row_no", F.transform("vector", lambda q: (q * F.col("scale")).cast("float")).alias("vector"))


def read_npz(spark: SparkSession, path: str, ids: str = "ids", vectors: str = "vectors") -> DataFrame:
    """(id, vector) of npz archives with an array of identifiers and a matrix."""

    def run(batches):
        for b in batches:
            for raw in b.column(1).to_pylist():
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    v = z[vectors].astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in z[ids]]), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "vector"])

    return _whole(spark, path).mapInArrow(run, "id string, vector array<float>")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as ``sinks.write_graph`` writes them, or nodes as one JSON array and edges as JSON lines."""
    return spark.read.schema("id string, type string, label string").json(f"{path}/nodes*", multiLine=False), spark.read.schema("src string, dst string, type string, weight double").json(f"{path}/edges*")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, t, r) of a term dictionary {"docs": [{"t": [], "r": []}]}; row_id is the place in the list."""
    docs = spark.read.schema("docs array<struct<t:array<string>,r:array<string>>>").json(path, multiLine=True)
    return docs.select(F.posexplode("docs").alias("row_id", "d")).select(F.col("row_id").cast("long").alias("row_id"), "d.t", "d.r")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a word list, gzip or plain."""
    return spark.read.text(path)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, relevant) of files [{"text": ..., "relevant": [...]}]; query_id is the place in the file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", EVAL)).alias("query_id", "x")).select(F.col("query_id").cast("long").alias("query_id"), "x.text", "x.relevant")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of files ["...", ...]."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("query_id", "text")).select(F.col("query_id").cast("long").alias("query_id"), "text")


def relevant_pairs(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """(query_id, ..., row_id) of pairs (query_id, ..., id); identifiers that the index does not have go."""
    return pairs.join(meta.select("id", "row_id"), "id").drop("id")


def relevant_rows(items: DataFrame, meta: DataFrame) -> DataFrame:
    """(query_id, text, rows) of evaluation items: relevant identifiers as row numbers; unknown ones go, and items without any."""
    known = relevant_pairs(items.select("query_id", "text", F.explode("relevant").alias("id")), meta)
    return known.groupBy("query_id", "text").agg(F.array_sort(F.collect_set("row_id")).alias("rows"))  # as many as an item lists


def student_rows(doc_ids: DataFrame, meta: DataFrame) -> DataFrame:
    """(place, row_id) of an encoder's documents (place, id): -1 for those that the index no longer has."""
    return doc_ids.join(meta.select("id", "row_id"), "id", "left").select("place", F.coalesce("row_id", F.lit(-1)).alias("row_id"))
