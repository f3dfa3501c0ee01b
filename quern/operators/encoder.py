"""The query encoder: tokens to slots of a vocabulary, slots to a unit vector, vectors to documents."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.graph import block_top_k

# Slots of a query, and what a part of a noun must have to stand for it.
MAX_SLOTS, FALLBACK_LENGTH, FALLBACK_SHARE = 16, 3, 0.5


def slots(queries: DataFrame, vocabulary: DataFrame, lexicon: DataFrame | None = None, most: int = MAX_SLOTS, use_fallback: bool = True) -> DataFrame:
    """(query_id, slot, kind, term, place): what each query's tokens stand for in the vocabulary, in their order.

    kind is core, ext (the lexicon) or fb (the longest part of a noun that the
    vocabulary knows, the leftmost of equals).  A word of one table counts once;
    ``most`` slots at the most.  ``vocabulary`` and ``lexicon`` have (term, place).
    """
    tokens = queries.select("query_id", F.posexplode(X.student_tokens(F.col("text"))).alias("no", "x")).select("query_id", "no", F.col("x.t").alias("t"), F.col("x.kind").alias("k"))
    core = tokens.join(vocabulary.select(F.col("term").alias("t"), F.col("place").alias("core")), "t", "left")
    core = core.join(lexicon.select(F.col("term").alias("t"), F.col("place").alias("ext")), "t", "left") if lexicon is not None else core.withColumn("ext", F.lit(None).cast("long"))
    whole = core.where("core IS NOT NULL OR ext IS NOT NULL").select("query_id", "no", F.when(F.col("core").isNotNull(), "core").otherwise("ext").alias("kind"), F.col("t").alias("term"), F.coalesce("core", "ext").alias("place"))
    if use_fallback:
        open_ = core.where((F.col("core").isNull()) & (F.col("ext").isNull()) & (F.col("k") == "n") & (F.length("t") >= FALLBACK_LENGTH))
        n = F.length("t")
        starts = F.transform(F.sequence(F.lit(1), n - 1), lambda s: s)
        parts = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), n - 1)), lambda m: F.struct(m.alias("m"), s.alias("s")))))
        parts = F.filter(parts, lambda p: (p["m"] < n) & (p["m"] / n >= FALLBACK_SHARE) & (p["s"] + p["m"] - 1 <= n))
        cut = open_.select("query_id", "no", "t", F.explode(parts).alias("p")).select("query_id", "no", F.expr("substring(t, p.s, p.m)").alias("term"), F.struct((-F.col("p.m")).alias("m"), F.col("p.s").alias("s")).alias("rank"))
        hit = cut.join(vocabulary.select("term", "place"), "term").groupBy("query_id", "no").agg(F.min_by(F.struct("term", "place"), "rank").alias("b"))
        whole = whole.unionByName(hit.select("query_id", "no", F.lit("fb").alias("kind"), F.col("b.term").alias("term"), F.col("b.place").alias("place")))
    table = F.when(F.col("kind") == "ext", "x").otherwise("c")
    once = whole.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", table, "place").orderBy("no"))).where("_n = 1")
    placed = once.withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy("no")) - 1).where(F.col("slot") < most)
    return placed.select("query_id", "slot", "kind", "term", "place")


@dataclass
class Member:
    """One student: a weight for each term, an affine projection, and the weights of fallback and lexicon slots."""

    term_scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    fb_weight: float = float(np.exp(-0.5))
    ext_weight: float = 1.0


@dataclass
class Student:
    vectors: np.ndarray  # of the vocabulary, by place
    members: list[Member] = field(default_factory=list)
    lexicon: np.ndarray | None = None


def encode(slot_table: DataFrame, student: Student) -> DataFrame:
    """(query_id, vector, exact_slots): each member's projection of the weighted slots at unit length, summed, at unit length."""
    kind = dict(slot_table.dtypes)["query_id"]
    rows = slot_table.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("slot", "kind", "place"))).alias("s"))  # MAX_SLOTS at the most

    def run(batches):
        for b in batches:
            out, exact = [], []
            for own in b.column(1).to_pylist():
                total = 0.0
                for m in student.members:
                    p = sum(
                        (m.ext_weight * student.lexicon[x["place"]]) if x["kind"] == "ext" else m.term_scale[x["place"]] * (m.fb_weight if x["kind"] == "fb" else 1.0) * student.vectors[x["place"]] for x in own
                    )
                    q = m.w @ p + m.b
                    total = total + q / max(np.linalg.norm(q), 1e-12)
                out.append((total / max(np.linalg.norm(total), 1e-12)).astype(np.float32))
                exact.append(sum(x["kind"] != "fb" for x in own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32())), pa.array(exact, pa.int64())], names=["query_id", "vector", "exact_slots"])

    return rows.mapInArrow(run, f"query_id {kind}, vector array<float>, exact_slots bigint")


def search(encoded: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, row_id, score, rank, exact_slots) of a set of encoded queries over documents (row_id, vector)."""
    hits = block_top_k(encoded.select(F.col("query_id").alias("row_id"), "vector"), docs, "row_id", "vector", k)
    return hits.withColumnRenamed("query", "query_id").join(encoded.select("query_id", "exact_slots"), "query_id")
