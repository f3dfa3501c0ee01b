"""The extension lexicon: candidates, affinity to the corpus, hash shards and packs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.runtime import numbered

# Hash shards of the lexicon, and the bytes of a pack.
SHARDS, PACK_BYTES = 256, 4 << 20


def frequency_candidates(lines: DataFrame, least: int = 2) -> DataFrame:
    """(word, freq) of 'word count' lines: counts summed by the stripped word, Hangul only, two letters or more."""
    parts = F.split(F.btrim("value"), " ")
    rows = lines.select(X.strip_particle(F.get(parts, F.lit(0))).alias("word"), F.coalesce(F.expr("try_cast(get(split(btrim(value), ' '), 1) AS bigint)"), F.lit(0)).alias("freq"))
    return rows.where(F.col("word").rlike("^[가-힣]{2,}$")).groupBy("word").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= least)


def title_candidates(lines: DataFrame) -> DataFrame:
    """(word, kind): Hangul titles of 2 to 6 letters; single if the word has no particle, compound up to 4 letters."""
    t = lines.select(F.col("value").alias("word")).where(F.col("word").rlike("^[가-힣]{2,6}$"))
    return t.select("word", F.when(X.strip_particle(F.col("word")) == F.col("word"), "single").when(F.length("word") <= 4, "compound").alias("kind")).where("kind IS NOT NULL")


def new_words(candidates: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return candidates.select("word").distinct().join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")


def affinity(words: DataFrame, docs: DataFrame, least: float = 0.37, block: int = 8192) -> DataFrame:
    """(word, affinity) of words (word, vector) whose best cosine to a document is ``least`` or more.

    Words meet the documents in blocks: each block of document vectors is one
    row group of a broadcast-free product by a shared block number.
    """
    held = docs.select("vector").where("vector IS NOT NULL")
    n = max(1, -(-held.count() // block))
    d = held.withColumn("part", F.pmod(F.xxhash64("vector"), F.lit(n)))
    w = words.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("part", F.col("part").cast("long"))
    kind = dict(words.dtypes)["word"]

    def meet(t: pa.Table) -> pa.Table:
        own, doc = t.column("vector"), t.column("word").is_null().to_numpy()
        v = np.stack(own.to_pylist()).astype(np.float32)
        x, y = v[~doc], v[doc]
        best = np.concatenate([np.zeros(0, np.float32), *((x[a : a + 1024] @ y.T).max(1) for a in range(0, len(x) if len(y) else 0, 1024))])
        return pa.table({"word": t.column("word").filter(pa.array(~doc)).slice(0, len(best)), "a": pa.array(best.astype(np.float64))})

    both = w.select("word", "vector", "part").unionByName(d.select(F.lit(None).cast(kind).alias("word"), "vector", "part"))
    met = both.groupBy("part").applyInArrow(meet, f"word {kind}, a double")
    return met.groupBy("word").agg(F.max("a").alias("affinity")).where(F.col("affinity") >= least)


def shards(terms: DataFrame, shard_count: int = SHARDS) -> DataFrame:
    """The terms with their shard: FNV-1a of the term modulo the number of shards."""
    return terms.withColumn("shard", F.pmod(X.fnv1a32(F.col("term")), F.lit(shard_count)).cast("int"))


def write_shards(sharded: DataFrame, path: str) -> None:
    sharded.repartition("shard").sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shard(spark, path: str, term: str | None = None, shard_count: int = SHARDS) -> DataFrame:
    """All shards, or of a term's shard the term's row: the literal predicate prunes to one folder."""
    df = spark.read.parquet(path)
    if term is None:
        return df
    h = 2166136261
    raw = term.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619 & 0xFFFFFFFF
    return df.where((F.col("shard") == h % shard_count) & (F.col("term") == term))


def packs(sizes: DataFrame, most: int = PACK_BYTES) -> DataFrame:
    """(shard, bytes, pack, start) of shards (shard, bytes), a bounded number: filled in order, a pack ends before it would pass ``most``."""
    rows = sizes.select("shard", "bytes").orderBy("shard").toPandas()
    pack, start, used, out = 0, 0, 0, []
    for s, b in rows.itertuples(index=False):
        if used and used + b > most:
            pack, used = pack + 1, 0
        start = used
        used += b
        out.append((int(s), int(b), pack, int(start)))
    return sizes.sparkSession.createDataFrame(out, "shard int, bytes bigint, pack int, start bigint")


def vocabulary_places(df: DataFrame) -> DataFrame:
    """(term, place) of kept terms in byte order."""
    return numbered(df.where("kept").select("term"), ["term"], "place")
