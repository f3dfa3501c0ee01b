"""Related articles: random walks, node embeddings, held-out links, the layout."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.vectors import dot, normalize, top_k
from quern.operators import graph
from quern.runtime import materialize


def random_walks(adjacent: DataFrame, walks: int = 10, length: int = 80, seed: int = 42) -> DataFrame:
    """(start, walk, path): walks from every node, the next node drawn by edge weight; a walk ends at a sink.

    All walks take a step together: a join of where they stand with the running
    sum of weights, cut by a hash of the walk and the step.  So the graph need
    not fit a worker; paths are cut from lineage every few steps.
    """
    order = Window.partitionBy("src").orderBy("dst")
    total = F.sum("weight").over(Window.partitionBy("src"))
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total
    # Shares follow one another without a gap and the last ends at 1, so a draw meets one edge and no other.
    marked = adjacent.where("weight > 0").withColumn("hi", F.when(F.lead("dst").over(order).isNull(), 1.0).otherwise(upto))
    steps = materialize(marked.select(F.col("src").alias("at"), "dst", F.coalesce(F.lag("hi").over(order), F.lit(0.0)).alias("lo"), "hi"))
    now = steps.select(F.col("at").alias("start")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).select("start", "walk", F.col("start").alias("at"), F.array("start").alias("path"))
    for s in range(1, length):
        u = F.pmod(F.xxhash64("start", "walk", F.lit(s), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        moved = now.withColumn("u", u).join(steps, "at", "left").where("dst IS NULL OR (u >= lo AND u < hi)")
        now = moved.select("start", "walk", F.coalesce("dst", "at").alias("at"), F.when(F.col("dst").isNotNull(), F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path"))
        if s % 8 == 0:
            now = materialize(now)
    return now.select("start", "walk", "path")


def node_embeddings(paths: DataFrame, dim: int = 128, window: int = 10, epochs: int = 5, seed: int = 42, partitions: int = 8) -> DataFrame:
    """(id, vector): skip-gram vectors of the walks' nodes at unit length."""
    from pyspark.ml.feature import Word2Vec

    w2v = Word2Vec(vectorSize=dim, windowSize=window, maxIter=epochs, minCount=0, seed=seed, numPartitions=partitions, inputCol="path", outputCol="v", maxSentenceLength=1000)
    vectors = w2v.fit(paths.select("path")).getVectors()
    from pyspark.ml.functions import vector_to_array

    return vectors.select(F.col("word").alias("id"), normalize(vector_to_array("vector")).alias("vector"))


def related(hits: DataFrame, meta: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(src, id, score, rank): the best of each source, with title and slugs where the index rows are given."""
    top = top_k(hits.select("src", "id", F.round("score", 4).alias("score")), ["src"], "score", ["id"], k)
    return top if meta is None else top.join(meta.select("id", "slug", "title", "board"), "id")


def hold_out(links: DataFrame, share: float = 0.15, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(kept, hidden) edges, by the MD5 of both ends."""
    mark = X.uniform(F.least("src", "dst"), F.greatest("src", "dst"), seed) < share
    return links.where(~mark), links.where(mark)


def link_quality(scores: DataFrame, hidden: DataFrame, known: DataFrame, k: int = 10) -> DataFrame:
    """(n, recall, mrr) of hidden links by rank among candidates that are no known neighbours."""
    open_ = scores.join(known.select("src", F.col("dst").alias("id")), ["src", "id"], "left_anti")
    want = hidden.select("src", F.col("dst").alias("id"))
    mark = want.join(open_, ["src", "id"], "left").select("src", "id", F.col("score").alias("mark"))
    better = mark.join(open_.select("src", F.col("id").alias("other"), "score"), "src", "left").groupBy("src", "id").agg(F.first("mark").alias("mark"), F.sum((F.col("score") > F.col("mark")).cast("long")).alias("rank"))
    r = F.when(F.col("mark").isNotNull(), F.col("rank"))
    return better.agg(F.count("*").alias("n"), F.avg(F.coalesce((r < k).cast("double"), F.lit(0.0))).alias("recall"), F.avg(F.coalesce(1 / (r + 1), F.lit(0.0))).alias("mrr"))


def principal_axes(vectors: DataFrame, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, share of variance) from one pass of partial sums; the largest part of each axis is positive."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                part = np.vstack([x.T @ x, x.sum(0), np.full((1, x.shape[1]), len(x), float)])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = vectors.select("vector").where("vector IS NOT NULL").mapInArrow(run, "part binary")
    total = None
    for (raw,) in parts.toLocalIterator():
        x = np.frombuffer(raw, np.float64)
        total = x.copy() if total is None else total + x
    dim = int(round((-2 + (4 + 4 * len(total)) ** 0.5) / 2))
    total = total.reshape(dim + 2, dim)
    n = total[-1, 0]
    mean = total[dim] / n
    values, axes = np.linalg.eigh(total[:dim] / n - np.outer(mean, mean))
    order = np.argsort(-values)[:rank]
    axes = axes[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return mean, axes, values[order] / max(values.sum(), 1e-12)


def basis_digest(mean: np.ndarray, axes: np.ndarray) -> str:
    """SHA-1 of a basis in single precision: what an encoder names the space by that its vectors belong to."""
    return hashlib.sha1(np.vstack([mean, axes.T]).astype("<f4").tobytes()).hexdigest()


def layout(vectors: DataFrame, exact_rows: int = 500, perplexity: float = 25.0, rounds: int = 1500) -> DataFrame:
    """(id, x, y) for drawing: t-SNE begun from the first two axes, at every size over each node's nearest ones.

    Forces between all nodes are summed by pairs up to ``exact_rows`` nodes, beyond
    that through a grid, in time that follows the nodes.  The driver holds the
    places and 3 x ``perplexity`` neighbours a node.
    """
    vectors = vectors.where("vector IS NOT NULL")
    mean, axes, _ = principal_axes(vectors, 2)
    at = lambda k: F.aggregate(F.zip_with("vector", F.array(*map(F.lit, axes[:, k].tolist())), lambda a, b: a * b), F.lit(float(-(mean @ axes[:, k]))), lambda s, v: s + v)
    rows = vectors.select("id", at(0).alias("x"), at(1).alias("y")).orderBy("id").toPandas()
    n = len(rows)
    most = max(1, min(n - 1, int(3 * perplexity)))
    # a product that falls with the distance: x . y - |y|^2 / 2
    ask = vectors.select("id", F.concat("vector", F.array(F.lit(1.0))).alias("v"))
    answer = vectors.select("id", F.concat("vector", F.array(-dot(F.col("vector"), F.col("vector")) / 2)).alias("v"))
    near = graph._tile_top_k(ask, answer, "id", "v", most, True, 8192).select("query", "id", "score").toPandas()
    place = pd.Index(rows["id"])
    y = _tsne(place.get_indexer(near["query"]), place.get_indexer(near["id"]), -2 * near["score"].to_numpy(), rows[["x", "y"]].to_numpy(np.float64), perplexity, rounds, exact_rows)
    y = y - y.mean(0)
    y = np.round(y / max(np.abs(y).max(), 1e-12), 4)
    return vectors.sparkSession.createDataFrame(list(zip(rows["id"].tolist(), y[:, 0].tolist(), y[:, 1].tolist(), strict=True)), f"id {dict(vectors.dtypes)['id']}, x double, y double")


def _affinities(i: np.ndarray, d: np.ndarray, n: int, perplexity: float) -> np.ndarray:
    """The share of each neighbour of ``i`` by squared distance ``d`` (less a constant a row), each row's bandwidth by bisection."""
    low = np.full(n, np.inf)
    np.minimum.at(low, i, d)
    d = d - low[i]
    goal, beta, lo, hi = np.log(min(perplexity, (n - 1) / 3)), np.ones(n), np.zeros(n), np.full(n, np.inf)
    for _ in range(50):
        p = np.exp(-d * beta[i])
        q = p / np.bincount(i, p, n)[i]
        up = np.bincount(i, -q * np.log(np.maximum(q, 1e-300)), n) > goal
        lo, hi = np.where(up, beta, lo), np.where(up, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    return q


def _repulsion(y: np.ndarray) -> tuple[np.ndarray, float]:
    """(force, sum of weights) between all pairs: the sums of w^2 (y_i - y_j) and of w = 1 / (1 + d^2)."""
    w = 1 / (1 + (y * y).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * y @ y.T)
    np.fill_diagonal(w, 0)
    total = w.sum()
    w *= w
    return w.sum(1)[:, None] * y - w @ y, total


@lru_cache(maxsize=2)
def _kernels(m: int, gap: float) -> np.ndarray:
    """The transforms of w and, three times, of w^2 over a grid of m x m nodes ``gap`` apart, for a convolution that does not wrap."""
    d = np.minimum(np.arange(2 * m), 2 * m - np.arange(2 * m)) * gap
    w = 1 / (1 + d[:, None] ** 2 + d[None] ** 2)
    one, two = np.fft.rfft2(w), np.fft.rfft2(w**2)
    return np.stack([one, two, two, two])


def _repulsion_by_grid(y: np.ndarray) -> tuple[np.ndarray, float]:
    """The same by cubic interpolation in boxes of at most 1 and a convolution over their nodes."""
    low, n = y.min(0), len(y)
    span = max((y.max(0) - low).max(), 1e-9)
    boxes, h = (20, span / 20) if span < 20 else (10 * int(np.ceil(span / 10)), 1.0)
    m, k = 4 * boxes, np.arange(4)
    t = (y - low) / h
    box = np.minimum(t.astype(np.int64), boxes - 1)
    t, at = t - box, (k + 0.5) / 4
    u = np.stack([np.prod([(t - at[b]) / (at[a] - at[b]) for b in k if b != a], 0) for a in k], 1)  # n, 4, 2
    weight = (u[:, :, None, 0] * u[:, None, :, 1]).reshape(n, 16)
    node = ((4 * box[:, 0, None] + k)[:, :, None] * m + (4 * box[:, 1, None] + k)[:, None, :]).reshape(n, 16)
    z = y - low - span / 2
    charge = np.stack([np.bincount(node.ravel(), (weight * q[:, None]).ravel(), m * m).reshape(m, m) for q in (np.ones(n), z[:, 0], z[:, 1])])
    f = np.fft.rfft2(charge, (2 * m, 2 * m))
    field = np.fft.irfft2(_kernels(m, h / 4) * f[[0, 0, 1, 2]], (2 * m, 2 * m))[:, :m, :m].reshape(4, -1)
    total, s, sx, sy = ((field[c][node] * weight).sum(1) for c in range(4))
    return s[:, None] * z - np.stack([sx, sy], 1), max(float(total.sum()) - n, 1e-12)


def _tsne(i: np.ndarray, j: np.ndarray, d: np.ndarray, start: np.ndarray, perplexity: float, rounds: int, exact_rows: int) -> np.ndarray:
    n = len(start)
    if n < 3:
        return start
    p = _affinities(i, d, n, perplexity) / (2 * n)
    i, j, p = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([p, p])
    y = start / max(start.std(), 1e-12) * 1e-4
    step, gain = np.zeros_like(y), np.ones_like(y)
    for k in range(rounds):
        apart = y[i] - y[j]
        pull = p * (12 if k < 100 else 1) / (1 + (apart * apart).sum(1))
        push, total = (_repulsion if n <= exact_rows else _repulsion_by_grid)(y)
        g = 4 * (np.stack([np.bincount(i, pull * apart[:, a], n) for a in (0, 1)], 1) - push / total)
        gain = np.maximum(np.where(np.sign(g) == np.sign(step), gain * 0.8, gain + 0.2), 0.01)
        step = (0.5 if k < 100 else 0.8) * step - max(n / 48, 50) * gain * g
        y = y + step
    return y
