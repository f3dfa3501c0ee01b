"""Problem 2: the k most similar vectors of every vector.

Method: balanced posting lists.  A bounded sample is halved at the median again
and again, so its leaves are of one size; their means are the lists' centroids.
Centroids are searched by a neighbour graph in the worker's memory, whatever
their number; its links are made once, on the driver.  A vector at a boundary is
stored in several lists: all whose centroid is at most ``1 + spread`` times as far
as the nearest (distance-ratio pruning), ``most`` at the most; the same rule
selects the lists that it searches, so each list is compared within itself and
yields only every member's k best.  Beyond ``max_lists`` lists grow: a list of more
than eight times ``list_rows`` is divided within its task by the same rule again.
A list that the sample shows to be beyond ``tile_rows`` is cut in parts whose pairs
are tasks of their own, so no task's rows are unbounded.

Equal vectors are compared once: of each set of copies the smallest row stands
for all, and its neighbours are given to the others afterwards.

Defined results: null vectors, zero vectors, vectors of another length and those
with NaN or infinite numbers take no part; ties go to the smaller row; two rows
of one id are two rows; fewer than k others give fewer rows; an empty table gives
an empty result.  Recall is measured in the tests against brute force.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import broadcast_below, materialize


def unit_vectors(df: DataFrame, row: str, vector: str, dim: int) -> DataFrame:
    """(row, print, vec): usable vectors at unit length as bytes, with a fingerprint of them."""
    kind = dict(df.select(F.col(row).alias("r")).dtypes)["r"]

    def run(batches):
        for b in batches:
            col = b.column(1)
            n = np.diff(col.offsets.to_numpy())
            ok = (n == dim) & col.is_valid().to_numpy(zero_copy_only=False) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(ok)
            first = col.offsets.to_numpy()[:-1][at]
            flat = col.values.to_numpy(zero_copy_only=False)
            x = flat[first[:, None] + np.arange(dim)].astype(np.float64) if len(at) else np.zeros((0, dim))
            with np.errstate(all="ignore"):
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                x = (x[good] / norm[good, None]).astype(np.float32)
            raw = [v.tobytes() for v in x]
            prints = pa.array(np.array([xxhash.xxh3_64_intdigest(v) for v in raw], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[good])), prints, pa.array(raw, pa.binary())], names=["row", "print", "vec"])

    return df.select(F.col(row).alias("row"), F.col(vector).alias("vector")).mapInArrow(run, f"row {kind}, print bigint, vec binary")


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim) if len(col) else np.zeros((0, dim), np.float32)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of ``lists`` leaves of equal size: each part is cut at the median along its two means' direction."""
    rng = np.random.default_rng(seed)
    parts = [x]
    while len(parts) < lists:
        parts.sort(key=len, reverse=True)
        new = []
        for i, p in enumerate(parts):
            if len(p) < 2 or len(new) + len(parts) - i >= lists:
                new += parts[i:]
                break
            a, b = p[rng.choice(len(p), 2, replace=False)]
            for _ in range(4):
                side = p @ (a - b)
                cut = side > np.median(side)
                if cut.all() or not cut.any():
                    break
                a, b = p[cut].mean(0), p[~cut].mean(0)
            half = np.argsort(p @ (a - b), kind="stable")
            new += [p[half[: len(p) // 2]], p[half[len(p) // 2 :]]]
        if len(new) == len(parts):
            break
        parts = new
    c = np.stack([p.mean(0) for p in parts])
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class CentroidGraph:
    """Centroids with links to their nearest ones and to a few at random, searched best-first for a slice of vectors at once."""

    def __init__(self, centroids: np.ndarray, near: int = 20, far: int = 4, links: np.ndarray | None = None, seed: int = 0) -> None:
        self.c, n = centroids, len(centroids)
        if links is None:
            near = min(near, n - 1)
            own = [self._nearest(a, min(a + 256, n), near) for a in range(0, n, 256)]
            links = np.concatenate([np.concatenate(own), np.random.default_rng(seed).integers(0, n, (n, far))], axis=1).astype(np.int32)
        self.links = links
        self.entries = np.unique(np.linspace(0, n - 1, min(n, max(64, n // 16))).astype(np.int32))  # the order of the halvings: spread over all

    def _nearest(self, a: int, b: int, near: int) -> np.ndarray:
        s = self.c[a:b] @ self.c.T
        s[np.arange(b - a), np.arange(a, b)] = -2
        return np.argpartition(-s, near - 1, axis=1)[:, :near] if near else np.zeros((b - a, 0), np.int64)

    def search(self, x: np.ndarray, k: int, pool: int = 32, at_once: int = 4, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) of the k most similar centroids found for each vector, best first."""
        found = [self._search(x[a : a + rows], min(k, len(self.c)), pool, at_once) for a in range(0, len(x), rows)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, x: np.ndarray, k: int, pool: int, at_once: int) -> tuple[np.ndarray, np.ndarray]:
        """Follows the links of the best ``at_once`` open centroids of each vector's pool until its first 2 k are all followed."""
        best = lambda s, m, *more: [np.take_along_axis(z, t, 1) for t in [np.argpartition(-s, m - 1, axis=1)[:, :m]] for z in (s, *more)]
        s = x @ self.c[self.entries].T
        s, ids = best(s, min(pool, s.shape[1]), np.broadcast_to(self.entries, s.shape))
        seen = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(-s, axis=1, kind="stable")
            s, ids, seen = (np.take_along_axis(z, order, 1) for z in (s, ids, seen))
            if seen[:, : max(2 * k, at_once)].all():
                return ids[:, :k], s[:, :k]
            pick = np.argpartition(np.where(seen, 3, -s), min(at_once, s.shape[1]) - 1, axis=1)[:, :at_once]
            np.put_along_axis(seen, pick, True, 1)
            new = np.sort(self.links[np.take_along_axis(ids, pick, 1)].reshape(len(x), -1), axis=1)
            v = np.einsum("nd,nmd->nm", x, self.c[new])
            known = (new[:, :, None] == ids[:, None, :]).any(2)
            known[:, 1:] |= new[:, 1:] == new[:, :-1]
            v[known] = -4
            s, ids, seen = (np.concatenate(z, axis=1) for z in ((s, v), (ids, new), (seen, known)))
            s, ids, seen = best(s, min(pool, s.shape[1]), ids, seen)


def memberships(graph: CentroidGraph, x: np.ndarray, spread: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, list) by distance ratio: every list whose centroid is at most ``1 + spread`` times as far as the nearest."""
    at, cos = graph.search(x, most)
    far = np.sqrt(np.maximum(2 - 2 * cos, 0))
    i, j = np.nonzero(far <= (1 + spread) * far[:, :1] + 1e-6)
    return i, at[i, j]


def _best(rows: np.ndarray, x: np.ndarray, other_rows: np.ndarray, y: np.ndarray, k: int, least: float | None):
    """(row, neighbour, cosine) of the k best of y for each of x, itself left out; ties to the smaller row."""
    order = np.argsort(other_rows, kind="stable")
    other_rows, y = other_rows[order], y[order]
    out = []
    if not len(y):
        return [rows[:0], other_rows[:0], np.zeros(0, np.float32)]
    step = max(1, min(512, 4_000_000 // len(y)))
    for a in range(0, len(x), step):
        s = x[a : a + step] @ y.T
        s[rows[a : a + step, None] == other_rows[None, :]] = -2
        if least is not None:
            i, j = np.nonzero(s >= least)
        else:
            cut = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
            i, j = np.nonzero((s >= cut[:, None]) & (s > -2))
        v = s[i, j]
        o = np.lexsort((j, -v, i))
        i, j, v = i[o], j[o], v[o]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out.append((rows[a + i[keep]], other_rows[j[keep]], v[keep]))
    return [np.concatenate(z) for z in zip(*out, strict=True)] if out else [rows[:0], other_rows[:0], np.zeros(0, np.float32)]


def _within(rows: np.ndarray, x: np.ndarray, k: int, least: float | None, list_rows: int, spread: float, most: int):
    """(row, neighbour, cosine) of the members of one list, which is divided again if it is large."""
    if len(rows) <= 8 * list_rows:
        return _best(rows, x, rows, x, k, least)
    some = np.random.default_rng(0).permutation(len(x))[: 16 * list_rows]
    graph = CentroidGraph(balanced_centroids(x[some], len(x) // list_rows))
    i, at = memberships(graph, x, spread, most)
    order = np.argsort(at, kind="stable")
    parts = np.split(i[order], np.flatnonzero(np.diff(at[order])) + 1)
    return [np.concatenate(z) for z in zip(*(_best(rows[p], x[p], rows[p], x[p], k, least) for p in parts), strict=True)]


def nearest(
    df: DataFrame, row: str, vector: str, dim: int, k: int = 10, least: float | None = None, list_rows: int = 1024, max_lists: int = 16_384, sample: int = 131_072, spread: float = 0.2, most: int = 8, tile_rows: int = 65_536
) -> DataFrame:
    """(row, neighbour, similarity, rank): the ``k`` rows most similar by cosine, of those of at least ``least`` if given.

    ``list_rows`` is the size aimed at for a list; ``max_lists`` and ``sample``
    bound what the driver holds and every worker gets.
    """
    spark = df.sparkSession
    units = unit_vectors(df, row, vector, dim)
    prints = materialize(units.select("row", "print"))  # the vectors are made again when they are needed: on disk they are as large as the input
    kind = dict(prints.dtypes)["row"]
    n = prints.count()
    out_schema = f"row {kind}, neighbour {kind}, similarity float"
    if n == 0:
        return spark.createDataFrame([], f"`{row}` {kind}, neighbour {kind}, similarity float, rank int")
    sets = prints.groupBy("print").agg(F.min("row").alias("rep"), F.count("*").alias("size")).where("size > 1")
    sets = broadcast_below(materialize(sets), 1_000_000)
    copies = materialize(prints.join(sets, "print").select("row", "rep"))
    others = broadcast_below(copies.where("row != rep").select("row"), 1_000_000)
    reps = units.select("row", "vec").join(others, "row", "left_anti")

    lists = max(1, min(max_lists, n // list_rows))
    take = min(1.0, min(sample, 256 * lists) / n)
    drawn = reps.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < F.lit(int(math.ceil(take * 1_000_000)))).select("vec").limit(2 * sample)
    x = np.stack([np.frombuffer(r.vec, np.float32) for r in drawn.toLocalIterator()] or [np.ones(dim, np.float32)])
    graph = CentroidGraph(balanced_centroids(x, lists))
    held = np.zeros(len(graph.c), np.int64)  # the sample's members of each list tell its size
    for a in range(0, len(x), 8192):
        held += np.bincount(memberships(graph, x[a : a + 8192], spread, most)[1], minlength=len(held))
    parts = np.maximum(1, np.ceil(held / len(x) * n / tile_rows)).astype(np.int64)
    first = np.cumsum(parts * (parts + 1) // 2) - parts * (parts + 1) // 2  # a list's tiles: each two of its parts, and each part with itself
    shared = spark.sparkContext.broadcast((graph.c, graph.links, parts, first))
    tiles = int(first[-1] + parts[-1] * (parts[-1] + 1) // 2)

    def placed(batches):
        """(tile, side, row, vec) for every tile that a vector belongs to; side 2 is both."""
        c, links, parts, first = shared.value
        graph = CentroidGraph(c, links=links)
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                cut = b.slice(a, 2048)
                raw = cut.column(1)
                i, at = memberships(graph, _matrix(raw, dim), spread, most)
                side = np.full(len(i), 2)
                tile = first[at]
                if (large := np.flatnonzero(parts[at] > 1)).size:
                    own = np.array([xxhash.xxh3_64_intdigest(raw[int(v)].as_py(), 7) for v in i[large]], np.uint64) % parts[at[large]].astype(np.uint64)
                    more = [np.stack([np.full(p, e), np.arange(p)]) for e, p in enumerate(parts[at[large]])]
                    which, other = np.concatenate(more, axis=1)
                    mine = own.astype(np.int64)[which]
                    hi, lo = np.maximum(mine, other), np.minimum(mine, other)
                    small = np.flatnonzero(parts[at] == 1)
                    i = np.concatenate([i[small], i[large][which]])
                    tile = np.concatenate([tile[small], tile[large][which] + hi * (hi + 1) // 2 + lo])
                    side = np.concatenate([side[small], np.where(mine == other, 2, (mine > other).astype(np.int64))])
                yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), pa.array(side.astype(np.int8)), cut.column(0).take(pa.array(i)), raw.take(pa.array(i))], names=["tile", "side", "row", "vec"])

    # Four tiles a task, however many there are: a task's share does not grow with the table.
    members = reps.mapInArrow(placed, f"tile int, side tinyint, row {kind}, vec binary").repartition(max(1, tiles // 4), "tile")

    def compare(table: pa.Table) -> pa.Table:
        side, rows, x = table.column("side").to_numpy(), table.column("row").to_numpy(), _matrix(table.column("vec"), dim)
        if (side == 2).all():
            r, o, s = _within(rows, x, k, least, list_rows, spread, most)
        else:
            p, q = side == 0, side == 1
            r, o, s = (np.concatenate(z) for z in zip(_best(rows[p], x[p], rows[q], x[q], k, least), _best(rows[q], x[q], rows[p], x[p], k, least), strict=True))
        return pa.table([pa.array(r), pa.array(o), pa.array(s.astype(np.float32))], names=["row", "neighbour", "similarity"])

    near = members.groupBy("tile").applyInArrow(compare, out_schema)
    order = Window.partitionBy("row").orderBy(F.col("similarity").desc(), "neighbour")
    near = near.groupBy("row", "neighbour").agg(F.max("similarity").alias("similarity"))
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not copies.isEmpty():
        # A representative's neighbours hold for its copies; each neighbour stands for its k + 1 smallest copies.
        some = copies.withColumn("c", F.row_number().over(Window.partitionBy("rep").orderBy("row"))).where(F.col("c") <= k + 1)
        some = broadcast_below(materialize(some.select(F.col("rep").alias("neighbour"), F.col("row").alias("copy"))), 1_000_000)
        asks = broadcast_below(copies.select(F.col("rep").alias("row"), F.col("row").alias("ask")), 1_000_000)
        own = copies.select(F.col("rep").alias("row")).distinct().select("row", F.col("row").alias("neighbour"), F.lit(1.0).cast("float").alias("similarity"))
        wide = near.select("row", "neighbour", "similarity").unionByName(own).join(some, "neighbour", "left").select("row", F.coalesce("copy", "neighbour").alias("neighbour"), "similarity")
        wide = wide.join(asks, "row", "left").select(F.coalesce("ask", "row").alias("row"), "neighbour", "similarity").where("row != neighbour")
        near = wide.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return near.select(F.col("row").alias(row), "neighbour", "similarity", F.col("rank").cast("int").alias("rank"))
