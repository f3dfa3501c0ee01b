"""Problem 4: groups of records that differ by small edits or order.

Method: BagMinHash.  A record is a multiset of word shingles.  An element's
weight is discretised to unit cells 0, 1, 2 ..., and the cells are grouped in
levels of doubling size: [0, 1), [1, 2), [2, 4), [4, 8) ...  Each level carries one
Poisson process whose rate is its size; a point is (time, position) and falls to
a cell by halving the level again and again, one bit of its hash each.  A level
wholly below the weight keeps all its points, the level that the weight cuts
keeps those whose cell lies below.  So an element costs as many processes as its
weight has bits, and the number of points does not depend on the weights.  A
signature keeps the earliest time at each position, so two signatures agree at a
position with the probability of the weighted Jaccard similarity.  Processes are
advanced point by point and dropped as soon as their time passes the latest entry
of the record's signature.  Signatures are banded; records that share a band are
compared exactly.

Buckets never become all their pairs: equal shingle sets are collapsed first,
then every member of a bucket is checked against the bucket's smallest member,
links are closed to components, and only members of one bucket that are still in
different components are checked with each other.  That loses no candidate
link, for inside one component no further link can change a group.  Of a bucket
with more than ``most_open`` of those, only pairs that share one of the rarest
elements of each are checked: two records of similarity ``least`` cannot share
only others, so that loses none either, and unlike records share none.

Defined results: records without text or with fewer words than a shingle have no
partner; rows of one id are one record; ties and repeats do not matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import lines
from quern.runtime import broadcast_below, materialize

_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word to 64-bit hash, remembered within a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(texts: list[str], width: int, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, element, weight) of the word shingles of all texts, ordered by owner and element."""
    words = Words()
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        counts[i] = len(w)
        flat += map(words.__getitem__, w)
    h = np.array(flat, np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    e = h[:n].copy()
    for j in range(1, width):
        e = mix(e * _M3 + h[j : n + j])
    e >>= np.uint64(32)  # identifiers of 32 bits halve what travels; equal by chance once in 10^5 pairs of records
    own = owner[:n]
    e, own = e[own == owner[width - 1 :]], own[own == owner[width - 1 :]]
    code, weight = np.unique((own.astype(np.uint64) << np.uint64(32)) | e, return_counts=True)
    return (code >> np.uint64(32)).astype(np.int64), code & np.uint64(0xFFFFFFFF), weight if weighted else np.ones(len(code), np.int64)


def levels(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """(owner, state, level's size, cells of it below the weight) of every level that an element of this weight has."""
    out = [(owner, mix(element * _M3 + mix(np.array([seed], np.uint64))), np.ones(len(owner)), np.ones(len(owner), np.int64))]
    k = 1
    while (on := np.flatnonzero(weight > (low := 1 << (k - 1)))).size:
        out.append((owner[on], mix(element[on] * _M3 + mix(np.array([seed + k], np.uint64))), np.full(len(on), float(low)), np.minimum(weight[on] - low, low)))
        k += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bag_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int, seed: int = 1) -> np.ndarray:
    """(n, size) signatures: the bits of the earliest time at each position; -1 for owners without elements."""
    owner, state, rate, below = levels(owner, element, weight, seed)
    cut = below < rate
    time = np.zeros(len(owner))
    sig = np.full(n * size, np.inf)
    table = sig.reshape(n, size)
    step = 0
    latest = np.full(n, np.inf)
    while len(owner):
        step += 1
        state = mix(state + _M3)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        at = owner * size + (mix(state ^ _M2) % np.uint64(size)).astype(np.int64)
        if cut.any():
            # the first bits of a hash are the halves that the point falls to, down to its cell
            in_ = ~cut
            cell = (mix(state[cut] ^ _M1) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * rate[cut]
            in_[cut] = np.floor(cell) < below[cut]
            np.minimum.at(sig, at[in_], time[in_])
        else:
            np.minimum.at(sig, at, time)
        if step & 1 == 0 or step < 3:
            if len(owner) * 4 < n:
                own = np.unique(owner)
                latest[own] = table[own].max(1)
            else:
                latest = table.max(1)
        live = time < latest[owner]
        owner, state, time, rate, below, cut = owner[live], state[live], time[live], rate[live], below[live], cut[live]
    return np.where(np.isinf(sig), -1.0, sig).view(np.int64).reshape(n, size)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys of ``rows`` successive positions each."""
    s = sig[:, : bands * rows].view(np.uint64).reshape(len(sig), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] * _M3 + np.uint64(17)
    for j in range(rows):
        key = mix(key + s[:, :, j])
    return key.view(np.int64)


def signatures(src: DataFrame, width: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """(row_id, id, n, print1, print2, elements, weights, bands) of the prepared rows that have a shingle.

    A row's lines whose identifier is in its array ``gone`` are left out, where
    ``src`` has one.  ``n`` is the sum of weights; without ``weighted`` each is 1
    and ``weights`` is null.
    """
    kinds = dict(src.dtypes)
    without = "gone" in kinds
    src = src.select("row_id", "id", "text", *(["keys", "gone"] if without else []))

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            if without:
                for i, (keys, gone) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                    if gone and not (out := set(gone)).isdisjoint(keys):
                        texts[i] = "\n".join(ln for ln, k in zip(texts[i].split("\n"), keys, strict=True) if k not in out)
            n = len(texts)
            owner, el, weight = shingles(texts, width, weighted)
            keys = band_keys(bag_minhash(owner, el, weight, n, bands * rows), bands, rows)
            first = np.searchsorted(owner, np.arange(n + 1))
            has = np.flatnonzero(np.diff(first) > 0)
            starts = first[has]
            marks = mix(el * _M3 + weight.astype(np.uint64))
            each = lambda x: np.add.reduceat(x, starts) if len(has) else x[:0]
            ends = pa.array(np.append(starts, len(el)).astype(np.int32))
            pick = pa.array(has, pa.int64())
            cols = [
                b.column(0).take(pick),
                b.column(1).take(pick),
                pa.array(each(weight).astype(np.int64)),
                pa.array(each(marks).view(np.int64)),
                pa.array(each(mix(marks + _M1)).view(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array(el.astype(np.uint32).view(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(weight.astype(np.int32))) if weighted else pa.nulls(len(has), pa.list_(pa.int32())),
                pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(keys[has].ravel())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["row_id", "id", "n", "print1", "print2", "elements", "weights", "bands"])

    return src.mapInArrow(run, f"row_id {kinds['row_id']}, id {kinds['id']}, n bigint, print1 bigint, print2 bigint, elements array<int>, weights array<int>, bands array<bigint>")


def _shared(batches):
    """(a, b, na, nb, both): the sum over the elements of two rows of the lesser weight."""
    for b in batches:
        sides = []
        for el, w in ((4, 5), (6, 7)):
            col = b.column(el)
            own = np.repeat(np.arange(len(col), dtype=np.int64), np.diff(col.offsets.to_numpy()))
            sides.append(((own << 32) | col.flatten().to_numpy(zero_copy_only=False).view(np.uint32), b.column(w).flatten().to_numpy(zero_copy_only=False)))
        _, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
        both = np.bincount(sides[0][0][i] >> 32, np.minimum(sides[0][1][i], sides[1][1][j]), b.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(both)], names=["a", "b", "na", "nb", "both"])


def verified(pairs: DataFrame, sets: DataFrame, least: float, weighted: bool = False) -> DataFrame:
    """The pairs (a, b) of rows whose elements overlap by at least ``least`` of their union, with ``weighted`` as multisets."""
    side = lambda x: sets.select(F.col("row_id").alias(x), F.col("n").alias(f"n{x}"), F.col("elements").alias(f"e{x}"), F.col("weights").alias(f"w{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))  # the most that sizes alone allow
    if weighted:
        kind = dict(sets.dtypes)["row_id"]
        met = met.select("a", "b", "na", "nb", "ea", "wa", "eb", "wb").mapInArrow(_shared, f"a {kind}, b {kind}, na bigint, nb bigint, both bigint")
        both = F.col("both")
    else:
        both = F.size(F.array_intersect("ea", "eb"))
    return met.where(both >= F.lit(least) * (F.col("na") + F.col("nb") - both) - F.lit(1e-9)).select("a", "b")


def rare_pairs(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of rows (row_id, label) of different labels that share one of the rarest elements of each.

    A row's elements go from rare to frequent; those count whose weight together
    with all behind them is ``least`` of the row's: rows of that similarity
    cannot share only others.
    """
    own = rows.join(sets, "row_id").select("row_id", "label", "n", F.explode(F.arrays_zip("elements", F.coalesce("weights", F.transform("elements", lambda x: F.lit(1))).alias("weights"))).alias("x")).select("row_id", "label", "n", F.col("x.elements").alias("el"), F.col("x.weights").alias("w"))
    own = materialize(own.join(own.groupBy("el").agg(F.count("*").alias("f")), "el"))
    behind = F.sum("w").over(Window.partitionBy("row_id").orderBy(F.col("f").desc(), F.col("el").desc()).rowsBetween(Window.unboundedPreceding, 0))
    front = own.withColumn("behind", behind).where((F.col("behind") >= F.lit(least) * F.col("n") - 1e-9) & (F.col("f") > 1))
    left, right = front.select("el", F.col("row_id").alias("a"), F.col("label").alias("la")), front.select("el", F.col("row_id").alias("b"), F.col("label").alias("lb"))
    return left.join(right, "el").where("la < lb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for all nodes of ``edges`` (a, b).

    Labels fall to the least of the neighbours' and then of the label's own
    label, so a chain of length L settles after about log L rounds.
    """
    links = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = materialize(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = materialize(
            labels.join(near, "node", "left").join(hop, "label", "left").select("node", F.least("label", "seen", "beyond").alias("label"), F.col("label").alias("was"))
        )
        labels = new.select("node", "label")
        if new.where("label != was").isEmpty():
            return labels


def groups(src: DataFrame, width: int = 5, least: float = 0.8, bands: int = 20, rows: int = 5, weighted: bool = False, most_open: int = 64) -> DataFrame:
    """(id, class_id): every id with a shingle and its class; those alone in theirs have no partner.

    ``src`` has (row_id, id, text[, keys, gone]).  ``bands`` and ``rows`` set
    the chance to miss a pair of similarity s: (1 - s**rows)**bands.
    """
    table = materialize(signatures(src, width, bands, rows, weighted))
    prints = table.groupBy("print1", "print2").agg(F.min("row_id").alias("rep"))
    copies = materialize(table.select("row_id", "id", "print1", "print2").join(prints, ["print1", "print2"]).select("row_id", "id", "rep"))
    others = broadcast_below(copies.where("row_id != rep").select("row_id"), 2_000_000)
    one = table.join(others, "row_id", "left_anti")
    spread = one.select("row_id", F.explode("bands").alias("key"))
    bucket = spread.groupBy("key").agg(F.min("row_id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    members = materialize(spread.join(bucket.hint("shuffle_hash"), "key"))  # few keys have two rows: nothing need be sorted
    candidates = broadcast_below(members.select("row_id").distinct(), 2_000_000)
    sets = materialize(one.select("row_id", "n", "elements", "weights").join(candidates, "row_id", "left_semi"))
    first = materialize(verified(members.where("row_id != rep").select(F.col("rep").alias("a"), F.col("row_id").alias("b")).distinct(), sets, least, weighted))
    labels = components(first)
    placed = members.where("size > 2").join(labels.withColumnRenamed("node", "row_id"), "row_id", "left").select("key", "row_id", F.coalesce("label", "row_id").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("open")).where("lo != hi").select("key", "open")
    open_ = materialize(placed.join(mixed, "key"))
    few = open_.where(F.col("open") <= most_open)
    left, right = few.select("key", F.col("row_id").alias("a"), F.col("label").alias("la")), few.select("key", F.col("row_id").alias("b"), F.col("label").alias("lb"))
    pairs = left.join(right, "key").where("la < lb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()  # most_open ** 2 a bucket
    many = open_.where(F.col("open") > most_open).select("row_id", "label").distinct()
    if not many.isEmpty():
        pairs = pairs.union(rare_pairs(many, sets, least)).distinct()
    rest = materialize(verified(pairs, sets, least, weighted))
    if not rest.isEmpty():
        labels = components(first.unionByName(rest))
    return copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("label", "rep")).alias("class_id"))


def article_groups(df: DataFrame, width: int = 3, least: float = 0.5, bands: int = 50, rows: int = 3, weighted: bool = False) -> DataFrame:
    """Groups of articles by title and content together, once characters, markup and repeated lines are put right."""
    slug = F.col("board.slug")
    src = df.where(F.col("content").isNotNull() & F.col("content").rlike("\\S")).select("row_id", "id", slug.alias("slug"), "title", "content")
    need = broadcast_below(materialize(lines.thresholds(df.select("id", slug.alias("slug")), "id", "slug").drop("n_docs")), lines.SMALL)
    ready = materialize(lines.prepared(src, "row_id", "id", "slug", "content", title="title", keep="clean"))
    blocks = lines.repeated_blocks(materialize(lines.suffix_table(ready, need, lines.DEPTH)))
    return groups(ready.join(lines.source_keys(blocks), "source", "left"), width, least, bands, rows, weighted)


def group_pairs(classes: DataFrame) -> DataFrame:
    """(id_a, id_b) of each two ids of one class, the smaller first."""
    both = classes.select("class_id", F.col("id").alias("id_a")).join(classes.select("class_id", F.col("id").alias("id_b")), "class_id")
    return both.where("id_a < id_b").select("id_a", "id_b")
