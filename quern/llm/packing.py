"""Problem 9: items of varying length in containers of a fixed capacity.

Method: cost-balanced packing.  A document of n tokens costs linear * n +
quadratic * n * n (attention).  Descending documents go to the lowest-cost
sequence that has room for them.  The number of sequences begins at the lower
bound of what the items need; only an item that fits nowhere opens another.
Documents longer than a container are cut into full containers and a rest,
which is packed like any other item.

Items are spread over shards by a hash of their key, each of a bounded number
of rows, so the shards pack at once and independently; a shard wastes no more
than a few containers beyond its bound.

Defined results: null and empty texts and rows without a key take no part; equal sizes are ordered by
key; repeated keys are items of their own; an empty table gives no container.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import materialize


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound of the containers needed: by volume, and by items too large to share one (Martello and Toth's L2)."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    number, volume = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best = -(-int(volume[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        big = number[-1] - number[capacity - k]  # these share with nothing of size k or more
        mid = number[capacity - k] - number[capacity // 2]
        mid_volume = volume[capacity - k] - volume[capacity // 2]
        small = volume[capacity // 2] - (volume[k - 1] if k else 0)
        best = max(best, int(big + mid + max(0, -(-int(small - (mid * capacity - mid_volume)) // capacity))))
    return best


def pack(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048, slack: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(container, offset) of items whose sizes descend and do not exceed ``capacity``.

    Sequences are kept by the room they have left, each room's in order of cost.
    An item goes to the lowest-cost sequence of those that it fills but for
    ``slack`` tokens, else to the lowest-cost sequence of all that have room.
    """
    slack = capacity // 64 if slack is None else slack
    bins = least_bins(sizes, capacity)
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    by_room[capacity] = [(0.0, b) for b in range(bins)]
    cheapest = np.full(capacity + 1, np.inf)  # by room
    if bins:
        cheapest[capacity] = 0.0
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        room = n + int(cheapest[n : n + slack + 1].argmin())
        if cheapest[room] == np.inf:
            room = n + int(cheapest[n:].argmin())
        if cheapest[room] == np.inf:
            room, cost, b = capacity, 0.0, bins
            bins += 1
        else:
            cost, b = heapq.heappop(by_room[room])
            cheapest[room] = by_room[room][0][0] if by_room[room] else np.inf
        where[i], offset[i] = b, capacity - room
        room, cost = room - n, cost + linear * n + quadratic * n * n
        heapq.heappush(by_room[room], (cost, b))
        cheapest[room] = by_room[room][0][0]
    return where, offset


def loads(packed: DataFrame, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """(container, n_items, n_tokens, cost) of a packing: what it fills, and the attention cost that the method balances."""
    n = F.col("n_tokens")
    return packed.groupBy("container").agg(F.count("*").alias("n_items"), F.sum(n).alias("n_tokens"), F.sum(linear * n + quadratic * n * n).alias("cost"))


def containers(items: DataFrame, key: str, size: str, capacity: int = 2048, linear: float = 1.0, quadratic: float | None = None, shard_rows: int = 100_000, slack: int | None = None) -> DataFrame:
    """(key, piece, n_tokens, container, place, offset) of every item of a positive size.

    ``container`` names the shard and the container in it; ``place`` counts the
    items of a container from 0, ``offset`` its tokens before the item.
    ``slack`` is that of ``pack``: ``capacity`` is the pure rule of lowest cost.
    """
    quadratic = 1.0 / capacity if quadratic is None else quadratic
    items = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where("size > 0 AND key IS NOT NULL")
    kind = dict(items.dtypes)["key"]
    items = materialize(items)
    shards = max(1, math.ceil(items.count() / shard_rows))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["size"].to_numpy()
        full, rest = n // capacity, n % capacity
        parts = full + (rest > 0)
        owner = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        sizes = np.where(piece < full[owner], capacity, rest[owner])
        keys = pdf["key"].to_numpy()[owner]
        order = np.lexsort((piece, keys, -sizes))
        where, offset = pack(sizes[order], capacity, linear, quadratic, slack)
        out = pd.DataFrame({key: keys[order], "piece": piece[order], "n_tokens": sizes[order], "container": where, "offset": offset})
        out["place"] = out.sort_values(["container", "offset"]).groupby("container").cumcount()
        out["container"] = out["container"] * shards + int(pdf["shard"].iloc[0])
        return out[[key, "piece", "n_tokens", "container", "place", "offset"]]

    return (
        items.withColumn("shard", F.pmod(F.xxhash64("key", "size"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(one, f"`{key}` {kind}, piece bigint, n_tokens bigint, container bigint, place bigint, offset bigint")
    )
