"""Filling containers of fixed capacity by bound-certified repacking.

Items are hashed into partitions of bounded size and packed there by best-fit
decreasing. Dual feasible functions give each partition a lower bound on its number of
containers; a partition that meets its bound is certified and final. The others keep
their full containers, exchange the documents of the rest (they are hashed anew into
fewer partitions) and are packed again, as long as that saves containers.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.scratch import drop, stage

PACKED = "doc_id long, piece int, begin_at long, size int, container_id string, fill int, certified boolean"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and fill of each bin; items of size 0 are dealt over the bins in turn.

    Open bins are kept by free space, with a bit mask of the spaces that occur, so the
    tightest bin that takes an item is one shift and one lowest bit away.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, fills = np.zeros(len(sizes), np.int64), []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order.tolist():
        size = int(sizes[i])
        if size == 0:
            break
        rest = mask >> size
        if rest:
            space = size + (rest & -rest).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask ^= 1 << space
            fills[b] += size
        else:
            space, b = capacity, len(fills)
            fills.append(size)
        bins[i] = b
        if left := space - size:
            by_space[left].append(b)
            mask |= 1 << left
    empty = np.flatnonzero(sizes == 0)
    if len(empty):
        fills = fills or [0]
        bins[empty] = np.arange(len(empty)) % len(fills)
    return bins, np.array(fills, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing of ``sizes`` needs fewer bins than this: the best of two families of dual feasible functions."""
    counts = np.bincount(sizes[sizes > 0], minlength=capacity + 1).astype(np.float64)
    x = np.arange(capacity + 1)
    best = float(counts @ x) / capacity
    # Threshold functions: more than capacity - e counts whole, less than e counts nothing.
    above, weight = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * x)
    for e in range(1, capacity // 2 + 1):
        whole = above[capacity - e + 1]
        middle = weight[capacity - e] - weight[e - 1]
        best = max(best, whole + middle / capacity)
    # Rounding functions: steps of 1/k, exact multiples of 1/(k+1) unchanged.
    for k in range(1, 21):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        best = max(best, float(counts @ np.where(exact, x / capacity, (scaled // capacity) / k)))
    return ceil(best - 1e-9)


def _pack(tag: str, capacity: int):
    import pyarrow as pa

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:

        sizes = table.column("size").to_numpy().astype(np.int64)
        ids = table.column("doc_id").to_numpy(zero_copy_only=False)
        pieces = table.column("piece").to_numpy()
        order = np.lexsort((pieces, ids))  # rows arrive in any order; the result must not depend on it
        table, sizes = table.take(pa.array(order)), sizes[order]
        bins, fills = best_fit_decreasing(sizes, capacity)
        certified = len(fills) == max(lower_bound(sizes, capacity), 1)
        names = [f"{tag}-{key[0].as_py()}-{b}" for b in bins.tolist()]
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "piece": table.column("piece"),
                "begin_at": table.column("begin_at"),
                "size": table.column("size"),
                "container_id": pa.array(names),
                "fill": pa.array(fills[bins].astype(np.int32)),
                "certified": pa.array([certified] * len(bins)),
            }
        )

    return run


def pack(items: DataFrame, capacity: int = 2048, part_items: int = 200_000, rounds: int = 4, seed: int = 0) -> DataFrame:
    """(doc_id, piece, begin_at, size, container_id, fill, certified) for every item.

    ``items``: doc_id, n_tokens (null counts as 0). Only an item longer than ``capacity``
    is split, into whole containers and one rest that is packed like an item. Items of
    size 0 are assigned too. ``certified`` says that the containers of the item's last
    partition are as few as any packing of that partition can have. Rows with the same
    doc_id are items of their own. An empty table gives an empty table.
    """
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0))
    cut = items.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
    begin = F.col("piece").cast("long") * capacity
    cut = cut.select("doc_id", "piece", begin.alias("begin_at"), F.least(F.col("n") - begin, F.lit(capacity)).cast("int").alias("size"))
    all_pieces = stage(cut, "pieces")
    full = all_pieces.where(F.col("size") == capacity).select(
        "*",
        F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container_id"),
        F.col("size").alias("fill"),
        F.lit(True).alias("certified"),
    )
    done, pool = [full], all_pieces.where(F.col("size") < capacity)
    count, used = pool.count(), None
    for r in range(rounds):
        if not count:
            break
        parts = max(1, ceil(count / part_items))
        part = F.pmod(F.xxhash64(F.lit(seed + r), "doc_id", "piece"), F.lit(parts)).alias("_part")
        packed = pool.select("doc_id", "piece", "begin_at", "size", part).groupBy("_part").applyInArrow(_pack(f"r{r}", capacity), PACKED)
        # A container is counted once, by its first piece.
        packed = stage(packed, "packed", gap=F.count_if(~F.col("certified")))
        bins = packed.select("container_id").distinct().count()
        if used is not None and bins >= used:  # exchanging saved nothing: what was there stands
            drop(packed)
            done.append(open_)
            count = 0
            break
        loose = ~F.col("certified") & (F.col("fill") < capacity)
        done.append(packed.where(~loose))
        open_ = packed.where(loose)
        count = open_.count()
        used = open_.select("container_id").distinct().count() if count else 0
        pool = open_
        if parts == 1:  # one partition held all that could be exchanged
            done.append(open_)
            count = 0
            break
    if count:
        done.append(open_)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out
