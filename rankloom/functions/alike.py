"""Pairs of distinct titles whose sequence ratio reaches a bound, without comparing what can't."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Titles of a block; two blocks are compared in one task.
BLOCK = 8_000
#: Letters fall into classes, whose counts up to the depth are compared; both only weaken the bound.
CLASSES, DEPTH = 41, 8
PAIRS = "ta string, tb string, ab double, ba double"


def blocks(lengths: dict[int, int], least: float, size: int = BLOCK) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """Blocks of each length, (first, how many), and the pairs of blocks whose lengths let the ratio reach ``least``."""
    of, ranges, room = {}, [], 0
    for n, count in sorted(lengths.items()):
        if count <= room:
            room -= count
            ranges[-1] = (ranges[-1][0], n)
            of[n] = (len(ranges) - 1, 1)
            continue
        parts = -(-count // size)
        of[n] = (len(ranges), parts)
        ranges += [(n, n)] * parts
        room = size - count if parts == 1 else 0
    meet = [(i, j) for i in range(len(ranges)) for j in range(i, len(ranges)) if _reach(ranges[i][1], ranges[j][0], least)]
    return of, meet


def _reach(short: int, long: int, least: float) -> bool:
    return short >= long or 2 * short >= (least - 1e-9) * (short + long)


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence; no set of matching blocks has more letters."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.udf(returnType=IntegerType(), useArrow=True)
def common_letters_of(a: str, b: str) -> int:
    return common_letters(a, b)


def _counts(titles: list[str]) -> np.ndarray:
    """Bits (title, class and depth): whether the title has at least so many letters of the class."""
    flat = np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32) % CLASSES
    owner = np.repeat(np.arange(len(titles)), [len(t) for t in titles])
    n = np.bincount(owner * CLASSES + flat, minlength=len(titles) * CLASSES).reshape(-1, CLASSES)
    return (n[:, :, None] > np.arange(DEPTH)).reshape(len(titles), -1)


def alike(left: list[str], right: list[str] | None, least: float) -> list[tuple[str, str, float, float]]:
    """(a, b, ratio of a and b, of b and a) where either ratio reaches ``least``; within ``left`` if there is no ``right``.

    In two texts that reach it, at most 1 - least of all letters have no partner, so
    their letter counts differ by no more; the bits that tell most are compared first.
    """
    left = sorted(left, key=len)
    right = left if (own := right is None) else sorted(right, key=len)
    if not left or not right:
        return []
    bits = _counts(left + ([] if own else right))
    share = bits.mean(0)
    bits = bits[:, np.argsort(-share * (1 - share), kind="stable")]
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    words = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)
    x, y = words[: len(left)], words if own else words[len(left) :]
    first, sizes, out = np.ascontiguousarray(y[:, 0]), np.array([len(t) for t in right]), []
    for i, a in enumerate(left):
        low = i + 1 if own else int(np.searchsorted(sizes, len(a) * (least - 1e-9) / (2 - least + 1e-9), "left"))
        high = int(np.searchsorted(sizes, len(a) * (2 - least + 1e-9) / (least - 1e-9), "right"))
        if low >= high:
            continue
        most = (1 - least + 1e-9) * (len(a) + sizes[low:high])
        at = np.nonzero(np.bitwise_count(first[low:high] ^ x[i, 0]) <= most)[0]
        at = at[np.bitwise_count(y[at + low] ^ x[i]).sum(1) <= most[at]]
        for j in (at + low).tolist():
            b = right[j]
            if 2 * common_letters(a, b) < (least - 1e-9) * (len(a) + len(b)):
                continue
            ab, ba = (round(SequenceMatcher(None, *p).ratio(), 9) for p in ((a, b), (b, a)))
            if max(ab, ba) >= least:
                out.append((a, b, ab, ba))
    return out


def alike_titles(titles: DataFrame, least: float, size: int = BLOCK) -> DataFrame:
    """(ta, tb, ab, ba) of every two of the distinct, non-empty ``t`` of ``titles`` of which a ratio reaches ``least``."""
    lengths = {r[0]: r[1] for r in titles.groupBy(F.length("t")).count().collect()}
    of, meet = blocks(lengths, least, size)
    spark = titles.sparkSession
    where = F.broadcast(spark.createDataFrame([(n, *v) for n, v in of.items()], "n int, at int, parts int"))
    sides = [(i, i, j, 0) for i, j in meet] + [(j, i, j, 1) for i, j in meet if i != j]
    sides = F.broadcast(spark.createDataFrame(sides, "block int, i int, j int, side int"))
    placed = titles.join(where, F.length("t") == F.col("n")).select("t", (F.col("at") + F.pmod(F.xxhash64("t"), "parts")).cast("int").alias("block"))

    def compare(group):
        import pyarrow as pa

        side = np.array(group.column("side"))
        left, right = (group.filter(pa.array(side == k)).column("t").to_pylist() for k in (0, 1))
        same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        found = list(zip(*alike(left, None if same else right, least))) or [()] * 4
        kinds = [pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(found, kinds)], names=["ta", "tb", "ab", "ba"])

    return placed.join(sides, "block").select("t", "i", "j", "side").groupBy("i", "j").applyInArrow(compare, PAIRS)
