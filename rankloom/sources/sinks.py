"""Writers: one folder a cut-off, and keyed replacement of earlier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.scratch import stage


def write_top_k(ranked: DataFrame, ks: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """The first k rows of every list for each k, written and read back."""
    cut = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    return stage(cut, "top-k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new ones."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
