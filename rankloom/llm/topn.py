"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    rows: DataFrame, group: str, order: Sequence[Column], salt_by: Sequence[str], n: int, salts: int = 64, rank_as: str = "place", copies: bool = False
) -> DataFrame:
    """The first ``n`` rows of every ``group`` under ``order``, ranked from 1 in ``rank_as``.

    Each group is hashed into ``salts`` subgroups by ``salt_by``; every subgroup keeps
    its first ``n`` rows, and the survivors (at most ``n * salts`` a group) are ranked
    again. Spark cuts each map partition to ``n`` rows a subgroup before the shuffle
    (WindowGroupLimit), so a group with a third of all rows moves a few rows a task.

    ``copies``: rows equal in every column are one row. They have one dense rank, so the
    cut keeps them beside each other, and they are made one among the survivors only.

    ``order`` should end in a unique key; rows equal in all of it come in any order.
    A null group is a group. An empty table gives an empty table. Columns of ``rows``
    named ``_salt`` or ``_r`` are refused.
    """
    for c in ("_salt", "_r", rank_as):
        if c in rows.columns:
            raise ValueError(f"column {c} is in the way")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    first = Window.partitionBy(group, "_salt").orderBy(*order)
    last = Window.partitionBy(group).orderBy(*order)
    kept = salted.withColumn("_r", (F.dense_rank() if copies else F.row_number()).over(first)).where(F.col("_r") <= n)
    kept = (kept.distinct() if copies else kept).drop("_salt", "_r")
    return kept.withColumn(rank_as, F.row_number().over(last)).where(F.col(rank_as) <= n)


def page_items(pages: DataFrame) -> DataFrame:
    """Scored items of result pages, as often as their page was delivered.

    Rows: qid, pred_id, item_pos, score, title. Items without a score or with one that
    is not a number are left out; null lists and null items give no row.
    """
    items = pages.select(
        "qid",
        "pred_id",
        F.posexplode(
            F.transform(
                "papers", lambda p: F.struct(p["title"].alias("title"), p["raw"]["day8_final_score"].alias("score"))
            )
        ).alias("item_pos", "item"),
    )
    scored = items.where(F.col("item.score").isNotNull() & ~F.isnan("item.score"))
    return scored.select("qid", "pred_id", "item_pos", "item.score", "item.title")


def best_items(pages: DataFrame, n: int = 10, salts: int = 64) -> DataFrame:
    """(qid, place, pred_id, item_pos) of the ``n`` best items of each qid.

    Ties: smaller title in byte order (a null title after all others), then smaller
    pred_id, then smaller position.
    """
    order = [F.desc("score"), F.asc_nulls_last("title"), F.asc("pred_id"), F.asc("item_pos")]
    best = top_n(page_items(pages), "qid", order, ["pred_id", "item_pos"], n, salts, copies=True)
    return best.select("qid", "place", "pred_id", F.col("item_pos").cast("int").alias("item_pos"))
