"""Consolidating pairwise links into groups by deterministic Borůvka hooking.

Every component picks its smallest outgoing edge. Edges are ordered by (smaller label,
larger label), all distinct, so the picks make trees whose only cycles are two components
that picked the same edge; the smaller of the two is the root. Trees collapse by pointer
doubling, edges take the labels of the roots, and duplicates and inner edges fall away,
until no edge is left. The number of components at least halves in every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.scratch import drop, grown, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group_id) for every node of ``edges``; ``group_id`` is the smallest node.

    Nulls on either side, self links, repeated and reversed links make no difference. No
    edges give no rows. Joins run on written tables with adaptive skew handling, and the
    smallest neighbour is taken with map-side combining, so a node with a third of all
    links is no bottleneck. Nothing but counts reaches the driver.
    """
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    usable = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    live = stage(edges.where(usable).select(lo, hi).distinct(), "edges")
    labels = None
    while live.measured["rows"]:
        roots = _collapse(_pick(live))
        if labels is None:
            labels = roots.select(F.col("v").alias("node"), F.col("p").alias("label"))
        else:
            moved = labels.join(grown(roots), labels.label == roots.v, "left")
            old, labels = labels, stage(moved.select("node", F.coalesce("p", "label").alias("label")), "labels")
            drop(old)
        live, old = stage(_relabel(live, roots), "edges"), live
        drop(old)
    if labels is None:
        return live.select(F.col("lo").alias("node"), F.col("hi").alias("group_id"))
    # A root is the smaller end of a mutual pick, not always its component's smallest node.
    least = labels.groupBy("label").agg(F.min("node").alias("group_id"))
    return labels.join(grown(least), "label").select("node", "group_id")


def _pick(edges: DataFrame) -> DataFrame:
    """(v, p): the other end of each component's smallest edge; roots point to themselves."""
    ends = F.array(
        F.struct(F.col("lo").alias("v"), F.col("hi").alias("p")), F.struct(F.col("hi").alias("v"), F.col("lo").alias("p"))
    )
    # Among the edges of v the smallest is the one to its smallest neighbour.
    picked = edges.select(F.inline(ends)).groupBy("v").agg(F.min("p").alias("p"))
    other = picked.select(F.col("v").alias("w"), F.col("p").alias("q"))
    mutual = (F.col("q") == F.col("v")) & (F.col("v") < F.col("p"))
    rooted = picked.join(grown(other), F.col("p") == F.col("w"))
    return stage(rooted.select("v", F.when(mutual, F.col("v")).otherwise(F.col("p")).alias("p")), "parents")


def _collapse(parents: DataFrame) -> DataFrame:
    """Pointer doubling until every node points to its root; two doublings a written table."""
    while True:
        once = _double(parents)
        nxt = stage(_double(once.drop("moved")), "parents", moved=F.count_if("moved"))
        drop(parents)
        if not nxt.measured["moved"]:
            return nxt.drop("moved")
        parents = nxt.drop("moved")


def _double(parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("v").alias("w"), F.col("p").alias("g"))
    far = parents.join(grown(up), F.col("p") == F.col("w"))
    return far.select("v", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved"))


def _relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    left = roots.select(F.col("v").alias("lo"), F.col("p").alias("x"))
    right = roots.select(F.col("v").alias("hi"), F.col("p").alias("y"))
    ends = edges.join(grown(left), "lo").join(grown(right), "hi").where(F.col("x") != F.col("y"))
    return ends.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()


def reference_key(ref: Column) -> Column:
    """One notation for an identifier of a record; null for null and blank.

    White space and letter case don't matter, nor does the address before an identifier,
    an ``arXiv:`` in front of it or the version after an arXiv number.
    """
    bare = F.lower(F.regexp_replace(ref, r"[\s\p{Z}\p{C}]+", ""))
    bare = F.regexp_replace(bare, r"^(?:https?://[^?#]*/|[a-z.]+\.(?:org|com|example)/(?:[^?#]*/)?)", "")
    bare = F.regexp_replace(bare, r"[?#].*$|\.pdf$|/+$", "")
    bare = F.regexp_replace(bare, r"^(?:arxiv|openalex|s2|corpusid)[:.]", "")
    bare = F.regexp_replace(bare, r"^(\d{4}\.\d{4,5})v\d+$", "$1")
    return F.when(bare != "", bare)


def _hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(7), key)


def record_links(matches: DataFrame, records: DataFrame) -> DataFrame:
    """(a, b): edges that join the records which positive matches link; void references fall away.

    References that differ in notation only, and repeated links, are made one before the
    joins. Keys travel as 128-bit hashes. Records that share an identifier hang on the
    smallest of them, and a match links two such hubs: an identifier of a third of all
    records gives an edge a record, never all pairs.
    """
    k1, k2 = _hashed(F.col("k"))
    ids = (
        records.select("rec_id", F.explode(F.array("source_record_id", "paperid", "id")).alias("ref"))
        .where(F.col("ref").isNotNull())
        .select("rec_id", reference_key(F.col("ref")).alias("k"))
        .where(F.col("k").isNotNull())
        .select("rec_id", k1.alias("k1"), k2.alias("k2"))
    )
    l1, l2 = _hashed(F.col("l"))
    r1, r2 = _hashed(F.col("r"))
    links = (
        matches.where("is_match")
        .select(reference_key(F.col("left_ref")).alias("l"), reference_key(F.col("right_ref")).alias("r"))
        .where(F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l") != F.col("r")))
        .select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"))
        .select(l1.alias("l1"), l2.alias("l2"), r1.alias("r1"), r2.alias("r2"))
        .distinct()
    )
    hubs = ids.groupBy("k1", "k2").agg(F.min("rec_id").alias("hub"), (F.min("rec_id") < F.max("rec_id")).alias("many"))
    left, right = (hubs.select(F.col("k1").alias(f"{e}1"), F.col("k2").alias(f"{e}2"), F.col("hub").alias(h), F.col("many").alias(f"many_{h}")) for e, h in (("l", "a"), ("r", "b")))
    met = stage(links.join(left, ["l1", "l2"]).join(right, ["r1", "r2"]), "met", many=F.count_if(F.col("many_a") | F.col("many_b")))
    edges = met.select("a", "b")
    if met.measured["many"]:
        shared = met.where("many_a").select("l1", "l2", "a").toDF("k1", "k2", "b").unionByName(met.where("many_b").select("r1", "r2", "b").toDF("k1", "k2", "b"))
        edges = edges.unionByName(ids.join(shared.distinct(), ["k1", "k2"]).select(F.col("rec_id").alias("a"), "b"))
    return edges


def record_groups(matches: DataFrame, records: DataFrame) -> DataFrame:
    """(rec_id, group_id) of each record in a group of two or more.

    Only links whose verdict is true count. Empty tables, null references and unknown
    references give no rows.
    """
    return connected_components(record_links(matches, records)).select(F.col("node").alias("rec_id"), "group_id")
