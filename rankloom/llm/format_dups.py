"""Duplicates hidden by formatting differences.

Every record is reduced to the letters and digits of its fields, hashed to 128 bits
and counted under that hash with map-side combining. A third hash of 64 bits and the
length are part of the key as a collision check: records that share the 128 bits alone
stay apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.cells import canonical, has_content
from rankloom.scratch import stage

PRINT = ("h1", "h2", "check", "width")
#: No more groups than this are ever joined by broadcast (see ``list_copies``).
MAX_HOT = 1000


def fingerprint(fields: Sequence[Column]) -> list[Column]:
    """Columns h1, h2 (128 bits), check and width of canonical fields in a fixed order."""
    text = F.concat_ws("\x1f", *fields)
    return [
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        F.xxhash64(F.lit(2), text).alias("check"),
        F.length(text).alias("width"),
    ]


def any_order(values: Column) -> Column:
    """Canonical form of a list whose order doesn't matter; blank entries left out."""
    clean = F.filter(F.transform(values, canonical), lambda v: v != "")
    return F.coalesce(F.array_join(F.array_sort(clean), "\x1e"), F.lit(""))


def venue_parts(venue: Column) -> Column:
    """Canonical venue: the fields of a JSON object in any order, or the plain text."""
    fields = F.from_json(venue, "map<string,string>")
    pairs = F.transform(
        F.map_entries(fields), lambda e: F.concat(canonical(e["key"]), F.lit("="), canonical(e["value"]))
    )
    pairs = F.filter(pairs, lambda p: ~p.endswith("="))
    as_object = venue.rlike(r"^\s*\{") & fields.isNotNull()
    return F.when(as_object, F.array_join(F.array_sort(pairs), "\x1e")).otherwise(canonical(venue))


def record_fields() -> list[Column]:
    """The bibliographic fields that make a record of papers_with_duplicates."""
    def nonblank(a: Column, b: Column) -> Column:
        return F.when(has_content(a), a).otherwise(b)

    openalex = F.col("source").eqNullSafe("openalex")
    names = F.when(openalex, F.col("authorships.author.display_name")).otherwise(F.col("authors.name"))
    others = F.when(openalex, F.col("authors.name")).otherwise(F.col("authorships.author.display_name"))
    return [
        F.coalesce(F.col("source"), F.lit("")),
        canonical(nonblank(F.col("title"), F.col("display_name"))),
        any_order(F.coalesce(names, others)),
        F.coalesce(F.coalesce("year", "publication_year").cast("string"), F.lit("")),
        canonical(nonblank(F.col("doi"), F.col("externalids.doi"))),
        venue_parts(F.col("venue")),
        canonical(F.col("abstract")),
    ]


def record_prints(records: DataFrame) -> DataFrame:
    return records.select(
        F.lit("papers").alias("tab"), F.col("rec_id").alias("id"), F.lit(0).alias("pos"), *fingerprint(record_fields())
    )


def item_prints(pages: DataFrame) -> DataFrame:
    """Prints of the items of each qid, an item of a page delivered twice once."""
    titles = pages.select(
        F.coalesce("qid", F.lit("\x00")).alias("q"), "pred_id", F.posexplode("papers.title").alias("pos", "title")
    )
    made = titles.select(
        F.lit("predictions").alias("tab"), F.col("pred_id").alias("id"), "pos", *fingerprint([F.col("q"), canonical(F.col("title"))])
    )
    return made.distinct()


def count_copies(prints: DataFrame) -> DataFrame:
    """One row per distinct record: its prints, first key and number of copies."""
    return prints.groupBy("tab", *PRINT).agg(
        F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("copies")
    )


def list_copies(prints: DataFrame) -> DataFrame:
    """(tab, first_id, first_pos, copy_id, copy_pos) of each copy other than the first.

    ``prints`` is read twice and should be a written table. Groups that hold more than a
    thousandth of all rows (so at most 1,000 of them, whatever the data) are matched by
    broadcast, the rest by a shuffled join; no group of copies meets in one task.
    """
    groups = stage(count_copies(prints).where(F.col("copies") > 1), "copy-groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    hot = groups.where(F.col("copies") > max(10_000, total // MAX_HOT))
    cold = groups.where(F.col("copies") <= max(10_000, total // MAX_HOT))
    on = ["tab", *PRINT]
    few = F.broadcast(hot)
    parts = [
        prints.join(few, on),
        prints.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on),
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .where(F.struct("id", "pos") != F.col("first"))
        .select(
            "tab",
            F.col("first.id").alias("first_id"),
            F.col("first.pos").cast("int").alias("first_pos"),
            F.col("id").alias("copy_id"),
            F.col("pos").cast("int").alias("copy_pos"),
        )
    )


def format_copies(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Copies among records and among the items of each qid that differ in format only.

    Null equals blank in every field. Letter case, punctuation, symbols and white space
    (visible or not) don't matter; letters and digits do, also those of markup and
    entities. Author names may come in any order, as may the fields of a JSON venue.
    Repeated pages count once; empty tables give no rows; other columns don't matter.
    """
    prints = stage(record_prints(records).unionByName(item_prints(pages)), "prints")
    return list_copies(prints)


def distinct_records(records: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per distinct record or item with its first key and its number of copies."""
    counted = count_copies(record_prints(records).unionByName(item_prints(pages)))
    return counted.select("tab", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos"), "copies")
