"""Deeply nested records turned into flat child tables with parent and position.

Every target table is one ``inline`` over an array that nested ``transform`` calls
have already tagged with the ancestor's key and the element's index, so a record is
read once and no row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.cells import has_content

#: A text that is an arXiv identifier and nothing else, in any notation.
ARXIV_ONLY = (
    r"(?i)^[\s\p{Z}\p{C}]*(?:https?://\S*?/(?:abs|pdf|html)/|(?:https?://)?(?:dx\.)?doi\.\S+?/|"
    r"(?:doi\s*:\s*)?10\.48550/)?(?:arxiv\s*[:./]?\s*)?"
    r"(?:\d{4}\.\d{4,5}|[a-z][a-z-]*(?:\.[a-z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?[\s\p{Z}\p{C}]*$"
)


def list_depth(text: Column) -> Column:
    """How deep the brackets outside the strings of a JSON text are nested."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    outside = F.array_join(F.filter(F.split(plain, '"'), lambda _, i: i % 2 == 0), " ")
    brackets = F.regexp_extract_all(outside, F.lit(r"[\[\]]"), F.lit(0))

    def step(seen: Column, bracket: Column) -> Column:
        now = seen["now"] + F.when(bracket == "[", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(seen["most"], now).alias("most"))

    deep = F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda x: x["most"])
    return F.coalesce(deep, F.lit(0))


def json_items(text: Column) -> Column:
    """All items of a JSON text in reading order, as ARRAY<VARIANT>.

    Lists are flattened over all their levels, an element of any other kind is one
    item (nulls and objects without fields included), and a lone value is a list of
    one. A JSON string that itself holds a JSON list or object is read as that list
    or object. Text that isn't valid JSON, an empty text and null give null.
    """
    # One more pair of brackets: parse_json alone ignores what follows the first value.
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    outer = F.try_variant_get(whole, "$", "array<variant>")
    inner_text = F.try_variant_get(whole, "$[0]", "string")
    quoted = F.ltrim(text).startswith('"') & inner_text.rlike(r"^\s*[\[{]")
    inner = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), inner_text, F.lit("]"))), "$", "array<variant>"
    )
    start = F.when(quoted & (F.size(inner) == 1), inner).otherwise(outer)
    start = F.when(F.size(outer) == 1, start)
    # As many rounds as its lists are deep.
    rounds = F.sequence(F.lit(0), F.greatest(list_depth(text), F.when(quoted, list_depth(inner_text)).otherwise(F.lit(0))))

    def is_list(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))

    def open_lists(items: Column, _: Column) -> Column:
        opened = F.transform(
            items, lambda v: F.when(is_list(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
        )
        return F.when(F.exists(items, is_list), F.flatten(opened)).otherwise(items)

    return F.aggregate(rounds, start, open_lists)


def title_of(item: Column) -> Column:
    """The item itself if it is a string, else its title or that of its paper."""
    kind = F.schema_of_variant(item)

    def text_at(path: str) -> Column:
        return F.when(
            F.schema_of_variant(F.try_variant_get(item, path, "variant")) == "STRING",
            F.try_variant_get(item, path, "string"),
        )

    own = F.when(kind == "STRING", F.try_variant_get(item, "$", "string"))
    named, inner = text_at("$.title"), text_at("$.paper.title")
    obj = F.when(has_content(named), named).otherwise(inner)
    return F.when(kind.startswith("OBJECT"), obj).otherwise(own)


def _child(kind: str, parent: Column, pos: Column, val: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        parent.cast("bigint").alias("parent_id"),
        pos.cast("int").alias("item_pos"),
        val.alias("val"),
    )


def answer_titles(rows: DataFrame) -> DataFrame:
    """(kind, parent_id, item_pos, val) of each title in ``answer``.

    Positions count all items from 0. Null, blank and broken answers, items without
    a title and strings that are only an arXiv identifier give no row.
    """
    items = rows.select(F.col("row_id").alias("_id"), json_items(F.col("answer")).alias("_items"))
    tagged = F.transform(F.col("_items"), lambda v, i: _child("answer", F.col("_id"), i, title_of(v)))
    return items.select(F.inline(tagged)).where(has_content(F.col("val")) & ~F.col("val").rlike(ARXIV_ONLY))


def record_children(rows: DataFrame) -> DataFrame:
    """(kind, parent_id, item_pos, val) of author names and DOIs of each record.

    Both child tables leave one scan. Null arrays, null elements, null and blank
    values give no row; positions count every element.
    """
    rec = F.col("rec_id")
    names = F.transform(
        F.coalesce(F.col("authorships.author.display_name"), F.array().cast("array<string>")),
        lambda v, i: _child("author", rec, i, v),
    )
    doi = F.array(_child("doi", rec, F.lit(0), F.col("externalids.doi")))
    return rows.select(F.inline(F.flatten(F.array(names, doi)))).where(has_content(F.col("val")))
