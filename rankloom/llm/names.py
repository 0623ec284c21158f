"""Variant spellings of the names of persons and organisations.

A name is parsed into folded tokens; spellings that differ in format only share a node.
Nodes meet through a symmetric-delete neighbourhood index: a key is one token with at
most one letter deleted beside the other tokens, so tokens within one edit of each other
share a key, and blocks stay as small as the names are alike. Each pair that meets is
aligned token by token by optimal assignment, where a token may stand for an equal one,
one within one edit, an initial, a short form or an abbreviation. What an alignment
leaves open (two namesakes, or one name mistyped?) is decided by works in common and by
how usual the letter groups and given names are in the whole corpus.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.cells import canonical, has_content
from rankloom.scratch import drop, grown, stage

from .components import connected_components

# Words before or after a name that aren't part of it.
_TITLES = frozenset("dr prof professor mr mrs ms miss sir jr sr ii iii phd md the of for and de".split())
# Abbreviations of words in the names of organisations.
_ORG = {
    "univ": "university", "inst": "institute", "institut": "institute", "lab": "laboratory", "labs": "laboratory",
    "collab": "collaboration", "res": "research", "consort": "consortium", "dept": "department", "ctr": "center",
    "centre": "center", "natl": "national", "intl": "international", "acad": "academy", "soc": "society", "tech": "technology",
}
_ORG_WORDS = frozenset(_ORG.values()) | frozenset("college group project initiative team school hospital foundation council".split())
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})

#: A given name or letter group is usual if this share of all names has it, and two more. At most 1/USUAL given
#: names are, and as many letter groups times the letters of a name, whatever the size of the corpus.
USUAL = 0.0005


def _fold(text: str) -> str:
    low = html.unescape(text).lower().translate(_LETTERS)
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def parse_name(name: str) -> tuple[str, list[str], str] | None:
    """(first initial or '', words with the given name first and the family name last, 'person' or 'org'); None if nothing is left."""
    plain = re.sub(r"[\d*†‡§¶;]+", " ", html.unescape(name)).strip(" .,")
    parts = plain.split(",")
    if len(parts) == 2 and parts[1].strip():
        plain = parts[1] + " " + parts[0]
    shouting = plain.upper() == plain
    words, initials = [], []
    for raw in re.split(r"[\s,]+", plain):
        for piece in re.split(r"(?<=\.)(?=\w)", raw):
            bare = re.sub(r"[^\w-]+", "", piece).strip("-_")
            if not bare:
                continue
            low = _fold(bare)
            short = [x for x in low.split("-") if x]
            if all(len(x) == 1 for x in short):
                initials += short
            elif piece.isupper() and len(bare) <= 3 and not shouting and words:
                initials += list(low)
            elif piece.endswith(".") and low in _ORG or low not in _TITLES:
                words.append(_ORG.get(low, low) if (low in _ORG and len(low) > 3) or piece.endswith(".") or low in _ORG_WORDS else low)
    if not words:
        return ("", ["".join(initials)], "person") if initials else None
    if any(w in _ORG_WORDS for w in words) or re.search(r"(?i)\b(?:of|for)\b", plain):
        return "", sorted(_ORG.get(w, w) for w in words), "org"
    if len(words) == 1:
        return initials[0] if initials else "", words, "person"
    return "", words, "person"


def _parsed(names: DataFrame) -> DataFrame:
    """(name, initial, words, kind) of distinct names."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [(n, p) for n in batch.column(0).to_pylist() if (p := parse_name(n))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n for n, _ in out], pa.string()),
                    pa.array([p[0] for _, p in out], pa.string()),
                    pa.array([p[1] for _, p in out], pa.list_(pa.string())),
                    pa.array([p[2] for _, p in out], pa.string()),
                ],
                ["name", "initial", "words", "kind"],
            )

    return names.mapInArrow(run, "name string, initial string, words array<string>, kind string")


def _one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def align(a: list[str], b: list[str], formal: dict[str, set[str]]) -> tuple[str, str, str] | None:
    """(kind, token of a, token of b) of the one place where the cheapest assignment of tokens differs; None if none fits."""

    def cost(x: str, y: str) -> tuple[int, str] | None:
        if x == y:
            return 0, "same"
        if len(x) == 1 or len(y) == 1:
            return (2, "initial") if x[0] == y[0] or any(f[0] == y[0] for f in formal.get(x, ())) or any(f[0] == x[0] for f in formal.get(y, ())) else None
        fx, fy = formal.get(x, {x}), formal.get(y, {y})
        if y in fx or x in fy or (x in formal and y in formal and fx & fy):
            return 2, "nick"
        short, long = (x, y) if len(x) < len(y) else (y, x)
        if len(short) >= 3 and long.startswith(short) and len(long) - len(short) > 1:
            return 2, "abbr"
        if min(len(x), len(y)) > 2 and _one_edit(x, y):
            return 3, "typo"
        return None

    if len(a) != len(b):
        return None
    if sorted(a) == sorted(b):
        return "same", "", ""
    found = [[cost(x, y) for y in b] for x in a]
    if any(all(c is None for c in row) for row in found):
        return None
    order = assignment([[_NEVER if c is None else c[0] for c in row] for row in found])
    chosen = [(found[i][j], a[i], b[j]) for i, j in enumerate(order)]
    if any(c is None for c, _, _ in chosen):
        return None
    differ = [(c[1], x, y) for c, x, y in chosen if c[0]]
    if len(differ) == 2 and {"initial", "typo"} == {k for k, _, _ in differ}:
        return ("initial_typo", *differ[0][1:])
    return differ[0] if len(differ) == 1 else None


_NEVER = 1_000


def assignment(costs: list[list[int]]) -> list[int]:
    """Column of each row in an assignment of least total cost (shortest augmenting paths, cubic time)."""
    n = len(costs)
    u, v, row_of, way = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, used = [1 << 60] * (n + 1), [False] * (n + 1)
        while True:
            used[at] = True
            row, step, nxt = row_of[at], 1 << 60, 0
            for j in range(1, n + 1):
                if not used[j]:
                    slack = costs[row - 1][j - 1] - u[row] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, at
                    if least[j] < step:
                        step, nxt = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = nxt
            if not row_of[at]:
                break
        while at:
            row_of[at] = row_of[way[at]]
            at = way[at]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


def align_people(a: list[str], b: list[str], ia: str, ib: str, formal: dict[str, set[str]]) -> tuple[str, str, str] | None:
    """As ``align`` for given and family names; names between them may be missing on one side but must not differ."""
    ma, mb = (a[1:-1] if len(a) > 2 else []), (b[1:-1] if len(b) > 2 else [])
    ends_a, ends_b = ([a[0], a[-1]] if len(a) > 1 else a), ([b[0], b[-1]] if len(b) > 1 else b)
    if ma and mb and (len(ma) != len(mb) or align(ma, mb, formal) is None):
        return None
    found = align([ia, *ends_a] if ia else ends_a, [ib, *ends_b] if ib else ends_b, formal)
    if found and found[0] == "same" and ma != mb:
        return "middle", " ".join(ma), " ".join(mb)
    return found


def _deletions(word: Column) -> Column:
    """The word and, from four letters on, the word with each of its letters deleted."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
    )
    return F.when(F.length(word) < 4, F.array(word)).otherwise(F.array_distinct(F.concat(F.array(word), cut)))


def _index(nodes: DataFrame) -> DataFrame:
    """(key, node, side): the neighbourhood index. side 0 meets side 0, side 1 (initials) meets side 2, side 3 (abbreviations) side 4.

    Every key holds what two nodes that meet must share, so a bucket has no more pairs
    than the alignment has to look at, however many bear a family name.
    """
    given, family = F.col("words")[0], F.element_at("words", -1)
    words = F.when((F.col("kind") == "person") & (F.size("words") > 2), F.array(given, family)).otherwise(F.col("words"))

    def entries(keys: Column, side: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(side).alias("side")))

    edits = F.flatten(
        F.transform(
            words,
            lambda w, i: F.transform(
                _deletions(w),
                lambda v: F.xxhash64(v, F.array_join(F.array_sort(F.filter(words, lambda x, j: j != i)), " ")),
            ),
        )
    )
    formals = F.transform(F.col("formals"), lambda f: F.xxhash64(f, family))
    whole = F.when(F.length(given) >= 3, F.array(F.xxhash64(F.lit("~"), given, family))).otherwise(F.array().cast("array<bigint>"))
    openings = F.when(
        F.length(given) >= 5, F.transform(F.sequence(F.lit(3), F.length(given) - 2), lambda n: F.xxhash64(F.lit("~"), F.substring(given, F.lit(1), n), family))
    ).otherwise(F.array().cast("array<bigint>"))
    lead = F.array_distinct(F.transform(F.concat(F.array(given), F.col("formals")), lambda g: F.substring(g, 1, 1)))
    full = F.concat(
        entries(edits, 0),
        F.when(F.col("kind") == "person", F.concat(entries(formals, 0), entries(whole, 3), entries(openings, 4))).otherwise(F.array().cast("array<struct<key:bigint,side:int>>")),
        F.when(
            F.col("kind") == "person",
            entries(F.flatten(F.transform(lead, lambda g: F.transform(_deletions(family), lambda v: F.xxhash64(F.lit("#"), g, v)))), 2),
        ).otherwise(F.array().cast("array<struct<key:bigint,side:int>>")),
    )
    short = entries(F.transform(_deletions(family), lambda v: F.xxhash64(F.lit("#"), F.col("initial"), v)), 1)
    return nodes.select("node", F.inline(F.when(F.col("initial") != "", short).otherwise(full))).distinct()


def _aligned(pairs: DataFrame, formal: dict[str, set[str]], usual: set[str], groups: set[str]) -> DataFrame:
    """(a, b, how, x, y, x_known, y_known, plausible) of the pairs that align, with what the whole corpus says of x and y.

    Known: a usual given name. Plausible: both are made of usual letter groups. The three
    dictionaries are bounded (see ``USUAL``); they travel with the function.
    """

    def like_others(word: str) -> bool:
        w = f"^{word}$"
        return all(w[i : i + 3] in groups for i in range(len(w) - 2))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            keep, kinds, xs, ys = [], [], [], []
            for r, (wa, wb, ia, ib, ka, kb) in enumerate(zip(*cols[2:])):
                if ka == kb == "person":
                    found = align_people(wa, wb, ia, ib, formal)
                else:
                    found = align([ia, *wa] if ia else wa, [ib, *wb] if ib else wb, formal)
                if found:
                    keep.append(r)
                    kinds.append(found[0])
                    xs.append(found[1])
                    ys.append(found[2])
            rows = pa.array(keep, pa.int32())
            flags = [[x in usual for x in xs], [y in usual for y in ys], [k == "typo" and like_others(x) and like_others(y) for k, x, y in zip(kinds, xs, ys)]]
            texts = [pa.array(c, pa.string()) for c in (kinds, xs, ys)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), *texts, *(pa.array(f, pa.bool_()) for f in flags)],
                ["a", "b", "how", "x", "y", "x_known", "y_known", "plausible"],
            )

    return pairs.select("a", "b", "wa", "wb", "ia", "ib", "ka", "kb").mapInArrow(
        run, "a long, b long, how string, x string, y string, x_known boolean, y_known boolean, plausible boolean"
    )


def occurrences(records: DataFrame) -> DataFrame:
    """(name, work): stored names, blank ones left out, with a hash of the record's title."""
    title = canonical(F.coalesce("title", "display_name"))
    work = F.when(title != "", F.xxhash64(title)).otherwise(F.xxhash64("rec_id"))
    lists = F.flatten(F.array_compact(F.array("authors.name", "authorships.author.display_name")))
    return records.select(F.explode(lists).alias("name"), work.alias("work")).where(has_content(F.col("name")))


def name_groups(records: DataFrame, given_names: DataFrame) -> DataFrame:
    """(name, entity): every stored spelling with the entity that it names.

    Null and blank names give no row, empty tables none. ``given_names`` is a small
    reference list of short forms, read as a whole.
    """
    formal: dict[str, set[str]] = {}
    for r in given_names.where("formal_name is not null and short_form is not null").toLocalIterator():
        formal.setdefault(_fold(r["short_form"]), set()).add(_fold(r["formal_name"]))
    spark = records.sparkSession
    table = [(k, sorted(v)) for k, v in formal.items()]
    nick = spark.createDataFrame(table, "g string, formals array<string>")

    seen = stage(occurrences(records).distinct(), "names")
    parsed = _parsed(seen.select("name").distinct())
    parsed = stage(parsed.select("*", F.xxhash64("initial", F.array_join(F.array_sort("words"), " ")).alias("node")), "parsed")
    people = parsed.where((F.col("kind") == "person") & (F.col("initial") == "") & (F.size("words") >= 2))
    floor = 2 + parsed.measured["rows"] * USUAL
    counted = people.groupBy(F.col("words")[0].alias("g")).agg(F.count("*").alias("n")).where(F.col("n") >= floor)
    usual = {r["g"] for r in counted.collect()} | {f for fs in formal.values() for f in fs}
    table = spark.createDataFrame([(g,) for g in sorted(usual)], "g string")
    groups = _letter_groups(people, floor)

    def known(df: DataFrame, column: str, flag: str) -> DataFrame:
        """``df`` with a flag that says whether the column holds a usual given name."""
        return df.join(F.broadcast(table.select(F.col("g").alias(column), F.lit(True).alias(flag))), column, "left").fillna(False, [flag])

    nodes = parsed.groupBy("node").agg(F.min_by(F.struct("initial", "words", "kind"), "name").alias("p")).select("node", "p.*")
    nodes = nodes.withColumns({"head": F.col("words")[0], "tail": F.element_at("words", -1)})
    nodes = known(known(nodes, "head", "head_known"), "tail", "tail_known")
    # A family name written first: the given name is the usual one.
    swap = (F.col("kind") == "person") & (F.size("words") >= 2) & F.col("tail_known") & ~F.col("head_known")
    turned = F.concat(F.slice("words", 2, F.size("words")), F.slice("words", 1, 1))
    nodes = nodes.withColumn("words", F.when(swap, turned).otherwise(F.col("words"))).join(F.broadcast(nick), F.col("words")[0] == F.col("g"), "left")
    nodes = stage(nodes.select("node", "initial", "words", "kind", F.coalesce("formals", F.array().cast("array<string>")).alias("formals")), "nodes")
    works = stage(seen.join(grown(parsed.select("name", "node")), "name").select("node", "work").distinct(), "works")
    support = works.groupBy("node").agg(F.count("*").alias("n"))

    index = _index(nodes)
    left, right = index.select("key", F.col("node").alias("a"), "side"), index.select("key", F.col("node").alias("b"), F.col("side").alias("side_b"))
    meet = ((F.col("side") == 0) & (F.col("side_b") == 0) & (F.col("a") < F.col("b"))) | ((F.col("side") == 1) & (F.col("side_b") == 2)) | ((F.col("side") == 3) & (F.col("side_b") == 4))
    # An initial comes first, of all others the smaller node.
    pairs = left.join(grown(right), "key").where(meet)
    swapped = (F.col("side") == 3) & (F.col("a") > F.col("b"))
    pairs = pairs.select(F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("b")).where("a <> b").distinct()
    attributes = nodes.select("node", "words", "initial", "kind")
    pairs = pairs.join(grown(attributes.toDF("a", "wa", "ia", "ka")), "a").join(grown(attributes.toDF("b", "wb", "ib", "kb")), "b")
    pairs = aligned = stage(_aligned(pairs, formal, usual, groups), "aligned")

    shared = (
        pairs.select("a", "b").join(grown(works.toDF("a", "work")), "a").join(grown(works.toDF("b", "work")), ["b", "work"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    )
    pairs = pairs.join(grown(shared), ["a", "b"], "left").fillna(0, ["shared"])
    pairs = pairs.join(grown(support.toDF("a", "na")), "a").join(grown(support.toDF("b", "nb")), "b")
    both_known, plausible = F.col("x_known") & F.col("y_known"), F.col("plausible")
    one_is_given = F.col("x_known") | F.col("y_known")
    firm = F.when(F.col("how") == "same", True).when(
        F.col("how") == "typo", ~both_known & (one_is_given | (F.col("shared") > 0) | ~plausible)
    )
    soft = F.col("how").isin("initial", "initial_typo", "nick", "abbr", "middle") & ~((F.col("how") == "abbr") & both_known)
    pairs = stage(pairs.select("*", F.coalesce(firm, F.lit(False)).alias("firm"), soft.alias("soft")), "judged")
    drop(aligned, nodes)
    # Short forms first: a name and its short form are one candidate for an initial.
    links = pairs.where("firm").select("a", "b")
    links = stage(links.unionByName(_resolved(pairs.where("soft and not startswith(how, 'initial')"), _heads(links, support))), "spellings")
    links = links.unionByName(_resolved(pairs.where("soft and startswith(how, 'initial')"), _heads(links, support)))
    entity = connected_components(links)
    drop(seen, works, pairs)
    return parsed.join(grown(entity), "node", "left").select("name", F.coalesce("group_id", "node").alias("entity"))


def _heads(links: DataFrame, support: DataFrame) -> DataFrame:
    """(full, rep): of each linked node itself or the best supported node that it is linked with."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(grown(support.toDF("b", "nb")), "b").groupBy("a").agg(F.max(F.struct(F.col("nb").alias("n"), F.col("b").alias("rep"))).alias("t"))
    own = F.struct(F.col("n"), F.col("a"))
    return ends.join(grown(support.toDF("a", "n")), "a").select(F.col("a").alias("full"), F.when(own < F.struct("t.n", "t.rep"), F.col("t.rep")).otherwise(F.col("a")).alias("rep"))


def _resolved(pairs: DataFrame, head: DataFrame) -> DataFrame:
    """(a, b): for each shortened name the one full name that it stands for.

    Candidates that are spellings of one name count as one (the best supported of them).
    Works in common decide first, then a single candidate, then three times the support
    of any other.
    """
    # The shortened side: a for initials; of short forms and abbreviations the shorter token.
    a_short = F.when(F.col("how").startswith("initial"), True).otherwise(F.length("x") < F.length("y")) | ((F.length("x") == F.length("y")) & (F.col("na") < F.col("nb")))
    soft = pairs.select(
        F.when(a_short, F.col("a")).otherwise(F.col("b")).alias("short"),
        F.when(a_short, F.col("b")).otherwise(F.col("a")).alias("full"),
        F.when(a_short, F.col("nb")).otherwise(F.col("na")).alias("n"),
        "shared",
        (F.col("how") == "initial_typo").cast("int").alias("far"),
    )
    named = soft.join(grown(head), "full", "left").select("short", F.coalesce("rep", "full").alias("rep"), "n", "shared", "far")
    each = named.groupBy("short", "rep").agg(F.sum("shared").alias("shared"), F.sum("n").alias("n"), F.min("far").alias("far"))
    top = each.groupBy("short").agg(
        F.max(F.struct("shared", (-F.col("far")).alias("near"), "n", "rep")).alias("best"),
        F.count_if(F.col("far") == 0).alias("near_count"),
        F.count("*").alias("all_count"),
        F.sum(F.when(F.col("far") == 0, F.col("n")).otherwise(0)).alias("near_n"),
        F.sum("n").alias("all_n"),
    )
    rivals = F.when(F.col("best.near") == 0, F.col("near_count")).otherwise(F.col("all_count"))
    others = F.when(F.col("best.near") == 0, F.col("near_n")).otherwise(F.col("all_n")) - F.col("best.n")
    sure = (F.col("best.shared") > 0) | (rivals == 1) | (F.col("best.n") >= 3 * others)
    return top.where(sure).select(F.col("short").alias("a"), F.col("best.rep").alias("b"))


def _letter_groups(people: DataFrame, floor: float) -> set[str]:
    """The usual groups of three letters in family names (see ``USUAL`` for their bound)."""
    family = people.select(F.concat(F.lit("^"), F.element_at("words", -1), F.lit("$")).alias("w")).distinct()
    at = F.sequence(F.lit(1), F.length("w") - 2)
    grams = family.select(F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("w"), i, F.lit(3))))).alias("g"))
    return {r["g"] for r in grams.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= floor).collect()}


def variant_pairs(records: DataFrame, given_names: DataFrame) -> DataFrame:
    """(name_a, name_b): pairs of different spellings of one entity, smaller first in byte order."""
    named = stage(name_groups(records, given_names), "named")
    a, b = named.toDF("name_a", "entity"), named.toDF("name_b", "entity")
    return a.join(grown(b), "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
