"""Text normalisation, tokens and overlaps of ranked retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from rankloom.lexicon import SINGULAR

# Words that say nothing in a research question.
STOPWORDS = (
    "a an and are as at be been being by can could for from give has have having in into is it its me of on or paper papers "
    "result results show shows shown that the their there these this to using was were what which with work works"
).split()
#: One word of these is no evidence by itself.
GENERIC = "analysis approach data document learning method model network paper prediction result system task".split()


def ascii_words(c: Column) -> Column:
    """Lower-case ASCII letters and digits with single spaces; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


@F.udf(returnType=StringType(), useArrow=True)
def compatible(text: str | None) -> str | None:
    """Compatibility forms of characters unified (NFKC)."""
    import unicodedata

    return None if text is None else unicodedata.normalize("NFKC", text)


@F.udf(returnType=StringType(), useArrow=True)
def decoded(text: str | None) -> str | None:
    """Entities of HTML decoded."""
    import html

    return None if text is None else html.unescape(text)


def guard_words(c: Column) -> Column:
    """``ascii_words`` after tags are taken out."""
    return ascii_words(F.regexp_replace(c, "<[^>]+>", " "))


def key_words(c: Column) -> Column:
    """Lower-case words with underscores as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "_", " "), r"[^a-z0-9]+", " "))


def evidence_words(c: Column) -> Column:
    """``ascii_words`` with common plurals in the singular."""
    table = F.create_map(*[F.lit(x) for kv in SINGULAR.items() for x in kv])
    return F.array_join(F.transform(F.split(ascii_words(c), " "), lambda t: F.coalesce(table[t], t)), " ")


def letters_key(c: Column) -> Column:
    """Letters only, in lower case: digits don't tell titles apart here."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}]", ""))


def tokens(c: Column) -> Column:
    """Distinct telling tokens of more than one character, in order."""
    found = F.regexp_extract_all(ascii_words(c), F.lit(r"[a-z][a-z0-9]*|\d+[a-z]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def soft_overlap(query: Column, doc: Column) -> Column:
    """Share of query tokens found, those that share a prefix counting half."""
    rest = F.array_except(query, doc)

    def near(q: Column) -> Column:
        return (F.length(q) >= 4) & F.exists(doc, lambda t: (F.length(t) >= 4) & (t.startswith(q) | q.startswith(t)))

    score = (F.size(F.array_intersect(query, doc)) + 0.5 * F.size(F.filter(rest, near))) / F.greatest(F.size(query), F.lit(1))
    return F.when((F.size(query) == 0) | (F.size(doc) == 0), 0.0).otherwise(score)


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word match of a normalised phrase in normalised text, a plural s allowed."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    plain = padded.contains(F.concat(F.lit(" "), phrase, F.lit(" ")))
    plural = padded.contains(F.concat(F.lit(" "), phrase, F.lit("s ")))
    return (phrase != "") & (plain | (~phrase.endswith("s") & plural))


def plural_forms(phrase: str) -> list[str]:
    """The phrase with each word in singular and plural."""
    forms = [""]
    for w in phrase.split():
        own = {w, w + "s"} | ({w[:-1]} if w.endswith("s") else set()) | ({w[:-1] + "ies"} if w.endswith("y") else set())
        own |= {w[:-3] + "y"} if w.endswith("ies") else set()
        forms = [f"{f} {o}".strip() for f in forms for o in sorted(own)]
    return forms


def has_any(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a normalised text has one of the phrases as whole words, in singular or plural."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        for form in plural_forms(p):
            out = out | padded.contains(f" {form} ")
    return out


def slug(c: Column, size: int) -> Column:
    cut = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, size)
    return F.when(cut == "", "constraint").otherwise(cut)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2.0 * p * r, p + r)


@F.udf(returnType=StringType(), useArrow=True)
def fold_title(text: str | None) -> str:
    """Entities decoded, compatibility forms unified, case folded, markup and punctuation as spaces."""
    import html
    import re
    import unicodedata

    t = unicodedata.normalize("NFKC", html.unescape((text or "").strip())).casefold()
    t = re.sub(r"\\(?:textit|textbf|mathrm|mathbf|emph)\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"[$\\{}]", " ", t)
    out = "".join(" " if not c.isalnum() and unicodedata.category(c)[0] in "PSZ" else c for c in t)
    return " ".join(out.split())


@F.udf(returnType=DoubleType(), useArrow=True)
def sequence_ratio(a: str | None, b: str | None) -> float:
    """Share of letters in matching blocks of two texts."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a or "", b or "").ratio()


def inverted_index_text(index: Column) -> Column:
    """Text of a word -> positions map."""
    pairs = F.flatten(
        F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    )
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
