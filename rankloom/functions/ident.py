"""Identifiers, addresses and the keys by which records are told apart.

Every text is read once into a ``parsed`` struct: the readable text, and host, path and
parameters where it is an address. The identifier schemes are then looked for in the
part where each may stand: a DOI in the path of its resolver or anywhere in a text, an
arXiv number in the path of an arXiv address, as the whole text, behind its label or in
the DOI that arXiv registers for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The DOI scheme (directory 10, registrant, suffix), both arXiv schemes, and the marks that end a sentence rather than an identifier.
DOI = r"(?i)(10\.\d{4,9}/[^\s\"<>]+)"
_NEW, _OLD = r"\d{4}\.\d{4,5}", r"[a-z\-]+(?:\.[a-z\-]+)?/\d{7}"
ARXIV = rf"({_NEW}|{_OLD})"
_AFTER = r"[ \t\r\n.,;:)\]}>\"']+$"
# Hosts of the registries, and the prefix under which arXiv registers its numbers.
_DOI_HOST, _ARXIV_HOST, _OPENALEX_HOST = r"^(?:dx\.)?doi\.org$", r"^(?:export\.)?arxiv\.org$|^ar5iv\.labs\.arxiv\.org$", r"^(?:api\.)?openalex\.org$"
_ARXIV_DOI = r"(?i)^10\.48550/arxiv\."


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def unescape(c: Column) -> Column:
    """The five predefined HTML entities decoded; ``&amp;`` last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def percent_decode(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` and malformed sequences alone."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def parsed(c: Column) -> Column:
    """struct<text, scheme, host, path, params>: the readable text, and its parts where it is an address, else ''."""
    part = lambda t, pattern: F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", pattern)
    return bound(
        F.trim(unescape(c)),
        lambda t: F.struct(percent_decode(t).alias("text"), F.lower(part(t, 1)).alias("scheme"), F.lower(part(t, 2)).alias("host"), part(t, 3).alias("path"), part(t, 4).alias("params")),
    )


def _doi_in(x: Column) -> Column:
    place = F.when(x["host"].rlike(_DOI_HOST), percent_decode(x["path"])).otherwise(x["text"])
    return _some(F.lower(F.regexp_replace(F.regexp_extract(F.regexp_replace(place, _AFTER, ""), DOI, 1), _AFTER, "")))


def _number(c: Column) -> Column:
    """The arXiv number that a text is, version and file type aside."""
    return _some(F.lower(F.regexp_extract(F.regexp_replace(F.trim(c), _AFTER, ""), rf"(?i)^{ARXIV}(?:v\d+)?(?:\.pdf)?$", 1)))


def _arxiv_in(x: Column) -> Column:
    of_doi = F.when(_doi_in(x).rlike(_ARXIV_DOI), _number(F.regexp_replace(_doi_in(x), _ARXIV_DOI, "")))
    whole = _number(F.regexp_replace(x["text"], r"(?i)^arxiv:\s*", ""))
    address = F.when(x["host"].rlike(_ARXIV_HOST), _number(F.regexp_replace(x["path"], r"^/+(?:abs|pdf|html)/", "")))
    labelled = _some(F.lower(F.regexp_extract(x["text"], rf"(?i)arxiv(?:\s*[:.]|\s+){ARXIV}", 1)))
    return F.coalesce(of_doi, whole, address, labelled)


def _openalex_in(x: Column) -> Column:
    return _some(F.upper(F.regexp_extract(x["text"], r"(?i)(W\d+)", 1)))


def extract_doi(c: Column) -> Column:
    """The first DOI in a DOI, an address or free text, in lower case; null where there is none."""
    return bound(parsed(c), _doi_in)


#: A DOI in any notation, its label or resolver in front or not.
normalize_doi = extract_doi


def arxiv_from_doi(c: Column) -> Column:
    """The arXiv number of a DOI that arXiv registered."""
    return bound(extract_doi(c), lambda doi: F.when(doi.rlike(_ARXIV_DOI), _number(F.regexp_replace(doi, _ARXIV_DOI, ""))))


def extract_arxiv(c: Column) -> Column:
    """An arXiv number in any notation, without its version; digits of other DOIs don't count."""
    return bound(parsed(c), _arxiv_in)


def extract_openalex(c: Column) -> Column:
    return bound(parsed(c), _openalex_in)


def normalize_s2(c: Column) -> Column:
    """40 hex digits in lower case, ``CorpusID:n``, or the text as it is."""

    def read(x: Column) -> Column:
        own = F.when(x["host"] == "www.semanticscholar.org", F.element_at(F.split(x["path"], "/"), -1)).otherwise(x["text"])
        return bound(F.regexp_replace(own, _AFTER, ""), lambda t: F.when(t.rlike("(?i)^[0-9a-f]{40}$"), F.lower(t)).when(
            t.rlike(r"(?i)^(?:corpusid:?)?\d+$"), F.concat(F.lit("CorpusID:"), F.regexp_extract(t, r"(\d+)$", 1))).otherwise(t))

    return bound(parsed(_some(c)), read)


# Parameters that only track where a visitor came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source")


def normalize_url(c: Column) -> Column:
    """Canonical scholarly addresses; of others lower-case host, clean path and sorted parameters."""

    def tidy(x: Column) -> Column:
        kept = F.array_sort(F.filter(F.split(x["params"], "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING)))
        query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
        path = F.regexp_replace(F.regexp_replace(x["path"], "/{2,}", "/"), "/+$", "")
        return F.when(x["host"] != "", F.concat(x["scheme"], F.lit("://"), x["host"], path, query)).otherwise(F.regexp_replace(x["text"], "/+$", ""))

    def read(x: Column) -> Column:
        at = lambda host, prefix, found: F.when(x["host"].rlike(host), F.concat(F.lit(prefix), found))
        known = (at(_DOI_HOST, "https://doi.org/", _doi_in(x)), at(_ARXIV_HOST, "https://arxiv.org/abs/", _arxiv_in(x)), at(_OPENALEX_HOST, "https://openalex.org/", _openalex_in(x)))
        return F.coalesce(*known, tidy(x))

    return bound(parsed(_some(c)), read)


def light_ident(c: Column) -> Column:
    """An identifier without resolver prefix and version, in lower case; '' for null."""
    t = F.trim(F.coalesce(c, F.lit("")))
    for prefix in ("https://doi.org/", "http://doi.org/", "https://arxiv.org/abs/", "arXiv:", "arxiv:"):
        t = F.replace(t, F.lit(prefix), F.lit(""))
    return F.trim(F.lower(F.regexp_replace(t, r"(?i)v\d+$", "")))


def identity_keys(doi: Column, arxiv: Column, openalex: Column, s2: Column) -> Column:
    """Sorted array of the keys that a record has."""
    made = [F.when(v.isNotNull(), F.concat(F.lit(p), v)) for p, v in (("arxiv:", arxiv), ("doi:", doi), ("openalex:", openalex), ("s2:", s2))]
    return F.array_compact(F.array(*made))


def _prefixed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c)


def canonical_id(doi: Column, arxiv: Column, openalex: Column, s2: Column, title: Column) -> Column:
    """One key by the order DOI, arXiv, OpenAlex, Semantic Scholar, title."""
    return F.coalesce(
        _prefixed("doi:", doi), _prefixed("arxiv:", arxiv), _prefixed("openalex:", openalex), _prefixed("s2:", s2), _prefixed("title:", title)
    )


def canonical_id_v2(doi: Column, arxiv: Column, openalex: Column, s2: Column, title: Column) -> Column:
    """As ``canonical_id`` for normalised parts, but arXiv first where the DOI is arXiv's own or missing."""
    own = F.nullif(F.regexp_extract(doi, rf"^10\.48550/arxiv\.({_NEW}|{_OLD})(?:v\d+)?$", 1), F.lit(""))
    first = F.when(doi.isNull(), _prefixed("arxiv:", arxiv)).otherwise(_prefixed("arxiv:", own))
    return F.coalesce(first, canonical_id(doi, arxiv, openalex, s2, title))


def candidate_key(doi: Column, arxiv: Column, openalex: Column, s2: Column, title: Column) -> Column:
    """The alphabetically first identity key, else the title."""
    return F.coalesce(F.array_min(identity_keys(doi, arxiv, openalex, s2)), _prefixed("title:", title))


def paper_key(doi: Column, arxiv: Column, openalex: Column, title: Column, fallback: Column) -> Column:
    """Key of a ranked candidate from light identifiers, then the title, then its place."""
    tried = [F.when(light_ident(c) != "", _prefixed(p, light_ident(c))) for p, c in (("doi:", doi), ("arxiv:", arxiv), ("openalex:", openalex))]
    return F.coalesce(*tried, F.when(title != "", _prefixed("title:", title)), _prefixed("place:", fallback))


def ids_conflict(left: list[Column], right: list[Column]) -> Column:
    """Whether both sides have some identifier of one kind and the two differ."""
    out = F.lit(False)
    for a, b in zip(left, right):
        out = out | F.coalesce(a != b, F.lit(False))
    return out
