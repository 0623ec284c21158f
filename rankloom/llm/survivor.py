"""Best representative of each duplicate group, field by field.

Fields are unpivoted to long rows of (group, field, record) with the numbers that decide, votes
are summed for each normalised value with map-side combining, winners are chosen by
``max_by`` and pivoted back to one row a group. Values stay where they are: the shuffles
move numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.cells import canonical

FIELDS = ("doi", "abstract", "venue")

# What is written where a value is missing, as bare letters and digits.
_STAND_INS = (
    "null|none|nil|nan|na|n a|undefined|unknown|unspecified|not specified|missing|empty|blank|pending|tba|tbd|"
    "to be announced|to be determined|not available|unavailable|not assigned|x+|misc|miscellaneous|various|other|see pdf|see publisher page|see full text"
)
_MISSING_VENUE = r"(?:the )?(?:unknown|no|missing|unspecified) (?:venue|journal|source|publisher)|(?:venue|journal|source) (?:is )?(?:missing|unknown|unavailable|pending|not (?:available|specified|known|given))"
_MISSING_ABSTRACT = (
    r"(?:there is )?no (?:abstract|summary|description)(?: is)?(?: available| provided| found| given| yet)?|"
    r"(?:the )?(?:abstract|summary)(?: is| was| has been)? (?:missing|removed|withheld|unavailable|unknown|pending|withdrawn|deleted|not (?:available|provided|found|given)|to follow)|"
    r"(?:click|tap|follow) (?:here|the link) to (?:read|view|see) (?:the )?(?:abstract|summary|full text)|"
    r"(?:abstract|summary)|"
    r"r[ée]sum[ée] (?:non|pas|in)\s?disponible|pas de r[ée]sum[ée](?: disponible)?|"
    r"keine zusammenfassung(?: verf[üu]gbar| vorhanden)?|(?:kein abstract|zusammenfassung fehlt)(?: verf[üu]gbar| vorhanden)?|"
    r"sin resumen(?: disponible)?|resumen no disponible|"
    r"th(?:is|e) (?:item|record|paper|article|work|entry) has no abstract .*|"
    r"(?:the|an) abstract of (?:record|item|paper|article|work|entry|this) .*(?:could not|cannot|not be|no longer|will be).*"
)


def _bare(pattern: str) -> str:
    """The pattern for the canonical form, which has no spaces."""
    return pattern.replace(r"\s?", "").replace(" ", "")


def states_doi(c: Column) -> Column:
    """A complete DOI (a registrant's prefix and a suffix) in whatever notation."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)%2f", "/"), r"\s+", "")
    found = F.regexp_extract(plain, r"10\.(\d{4,9})/+[\p{P}\p{S}]*[\p{L}\p{N}]", 1)
    return (found != "") & ~found.rlike("^0+$")


def states_abstract(form: Column) -> Column:
    """An actual abstract, shortened or not, by its canonical form; no stand-in for a missing one."""
    return (form != "") & ~form.rlike(_bare(f"^(?:{_STAND_INS}|{_MISSING_ABSTRACT})$"))


def venue_name(source: Column, venue: Column) -> Column:
    """The name of the venue; of an openalex venue its display name."""
    return F.when(source == "openalex", F.get_json_object(venue, "$.display_name")).otherwise(venue)


def states_venue(form: Column) -> Column:
    return (form != "") & ~form.rlike(_bare(f"^(?:{_STAND_INS}|{_MISSING_VENUE})$"))


def field_values(records: DataFrame, *keep: str) -> DataFrame:
    """(rec_id, source, ingested_at, *keep, cells): of each record its values that state something.

    ``weight`` is the number of letters and digits for abstract and venue and 0 for doi,
    which that doesn't decide. ``value_key`` is a hash of the normalised value.
    """
    doi = F.when(F.col("source") == "semantic_scholar", F.col("externalids.doi")).otherwise(F.col("doi"))
    doi_key = F.regexp_extract(F.lower(F.regexp_replace(doi, "(?i)%2f", "/")), r"10\.\d{4,9}/\S*[\p{L}\p{N}]", 0)
    # Each text takes its canonical form once; everything else is read off that.
    forms = records.select(
        "rec_id", "source", "ingested_at", *keep, doi.alias("_doi"), doi_key.alias("_doi_key"),
        canonical(F.col("abstract")).alias("_abstract"), canonical(venue_name(F.col("source"), F.col("venue"))).alias("_venue"),
    )

    def cell(name: str, ok: Column, form: str, weigh: bool) -> Column:
        weight = F.length(form) if weigh else F.lit(0)
        return F.struct(F.lit(name).alias("field_name"), ok.alias("ok"), weight.alias("weight"), F.xxhash64(form).alias("value_key"))

    cells = F.array(
        cell("doi", states_doi(F.col("_doi")), "_doi_key", False),
        cell("abstract", states_abstract(F.col("_abstract")), "_abstract", True),
        cell("venue", states_venue(F.col("_venue")), "_venue", True),
    )
    return forms.select("rec_id", "source", "ingested_at", *keep, F.filter(cells, lambda x: x["ok"]).alias("cells"))


def survivors(
    records: DataFrame, groups: DataFrame, trust: DataFrame, policy: str = "priority", half_life_days: float = 180.0
) -> DataFrame:
    """(group_id, field_name, rec_id): the record whose value survives.

    Every record votes for its normalised value with the trust of its source in the field
    times 2^(-age / half life), age counted back from the latest record. The votes of
    each value are summed, and a value's best record stands for it: higher trust, then
    more letters and digits (abstract, venue), then later ``ingested_at``, then smaller
    ``rec_id``. ``policy="votes"``: the value with the highest sum wins, that order
    decides ties. ``policy="priority"``: that order decides first and the votes break
    ties. Winners come from ``max_by`` and are pivoted to one row a group, from which the
    rows of the result are read.

    A source without a trust row has trust 0, a null ``ingested_at`` is oldest. Fields
    without any value give no row, empty tables give none.
    """
    won = pivoted(records, groups, trust, policy, half_life_days)
    picks = F.filter(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_rec").alias("rec_id")) for f in FIELDS)), lambda x: x["rec_id"].isNotNull())
    return won.select("group_id", F.inline(picks))


def pivoted(records: DataFrame, groups: DataFrame, trust: DataFrame, policy: str = "priority", half_life_days: float = 180.0) -> DataFrame:
    """(group_id, doi_rec, abstract_rec, venue_rec): the surviving record of each field, null where none; see ``survivors``."""
    trusted = F.broadcast(trust.groupBy("source", "field_name").agg(F.max("trust").alias("trust")))
    newest = F.broadcast(records.agg(F.max("ingested_at").alias("newest")))
    long = (
        field_values(records.join(groups, "rec_id"), "group_id")
        .where(F.size("cells") > 0)
        .select("rec_id", "source", "ingested_at", "group_id", F.inline("cells"))
        .join(trusted, ["source", "field_name"], "left")
        .withColumn("trust", F.coalesce("trust", F.lit(0)))
        .join(newest)
    )
    rank = F.struct(
        "trust", "weight", F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(2**62))).alias("at"), (-F.col("rec_id")).alias("neg")
    )
    age = (F.unix_seconds(F.col("newest").cast("timestamp")) - F.unix_seconds(F.col("ingested_at").cast("timestamp"))) / F.lit(86400.0)
    vote = F.col("trust") * F.coalesce(F.pow(F.lit(2.0), -age / half_life_days), F.lit(0.0))
    votes = long.groupBy("group_id", "field_name", "value_key").agg(F.sum(vote).alias("votes"), F.max(rank).alias("rank"))
    sums = F.round("votes", 9)
    best = F.struct(sums, "rank") if policy == "votes" else F.struct("rank", sums)
    picks = [(-F.max_by("rank.neg", F.when(F.col("field_name") == f, best))).alias(f"{f}_rec") for f in FIELDS]
    return votes.groupBy("group_id").agg(*picks)
