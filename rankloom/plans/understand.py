"""Questions turned into rows: rewritten variants, weighted constraints, sub-queries and plans.

A question is normalised in a projection of its own; everything else is read off those
columns by higher-order functions over literal tables (``lexicon``), so a question stays
one row from beginning to end and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import ascii_words, compatible
from rankloom import lexicon as L
from rankloom.plans.inputs import norm, table
from rankloom.registry import query

# Question openings, tried in this order; the first that fits is taken off.
OPENINGS = (
    r"^\s*is\s+there\s+any\s+work\s+that\s+",
    r"^\s*is\s+there\s+any\s+paper\s+that\s+",
    r"^\s*are\s+there\s+any\s+works?\s+that\s+",
    r"^\s*are\s+there\s+any\s+papers?\s+that\s+",
    r"^\s*find\s+(?:me\s+)?(?:papers?|works?)\s+(?:that|about|on)\s+",
    r"^\s*give\s+me\s+(?:papers?|works?)\s+(?:that|about|on)\s+",
    r"^\s*what\s+are\s+(?:some\s+)?(?:papers?|works?)\s+(?:that|about|on)\s+",
    r"^\s*which\s+(?:papers?|works?)\s+(?:study|analyze|focus\s+on|about|on)\s+",
    r"^\s*show\s+me\s+(?:papers?|works?)\s+(?:that|about|on)\s+",
)
# A term of a question and the terms that are searched along with it.
ACADEMIC = {
    "image": ("image", "visual", "vision", "pixel"),
    "encoding": ("encoding", "encoder", "compression", "entropy coding", "latent representation"),
    "distribution": ("distribution", "probability distribution", "density", "prior", "generative"),
    "large language model": ("large language model", "LLM", "foundation model", "generative model"),
    "graph neural network": ("graph neural network", "GNN", "graph representation learning", "message passing neural network"),
    "molecular property": ("molecular property prediction", "chemical property prediction", "molecular modeling"),
}
TYPE_WEIGHT = {"data_condition": 1.30, "performance_relation": 1.30, "method_or_property": 1.25, "task_or_modality": 1.15, "model_or_entity": 1.10, "topic": 1.0}
PRIORITY = {"performance_relation": 0, "data_condition": 1, "method_or_property": 2, "task_or_modality": 3, "model_or_entity": 4, "topic": 5}
# Comparisons of data and performance in normalised words, what each stands for, and its type.
COMPARATIVES = (
    (r"(smaller|small|less|fewer).{0,25}(dataset|data)", "smaller dataset", "data_condition"),
    (r"(bigger|larger|more).{0,25}(dataset|data)", "bigger dataset", "data_condition"),
    (r"(better|outperform|outperforms|improved).{0,35}(model|performance)|better models", "better models", "performance_relation"),
    (r"(smaller|small|less|fewer).{0,40}(better|outperform|improved)|better.{0,40}(bigger|larger|more)", "smaller dataset better than bigger dataset", "performance_relation"),
)
# Relations and capabilities that are kept as whole spans, and their types.
RELATIONS = (
    (r"\b(?:llms?|large language models?)\s+(?:have|has|possess|possesses|demonstrate|demonstrates)\s+(?:sufficient\s+)?(?:inductive\s+)?(?:capacity|capability|capabilities|ability|abilities|reasoning)\b", "method_or_property"),
    (r"\b(?:analyze|analyse|understand|model|capture)\s+(?:the\s+)?relationships?\s+(?:between|among)\s+(?:multiple|several|different)\s+(?:papers?|documents?|studies?|works?)\b", "topic"),
    (r"\brelationships?\s+(?:between|among)\s+(?:multiple|several|different)\s+(?:papers?|documents?|studies?|works?)\b", "topic"),
    (r"\b(?:systematically|automatically)\s+(?:write|generate|produce|compose)\s+(?:a\s+|an\s+)?(?:survey|review|literature review|systematic review)\b", "topic"),
    (r"\bmining\s+factors?\b", "topic"),
    (r"\b(?:llm\s+generated|generated)\s+text(?:\s+(?:detection|detector|classification))?\b", "task_or_modality"),
)
# Parts of words that give a phrase its type, in order of precedence.
TYPE_MARKS = (
    ("data_condition", "smaller|small|less|fewer|bigger|larger|more|dataset size|data efficient"),
    ("performance_relation", "better|outperform|performance|improved"),
    ("method_or_property", "scaling|retrieval|generation|learning|tuning|distillation|pretraining|pre training"),
    ("task_or_modality", "video|image|vision|language|sql|question|segmentation|detection"),
    ("model_or_entity", "llm|gpt|bert|clip|transformer|diffusion|yolo|rtdetr"),
)
ACRONYM = r"\b[A-Za-z]+-\d+[A-Za-z]*\b|\b[A-Z]{2,}[A-Za-z0-9]*\b"
MARKS, DASHES = r"[?？!！,，;；:：()\[\]{}<>]", "[‐‑‒–—−]"
MOST_CONSTRAINTS = MOST_SUBQUERIES = 6

_Q = "q AS (SELECT row_id, question FROM pasa_like_sample WHERE question IS NOT NULL)"


def questions(spark, d) -> DataFrame:
    return table(spark, d, "pasa_like_sample").where("question is not null").select("row_id", "question")


# ---- text rules, each as a column and as SQL


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def _first_off(c: Column, patterns) -> Column:
    """The text without the first of the patterns that fits."""
    return F.coalesce(*[F.when(c.rlike("(?i)" + p), F.regexp_replace(c, "(?i)" + p, "")) for p in patterns], c)


def clean(c: Column) -> Column:
    """The question without its opening and punctuation."""
    text = _first_off(F.regexp_replace(_squeeze(c), "^[ ?。？]+|[ ?。？]+$", ""), OPENINGS)
    return _squeeze(F.regexp_replace(F.replace(F.regexp_replace(text, DASHES, "-"), F.lit("/"), F.lit(" ")), MARKS, " "))


def unhyphened(c: Column) -> Column:
    """Words joined by hyphens apart (twice, for words of one letter)."""
    once = F.regexp_replace(c, r"(\w)-(\w)", "$1 $2")
    return F.regexp_replace(once, r"(\w)-(\w)", "$1 $2")


def stripped(c: Column) -> Column:
    """The text without the opening of a request."""
    text = F.regexp_replace(_first_off(_squeeze(c), L.PROMPT_PREFIXES), r"(?i)^\s*(?:that\s+)?(?:using|use|used)\s+", "")
    return _squeeze(F.regexp_replace(text, "^[ ?。？!！]+|[ ?。？!！]+$", ""))


#: What else is taken off a question before its constraints are read.
_CLAIMS = (r"^\s*(?:supporting|support|providing)\s+(?:the\s+)?claim\s+(?:that\s+)?", r"^\s*(?:i\s+)?(?:want|would\s+like)\s+to\s+know\s+(?:how|whether|if|about)?\s*")


def for_constraints(cleaned: Column) -> Column:
    text = stripped(cleaned)
    for p in _CLAIMS:
        text = F.regexp_replace(text, "(?i)" + p, "")
    return _squeeze(F.regexp_replace(F.regexp_replace(text, f"{DASHES}|-", " "), MARKS, " "))


_EDGE = r"[ ?。？!！,，;；:：()\[\]{}<>]+"


def cleaned_phrase(c: Column) -> Column:
    """A phrase without what a request leaves around it."""
    text = F.regexp_replace(_squeeze(c), f"^{_EDGE}|{_EDGE}$", "")
    for p in (*L.LEADING_NOISE, r"^(?:that|which)\s+"):
        text = F.trim(F.regexp_replace(text, "(?i)" + p, ""))
    text = _squeeze(text)
    for p in L.TRAILING_NOISE:
        text = F.trim(F.regexp_replace(text, "(?i)" + p, ""))
    return text


def is_fragment(key: Column) -> Column:
    """Whether normalised words are a mere fragment."""
    ends = "|".join(L.FRAGMENT_ENDS)
    open_ = r"(?:^| )(?:between|multiple|inductive)$|(?:^| )between (?:.* )?(?:multiple|several|different)$"
    return (key == "") | key.isin(*L.FRAGMENTS) | key.rlike(f"^(?:{'|'.join(L.FRAGMENT_STARTS)})|(?:{ends})$|{open_}")


def type_of(key: Column) -> Column:
    """Type of constraint of normalised words."""
    out = F.create_map(*[F.lit(x) for kv in L.SHORT_TERMS.items() for x in kv])[key]
    found = F.lit("topic")
    for kind, marks in reversed(TYPE_MARKS):
        found = F.when(key.rlike(marks), kind).otherwise(found)
    return F.coalesce(out, found)


_GENERIC_ONLY = f"^(?:{'|'.join(L.GENERIC_TOPIC)})(?: (?:{'|'.join(L.GENERIC_TOPIC)})){{0,2}}$"
_DANGLES = f" (?:{'|'.join(L.DANGLING)})$|(?:^| )(?:between|among) (?:.* )?(?:multiple|several|different)$"


def is_complete(key: Column, kind: Column) -> Column:
    """Whether normalised words can stand as a constraint of this type."""
    named = kind.isin("model_or_entity", "method_or_property", "task_or_modality") | key.isin(*L.SHORT_TERMS)
    return ~is_fragment(key) & (named | (key.contains(" ") & ~key.rlike(_DANGLES) & ~key.rlike(_GENERIC_ONLY)))


def _lst(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _in(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def _squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def _off_sql(c: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN regexp_replace({c}, '(?i){p}', '')" for p in patterns) + f" ELSE {c} END"


def _clean_steps(src: str, col: str, out: str) -> str:
    """CTEs that end in ``out`` with the cleaned text as ``cleaned`` beside all columns of ``src``."""
    return f"""{out}_a AS (SELECT *, regexp_replace({_squeeze_sql(col)}, '^[ ?。？]+|[ ?。？]+$', '', 'g') AS t_a FROM {src}),
{out}_b AS (SELECT *, {_off_sql('t_a', OPENINGS)} AS t_b FROM {out}_a),
{out} AS (SELECT * EXCLUDE (t_a, t_b), {_squeeze_sql(f"regexp_replace(replace(regexp_replace(t_b, '{DASHES}', '-', 'g'), '/', ' '), '{MARKS}', ' ', 'g')")} AS cleaned FROM {out}_b)"""


def _unhyphened_sql(c: str) -> str:
    for _ in range(2):
        c = f"regexp_replace({c}, '(\\w)-(\\w)', '\\1 \\2', 'g')"
    return c


def _stripped_steps(src: str, col: str, out: str) -> str:
    return f"""{out}_a AS (SELECT *, {_squeeze_sql(col)} AS t_a FROM {src}), {out}_b AS (SELECT *, {_off_sql('t_a', L.PROMPT_PREFIXES)} AS t_b FROM {out}_a),
{out} AS (SELECT * EXCLUDE (t_a, t_b), {_squeeze_sql("regexp_replace(regexp_replace(t_b, '(?i)^\\s*(?:that\\s+)?(?:using|use|used)\\s+', ''), '^[ ?。？!！]+|[ ?。？!！]+$', '', 'g')")} AS stripped FROM {out}_b)"""


def _phrase_sql(c: str) -> str:
    c = f"regexp_replace({_squeeze_sql(c)}, '^{_EDGE}|{_EDGE}$', '', 'g')"
    for p in (*L.LEADING_NOISE, r"^(?:that|which)\s+"):
        c = f"trim(regexp_replace({c}, '(?i){p}', ''))"
    c = _squeeze_sql(c)
    for p in L.TRAILING_NOISE:
        c = f"trim(regexp_replace({c}, '(?i){p}', ''))"
    return c


def _fragment_sql(k: str) -> str:
    open_ = "(^| )(between|multiple|inductive)$|(^| )between (.* )?(multiple|several|different)$"
    return f"({k} = '' OR {k} IN {_in(L.FRAGMENTS)} OR regexp_matches({k}, '^({'|'.join(L.FRAGMENT_STARTS)})|({'|'.join(L.FRAGMENT_ENDS)})$|{open_}'))"


def _type_sql(k: str) -> str:
    short = " ".join(f"WHEN {k} = '{t}' THEN '{v}'" for t, v in L.SHORT_TERMS.items())
    return f"CASE {short} " + " ".join(f"WHEN regexp_matches({k}, '{m}') THEN '{t}'" for t, m in TYPE_MARKS) + " ELSE 'topic' END"


def _complete_sql(k: str, kind: str) -> str:
    named = f"({kind} IN ('model_or_entity', 'method_or_property', 'task_or_modality') OR {k} IN {_in(L.SHORT_TERMS)})"
    return f"(NOT {_fragment_sql(k)} AND ({named} OR (contains({k}, ' ') AND NOT regexp_matches({k}, '{_DANGLES}') AND NOT regexp_matches({k}, '{_GENERIC_ONLY}'))))"


# ---- B18, B19, B22..B24


@query("B18_clean_question", f"WITH {_Q}, {_clean_steps('q', 'question', 'c')} SELECT row_id, cleaned, {_unhyphened_sql('cleaned')} AS split FROM c")
def b18(spark, d):
    q = questions(spark, d).select("row_id", clean(compatible(F.col("question"))).alias("cleaned"))
    return q.select("row_id", "cleaned", unhyphened(F.col("cleaned")).alias("split"))


@query("B19_clean_candidate", f"WITH {_Q}, {_stripped_steps('q', 'question', 's')} SELECT row_id, stripped, {_phrase_sql('stripped')} AS phrase FROM s")
def b19(spark, d):
    q = questions(spark, d).select("row_id", stripped(F.col("question")).alias("stripped"))
    return q.select("row_id", "stripped", cleaned_phrase(F.col("stripped")).alias("phrase"))


def keywords(cleaned: Column, most: int = 12) -> Column:
    """Distinct telling words in order; words in capitals keep them."""
    found = F.regexp_extract_all(unhyphened(cleaned), F.lit(r"[A-Za-z][A-Za-z0-9]*|\d+[A-Za-z]*"), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*L.KEYWORD_STOPS))
    shown = F.transform(kept, lambda t: F.when((t == F.upper(t)) & t.rlike("[A-Z]") & (F.length(t) <= 8), t).otherwise(F.lower(t)))
    return F.slice(F.array_distinct(shown), 1, most)


def clean_keywords(words: Column, most: int = 12) -> Column:
    """Distinct words of normalised text that aren't noise of a request."""
    found = F.regexp_extract_all(words, F.lit(r"[a-z][a-z0-9]*|\d+[a-z]*"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*L.PROMPT_NOISE))), 1, most)


_uniq = lambda xs: f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def _keywords_steps(src: str, out: str, col: str = "cleaned") -> str:
    found = f"regexp_extract_all({_unhyphened_sql(col)}, '[A-Za-z][A-Za-z0-9]*|\\d+[A-Za-z]*')"
    shown = "CASE WHEN t = upper(t) AND regexp_matches(t, '[A-Z]') AND len(t) <= 8 THEN t ELSE lower(t) END"
    return f"""{out}_a AS (SELECT *, list_transform(list_filter({found}, lambda t: len(t) >= 2 AND NOT list_contains({_lst(L.KEYWORD_STOPS)}, lower(t))), lambda t: {shown}) AS k_a FROM {src}),
{out} AS (SELECT * EXCLUDE (k_a), {_uniq('k_a')} AS kws FROM {out}_a)"""


def _clean_keywords_steps(src: str, out: str, words: str) -> str:
    return f"""{out}_a AS (SELECT *, list_filter(regexp_extract_all({words}, '[a-z][a-z0-9]*|\\d+[a-z]*'), lambda t: len(t) >= 2 AND NOT list_contains({_lst(L.PROMPT_NOISE)}, t)) AS k_a FROM {src}),
{out} AS (SELECT * EXCLUDE (k_a), {_uniq('k_a')} AS terms FROM {out}_a)"""


_QC = f"{_Q}, {_clean_steps('q', 'question', 'c')}"
_QK = f"{_QC}, {_keywords_steps('c', 'k')}"


@query("B22_keywords", f"WITH {_QK} SELECT row_id, array_to_string(kws[1:12], ' ') AS keywords FROM k")
def b22(spark, d):
    q = questions(spark, d).select("row_id", clean(F.col("question")).alias("c"))
    return q.select("row_id", F.array_join(keywords(F.col("c")), " ").alias("keywords"))


@query("B23_phrase_terms", f"WITH {_Q}, {_clean_keywords_steps('q', 'k', norm('question'))} SELECT row_id, terms, terms[1:12] AS keywords FROM k")
def b23(spark, d):
    q = questions(spark, d).select("row_id", ascii_words(F.col("question")).alias("w"))
    return q.select("row_id", clean_keywords(F.col("w"), 100_000).alias("terms"), clean_keywords(F.col("w")).alias("keywords"))


def compact(terms: Column, most: int) -> Column:
    """The first terms that differ in more than letter case, as one text."""
    low = F.transform(F.filter(terms, lambda t: _squeeze(t) != ""), lambda t: F.struct(_squeeze(t).alias("t"), F.lower(_squeeze(t)).alias("k")))
    seen = F.transform(low, lambda x: x["k"])
    first = F.filter(low, lambda x, i: F.array_position(seen, x["k"]) == i + 1)
    return F.array_join(F.transform(F.slice(first, 1, most), lambda x: x["t"]), " ")


def _compact_sql(terms: str, most: int) -> str:
    t = f"list_filter(list_transform({terms}, lambda t: {_squeeze_sql('t')}), lambda t: t <> '')"
    low = f"list_transform({t}, lambda t: lower(t))"
    return f"array_to_string((list_filter({t}, lambda t, i: list_position({low}, lower(t)) = i))[1:{most}], ' ')"


@query("B24_compact_terms", f"WITH {_QK} SELECT row_id, {_compact_sql('list_concat(kws, string_split(cleaned, chr(32)))', 16)} AS terms FROM k")
def b24(spark, d):
    q = questions(spark, d).select("row_id", clean(F.col("question")).alias("c"))
    return q.select("row_id", compact(F.concat(keywords(F.col("c"), 100_000), F.split("c", " ")), 16).alias("terms"))


# ---- E01..E03


def _table(rows: list[dict]) -> Column:
    return F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).alias(k) for k, v in r.items()]) for r in rows])


def _table_sql(rows: list[dict]) -> str:
    cell = lambda v: _lst(v) if isinstance(v, (list, tuple)) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join("{" + ", ".join(f"'{k}': {cell(v)}" for k, v in r.items()) + "}" for r in rows) + "]"


_EXPANSION_ROWS = [{"p": p, "also": list(also)} for p, also in L.EXPANSIONS]


def _phrases(low: Column, raw: Column) -> Column:
    """Known phrases in the unhyphened lower-case text, then acronyms and names with numbers of the raw one."""
    known = F.transform(F.filter(_table(_EXPANSION_ROWS), lambda x: low.contains(x["p"])), lambda x: x["p"])
    return F.array_distinct(F.concat(known, F.regexp_extract_all(raw, F.lit(ACRONYM), F.lit(0))))


def _expansions(low: Column) -> Column:
    found = F.flatten(F.transform(F.filter(_table(_EXPANSION_ROWS), lambda x: low.contains(x["p"])), lambda x: x["also"]))
    keys = F.transform(found, lambda t: F.lower(t))
    return F.filter(found, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1)


def _phrases_sql(low: str, raw: str) -> str:
    both = f"list_concat(list_transform(list_filter({_table_sql(_EXPANSION_ROWS)}, lambda x: contains({low}, x.p)), lambda x: x.p), regexp_extract_all({raw}, '{ACRONYM}'))"
    return _uniq(both)


def _expansions_sql(low: str) -> str:
    found = f"flatten(list_transform(list_filter({_table_sql(_EXPANSION_ROWS)}, lambda x: contains({low}, x.p)), lambda x: x.also))"
    return f"list_filter({found}, lambda t, i: list_position(list_transform({found}, lambda y: lower(y)), lower(t)) = i)"


def read(asked: DataFrame, *keep: str) -> DataFrame:
    """Each question with its normalised forms: raw, cleaned, low (unhyphened), kws, phrases, expansions."""
    q = asked.select(*keep, _squeeze(F.col("question")).alias("raw"), clean(F.col("question")).alias("cleaned"))
    q = q.select("*", unhyphened(F.lower("cleaned")).alias("low"), keywords(F.col("cleaned"), 100_000).alias("kws"))
    return q.select("*", _phrases(F.col("low"), F.col("raw")).alias("phrases"), _expansions(F.col("low")).alias("expansions"))


_READ = f"""{_QK}, r0 AS (SELECT *, {_squeeze_sql('question')} AS raw, {_unhyphened_sql('lower(cleaned)')} AS low FROM k),
r AS (SELECT *, {_phrases_sql('low', 'raw')} AS phrases, {_expansions_sql('low')} AS expansions FROM r0)"""


def variants(spark, d) -> DataFrame:
    """(row_id, n, kind, text): raw, cleaned, keyword, expanded and phrase variants, equal texts once, at most five."""
    r = read(questions(spark, d), "row_id")
    some = lambda have, terms, most: F.when(F.size(have) > 0, compact(F.concat(*terms), most))
    made = [("raw", F.col("raw")), ("cleaned", F.col("cleaned")), ("keyword_core", some("kws", ["phrases", F.slice("kws", 1, 12)], 12)),
            ("expanded", some("expansions", ["phrases", F.slice("kws", 1, 8), "expansions"], 16)), ("phrase_focus", some("phrases", ["phrases", "expansions"], 10))]
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in made])
    cells = F.filter(cells, lambda x: F.coalesce(x["text"], F.lit("")) != "")
    keys = F.transform(cells, lambda x: F.lower(x["text"]))
    first = F.filter(cells, lambda x, i: F.array_position(keys, F.lower(x["text"])) == i + 1)
    return r.select("row_id", F.posexplode(F.slice(first, 1, 5)).alias("i", "v")).select("row_id", (F.col("i") + 1).alias("n"), F.col("v.kind").alias("kind"), F.col("v.text").alias("text"))


@query("E01_query_variants", f"""WITH {_READ}, v AS (SELECT row_id, [{{'kind': 'raw', 'text': raw}}, {{'kind': 'cleaned', 'text': cleaned}}, {{'kind': 'keyword_core', 'text': CASE WHEN len(kws) > 0 THEN {_compact_sql('list_concat(phrases, kws[1:12])', 12)} END}},
  {{'kind': 'expanded', 'text': CASE WHEN len(expansions) > 0 THEN {_compact_sql('list_concat(list_concat(phrases, kws[1:8]), expansions)', 16)} END}}, {{'kind': 'phrase_focus', 'text': CASE WHEN len(phrases) > 0 THEN {_compact_sql('list_concat(phrases, expansions)', 10)} END}}] AS vs FROM r),
v1 AS (SELECT row_id, unnest(vs, recursive := true), generate_subscripts(vs, 1) AS i FROM v), v2 AS (SELECT *, row_number() OVER (PARTITION BY row_id, lower(text) ORDER BY i) AS f FROM v1 WHERE coalesce(text, '') <> '')
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) AS INTEGER) AS n, kind, text FROM v2 WHERE f = 1""")
def e01(spark, d):
    return variants(spark, d)


@query("E02_salient_phrases", f"WITH {_READ} SELECT row_id, phrases, expansions FROM r")
def e02(spark, d):
    return read(questions(spark, d), "row_id").select("row_id", "phrases", "expansions")


@query("E03_academic_expansion", f"""WITH {_Q}, a AS (SELECT row_id, question, flatten(list_transform(list_filter({_table_sql([{"k": k, "t": list(t)} for k, t in ACADEMIC.items()])}, lambda x: contains(lower(question), x.k)), lambda x: x.t)) AS ts FROM q),
b AS (SELECT row_id, question, CASE WHEN len(ts) = 0 THEN [question] ELSE {_uniq('ts')} END AS terms FROM a) SELECT row_id, terms, question || ' ' || array_to_string(terms, ' ') AS expanded FROM b""")
def e03(spark, d):
    low = F.lower("question")
    rows = _table([{"k": k, "t": list(t)} for k, t in ACADEMIC.items()])
    found = F.array_distinct(F.flatten(F.transform(F.filter(rows, lambda x: low.contains(x["k"])), lambda x: x["t"])))
    q = questions(spark, d).select("row_id", "question", F.when(F.size(found) > 0, found).otherwise(F.array("question")).alias("terms"))
    return q.select("row_id", "terms", F.concat_ws(" ", "question", F.array_join("terms", " ")).alias("expanded"))


# ---- E04..E10: constraints

_PATTERN_ROWS = [{"text": p, "kind": k} for k, ps in L.PATTERNS.items() for p in ps]
_SHORT_ROWS = [{"term": t, "text": t.upper() if t.isalpha() and len(t) <= 6 else t, "kind": k} for t, k in L.SHORT_TERMS.items()]
CELL = "array<struct<text:string,kind:string>>"


def _cell(text: Column, kind: Column) -> Column:
    return F.struct(text.alias("text"), kind.alias("kind"))


def _known(words: Column) -> Column:
    """Known phrases of normalised words; a large language model isn't a language model besides."""
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    found = F.filter(_table(_PATTERN_ROWS), lambda x: padded.contains(F.concat(F.lit(" "), x["text"], F.lit(" "))) | padded.contains(F.concat(F.lit(" "), x["text"], F.lit("s "))))
    large = F.exists(found, lambda x: x["text"].startswith("large language model"))
    return F.filter(found, lambda x: ~(large & x["text"].isin("language model", "language models")))


def _once(cells: Column, key) -> Column:
    keys = F.transform(cells, key)
    return F.filter(cells, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def candidates_of(asked: DataFrame, *keep: str) -> DataFrame:
    """Each question with the cells that become its constraints, one column a source, and ``all_`` of them in order."""
    q = asked.select(*keep, "question", ascii_words(F.col("question")).alias("w"), clean(F.col("question")).alias("c0"))
    q = q.select("*", for_constraints(F.col("c0")).alias("con_text"), unhyphened(F.lower("c0")).alias("low0"))
    q = q.select("*", ascii_words(F.col("con_text")).alias("cw"), unhyphened(F.lower(clean(F.col("con_text")))).alias("low"))
    comparatives = F.array_compact(F.array(*[F.when(F.col("w").rlike(p), _cell(F.lit(t), F.lit(k))) for p, t, k in COMPARATIVES]))
    spans_of = lambda p, k: F.transform(F.regexp_extract_all("cw", F.lit(p), F.lit(0)), lambda s: _cell(cleaned_phrase(s), F.lit(k)))
    spans = F.flatten(F.array(*[spans_of(p, k) for p, k in RELATIONS]))
    relations = _once(F.filter(spans, lambda x: (x["text"] != "") & is_complete(ascii_words(x["text"]), x["kind"])), lambda x: F.concat_ws("|", ascii_words(x["text"]), x["kind"]))
    padded = F.concat(F.lit(" "), "w", F.lit(" "))
    protected = F.transform(F.filter(_table(_SHORT_ROWS), lambda x: padded.contains(F.concat(F.lit(" "), x["term"], F.lit(" ")))), lambda x: _cell(x["text"], x["kind"]))
    phrases = F.transform(_phrases(F.col("low"), F.col("con_text")), lambda p: F.struct(cleaned_phrase(p).alias("text"), ascii_words(cleaned_phrase(p)).alias("key")))
    salient = F.filter(F.transform(phrases, lambda x: F.struct(x["text"].alias("text"), type_of(x["key"]).alias("kind"), x["key"].alias("key"))), lambda x: (x["text"] != "") & is_complete(x["key"], x["kind"]))
    q = q.select("*", comparatives.alias("comparatives"), _known(F.col("w")).alias("known"), relations.alias("relations"), protected.alias("protected"),
                 F.transform(salient, lambda x: _cell(x["text"], x["kind"])).alias("salient"), clean_keywords(F.col("cw")).alias("terms"))
    q = q.withColumn("all_", F.concat("comparatives", "known", "relations", "protected", "salient"))
    none = F.array().cast(CELL)

    def topic(first: int, when: Column) -> Column:
        text = F.array_join(F.slice("terms", first, 4), " ")
        return F.when(when & is_complete(text, F.lit("topic")), F.array(_cell(text, F.lit("topic")))).otherwise(none)

    q = q.withColumn("all_", F.concat("all_", topic(1, (F.size("all_") < 3) & (F.size("terms") > 0))))
    q = q.withColumn("all_", F.concat("all_", topic(5, (F.size("all_") < 4) & (F.size("terms") >= 6))))
    more = F.transform(F.slice(_expansions(F.col("low0")), 1, F.greatest(F.lit(4) - F.size("all_"), F.lit(0))), lambda t: _cell(t, F.lit(None).cast("string")))
    return q.withColumn("all_", F.concat("all_", more))


def suppressed(cells: Column) -> Column:
    """Cells with cleaned texts and keys, fragments and repetitions left out, and what two others say together."""
    made = F.transform(cells, lambda x: F.struct(cleaned_phrase(x["text"]).alias("text"), x["kind"].alias("kind")))
    made = F.transform(made, lambda x: F.struct(x["text"].alias("text"), x["kind"].alias("kind"), ascii_words(x["text"]).alias("key")))
    made = F.transform(made, lambda x: F.struct(x["text"].alias("text"), x["kind"].alias("kind"), x["key"].alias("key"), F.array_distinct(F.split(x["key"], " ")).alias("ws")))
    return _once(F.filter(made, lambda x: (x["key"] != "") & ~is_fragment(x["key"])), lambda x: x["key"])


def not_redundant(cells: Column) -> Column:
    """Cells that aren't a proper part and the rest of two others together."""

    def rest_is_said(x: Column, part: Column) -> Column:
        rest = F.array_except(x["ws"], part["ws"])
        return F.exists(cells, lambda o: (o["key"] != x["key"]) & (o["key"] != part["key"]) & (F.size(F.array_except(rest, o["ws"])) == 0))

    def redundant(x: Column) -> Column:
        return F.exists(cells, lambda p: (p["key"] != x["key"]) & (F.size(p["ws"]) < F.size(x["ws"])) & (F.size(F.array_except(p["ws"], x["ws"])) == 0) & rest_is_said(x, p))

    return F.filter(cells, lambda x: ~redundant(x))


def constraints(spark, d) -> DataFrame:
    return constraints_of(questions(spark, d))


def constraints_of(asked: DataFrame) -> DataFrame:
    """(row_id, idx, text, kind, weight) of at most six constraints a question, in order."""
    q = candidates_of(asked, "row_id").select("row_id", suppressed(F.col("all_")).alias("cells"))
    q = q.select("row_id", not_redundant(F.col("cells")).alias("cells"))
    typed = F.transform("cells", lambda x: F.struct(x["text"].alias("text"), F.coalesce(x["kind"], type_of(x["key"])).alias("kind"), x["key"].alias("key")))
    kept = F.slice(F.filter(typed, lambda x: is_complete(x["key"], x["kind"])), 1, MOST_CONSTRAINTS)
    weights = F.create_map(*[F.lit(x) for kv in TYPE_WEIGHT.items() for x in kv])
    rows = q.select("row_id", F.posexplode(kept).alias("idx", "c"))
    return rows.select("row_id", "idx", F.col("c.text").alias("text"), F.col("c.kind").alias("kind"), weights[F.col("c.kind")].alias("weight"))


def _candidates_sql() -> str:
    pad = "(' ' || w || ' ')"
    comp = ", ".join(f"CASE WHEN regexp_matches(w, '{p}') THEN {{'text': '{t}', 'kind': '{k}'}} END" for p, t, k in COMPARATIVES)
    known = f"list_filter({_table_sql(_PATTERN_ROWS)}, lambda x: contains({pad}, ' ' || x.text || ' ') OR contains({pad}, ' ' || x.text || 's '))"
    rel = "flatten([" + ", ".join(f"list_transform(regexp_extract_all(cw, '{p}'), lambda s: {{'text': {_phrase_sql('s')}, 'kind': '{k}'}})" for p, k in RELATIONS) + "])"
    key = lambda v: norm(v)
    return f"""{_clean_steps('q', 'question', 'd1')}, {_stripped_steps('d1', 'cleaned', 'd2')},
d3 AS (SELECT row_id, question, {norm('question')} AS w, {_unhyphened_sql('lower(cleaned)')} AS low0, {_squeeze_sql(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(stripped, '(?i){_CLAIMS[0]}', ''), '(?i){_CLAIMS[1]}', ''), '{DASHES}|-', ' ', 'g'), '{MARKS}', ' ', 'g')")} AS con_text FROM d2),
{_clean_steps('d3', 'con_text', 'd4')},
d5 AS (SELECT * EXCLUDE (cleaned), {norm('con_text')} AS cw, {_unhyphened_sql('lower(cleaned)')} AS low FROM d4), {_clean_keywords_steps('d5', 'd6', 'cw')},
d7 AS (SELECT * REPLACE (terms[1:12] AS terms), list_filter([{comp}], lambda x: x IS NOT NULL) AS comparatives, {known} AS known0, list_filter({rel}, lambda x: x.text <> '' AND {_complete_sql(key('x.text'), 'x.kind')}) AS rel0,
  list_transform(list_filter({_table_sql(_SHORT_ROWS)}, lambda x: contains({pad}, ' ' || x.term || ' ')), lambda x: {{'text': x.text, 'kind': x.kind}}) AS protected,
  list_transform({_phrases_sql('low', 'con_text')}, lambda p: {{'text': {_phrase_sql('p')}, 'key': {key(_phrase_sql('p'))}}}) AS sal0, {_expansions_sql('low0')} AS exps FROM d6),
d8 AS (SELECT *, list_filter(known0, lambda x: NOT (len(list_filter(known0, lambda y: starts_with(y.text, 'large language model'))) > 0 AND x.text IN ('language model', 'language models'))) AS known,
  list_filter(rel0, lambda x, i: list_position(list_transform(rel0, lambda y: {key('y.text')} || '|' || y.kind), {key('x.text')} || '|' || x.kind) = i) AS relations,
  list_filter(list_transform(sal0, lambda x: {{'text': x.text, 'kind': {_type_sql('x.key')}, 'key': x.key}}), lambda x: x.text <> '' AND {_complete_sql('x.key', 'x.kind')}) AS sal1 FROM d7),
d9 AS (SELECT *, list_concat(list_concat(list_concat(list_concat(comparatives, known), relations), protected), list_transform(sal1, lambda x: {{'text': x.text, 'kind': x.kind}})) AS all0, array_to_string(terms[1:4], ' ') AS k1, array_to_string(terms[5:8], ' ') AS k2 FROM d8),
d10 AS (SELECT *, CASE WHEN len(all0) < 3 AND len(terms) > 0 AND {_complete_sql('k1', "'topic'")} THEN list_concat(all0, [{{'text': k1, 'kind': 'topic'}}]) ELSE all0 END AS all1 FROM d9),
d11 AS (SELECT *, CASE WHEN len(all1) < 4 AND len(terms) >= 6 AND {_complete_sql('k2', "'topic'")} THEN list_concat(all1, [{{'text': k2, 'kind': 'topic'}}]) ELSE all1 END AS all2 FROM d10),
d12 AS (SELECT *, list_concat(all2, list_transform(exps[1:greatest(4 - len(all2), 0)], lambda t: {{'text': t, 'kind': NULL::VARCHAR}})) AS all_ FROM d11),
d13 AS (SELECT row_id, list_transform(all_, lambda x: {{'text': {_phrase_sql('x.text')}, 'kind': x.kind, 'key': {key(_phrase_sql('x.text'))}}}) AS m0 FROM d12),
d14 AS (SELECT row_id, list_filter(m0, lambda x: x.key <> '' AND NOT {_fragment_sql('x.key')}) AS m1 FROM d13),
d15 AS (SELECT row_id, list_transform(list_filter(m1, lambda x, i: list_position(list_transform(m1, lambda y: y.key), x.key) = i), lambda x: {{'text': x.text, 'kind': x.kind, 'key': x.key, 'ws': list_distinct(string_split(x.key, ' '))}}) AS m2 FROM d14),
d16 AS (SELECT row_id, m2, unnest(m2, recursive := true), generate_subscripts(m2, 1) AS o FROM d15),
d17 AS (SELECT row_id, o, text, coalesce(kind, {_type_sql('key')}) AS kind, key FROM d16 WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT unnest(m2) AS p) WHERE p.key <> d16.key AND len(p.ws) < len(d16.ws) AND len(list_intersect(p.ws, d16.ws)) = len(p.ws)
    AND EXISTS (SELECT 1 FROM (SELECT unnest(m2) AS t) WHERE t.key <> d16.key AND t.key <> p.key AND len(list_filter(d16.ws, lambda z: NOT list_contains(p.ws, z) AND NOT list_contains(t.ws, z))) = 0)))"""


_KINDS = " ".join(f"WHEN '{k}' THEN {w}" for k, w in TYPE_WEIGHT.items())
_CON = f"""{_Q}, {_candidates_sql()},
con AS (SELECT row_id, idx, text, kind, CASE kind {_KINDS} ELSE 1.0 END::DOUBLE AS weight FROM (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY o) - 1 AS idx, text, kind FROM d17 WHERE {_complete_sql('key', 'kind')}) WHERE idx < {MOST_CONSTRAINTS})"""


@query("E04_pattern_constraints", f"WITH {_CON} SELECT row_id, x.text AS text, x.kind AS kind, CAST(i AS INTEGER) AS i FROM (SELECT row_id, unnest(known) AS x, generate_subscripts(known, 1) - 1 AS i FROM d8)")
def e04(spark, d):
    return candidates_of(questions(spark, d), "row_id").select("row_id", F.posexplode("known").alias("i", "x")).select("row_id", "x.text", "x.kind", "i")


@query("E05_comparative_constraints", f"WITH {_CON} SELECT row_id, list_transform(comparatives, lambda x: x.text) AS texts FROM d8")
def e05(spark, d):
    return candidates_of(questions(spark, d), "row_id").select("row_id", F.transform("comparatives", lambda x: x["text"]).alias("texts"))


@query("E06_relation_spans", f"WITH {_CON} SELECT row_id, list_transform(relations, lambda x: x.text) AS spans, list_transform(relations, lambda x: x.kind) AS kinds FROM d8")
def e06(spark, d):
    q = candidates_of(questions(spark, d), "row_id")
    return q.select("row_id", F.transform("relations", lambda x: x["text"]).alias("spans"), F.transform("relations", lambda x: x["kind"]).alias("kinds"))


@query("E07_protected_terms", f"WITH {_CON} SELECT row_id, x.text AS term, x.kind AS kind FROM (SELECT row_id, unnest(protected) AS x FROM d8)")
def e07(spark, d):
    return candidates_of(questions(spark, d), "row_id").select("row_id", F.explode("protected").alias("x")).select("row_id", F.col("x.text").alias("term"), "x.kind")


@query("E08_complete_phrases", f"""WITH {_CON}, g AS (SELECT row_id, unnest(list_transform(range(1, 20), lambda i: array_to_string(string_split(cw, ' ')[1:i], ' '))) AS key FROM d8), h AS (SELECT DISTINCT row_id, key, {_type_sql('key')} AS kind FROM g WHERE key <> '')
SELECT row_id, key, kind, {_fragment_sql('key')} AS fragment, {_complete_sql('key', 'kind')} AS complete FROM h""")
def e08(spark, d):
    """Every opening of a question, up to 19 words: its type, whether it is a fragment and whether it could stand alone."""
    q = candidates_of(questions(spark, d), "row_id").select("row_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: F.array_join(F.slice(F.split("cw", " "), F.lit(1), i), " "))).alias("key"))
    q = q.where("key <> ''").distinct().select("row_id", "key", type_of(F.col("key")).alias("kind"))
    return q.select("*", is_fragment(F.col("key")).alias("fragment"), is_complete(F.col("key"), F.col("kind")).alias("complete"))


_SLUG = "coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), ''), 'constraint')"


def constraint_id() -> Column:
    from rankloom.functions.text import slug

    return F.concat(F.lit("c"), (F.col("idx") + 1).cast("string"), F.lit("_"), slug(F.col("text"), 40))


@query("E09_constraint_weights", f"WITH {_CON} SELECT row_id, 'c' || (idx + 1) || '_' || {_SLUG} AS id, {_type_sql(norm('text'))} AS inferred, weight FROM con")
def e09(spark, d):
    """Identifier and weight of each constraint, and the type that its words alone would give it."""
    return constraints(spark, d).select("row_id", constraint_id().alias("id"), type_of(ascii_words(F.col("text"))).alias("inferred"), "weight")


@query("E10_decomposition", f"WITH {_CON} SELECT row_id, CAST(idx AS INTEGER) AS idx, text, kind, weight FROM con")
def e10(spark, d):
    return constraints(spark, d)


_PRI = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " END"


@query("E11_subqueries", f"""WITH {_CON}, p0 AS (SELECT *, 'c' || (idx + 1) || '_' || {_SLUG} AS id FROM con), p1 AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {_PRI}, weight DESC, id) AS n FROM p0),
g AS (SELECT row_id, min(text) FILTER (n = 1) AS top, coalesce(list(text ORDER BY idx) FILTER (n > 1), []) AS others FROM p1 GROUP BY row_id),
s AS (SELECT d8.row_id, list_filter(flatten([[{{'kind': 'full_cleaned', 'text': con_text}}, {{'kind': 'keyword_fallback', 'text': array_to_string(terms[1:10], ' ')}}, {{'kind': 'constraint_core', 'text': {_compact_sql('list_concat([top], others[1:3])', 14)}}}],
  list_transform(others[1:4], lambda o: {{'kind': 'pairwise_constraint', 'text': {_compact_sql('[top, o]', 8)}}}), CASE WHEN len(others) = 0 THEN [{{'kind': 'single_constraint', 'text': top}}] ELSE [] END]), lambda x: coalesce({norm('x.text')}, '') <> '') AS subs FROM d8 LEFT JOIN g USING (row_id)),
t AS (SELECT row_id, unnest(subs, recursive := true), generate_subscripts(subs, 1) AS i FROM s), u AS (SELECT *, row_number() OVER (PARTITION BY row_id, {norm('text')} ORDER BY i) AS f FROM t)
SELECT * FROM (SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) AS INTEGER) AS n, kind, text FROM u WHERE f = 1) WHERE n <= {MOST_SUBQUERIES}""")
def e11(spark, d):
    """The whole question, its keywords, the leading constraint with three others, with each of four others, or alone."""
    pri = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("kind")]
    c = constraints(spark, d).withColumn("id", constraint_id())
    first = F.min(F.struct(pri.alias("p"), (-F.col("weight")).alias("w"), "id", "text", "idx"))
    g = c.groupBy("row_id").agg(first.alias("first"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("all"))
    others = F.transform(F.filter("all", lambda x: x["idx"] != F.col("first.idx")), lambda x: x["text"])
    g = g.select("row_id", F.col("first.text").alias("top"), others.alias("others"))
    q = candidates_of(questions(spark, d), "row_id").select("row_id", "con_text", "terms").join(g, "row_id", "left")
    q = q.withColumn("others", F.coalesce("others", F.array().cast("array<string>")))
    sub = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    made = F.concat(
        F.array(sub("full_cleaned", F.col("con_text")), sub("keyword_fallback", F.array_join(F.slice("terms", 1, 10), " ")),
                sub("constraint_core", F.when(F.col("top").isNotNull(), compact(F.concat(F.array("top"), F.slice("others", 1, 3)), 14)))),
        F.transform(F.slice("others", 1, 4), lambda o: sub("pairwise_constraint", compact(F.array("top", o), 8))),
        F.when(F.size("others") == 0, F.array(sub("single_constraint", F.col("top")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")))
    kept = _once(F.filter(made, lambda x: ascii_words(x["text"]) != ""), lambda x: ascii_words(x["text"]))
    return q.select("row_id", F.posexplode(F.slice(kept, 1, MOST_SUBQUERIES)).alias("i", "s")).select("row_id", (F.col("i") + 1).alias("n"), F.col("s.kind").alias("kind"), F.col("s.text").alias("text"))


# ---- C09, C10

# What a phrase of a request begins with; the last words of a phrase that may be cut.
DISCOURSE = ("supporting the claim ", "show that ", "showing that ", "evidence that ", "papers that ", "paper that ")
CUT_ENDS = "a an and between claim have inductive knowledgeable multiple of or supporting systematically the to with".split()
_BROAD = [*L.GENERIC_TOPIC]


def suspicions(text: Column, kind: Column) -> Column:
    """Why a constraint looks wrong, in a fixed order; empty for a sound one."""
    key = ascii_words(text)
    ws = F.split(key, " ")
    n, last, topic = F.size(ws), F.element_at(ws, -1), kind == "topic"
    flags = F.array_compact(F.array(
        F.when((n == 1) & topic, "single_token_topic"), F.when((n <= 3) & topic, "very_short_topic"), F.when(last.isin(*CUT_ENDS), "fragment_prone_ending"),
        F.when(key.rlike("^(?:" + "|".join(DISCOURSE) + ")"), "discourse_prefix"), F.when((n >= 2) & (F.size(F.array_except(ws, F.array(*map(F.lit, _BROAD)))) == 0), "generic_topic_only"),
        F.when(F.array_contains(ws, "between") & last.isin("between", "multiple"), "dangling_relation")))
    return F.when(key == "", F.array(F.lit("empty_constraint"))).otherwise(flags)


_SUSPECT = f"""CASE WHEN {norm('text')} = '' THEN ['empty_constraint'] ELSE list_filter([CASE WHEN n = 1 AND kind = 'topic' THEN 'single_token_topic' END, CASE WHEN n <= 3 AND kind = 'topic' THEN 'very_short_topic' END, CASE WHEN list_contains({_lst(CUT_ENDS)}, ws[-1]) THEN 'fragment_prone_ending' END,
  CASE WHEN regexp_matches(array_to_string(ws, ' '), '^({'|'.join(DISCOURSE)})') THEN 'discourse_prefix' END, CASE WHEN n >= 2 AND len(list_filter(ws, lambda t: NOT list_contains({_lst(_BROAD)}, t))) = 0 THEN 'generic_topic_only' END, CASE WHEN list_contains(ws, 'between') AND ws[-1] IN ('between', 'multiple') THEN 'dangling_relation' END], lambda x: x IS NOT NULL) END"""


@query("C09_suspicious_constraints", f"WITH {_CON}, t AS (SELECT *, string_split({norm('text')}, ' ') AS ws, len(string_split({norm('text')}, ' ')) AS n FROM con) SELECT row_id, CAST(idx AS INTEGER) AS idx, {_SUSPECT} AS reasons FROM t")
def c09(spark, d):
    return constraints(spark, d).select("row_id", "idx", suspicions(F.col("text"), F.col("kind")).alias("reasons"))


def placed(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("row_id").orderBy(*order)))
