"""Search plans of a question: anchors with their places, alias rules, compositions, selection; canonical constraints and what they leave open."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import evidence_words, jaccard, slug
from rankloom import lexicon as L
from rankloom.plans.inputs import norm, table
from rankloom.plans.scalars import questions as by_qid
from rankloom.plans.understand import _CON, _Q, _compact_sql, _clean_steps, _in, _keywords_steps, _lst, _squeeze, _squeeze_sql, _table, _table_sql, clean, compact, constraint_id, constraints, keywords, questions
from rankloom.registry import query

QUOTED = "[\"“”']([^\"“”']{5,180})[\"“”']"
TITLED = "\\b(?:paper|work|article)\\s+(?:titled|called|named)\\s+[\"“”']?([^\"“”',.;?]{5,180})"
COINED = r"(?<![A-Za-z0-9_])(?:[A-Z]{2,}[A-Za-z0-9_-]*|[A-Z][a-z]+(?:[A-Z][A-Za-z0-9_-]+)+|[A-Za-z]+_[A-Za-z0-9_]+)(?![A-Za-z0-9_])"
# Names that anchor nothing.
COMMON_NAMES = ("api", "pdf", "doi", "url", "ai", "ml", "nlp")
SURE = ("benchmark", "method", "model")
MOST_TERMS, MOST_PLANS = 14, 2
_STRIP = " \t\r\n,.;:?!()[]{}\"'“”"


def _literal(value: str) -> str:
    """A known name as a pattern; between its words may stand spaces, hyphens and underscores."""
    return re.escape(value).replace(r"\ ", r"[\s_-]+")


def _key(text: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9]+", " ", text.casefold().replace("_", " ")).split())


_ANCHOR_RULES: list[tuple[str, str, int, str, float]] = (
    [(rf"(?<![A-Za-z0-9]){_literal(v)}(?![A-Za-z0-9])", k, 0, "", 1.0 if k in SURE else 0.92) for k, vs in L.KNOWN_ANCHORS.items() for v in sorted(vs, key=len, reverse=True)]
    + [(p, "negative_constraint", 0, v, 1.0) for p, v in L.NEGATIVE]
    + [(p, "temporal_constraint", 0, v, 1.0) for p, v in L.TEMPORAL]
    + [(p, "comparison", 0, v, 0.96) for p, v in L.COMPARISON]
    + [(TITLED, "paper_title", 1, "", 0.98)]
)
ANCHORS = "row_id {}, begin_at int, end_at int, kind string, text string, key string, value string, years array<int>, confidence double"


def spans_of(question: str) -> list[tuple[int, int, str, str, str, str, list[int], float]]:
    """(begin, end, kind, text, key, value, years, confidence) of every anchor, by place, longer ones first."""
    noise = {_key(n) for n in L.NOT_ANCHORS}
    found: dict[tuple, tuple] = {}

    def add(m: re.Match, group: int, kind: str, value: str, sure: float) -> None:
        a, b = m.span(group)
        text = m.group(group).strip(_STRIP)
        key = _key(text)
        if key and _key(question[a:b]) and _key(question[a:b]) not in noise:
            years = [int(g) for g in m.groups() if g] if kind == "temporal_constraint" else []
            found.setdefault((kind, key, a, b), (a, b, kind, text, key, value, years, sure))

    for pattern, kind, group, value, sure in _COMPILED:
        for m in pattern.finditer(question):
            add(m, group, kind, value, sure)
    for m in _QUOTED.finditer(question):
        if len(m.group(1).split()) >= 3:
            add(m, 1, "paper_title", "", 0.82)
    known = {k[1] for k in found}
    for m in _COINED.finditer(question):
        if _key(m.group()) not in known and _key(m.group()) not in COMMON_NAMES:
            add(m, 0, "named_entity", "", 0.72)
    return sorted(found.values(), key=lambda x: (x[0], -x[1], x[2]))


_COMPILED = [(re.compile(p, re.IGNORECASE), k, g, v, c) for p, k, g, v, c in _ANCHOR_RULES]
_QUOTED, _COINED = re.compile(QUOTED), re.compile(COINED)


def anchors(asked: DataFrame) -> DataFrame:
    """(row_id, begin_at, end_at, kind, text, key, value, years, confidence) of the anchors in each question, with their offsets."""

    def run(batches):
        import pyarrow as pa

        types = [pa.int32(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.int32()), pa.float64()]
        for b in batches:
            found = [(i, *x) for i, q in enumerate(b.column(1).to_pylist()) for x in spans_of(q)]
            rows, *columns = list(zip(*found)) or [()] * 9
            arrays = [b.column(0).take(pa.array(list(rows), pa.int32())), *(pa.array(list(c), t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in ANCHORS.split(", ")])

    q = asked.select("row_id", _squeeze(F.col("question")).alias("question"))
    return q.mapInArrow(run, ANCHORS.format(asked.schema["row_id"].dataType.simpleString()))


@query("E12_anchor_spans")
def e12(spark, d):
    return anchors(questions(spark, d))


def anchored(asked: DataFrame) -> DataFrame:
    """Each question with its anchors in order: row_id, question, anchors (kind, text, value, years)."""
    cell = F.struct("begin_at", (-F.col("end_at")).alias("e"), "kind", "text", "value", "years")
    found = anchors(asked).groupBy("row_id").agg(F.array_sort(F.collect_list(cell)).alias("anchors"))
    none = F.array().cast("array<struct<begin_at:int,e:int,kind:string,text:string,value:string,years:array<int>>>")
    return asked.select("row_id", _squeeze(F.col("question")).alias("question")).join(found, "row_id", "left").withColumn("anchors", F.coalesce("anchors", none))


def texts_of(kind: str) -> Column:
    return F.array_distinct(F.transform(F.filter("anchors", lambda x: x["kind"] == kind), lambda x: x["text"]))


# The same in SQL: the first place of each pattern, which is what orders texts of one kind.
def _first_sql(pattern: str, kind: str, value: str = "", group: int = 0) -> str:
    """A pattern's first match; lookarounds are written as characters before and behind."""
    before, behind = "()", ""
    body = pattern
    if body.startswith("(?<!"):
        edge = "[^A-Za-z0-9_]" if "_" in body[: body.index(")")] else "[^A-Za-z0-9]"
        body = body[body.index(")") + 1 : body.rindex("(?!")]
        before, behind = f"(?:^|{edge})", f"(?:$|{edge})"
    case = "" if kind == "named_entity" else "i"
    quoted = body.replace("'", "''")
    groups = "['pre', 'hit', 'g']" if group else "['pre', 'hit']"
    rest = f"(?s{case})^((?:.*?{before[3:-1] if before.startswith('(?:') else ''})??)({quoted}){behind}".replace("??)", "?)") if before.startswith("(?:") else f"(?s{case})^(.*?)({quoted})"
    if before.startswith("(?:"):
        edge = before[5:-1]
        rest = f"(?s{case})^((?:.*?{edge})?)({quoted}){behind}"
    m = f"regexp_extract(question, '{rest}', {groups})"
    return f"SELECT row_id, '{kind}' AS kind, '{value}' AS value, trim({m}.{'g' if group else 'hit'}, ' \t\r\n,.;:?!()[]{{}}\"''“”') AS text, len({m}.pre) + {f'instr({m}.hit, {m}.g) - 1' if group else '0'} AS a, len({m}.pre) + len({m}.hit) AS b FROM qa WHERE regexp_matches(question, '{rest}')"


_AN_ROWS = " UNION ALL ".join(_first_sql(p, k, v, g) for p, k, g, v, _ in _ANCHOR_RULES if k != "comparison" or True)
_AN = f"""{_Q}, qa AS (SELECT row_id, {_squeeze_sql('question')} AS question FROM q), an0 AS ({_AN_ROWS}
  UNION ALL SELECT * FROM (SELECT row_id, 'paper_title' AS kind, '' AS value, trim(unnest(regexp_extract_all(question, '{QUOTED.replace("'", "''")}', 1))) AS text, 500 AS a, 501 AS b FROM qa) WHERE len(string_split_regex(trim(text), '\\s+')) >= 3),
named AS (SELECT row_id, unnest(regexp_extract_all(question, '(?:^|[^A-Za-z0-9_])([A-Z]{{2,}}[A-Za-z0-9_-]*|[A-Z][a-z]+(?:[A-Z][A-Za-z0-9_-]+)+|[A-Za-z]+_[A-Za-z0-9_]+)(?:$|[^A-Za-z0-9_])', 1)) AS text, question FROM qa),
an AS (SELECT DISTINCT row_id, kind, value, text, a, b FROM an0 WHERE {norm('text')} <> ''
  UNION ALL SELECT DISTINCT n.row_id, 'named_entity', '', n.text, instr(n.question, n.text) - 1, instr(n.question, n.text) - 1 + len(n.text) FROM named n
  WHERE {norm('n.text')} NOT IN {_in(COMMON_NAMES)} AND NOT EXISTS (SELECT 1 FROM an0 WHERE an0.row_id = n.row_id AND {norm('an0.text')} = {norm('n.text')})),
by_kind AS (SELECT row_id, kind, list(text ORDER BY a, b DESC) AS texts FROM (SELECT row_id, kind, text, min(a) AS a, max(b) AS b FROM an GROUP BY ALL) GROUP BY row_id, kind)"""


@query("E13_filters", f"""WITH {_AN} SELECT qa.row_id, coalesce((SELECT list(DISTINCT value ORDER BY value) FROM an WHERE an.row_id = qa.row_id AND kind = 'negative_constraint'), []) AS excluded,
  coalesce((SELECT list(value || ':' || array_to_string(regexp_extract_all(text, '(19|20)\\d\\d', 0), ',') ORDER BY value) FROM an WHERE an.row_id = qa.row_id AND kind = 'temporal_constraint'), []) AS years FROM qa""")
def e13(spark, d):
    """What each question excludes, and its conditions on the year as relation:years."""
    q = anchored(questions(spark, d))
    some = lambda kind, f: F.array_sort(F.array_distinct(F.transform(F.filter("anchors", lambda x: x["kind"] == kind), f)))
    years = some("temporal_constraint", lambda x: F.concat(x["value"], F.lit(":"), F.array_join(x["years"], ",")))
    return q.select("row_id", some("negative_constraint", lambda x: x["value"]).alias("excluded"), years.alias("years"))


_RULE_ROWS = [{"p": p, "aliases": list(a), "kind": k, "plan": t, "priority": n} for p, a, k, t, n in L.ALIAS_RULES]
PLAN = "array<struct<text:string,plan_type:string,priority:int,confidence:double>>"


def _plan(text: Column, plan_type: Column, priority: Column, confidence: Column) -> Column:
    return F.struct(text.alias("text"), plan_type.alias("plan_type"), priority.cast("int").alias("priority"), confidence.cast("double").alias("confidence"))


def alias_plans(question: Column) -> Column:
    """The first two aliases of every rule whose pattern the question has."""
    found = F.array_compact(F.array(*[F.when(question.rlike("(?i)" + r["p"]), F.struct(F.array(*map(F.lit, r["aliases"])).alias("a"), F.lit(r["plan"]).alias("t"), F.lit(r["priority"]).alias("n"))) for r in _RULE_ROWS]))
    two = F.transform(found, lambda r: F.transform(F.slice(r["a"], 1, 2), lambda a, i: _plan(a, r["t"], r["n"] - i, F.round(F.greatest(F.lit(0.75), 0.99 - 0.03 * i), 9))))
    return F.flatten(two)


_RULES_SQL = f"(SELECT unnest({_table_sql(_RULE_ROWS)}, recursive := true))".replace("\\\\", "\\")
_ALIAS = f"""al AS (SELECT row_id, aliases[i] AS text, plan AS plan_type, priority - (i - 1) AS priority, round(greatest(0.75, 0.99 - 0.03 * (i - 1)), 9)::DOUBLE AS confidence
  FROM qa JOIN {_RULES_SQL} r ON regexp_matches(question, '(?i)' || r.p), (SELECT unnest([1, 2]) AS i))"""


@query("E14_alias_plans", f"WITH {_Q}, qa AS (SELECT row_id, {_squeeze_sql('question')} AS question FROM q), {_ALIAS} SELECT row_id, text, plan_type, CAST(priority AS INTEGER) AS priority, confidence FROM al")
def e14(spark, d):
    q = questions(spark, d).select("row_id", _squeeze(F.col("question")).alias("question"))
    return q.select("row_id", F.inline(alias_plans(F.col("question"))))


def composed(asked: DataFrame) -> DataFrame:
    """Each question with its plans by source: titles, aliases, compositions of anchors, fallback."""
    q = anchored(asked)
    q = q.select("*", clean(F.col("question")).alias("cleaned"), *(texts_of(k).alias(k) for k in ("benchmark", "method", "model", "task", "modality", "named_entity", "comparison", "paper_title")))
    q = q.select("*", keywords(F.col("question"), 8).alias("own"), keywords(F.col("cleaned"), MOST_TERMS).alias("kws"))
    has = lambda c: F.size(c) > 0
    eight = F.slice("kws", 1, 8)

    def made(when: Column, terms: list, plan_type: str, priority: int, confidence: float) -> Column:
        text = compact(F.concat(*terms), MOST_TERMS)
        return F.when(when & (text != ""), F.array(_plan(text, F.lit(plan_type), F.lit(priority), F.lit(confidence)))).otherwise(F.array().cast(PLAN))

    method_task, model_task = has("method") & has("task"), ~has("method") & has("model") & has("task")
    plans = F.concat(
        made(has("comparison") & has("benchmark"), ["benchmark", "comparison"], "benchmark_comparison", 94, 0.93),
        made(has("benchmark"), ["benchmark", "task", "own"], "benchmark_aware", 88, 0.88),
        made(method_task, ["method", "task", "model", "modality"], "task_method", 86, 0.87),
        made(model_task, ["model", "task", "modality"], "model_task", 84, 0.85),
        made(has("task") & ~has("method") & ~has("model"), ["task", "modality", "named_entity", eight], "task_focus", 78, 0.79),
        made(~has("task") & (has("method") | has("model")), ["method", "model", "named_entity", eight], "method_model", 76, 0.77),
    )
    titles = F.transform("paper_title", lambda t: _plan(t, F.lit("title_anchor"), F.lit(110), F.lit(1.0)))
    named = F.transform(F.filter("anchors", lambda x: ~x["kind"].isin("negative_constraint", "temporal_constraint", "comparison")), lambda x: x["text"])
    fallback = made(F.lit(True), [named, "kws"], "keyword_fallback", 40, 0.55)
    return q.select("row_id", "question", "anchors", titles.alias("titles"), alias_plans(F.col("question")).alias("aliases"), plans.alias("composed"), fallback.alias("fallback"))


_T = lambda k: f"coalesce((SELECT texts FROM by_kind b WHERE b.row_id = c.row_id AND kind = '{k}'), [])"
_KINDS = ("benchmark", "method", "model", "task", "modality", "named_entity", "comparison", "paper_title")
_cat = lambda xs: xs[0] if len(xs) == 1 else f"list_concat({_cat(xs[:-1])}, {xs[-1]})"
_COMPOSED = f"""{_AN}, {_clean_steps('qa', 'question', 'c')}, {_keywords_steps('c', 'ck')}, {_keywords_steps('ck', 'qk', 'question').replace('AS kws FROM', 'AS own FROM')},
tx AS (SELECT row_id, question, kws[1:{MOST_TERMS}] AS kws, own[1:8] AS own, {', '.join(f'{_T(k)} AS {k}' for k in _KINDS)} FROM qk c),
pl AS ({' UNION ALL '.join(f"SELECT row_id, '{t}' AS plan_type, {n} AS priority, {c}::DOUBLE AS confidence, {_compact_sql(_cat(terms), MOST_TERMS)} AS text FROM tx WHERE {w}" for w, terms, t, n, c in (
  ("len(comparison) > 0 AND len(benchmark) > 0", ["benchmark", "comparison"], "benchmark_comparison", 94, 0.93),
  ("len(benchmark) > 0", ["benchmark", "task", "own"], "benchmark_aware", 88, 0.88),
  ("len(method) > 0 AND len(task) > 0", ["method", "task", "model", "modality"], "task_method", 86, 0.87),
  ("len(method) = 0 AND len(model) > 0 AND len(task) > 0", ["model", "task", "modality"], "model_task", 84, 0.85),
  ("len(method) = 0 AND len(model) = 0 AND len(task) > 0", ["task", "modality", "named_entity", "kws[1:8]"], "task_focus", 78, 0.79),
  ("len(task) = 0 AND (len(method) > 0 OR len(model) > 0)", ["method", "model", "named_entity", "kws[1:8]"], "method_model", 76, 0.77)))}),
named_all AS (SELECT row_id, list(text ORDER BY a, b DESC, kind) AS texts FROM (SELECT row_id, kind, text, min(a) AS a, max(b) AS b FROM an WHERE kind NOT IN ('negative_constraint', 'temporal_constraint', 'comparison') GROUP BY ALL) GROUP BY row_id),
fb AS (SELECT row_id, {_compact_sql('list_concat(coalesce(texts, []), kws)', MOST_TERMS)} AS text FROM tx LEFT JOIN named_all USING (row_id)),
tt AS (SELECT row_id, unnest(paper_title) AS text FROM tx)"""


@query("E15_composed_plans", f"WITH {_COMPOSED} SELECT row_id, plan_type, CAST(priority AS INTEGER) AS priority, confidence, text FROM pl WHERE text <> ''")
def e15(spark, d):
    return composed(questions(spark, d)).select("row_id", F.inline("composed"))


@query("E16_title_plans", f"WITH {_COMPOSED} SELECT row_id, 'title_anchor' AS plan_type, 110 AS priority, text FROM tt UNION ALL SELECT row_id, 'keyword_fallback', 40, text FROM fb WHERE text <> ''")
def e16(spark, d):
    c = composed(questions(spark, d))
    return c.select("row_id", F.inline(F.concat("titles", "fallback"))).select("row_id", "plan_type", "priority", "text")


def plans(asked: DataFrame) -> DataFrame:
    """(row_id, n, plan_type, priority, confidence, text): at most two plans a question, equal texts once."""
    rows = composed(asked).select("row_id", F.inline(F.concat("titles", "aliases", "composed", "fallback")))
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    order = [F.desc("priority"), F.desc("confidence"), F.asc(F.lower("text"))]
    rows = rows.withColumn("f", F.row_number().over(Window.partitionBy("row_id", key).orderBy(*order))).where("f = 1").where(key != "")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("row_id").orderBy(*order))).where(F.col("n") <= MOST_PLANS)
    return rows.select("row_id", "n", "plan_type", "priority", "confidence", "text")


_PLANS = f"""{_COMPOSED}, {_ALIAS}, pall AS (SELECT row_id, plan_type, priority, confidence, text FROM pl UNION ALL SELECT row_id, plan_type, priority, confidence, text FROM al UNION ALL SELECT row_id, 'title_anchor', 110, 1.0, text FROM tt UNION ALL SELECT row_id, 'keyword_fallback', 40, 0.55, text FROM fb),
pf AS (SELECT *, row_number() OVER (PARTITION BY row_id, {norm('text')} ORDER BY priority DESC, confidence DESC, lower(text)) AS f FROM pall WHERE {norm('text')} <> ''),
plan AS (SELECT * FROM (SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY priority DESC, confidence DESC, lower(text)) AS INTEGER) AS n, plan_type, CAST(priority AS INTEGER) AS priority, confidence::DOUBLE AS confidence, text FROM pf WHERE f = 1) WHERE n <= {MOST_PLANS})"""


@query("E17_plan_selection", f"WITH {_PLANS} SELECT * FROM plan")
def e17(spark, d):
    return plans(questions(spark, d))


@query("C10_plan_counts", f"""WITH {_PLANS}, n AS (SELECT qa.row_id, count(plan.n) AS k FROM qa LEFT JOIN plan USING (row_id) GROUP BY 1)
SELECT 'plans' AS what, plan_type AS name, count(*) AS n FROM plan GROUP BY plan_type UNION ALL SELECT 'queries', k || ' plans', count(*) FROM n GROUP BY k UNION ALL SELECT 'total', 'queries', count(*) FROM n UNION ALL SELECT 'total', 'plans', count(*) FROM plan""")
def c10(spark, d):
    """Plans by type, questions by their number of plans, and both in all; every plan stands for one call."""
    asked = questions(spark, d)
    p = plans(asked)
    k = asked.select("row_id").join(p.groupBy("row_id").agg(F.count("*").alias("k")), "row_id", "left").fillna(0, ["k"])
    rows = lambda df, what, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    out = rows(p, "plans", F.col("plan_type")).unionByName(rows(k, "queries", F.concat("k", F.lit(" plans"))))
    return out.unionByName(rows(k, "total", F.lit("queries"))).unionByName(rows(p, "total", F.lit("plans")))


@query("C02_plan_validation", f"""WITH {_PLANS}, per AS (SELECT row_id, count(*) AS n FROM plan GROUP BY row_id) SELECT count(*) AS queries, sum(n)::BIGINT AS plans, max(n) AS most, count(*) FILTER (n > {MOST_PLANS}) AS too_many, 0 AS gold_columns, sum(n) <= 48 AS within_budget FROM per""")
def c02(spark, d):
    """Checks before any call: plans a question, calls against the budget, and no column at any depth that speaks of gold."""
    p = plans(questions(spark, d))
    per = p.groupBy("row_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("queries"), F.sum("n").alias("plans"), F.max("n").alias("most"), F.count_if(F.col("n") > MOST_PLANS).alias("too_many"),
                   F.lit(len(gold_columns(p.schema))).alias("gold_columns"), (F.sum("n") <= 48).alias("within_budget"))


# Names of columns that hold what only the evaluation may read.
GOLD_NAMES = ("gold", "gold_papers", "gold_titles", "gold_ids", "matched_gold", "answer", "answers", "answer_arxiv_id")


def gold_columns(schema) -> list[str]:
    """Names of columns, at any depth, that speak of gold."""
    out = []

    def walk(t) -> None:
        for f in getattr(t, "fields", None) or ():
            name = f.name.strip().casefold()
            if name in GOLD_NAMES or name.startswith("gold_"):
                out.append(f.name)
            walk(f.dataType)
        for inner in ("elementType", "valueType"):
            if hasattr(t, inner):
                walk(getattr(t, inner))

    walk(schema)
    return out


def require_plans(spec: DataFrame, most_plans: int = MOST_PLANS, most_calls: int | None = None) -> DataFrame:
    """``spec`` (qid, planned_queries: a list) as it is, or an error: gold columns, missing or repeated qids, too many or no plans, calls over the budget."""
    if gold_columns(spec.schema):
        raise ValueError(f"gold columns in a plan: {', '.join(gold_columns(spec.schema))}")
    n = F.coalesce(F.size("planned_queries"), F.lit(0))
    bad = spec.groupBy("qid").agg(F.count("*").alias("times"), F.min(n).alias("least"), F.max(n).alias("most"))
    wrong = (F.coalesce(F.trim(F.col("qid").cast("string")), F.lit("")) == "") | (F.col("times") > 1) | (F.col("least") < 1) | (F.col("most") > most_plans)
    first = bad.where(wrong).limit(1).collect()
    if first:
        raise ValueError(f"plan {first[0]['qid']!r}: {first[0]['times']} rows, {first[0]['least']} to {first[0]['most']} plans, of which {most_plans} are allowed")
    if most_calls is not None and (calls := spec.agg(F.sum(n)).first()[0] or 0) > most_calls:
        raise ValueError(f"{calls} calls exceed the budget of {most_calls}")
    return spec


# ---- E18, E19: canonical constraints


def peeled(c: Column) -> Column:
    """Evidence words without connectors at either end, as long as three words are there to take one from."""
    ws = F.split(evidence_words(c), " ")

    def run(ws: Column, words) -> Column:
        """How many of the first words are in the set."""
        other = F.array_position(F.transform(ws, lambda w: ~w.isin(*words)), True)
        return F.when(other == 0, F.size(ws)).otherwise(other - 1).cast("int")

    cut = F.least(run(ws, L.LEADING_CONNECTORS), F.greatest(F.size(ws) - 2, F.lit(0)))
    ws = F.slice(ws, cut + 1, F.size(ws))
    back = F.reverse(ws)
    cut = F.least(run(back, L.TRAILING_CONNECTORS), F.greatest(F.size(ws) - 2, F.lit(0)))
    return F.array_join(F.slice(ws, F.lit(1), F.size(ws) - cut), " ")


def _evidence_sql(c: str) -> str:
    sing = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.SINGULAR.items()) + " ELSE t END"
    return f"array_to_string(list_transform(string_split({norm(c)}, ' '), lambda t: {sing}), ' ')"


def _peeled_sql(src: str, col: str, out: str) -> str:
    run = lambda ws, words: f"coalesce(nullif(list_position(list_transform({ws}, lambda w: NOT list_contains({_lst(words)}, w)), true), 0) - 1, len({ws}))"
    return f"""{out}_a AS (SELECT *, string_split({_evidence_sql(col)}, ' ') AS w_a FROM {src}),
{out}_b AS (SELECT *, w_a[least({run('w_a', L.LEADING_CONNECTORS)}, greatest(len(w_a) - 2, 0)) + 1:] AS w_b FROM {out}_a),
{out} AS (SELECT * EXCLUDE (w_a, w_b), array_to_string(w_b[:len(w_b) - least({run('list_reverse(w_b)', L.TRAILING_CONNECTORS)}, greatest(len(w_b) - 2, 0))], ' ') AS peeled FROM {out}_b)"""


@query("B17_peeled_phrases", f"WITH {_Q}, {_peeled_sql('q', 'question', 'p')} SELECT row_id, peeled AS phrase FROM p")
def b17(spark, d):
    return questions(spark, d).select("row_id", peeled(F.col("question")).alias("phrase"))


def _plain(text: str) -> str:
    """Evidence words of a fixed value."""
    return " ".join(L.SINGULAR.get(t, t) for t in re.sub("[^a-z0-9]+", " ", text.lower()).split())


ALIASES = {_plain(a): _plain(name) for name, also in L.ALIAS_GROUPS.items() for a in (name, *also)}


def canonical_name(key: Column) -> Column:
    """The name that stands for a peeled phrase's concept."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[key], key)


def merged(rows: DataFrame, *group: str, least: float = 0.80) -> DataFrame:
    """Constraints of a group made one where they name one concept: (group, n, text, kind, weight, terms, aliases, ids).

    In order, each joins the first earlier one of the same name or alias, else the first
    of its type whose words it shares to ``least``, else stands alone. Groups hold at
    most nine constraints, and each is folded as one array.
    """
    key = peeled(F.col("text"))
    c = rows.select(*group, "idx", "id", "kind", "weight", key.alias("key"), evidence_words(F.col("text")).alias("raw")).where("key <> ''")
    c = c.withColumn("name", canonical_name(F.col("key"))).withColumn("ws", F.array_distinct(F.split("name", " ")))
    cells = c.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("idx", "id", "kind", "weight", "key", "raw", "name", "ws"))).alias("cells"))
    empty = F.array().cast("array<struct<text:string,kind:string,weight:double,terms:array<string>,aliases:array<string>,ids:array<string>>>")

    def join_in(have: Column, x: Column) -> Column:
        named = F.transform(have, lambda h: (h["text"] == x["name"]) | F.array_contains(h["aliases"], x["name"]))
        alike = F.transform(have, lambda h: (h["kind"] == x["kind"]) & (jaccard(h["terms"], x["ws"]) >= least))
        by_name, by_words = F.array_position(named, True), F.array_position(alike, True)
        at = F.when(by_name > 0, by_name).otherwise(by_words)
        aliases = F.array(x["key"], x["name"], x["raw"])
        fresh = F.struct(x["name"].alias("text"), x["kind"].alias("kind"), x["weight"].alias("weight"), x["ws"].alias("terms"), F.array_distinct(aliases).alias("aliases"), F.array(x["id"]).alias("ids"))

        def shorter(a: Column, b: Column) -> Column:
            na, nb = F.size(F.split(a, " ")), F.size(F.split(b, " "))
            plain = F.when(nb < na, b).when(na < nb, a).otherwise(F.least(a, b))
            return F.when(canonical_name(a) != a, canonical_name(a)).when(canonical_name(b) != b, canonical_name(b)).otherwise(plain)

        def grown(h: Column) -> Column:
            return F.struct(shorter(h["text"], x["name"]).alias("text"), h["kind"].alias("kind"), F.greatest(h["weight"], x["weight"]).alias("weight"), F.array_union(h["terms"], x["ws"]).alias("terms"),
                            F.array_union(h["aliases"], aliases).alias("aliases"), F.array_union(h["ids"], F.array(x["id"])).alias("ids"))

        return F.when(at > 0, F.transform(have, lambda h, i: F.when(i + 1 == at, grown(h)).otherwise(h))).otherwise(F.concat(have, F.array(fresh)))

    out = cells.select(*group, F.posexplode(F.aggregate("cells", empty, join_in)).alias("n", "c"))
    return out.select(*group, "n", "c.text", "c.kind", "c.weight", F.array_sort("c.terms").alias("terms"), F.array_sort("c.aliases").alias("aliases"), "c.ids")


@query("E18_merged_constraints")
def e18(spark, d):
    """Canonical constraints of each question, with the identifiers of what they were made of."""
    return merged(constraints(spark, d).withColumn("id", constraint_id()), "row_id")


# Shortest and longest span of what is left, and how many are taken.
SPAN_LEAST, SPAN_MOST, SPANS = 2, 8, 3
_BROAD = f"^(?:{'|'.join(L.GENERIC_TOPIC)})(?: (?:{'|'.join(L.GENERIC_TOPIC)})){{0,2}}$"


def meaningful(key: Column) -> Column:
    ws = F.split(key, " ")
    last = F.element_at(ws, -1)
    loose = (F.size(ws) == 1) | last.isin(*L.RESIDUAL_DANGLING) | (F.array_contains(ws, "between") & last.isin("between", "multiple")) | key.rlike(_BROAD)
    return (key != "") & (key.isin(*L.SHORT_TERMS) | ~loose)


def residuals(asked: DataFrame, canonical: DataFrame) -> DataFrame:
    """(row_id, n, span): runs of 2 to 8 question words that no canonical constraint covers, the first three that add something.

    Gaps and islands over the words: covered words and boundaries end a run.
    """
    q = asked.select("row_id", F.split(evidence_words(F.col("question")), " ").alias("ws"))
    phrases = canonical.groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("text"), "aliases")))).alias("phrases"), F.collect_list("terms").alias("concepts"))
    q = q.join(phrases, "row_id", "left")
    q = q.withColumn("parts", F.transform(F.coalesce("phrases", F.array().cast("array<string>")), lambda p: F.split(peeled(p), " ")))

    def covered(i: Column) -> Column:
        """Whether a phrase's words stand in the question around the word at ``i``."""
        return F.exists("parts", lambda p: F.exists(F.sequence(F.greatest(i - F.size(p) + 2, F.lit(1)), i + 1), lambda s: F.slice("ws", s, F.size(p)) == p))

    marks = F.transform("ws", lambda w, i: F.when(covered(i) | w.isin(*L.BOUNDARIES), F.lit("|")).otherwise(w))
    runs = F.transform(F.split(F.array_join(marks, " "), r" ?\| ?(?:\| ?)*"), lambda r: F.trim(r))
    fit = F.filter(runs, lambda r: (r != "") & F.size(F.split(r, " ")).between(SPAN_LEAST, SPAN_MOST))
    keys = F.filter(F.transform(fit, lambda r: peeled(r)), lambda k: (F.size(F.split(k, " ")) >= SPAN_LEAST) & meaningful(k))
    named = F.array_distinct(F.transform(keys, canonical_name))
    said = lambda k: F.exists(F.coalesce("concepts", F.array().cast("array<array<string>>")), lambda c: jaccard(F.array_distinct(F.split(k, " ")), c) >= 0.80)
    kept = F.slice(F.filter(named, lambda k: meaningful(k) & ~said(k)), 1, SPANS)
    return q.select("row_id", F.posexplode(kept).alias("n", "span"))


@query("E19_residual_spans")
def e19(spark, d):
    asked = questions(spark, d)
    return residuals(asked, e18(spark, d))


def canonical_constraints(asked: DataFrame, plain: DataFrame) -> DataFrame:
    """``merged`` over a question's constraints and the spans that they leave open (as topics of weight 1)."""
    own = plain.withColumn("id", constraint_id()).select("row_id", "idx", "id", "text", "kind", "weight")
    spans = residuals(asked, merged(own, "row_id"))
    more = spans.select("row_id", (F.col("n") + 100).alias("idx"), F.concat(F.lit("residual_query_span_"), F.col("n") + 1).alias("id"), F.col("span").alias("text"), F.lit("topic").alias("kind"), F.lit(1.0).alias("weight"))
    return merged(own.unionByName(more), "row_id").withColumn("id", F.concat(F.lit("cc"), F.col("n") + 1, F.lit("_"), slug(F.col("text"), 48)))


@query("E19_canonical_constraints")
def e19_canonical(spark, d):
    asked = questions(spark, d)
    return canonical_constraints(asked, constraints(spark, d))


@query("E21_plan_substitution", f"""WITH a AS (SELECT qid, min(question) AS base FROM predictions WHERE question IS NOT NULL GROUP BY qid), b AS (SELECT qid, min(question) AS fresh FROM pasa_like_sample WHERE qid IS NOT NULL AND question IS NOT NULL GROUP BY qid) SELECT qid, fresh AS text, base <> fresh AS replaced FROM a JOIN b USING (qid)""")
def e21(spark, d):
    b = table(spark, d, "pasa_like_sample").where("qid is not null and question is not null").groupBy("qid").agg(F.min("question").alias("fresh"))
    return by_qid(spark, d).join(b, "qid").select("qid", F.col("fresh").alias("text"), (F.col("question") != F.col("fresh")).alias("replaced"))


def substituted(plan: DataFrame, failures: DataFrame, expansions: DataFrame) -> DataFrame:
    """Plans (qid, planned_queries of structs with ``text``) of the queries that retrieval missed, their first plan's text replaced, the others dropped.

    A missed query without a plan or an expansion is an error that names it.
    """
    missed = failures.where("failure_type = 'retrieval_miss'").select("qid").distinct()
    both = missed.join(plan, "qid", "left").join(expansions.select("qid", "expanded_query"), "qid", "left")
    gaps = both.where(F.coalesce(F.size("planned_queries"), F.lit(0)).eqNullSafe(0) | F.col("expanded_query").isNull()).select("qid").orderBy("qid").limit(1).collect()
    if gaps:
        raise ValueError(f"no plan or expansion for {gaps[0]['qid']}")
    first = F.element_at("planned_queries", 1).withField("text", F.col("expanded_query"))
    return both.select("qid", F.array(first).alias("planned_queries"))


# ---- canonical constraints in SQL: the fold over a question's constraints is a recursive query


def _canonical_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in ALIASES.items() if a != n) + f" ELSE {c} END"


def _jaccard_sql(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"


def _fold_sql(items: str, out: str) -> str:
    """``out``: (row_id, n, text, kind, weight, terms, aliases, ids) from ``items`` (row_id, n from 1, id, kind, weight, key, raw, name, ws)."""
    struct = "STRUCT(text VARCHAR, kind VARCHAR, weight DOUBLE, terms VARCHAR[], aliases VARCHAR[], ids VARCHAR[])"
    size = lambda c: f"len(string_split({c}, ' '))"
    shorter = f"CASE WHEN {_canonical_sql('h.text')} <> h.text THEN {_canonical_sql('h.text')} WHEN {size('name')} < {size('h.text')} THEN name WHEN {size('h.text')} < {size('name')} THEN h.text ELSE least(h.text, name) END"
    grown = f"{{'text': {shorter}, 'kind': h.kind, 'weight': greatest(h.weight, weight), 'terms': list_distinct(list_concat(h.terms, ws)), 'aliases': list_distinct(list_concat(h.aliases, [key, name, raw])), 'ids': list_distinct(list_concat(h.ids, [id]))}}"
    fresh = "{'text': name, 'kind': kind, 'weight': weight, 'terms': ws, 'aliases': list_distinct([key, name, raw]), 'ids': [id]}"
    at = f"coalesce(nullif(list_position(list_transform(f.have, lambda h: h.text = x.name OR list_contains(h.aliases, x.name)), true), 0), list_position(list_transform(f.have, lambda h: h.kind = x.kind AND {_jaccard_sql('h.terms', 'x.ws')} >= 0.8), true), 0)"
    return f"""{out}_r AS (SELECT row_id, 0::BIGINT AS step, []::{struct}[] AS have FROM (SELECT DISTINCT row_id FROM {items})
  UNION ALL SELECT row_id, step + 1, CASE WHEN spot > 0 THEN list_transform(have, lambda h, i: CASE WHEN i = spot THEN {grown} ELSE h END) ELSE list_append(have, {fresh}) END
  FROM (SELECT f.row_id, f.step, f.have, x.id, x.kind, x.weight, x.key, x.raw, x.name, x.ws, {at} AS spot FROM {out}_r f JOIN {items} x ON x.row_id = f.row_id AND x.n = f.step + 1)),
{out}_l AS (SELECT row_id, arg_max(have, step) AS have FROM {out}_r GROUP BY row_id),
{out} AS (SELECT row_id, n, h.text, h.kind, h.weight, list_sort(h.terms) AS terms, list_sort(h.aliases) AS aliases, h.ids FROM (SELECT row_id, unnest(have) AS h, generate_subscripts(have, 1) - 1 AS n FROM {out}_l))"""


_SLUG = lambda c, n: f"coalesce(nullif(substr(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, {n}), ''), 'constraint')"


def _items_sql(src: str, out: str) -> str:
    """``src`` has row_id, idx, id, text, kind, weight."""
    return f"""{_peeled_sql(src, 'text', out + '_p')},
{out} AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY idx) AS n, id, kind, weight, peeled AS key, {_evidence_sql('text')} AS raw, {_canonical_sql('peeled')} AS name, list_distinct(string_split({_canonical_sql('peeled')}, ' ')) AS ws FROM {out}_p WHERE peeled <> '')"""


def _peeled_expr(c: str) -> str:
    """``peeled`` of one value as an expression, for short phrases within lists."""
    run = lambda ws, words: f"coalesce(nullif(list_position(list_transform({ws}, lambda w: NOT list_contains({_lst(words)}, w)), true), 0) - 1, len({ws}))"
    ws = f"string_split({_evidence_sql(c)}, ' ')"
    front = f"({ws})[least({run(ws, L.LEADING_CONNECTORS)}, greatest(len({ws}) - 2, 0)) + 1:]"
    back = f"list_reverse({front})"
    return f"array_to_string(list_reverse(({back})[least({run(back, L.TRAILING_CONNECTORS)}, greatest(len({front}) - 2, 0)) + 1:]), ' ')"


def _meaningful_sql(k: str) -> str:
    ws = f"string_split({k}, ' ')"
    loose = f"(len({ws}) = 1 OR {ws}[-1] IN {_in(L.RESIDUAL_DANGLING)} OR (list_contains({ws}, 'between') AND {ws}[-1] IN ('between', 'multiple')) OR regexp_matches({k}, '{_BROAD}'))"
    return f"({k} <> '' AND ({k} IN {_in(L.SHORT_TERMS)} OR NOT {loose}))"


_MERGED = f"""ci AS (SELECT row_id, idx, 'c' || (idx + 1) || '_' || {_SLUG('text', 40)} AS id, text, kind, weight FROM con), {_items_sql('ci', 'it')}, {_fold_sql('it', 'mg')}"""
_RESIDUAL = f"""rq AS (SELECT row_id, string_split({_evidence_sql('question')}, ' ') AS ws FROM q),
rp AS (SELECT row_id, list_distinct(flatten(list(list_concat([text], aliases)))) AS phrases, list(terms) AS concepts FROM mg GROUP BY row_id),
rp1 AS (SELECT row_id, unnest(phrases) AS p FROM rp), {_peeled_sql('rp1', 'p', 'rp2')}, rp3 AS (SELECT row_id, list(string_split(peeled, ' ')) AS parts FROM rp2 GROUP BY row_id),
rs0 AS (SELECT rq.row_id, ws, coalesce(parts, []) AS parts, coalesce(concepts, []) AS concepts FROM rq LEFT JOIN rp USING (row_id) LEFT JOIN rp3 USING (row_id)),
rs1 AS (SELECT row_id, concepts, array_to_string(list_transform(ws, lambda w, i: CASE WHEN list_contains({_lst(L.BOUNDARIES)}, w) OR len(list_filter(parts, lambda p: len(list_filter(range(greatest(i - len(p) + 1, 1), i + 1), lambda s: ws[s:s + len(p) - 1] = p)) > 0)) > 0 THEN '|' ELSE w END), ' ') AS marks FROM rs0),
rs2 AS (SELECT row_id, concepts, unnest(string_split_regex(marks, ' ?\\| ?(\\| ?)*')) AS r, generate_subscripts(string_split_regex(marks, ' ?\\| ?(\\| ?)*'), 1) AS i FROM rs1),
rs3 AS (SELECT row_id, concepts, i, trim(r) AS r FROM rs2 WHERE trim(r) <> '' AND len(string_split(trim(r), ' ')) BETWEEN {SPAN_LEAST} AND {SPAN_MOST}), {_peeled_sql('rs3', 'r', 'rs4')},
rs5 AS (SELECT row_id, concepts, i, {_canonical_sql('peeled')} AS k FROM rs4 WHERE len(string_split(peeled, ' ')) >= {SPAN_LEAST} AND {_meaningful_sql('peeled')}),
rs6 AS (SELECT row_id, k, min(i) AS i, any_value(concepts) AS concepts FROM rs5 GROUP BY row_id, k),
res AS (SELECT * FROM (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS n, k AS span FROM rs6 WHERE {_meaningful_sql('k')} AND len(list_filter(concepts, lambda c: {_jaccard_sql("list_distinct(string_split(k, ' '))", 'c')} >= 0.8)) = 0) WHERE n < {SPANS})"""
CANON = f"""{_CON}, {_MERGED}, {_RESIDUAL},
ci2 AS (SELECT row_id, idx, id, text, kind, weight FROM ci UNION ALL SELECT row_id, n + 100, 'residual_query_span_' || (n + 1), span, 'topic', 1.0 FROM res), {_items_sql('ci2', 'it2')}, {_fold_sql('it2', 'can0')},
can AS (SELECT *, 'cc' || (n + 1) || '_' || {_SLUG('text', 48)} AS id FROM can0)"""

from rankloom.registry import SQL  # noqa: E402

SQL["E18_merged_constraints"] = f"WITH RECURSIVE {_CON}, {_MERGED} SELECT row_id, CAST(n AS INTEGER) AS n, text, kind, weight, terms, aliases, ids FROM mg"
SQL["E19_residual_spans"] = f"WITH RECURSIVE {_CON}, {_MERGED}, {_RESIDUAL} SELECT row_id, CAST(n AS INTEGER) AS n, span FROM res"
SQL["E19_canonical_constraints"] = f"WITH RECURSIVE {CANON} SELECT row_id, CAST(n AS INTEGER) AS n, text, kind, weight, terms, aliases, ids, id FROM can"
