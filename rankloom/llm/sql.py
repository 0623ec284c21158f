"""DuckDB SQL for the queries of this package that SQL can express."""

_CANON = "replace(lower(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')), 'ß', 'ss')"


def canon(c: str) -> str:
    return _CANON.format(c=c)


_ITEMS = """items AS (
  SELECT DISTINCT qid, pred_id, pos, p.title AS title, p.raw.day8_final_score AS score
  FROM (SELECT qid, pred_id, unnest(papers) AS p, generate_subscripts(papers, 1) - 1 AS pos FROM predictions))"""

P2 = f"""WITH {_ITEMS}
SELECT * FROM (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, encode(title) NULLS LAST, pred_id, pos) AS INTEGER) AS place, pred_id, CAST(pos AS INTEGER) AS item_pos
  FROM items WHERE score IS NOT NULL AND NOT isnan(score)) WHERE place <= 10"""

P5 = f"""WITH {_ITEMS},
recs AS (
  SELECT rec_id, source, coalesce(nullif({canon('title')}, ''), {canon('display_name')}) AS t,
    array_to_string(list_sort(list_filter(list_transform(CASE WHEN source = 'openalex' THEN list_transform(authorships, lambda a: a.author.display_name)
      ELSE list_transform(authors, lambda a: a.name) END, lambda n: {canon('n')}), lambda n: n <> '')), '|') AS names,
    coalesce(year, publication_year) AS y, coalesce(nullif({canon('doi')}, ''), {canon('externalids.doi')}) AS doi,
    CASE WHEN starts_with(ltrim(venue), '{{') AND json_valid(venue) THEN {canon("venue->>'$.display_name'")} || '|' || {canon("venue->>'$.type'")} ELSE {canon('venue')} END AS v,
    {canon('abstract')} AS a FROM papers_with_duplicates),
rows AS (
  SELECT 'papers' AS tab, rec_id AS id, 0 AS pos, concat_ws('~', source, t, coalesce(names, ''), coalesce(y::VARCHAR, ''), doi, v, a) AS k FROM recs
  UNION ALL SELECT 'predictions', pred_id, pos, coalesce(qid, '') || '~' || {canon('title')} FROM items),
firsts AS (SELECT *, first_value(id) OVER w AS first_id, first_value(pos) OVER w AS first_pos FROM (SELECT DISTINCT * FROM rows) WINDOW w AS (PARTITION BY tab, k ORDER BY id, pos))
SELECT tab, first_id, CAST(first_pos AS INTEGER) AS first_pos, id AS copy_id, CAST(pos AS INTEGER) AS copy_pos FROM firsts WHERE (id, pos) <> (first_id, first_pos)"""

_REF = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({c}, '\\s+', '', 'g')), '^https?://.*/', ''), '^arxiv:', ''), '^(\\d{{4}}\\.\\d{{4,5}})v\\d+$', '\\1')"
_GROUPS = f"""ids AS (SELECT rec_id, {_REF.format(c='ref')} AS k FROM (SELECT rec_id, unnest([source_record_id, paperid, id]) AS ref FROM papers_with_duplicates) WHERE ref IS NOT NULL),
lk AS (SELECT a.rec_id AS a, b.rec_id AS b FROM paper_matches m JOIN ids a ON a.k = {_REF.format(c='m.left_ref')} JOIN ids b ON b.k = {_REF.format(c='m.right_ref')} WHERE m.is_match AND a.rec_id <> b.rec_id),
e AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
grp AS (SELECT a AS rec_id, min(b) AS group_id FROM reach GROUP BY a)"""

P7 = f"WITH RECURSIVE {_GROUPS} SELECT rec_id, group_id FROM grp"


_BLANK_ABSTRACT = """clickheretoreadtheabstract undefined null na abstractremoved noabstractavailable abstractmissing résuménondisponible xxx tba noabstract
abstractnotavailable seepdf none keinezusammenfassungverfügbar sinresumen""".split()
_BLANK_VENUE = "na notspecified unknownvenue venuemissing tobeannounced unknown misc null none".split()


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_VALUES = f"""WITH RECURSIVE {_GROUPS},
f AS (
  SELECT rec_id, source, ingested_at, 'doi' AS field_name, CASE WHEN source = 'semantic_scholar' THEN externalids.doi ELSE doi END AS v FROM papers_with_duplicates
  UNION ALL SELECT rec_id, source, ingested_at, 'abstract', abstract FROM papers_with_duplicates
  UNION ALL SELECT rec_id, source, ingested_at, 'venue', CASE WHEN source = 'openalex' THEN CASE WHEN json_valid(venue) THEN venue->>'$.display_name' END ELSE venue END FROM papers_with_duplicates),
w AS (SELECT *, {canon('v')} AS c FROM f WHERE v IS NOT NULL),
ok AS (SELECT * FROM w WHERE
  (field_name = 'doi' AND regexp_matches(v, '(?i)10\\.\\d{{4,9}}(/|%2f)\\s*\\S') AND NOT contains(v, '10.00000/'))
  OR (field_name = 'abstract' AND c <> '' AND c NOT IN ({_listed(_BLANK_ABSTRACT)}) AND NOT starts_with(c, 'thisitemhasnoabstract') AND NOT starts_with(c, 'theabstractofrecord'))
  OR (field_name = 'venue' AND c <> '' AND c NOT IN ({_listed(_BLANK_VENUE)})))"""

P3 = _VALUES + """
SELECT group_id, field_name, rec_id FROM (
  SELECT g.group_id, ok.field_name, ok.rec_id, row_number() OVER (PARTITION BY g.group_id, ok.field_name
    ORDER BY coalesce(t.trust, 0) DESC, CASE WHEN ok.field_name = 'doi' THEN 0 ELSE len(c) END DESC, ok.ingested_at DESC NULLS LAST, ok.rec_id) AS n
  FROM ok JOIN grp g USING (rec_id) LEFT JOIN source_trust t ON t.source = ok.source AND t.field_name = ok.field_name) WHERE n = 1"""

# Votes: trust times the decay of a value's age, summed for each normalised value.
P3_VOTES = _VALUES + """,
voted AS (SELECT g.group_id, ok.field_name, ok.rec_id, coalesce(t.trust, 0) AS trust, ok.ingested_at,
    CASE WHEN ok.field_name = 'doi' THEN 0 ELSE len(c) END AS letters,
    CASE WHEN ok.field_name = 'doi' THEN regexp_extract(lower(regexp_replace(v, '(?i)%2f', '/', 'g')), '10\\.\\d{4,9}/\\S*[\\p{L}\\p{N}]') ELSE c END AS val,
    coalesce(t.trust, 0) * coalesce(pow(2.0, -((epoch(n.newest)::BIGINT - floor(epoch(ok.ingested_at))::BIGINT) / 86400.0) / 180.0), 0.0) AS vote
  FROM ok JOIN grp g USING (rec_id) CROSS JOIN (SELECT max(ingested_at) AS newest FROM papers_with_duplicates) n
  LEFT JOIN source_trust t ON t.source = ok.source AND t.field_name = ok.field_name),
summed AS (SELECT *, round(sum(vote) OVER (PARTITION BY group_id, field_name, val), 9) AS votes FROM voted)
SELECT group_id, field_name, rec_id FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY votes DESC, trust DESC, letters DESC, ingested_at DESC NULLS LAST, rec_id) AS n FROM summed) WHERE n = 1"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2, "p3_found": P3, "p3_votes": P3_VOTES, "p5_found": P5, "p7_found": P7}
