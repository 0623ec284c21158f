"""Sentences, names and record matching on cases whose answer is plain."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm.matching import match_records, same_work, title_words
from rankloom.llm.names import align, align_people, assignment, parse_name, variant_pairs
from rankloom.llm.sentences import sentences, split_text

from .test_exact import RECORDS, record

CASES = [
    ["Dr. A. B. Lee et al. wrote it, e.g. in no. 5.", "It failed... but only once."],
    ["What a surprise!", "“Yes!”", "That was it.", "The U.S. and the U.K. agree."],
    ['They wrote: "It is thin. More is needed."', "We agree."],
    ["(An earlier version used x.)", "See https://a.example/x.html?v=1.2.", "It runs in 3.5 s."],
    ["Bei X fehlen Autoren, Jahr usw.", "Das ist schlecht.", "Die 5. Auflage kam am 2. Mai, z. B. hier."],
    ["« Est-ce assez ? » demande Mme Ponimor.", "Quelle surprise !", "Il reste petit."],
    ["¿Por qué?", "Porque sí.", "—¿Basta? —preguntó D. Ponimor.", "La Sra. X (ed.) cita el art. 7."],
    ["См. рис. 5 и табл. 4.", "Версия вышла 1 янв. 2019 г., т. е. рано.", "«Метод плох», — отмечает P. X."],
]


@pytest.mark.parametrize("parts", CASES)
def test_sentences(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in split_text(text)] == parts


def test_unspaced_scripts_and_lines():
    for parts in (["他们说：“不错！但不够。”", "我们同意。"], ["結果は表1に示す．", "「十分だ！」と彼は言った。", "（付録1も参照。）"], ["यह है।", '"क्या?" X ने पूछा।']):
        text = "".join(parts)
        assert [text[a:b] for a, b in split_text(text)] == parts
    text = "5 Introduction\nThis is a\nwrapped line. Next one.\n\n- first item\n- second item.\n\nLimitations"
    assert [text[a:b] for a, b in split_text(text)] == ["5 Introduction", "This is a\nwrapped line.", "Next one.", "- first item", "- second item.", "Limitations"]
    assert split_text(None) == split_text("") == split_text(" \n\t ") == []


def test_sentences_cover_any_text(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aB. !?\n\"“”()。1,- 」ก​") for _ in range(rnd.randrange(0, 400))) for _ in range(300)] + ["a" * 100_000, ". " * 20_000]
    for t in texts:
        last, seen = 0, 0
        for a, b in split_text(t):
            assert last <= a < b and not t[a].isspace() and not t[b - 1].isspace() and not t[last:a].strip()
            last, seen = b, seen + 1
        assert not t[last:].strip()
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, begin_at string")
    assert [tuple(r) for r in sentences(df).orderBy("begin_at").collect()] == [(1, 0, 4), (1, 5, 9)]


def test_parse_and_align():
    assert parse_name("Dr. Lee-Ng, Ann B.") == ("", ["ann", "lee-ng"], "person")
    assert parse_name("J.-L. Łuk*") == ("j", ["luk"], "person")
    assert parse_name("Univ. of Xia") == ("", ["university", "xia"], "org")
    assert parse_name(" . ") is None
    formal = {"bob": {"robert"}}
    assert align(["bob", "lee"], ["robert", "lee"], formal)[0] == "nick"
    assert align(["lee", "ann"], ["ann", "leee"], formal)[0] == "typo"
    assert align(["a", "lee"], ["ann", "lee"], formal)[0] == "initial"
    assert align(["ann", "lee"], ["eva", "lee"], formal) is None
    six = "alpha beta gamma delta epsilon zeta".split()
    assert align(six, six[::-1], formal)[0] == "same" and align(six, [*six[:0:-1], "alpa"], formal)[0] == "typo"


def test_middle_names_are_kept():
    assert parse_name("Mary Ann Smith")[1] == ["mary", "ann", "smith"]
    assert align_people(["mary", "ann", "smith"], ["mary", "jane", "smith"], "", "", {}) is None
    assert align_people(["mary", "ann", "smith"], ["mary", "smith"], "", "", {})[0] == "middle"
    assert align_people(["mary", "ann", "smith"], ["mary", "anne", "smith"], "", "", {})[0] in ("same", "middle")


def test_assignment_is_the_cheapest():
    from itertools import permutations

    rnd = random.Random(2)
    for n in (1, 2, 4, 6):
        for _ in range(30):
            costs = [[rnd.choice([0, 1, 2, 3, 1000]) for _ in range(n)] for _ in range(n)]
            order = assignment(costs)
            assert sorted(order) == list(range(n))
            assert sum(costs[i][j] for i, j in enumerate(order)) == min(sum(costs[i][j] for i, j in enumerate(p)) for p in permutations(range(n)))


def test_variant_pairs(spark):
    names = ["Robert Fokabarhara", "Bob Fokabarhara", "FOKABARHARA, R.", "Robert  Fokabarhara*", "Petra Fokabarhara", "Robert Wutelunde", " ", None]
    recs = [record(i, title=f"t{i}", authors=[(n,)]) for i, n in enumerate(names)] + [record(50, authors=None)]
    given = spark.createDataFrame([("Robert", "Bob"), (None, "x")], "formal_name string, short_form string")
    got = {tuple(r) for r in variant_pairs(spark.createDataFrame(recs, RECORDS).withColumn("entity", F.lit(1)), given).collect()}
    same = sorted(n for n in names[:4])
    assert got == {(a, b) for i, a in enumerate(same) for b in same[i + 1 :]}
    assert variant_pairs(spark.createDataFrame([], RECORDS), given).count() == 0


def test_no_growing_table_of_names_is_broadcast(spark, monkeypatch):
    from rankloom.llm import components, names

    plans = []

    def kept(df, tag, **measures):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, tag, **measures)

    stage = names.stage
    monkeypatch.setattr(names, "stage", kept)
    monkeypatch.setattr(components, "stage", kept)
    recs = [record(i, title=f"t{i}", authors=[(n,)]) for i, n in enumerate(["Robert Fokabarhara", "Bob Fokabarhara", "FOKABARHARA, R.", "Petra Wutelunde"])]
    found = variant_pairs(spark.createDataFrame(recs, RECORDS), spark.createDataFrame([("Robert", "Bob")], "formal_name string, short_form string"))
    plans.append(("found", found._jdf.queryExecution().executedPlan().toString()))
    # Nodes are joined with given names, of which there are few at any size.
    assert {tag for tag, plan in plans if "Broadcast" in plan} == {"nodes"}
    assert len(found.collect()) == 3


def test_title_words():
    assert title_words("[Preprint] \\emph{On} X-2: Y…")[:3] == (["on", "x", "2", "y"], ["2"], True)
    assert title_words("A study of xyz (Corection)")[1] == ["correction"]
    assert title_words(None) == ([], [], False)


def pair(ta, tb, na="lee kim", nb="lee kim", ya=2020, yb=2020, da="", db=""):
    a, b = title_words(ta), title_words(tb)
    return same_work((" ".join(a[0]), " ".join(a[1]), a[2], na, ya, da, ""), (" ".join(b[0]), " ".join(b[1]), b[2], nb, yb, db, ""))


def test_same_work():
    t = "Calibrated Dense Retrieval for Query Autocompletion in Museum Catalogues"
    assert pair(t, "calibrated dense retrival for autocompletion query in museum catalogues")
    assert pair(t, "Calibrated Dense Retrieval for Query…") and pair(t, t, nb="", yb=2021)
    assert not pair(t, t + " II") and not pair(t, "Revisiting " + t) and not pair(t, t + " (Correction)") and not pair("X-2: a b c d", "X-3: a b c d")
    assert not pair(t, t, nb="novak marek") and not pair(t, t, yb=2025)
    assert not pair(t, "Calibrated Dense Retrieval for Query Autocompletion in Power Grids")
    assert pair(t, "", da="9/x", db="9/x") and not pair(t, "Editorial", da="9/x", db="9/x")


def test_match_records(spark):
    t = "Calibrated Dense Retrieval for Query Autocompletion in Museum Catalogues"
    recs = [
        record(1, "openalex", display_name=t, authorships=[("first", ("i", "Ann Fokabarhara"))], publication_year=2020),
        record(2, "generic", title=t.upper() + "*", authors=[("Fokabarhara, A.",)], year=2021), record(3, "generic", title=t + " II", authors=[("Ann Fokabarhara",)], year=2021),
        record(4, "arxiv", title=t, authors=[(None,), (" ",)], year=2020), record(5, "openalex"), record(6, "generic"), record(7, None, title="x"),
    ]
    df = spark.createDataFrame(recs, RECORDS).withColumn("cosine", F.lit("clash"))
    got = match_records(df).collect()
    assert {(r["rec_a"], r["rec_b"]) for r in got} == {(1, 2), (1, 4)} and all(0 <= r["confidence"] <= 1 for r in got)
    assert match_records(df.limit(0)).count() == 0


def test_shared_identifier_needs_no_cosine(spark):
    """A title cut to one word beside a long record: only the DOI brings them together."""
    t = "Calibrated Dense Retrieval for Query Autocompletion in Museum Catalogues"
    many = [("first", ("i", f"Ann Fokabarhara{c}")) for c in "abcdefghijklmnopqrstuvwxyz"]
    recs = [record(1, "openalex", display_name=t, authorships=many, publication_year=2020, doi="10.1234/x"), record(2, "generic", title="Calibrated…", doi="10.1234/x")]
    assert [(r["rec_a"], r["rec_b"]) for r in match_records(spark.createDataFrame(recs, RECORDS)).collect()] == [(1, 2)]


def test_terminators_of_other_scripts():
    for mark in "\u0700\u0701\u0702\u07f9\u1368\u1803\u1809\u1c7e\u203d\ua6f3\uaaf0":
        parts = [f"ab cd{mark}", f"Ef gh{mark}"]
        assert [" ".join(parts)[a:b] for a, b in split_text(" ".join(parts))] == parts


def test_crowded_bucket_is_split(spark, monkeypatch):
    """200 records in one bucket (one author, one word) and 200 under one DOI: fewer pairs, no match lost."""
    import rankloom.llm.matching as m

    monkeypatch.setattr(m, "CELL", 20)
    rnd = random.Random(3)
    made = ["".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(5)) for _ in range(260)]
    recs = []
    for i in range(200):
        doi, who, word = ("10.1234/x", f"Ann {made[-1 - i]}", "") if i < 100 else (None, "Ann Lee", "zzzzzzzz ")
        words = f"{word}{made[i]} {made[i + 30]} {made[i + 60]}"
        recs.append(record(2 * i, "openalex", display_name=words, authorships=[("first", ("i", who))], publication_year=2020, doi=doi))
        recs.append(record(2 * i + 1, "generic", title=words.replace(made[i], made[i][:-1] + "x"), authors=[(who,)], year=2020, doi=doi))
    recs += [record(1000, "openalex", display_name="Zzzzzzzz", authorships=[("first", ("i", "Ann Lee"))]), record(1001, "generic", title="Zzzzzzzz", authors=[("Ann Lee",)])]
    df = spark.createDataFrame(recs, RECORDS)
    trained = spark.sparkContext.broadcast(({}, {}))
    placed = m.stage(m._raw(df).mapInArrow(m._place(trained), m.PLACED), "placed")
    want = {(2 * i, 2 * i + 1) for i in range(200)} | {(1000, 1001)}
    got = {tuple(r) for r in m.candidates(placed, trained)[0].collect()}
    assert want <= got and len(got) < 5_000  # of 20,201 pairs
    assert want <= {(r[0], r[1]) for r in match_records(df).select("rec_a", "rec_b").collect()}


def test_confidence_is_calibrated_on_held_out_pairs(spark):
    from rankloom.llm.matching import held_out

    rnd = random.Random(1)
    rows = [(i, i + 1, rnd.gauss(0.8 if i % 2 else 0.3, 0.1), True, i % 2) for i in range(400)]
    got = held_out(spark.createDataFrame(rows, "rec_a long, rec_b long, cosine double, same boolean, label int"))
    assert got["pairs"] > 100 and got["brier"] < 0.05 < got["brier_of_the_mean"]


def test_marks_and_letters_by_property():
    for mark, letters in (("\u1803", "ᠠᠡ"), ("\u1809", "ᠠᠡ"), ("\u07f9", "ߊߋ"), ("\u1c7e", "ᱚᱛ"), ("\uabeb", "ꯀꯁ"), ("\ua8ce", "ꢒꢓ"), ("\u1b5a", "ᬓᬔ")):
        parts = [letters * 3 + mark, letters[::-1] * 2 + mark]
        assert [" ".join(parts)[a:b] for a, b in split_text(" ".join(parts))] == parts


def test_long_quotation_is_one_sentence():
    for opening, closing in ("“”", "()", "«»", '""'):
        text = f"He wrote: {opening}{'It is so. ' * 1500}It ends.{closing} We agree."
        assert len(split_text(text)) == 2
    assert len(split_text("A ( b. C d. " * 1000)) == 2000  # nothing closes


def test_abbreviations_of_the_language_of_the_text():
    assert len(split_text("Wir sehen es bzw. Das ist die Regel und nicht falsch.")) == 1
    assert len(split_text("The name of it is bzw. That is the rule and not an error.")) == 2
    assert len(split_text("Xyz bzw. Abc.", "de_DE")) == 1 and len(split_text("Xyz bzw. Abc.", "en")) == 2


def test_wrapped_paragraph_of_any_usual_width():
    for width in (60, 72, 96):
        words, lines = ("Some words of a sentence that goes On and on " * 20).split(), [""]
        for w in words:
            if len(lines[-1]) + 1 + len(w) > width:
                lines.append(w)
            else:
                lines[-1] = (lines[-1] + " " + w).strip()
        assert len(split_text("\n".join(lines) + ".")) == 1


def test_every_record_counts_and_trains(spark):
    """Tokens, their counts and vectors come from all records, in whatever blocks; a sample of 5,000 lacked some."""
    import numpy as np

    import rankloom.llm.matching as m

    recs = [record(i, "generic", title=f"common w{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}y{chr(97 + i // 676)}z", authors=[("Ann Fokabar",)]) for i in range(5_300)]
    recs.append(record(9_000, "generic", title="solitary"))
    parsed = m.stage(m._raw(spark.createDataFrame(recs, RECORDS)).mapInArrow(m._parse, m.PARSED), "parsed")
    tokens = ["t:common", "a:fokabar", "t:solitary", "t:absent", *(f"t:w{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}y{chr(97 + i // 676)}z" for i in range(5_300))]
    vocabulary, n = m.learn(parsed, block=700)
    at, rows = vocabulary.look_up(np.array([m._hash(t) for t in tokens]))
    got = {tokens[i]: r for i, r in zip(at.tolist(), rows)}
    assert n == 5_301 and set(got) == {*tokens} - {"t:absent"}
    assert [int(got[t]["n"]) for t in tokens[:3]] == [5_300, 5_300, 1] and all(int(got[t]["n"]) == 1 for t in tokens[4:])
    sizes = {t: float(np.linalg.norm(r["v"].astype(float))) for t, r in got.items()}
    assert sizes.pop("t:solitary") == 0 and all(abs(s - 1) < 0.01 for s in sizes.values())  # alone in its record, no walk leaves it
    assert m.learn(parsed.limit(0)) and m.learn(parsed.limit(0))[1] == 0


def test_all_labelled_pairs_are_fitted(spark):
    from rankloom.llm.matching import _labelled, calibrate

    scored = spark.range(60_000).selectExpr("id as rec_a", "id + 1 as rec_b", "cast(id % 7 as double) / 7 as cosine", "true as same", "cast(id % 7 > 3 as int) as label")
    assert _labelled(scored)[:, 3].sum() == 60_000 and calibrate(scored)[0] > 0


def test_records_are_hashed_and_trained_in_arrays(monkeypatch):
    """Few Python calls a record, and a step of a walk is written once for both neighbours: 22 rows a walk and round, not 30."""
    import cProfile
    import pstats
    from types import SimpleNamespace

    import pyarrow as pa

    import rankloom.llm.matching as m

    rnd = random.Random(5)
    made = ["".join(rnd.choice("bcdfghklm") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 5))) for _ in range(500)]
    rows = [(i, i % 2, 0, " ".join(rnd.choices(made, k=9)), rnd.choice(["", "ii"]), False, " ".join(rnd.choices(made, k=i % 4)), 2020, rnd.choice(["", f"9/{i}"]), "") for i in range(2_000)]
    kinds = dict(c.split() for c in m.PARSED.split(", "))
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    batch = pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds.values())], [*kinds])
    run = m._hash_parts(SimpleNamespace(value=({}, 0)))
    (whole,) = run([batch])
    profile = cProfile.Profile()
    profile.runcall(lambda: list(run([batch])))
    assert pstats.Stats(profile).total_calls < 20 * len(rows)
    alone = [next(iter(run([batch.slice(i, 1)]))) for i in range(60)]
    assert [sorted(a.column(2)[0].as_py()) for a in alone] == [sorted(k.as_py()) for k in whole.column(2)[:60]]
    written, add = [], m._add
    monkeypatch.setattr(m, "_add", lambda to, at, *rest: (written.append(len(at)), add(to, at, *rest)))
    list(m._learn(60, 50_000)([batch.select(["words", "names"])]))
    assert sum(written) == 3 * 3 * len(rows) * 22
