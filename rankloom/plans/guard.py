"""Hard conditions of a question, as a table of rules: what asks for each, and what a paper must have or must not have."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom import lexicon as L
from rankloom.functions.text import ascii_words, plural_forms
from rankloom.plans.inputs import norm

Test = tuple  # ("any", phrases), ("word", words), ("and", tests...) or ("or", tests...)


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    label: str
    asked: Test
    groups: tuple[tuple[str, ...], ...] = ()
    refused: tuple[str, ...] = ()
    high: bool = False


def has_any_of(*phrases: str) -> Test:
    return ("any", phrases)


def has_word(words: str) -> Test:
    return ("word", tuple(words.split()))


def both(*tests: Test) -> Test:
    return ("and", *tests)


def either(*tests: Test) -> Test:
    return ("or", *tests)


def _plain(phrase: str) -> str:
    return "".join(c if c.isalnum() else " " for c in phrase.lower())


def _forms(test: Test) -> list[str]:
    """What the padded words may contain for a test on phrases or words to hold."""
    kind, terms = test
    if kind == "any":
        return [f for t in terms for f in plural_forms(" ".join(_plain(t).split()))]
    out = []
    for w in terms:
        out += [w] + ([w[:-1] + "ies"] if w.endswith("y") else []) + ([w + "s"] if not w.endswith("s") else [])
    return out


def pattern(test: Test) -> str:
    return " (?:" + "|".join(dict.fromkeys(_forms(test))) + ") "


def holds(test: Test, padded: Column) -> Column:
    """Whether normalised words, with a space at either end, pass the test."""
    if test[0] in ("any", "word"):
        return padded.rlike(pattern(test))
    parts = [holds(t, padded) for t in test[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if test[0] == "and" else out | p
    return out


def holds_sql(test: Test, padded: str) -> str:
    if test[0] in ("any", "word"):
        return f"regexp_matches({padded}, '{pattern(test)}')"
    return "(" + (" AND " if test[0] == "and" else " OR ").join(holds_sql(t, padded) for t in test[1:]) + ")"


_LLM = has_any_of("large language model", "large language models")
_RANK, _SEARCH = has_word("rank ranking rerank reranking"), either(has_any_of("search result", "search results"), has_word("search retrieval results result"))
_SMALL = either(has_any_of("smaller dataset", "smaller datasets", "small dataset", "small datasets", "less data", "limited data"), both(has_word("small smaller less limited"), has_word("dataset data")))
_BIG = either(has_any_of("bigger dataset", "bigger datasets", "larger dataset", "larger datasets", "more data"), both(has_word("big bigger large larger more"), has_word("dataset data")))
_VIDEO_GENERATION = ("video generation", "video generations", "generate videos", "generating videos", "generate video", "generating video", "text to video", "text-to-video")
# Methods whose lack weighs more.
_HIGH = ("RLHF", "reward_shaping", "autoregressive_transformer", "llm_agent", "ranking_with_llm")


def _method_test(name: str, groups: list[list[str]]) -> Test:
    if name == "ranking_with_llm":
        return either(both(_RANK, _SEARCH, has_word("llm llms")), both(_RANK, _LLM, _SEARCH))
    test = both(*(has_any_of(*g) for g in groups)) if len(groups) > 1 else has_any_of(*groups[0])
    if name == "llm_agent":
        named = has_any_of("large language model agent", "large language model agents", "llm agent", "llm agents")
        return either(test, named, both(either(_LLM, has_word("llm llms")), has_word("agent agents")))
    return test


def _rules() -> list[Rule]:
    out = [Rule("exclude_survey_or_review", "exclusion", "排除综述/调研类论文", has_any_of(*L.SURVEY_REFUSALS), refused=tuple(L.SURVEY_TERMS), high=True)]
    for name, also in L.DATASETS.items():
        out.append(Rule(f"dataset_{'_'.join(_plain(name).split())}", "dataset", f"要求数据集：{name}", has_any_of(*also), (tuple(also),), high=True))
    for name, groups in L.METHODS.items():
        out.append(Rule(f"method_{name}", "method", f"要求方法/机制：{name}", _method_test(name, groups), tuple(map(tuple, groups)), high=name in _HIGH))
    out += [
        Rule("modality_visual_audio", "modality", "要求同时支持视觉与音频输入",
             either(has_any_of("visual and audio", "visual audio", "audio visual", "audio and visual"), both(has_word("visual vision image video"), has_word("audio sound"))),
             (("visual", "vision", "image", "video"), ("audio", "sound", "acoustic")), high=True),
        Rule("task_image_video_description", "task", "要求图像与视频描述/字幕任务",
             either(has_any_of("image and video description", "image video description", "image and video caption", "image video caption"),
                    both(has_word("image images visual"), has_word("video videos"), has_word("description descriptions caption captions captioning"))),
             (("image", "images", "visual"), ("video", "videos"), ("description", "descriptions", "caption", "captions", "captioning")), high=True),
        Rule("task_long_video", "task", "要求长视频场景", has_any_of("long video", "long videos", "long form video", "long form videos"), (("long video", "long videos", "long form video", "long form videos"),)),
        Rule("task_video_generation", "task", "要求视频生成任务", either(has_any_of(*_VIDEO_GENERATION), both(has_word("generate generating generation"), has_word("video videos"))),
             (("video generation", "video generations", "generate video", "generate videos", "generating video", "generating videos", "text to video", "text-to-video"),)),
        Rule("task_hallucination", "task", "要求幻觉问题相关", has_any_of("hallucination", "hallucinations"), (("hallucination", "hallucinations", "hallucinate"),)),
        Rule("model_foundation_model", "model", "要求基础模型/多模态基础模型", has_any_of("foundation model", "foundation models"), (("foundation model", "foundation models"),)),
        Rule("relation_smaller_dataset_better", "relation", "要求小数据集优于大数据集的比较关系",
             both(_SMALL, _BIG, has_word("better outperform outperforms improve improved superior")),
             (("smaller dataset", "smaller datasets", "small dataset", "small datasets", "less data", "limited data", "deduplicating", "deduplication"),
              ("bigger dataset", "bigger datasets", "larger dataset", "larger datasets", "more data", "scaling"),
              ("better", "better model", "better models", "outperform", "improve", "improved", "makes language models better")), high=True),
    ]
    return out


RULES = _rules()


#: Any other entity: a sign or a letter that isn't ASCII, which is no part of a word here.
ENTITY = "&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"


def text_of(c: Column) -> Column:
    """Words without entities and tags."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return ascii_words(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), ENTITY, " "))


def text_sql(c: str) -> str:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{sign}')"
    return norm(f"regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '{ENTITY}', ' ', 'g')")


def padded(words: Column) -> Column:
    return F.concat(F.lit(" "), words, F.lit(" "))


def asked_rules(question: Column) -> Column:
    """Places in ``RULES`` of what the question asks for."""
    q = padded(text_of(question))
    return F.array_compact(F.array(*[F.when(holds(r.asked, q), F.lit(i)) for i, r in enumerate(RULES)]))


VERDICT = "struct<id:string,label:string,kind:string,weight:double,ok:boolean,missing:array<string>,hits:array<string>>"


def verdicts(asked: Column, title: Column, full: Column) -> Column:
    """For each asked rule whether the paper's padded words satisfy it: array of ``VERDICT``."""

    def one(i: int, r: Rule) -> Column:
        if r.kind == "exclusion":
            bad = holds(has_any_of(*r.refused), title) | holds(has_any_of(*r.refused), full)
            ok, missing, hits = ~bad, F.array().cast("array<string>"), F.array().cast("array<string>")
        else:
            got = [(holds(has_any_of(*g), full), "/".join(g[:3])) for g in r.groups]
            missing = F.array_compact(F.array(*[F.when(~h, F.lit(n)) for h, n in got]))
            hits = F.array_compact(F.array(*[F.when(h, F.lit(n)) for h, n in got]))
            ok = F.size(missing) == 0
        cell = F.struct(F.lit(r.id).alias("id"), F.lit(r.label).alias("label"), F.lit(r.kind).alias("kind"), F.lit(1.5 if r.high else 1.0).alias("weight"), ok.alias("ok"), missing.alias("missing"), hits.alias("hits"))
        return F.when(F.array_contains(asked, i), cell)

    return F.array_compact(F.array(*[one(i, r) for i, r in enumerate(RULES)]))


def asked_sql(question: str) -> str:
    q = f"(' ' || {text_sql(question)} || ' ')"
    return "list_filter([" + ", ".join(f"CASE WHEN {holds_sql(r.asked, q)} THEN {i} END" for i, r in enumerate(RULES)) + "], lambda x: x IS NOT NULL)"


def verdicts_sql(asked: str, title: str, full: str) -> str:
    def one(i: int, r: Rule) -> str:
        if r.kind == "exclusion":
            t = has_any_of(*r.refused)
            ok, missing, hits = f"NOT ({holds_sql(t, title)} OR {holds_sql(t, full)})", "[]::VARCHAR[]", "[]::VARCHAR[]"
        else:
            got = [(holds_sql(has_any_of(*g), full), "/".join(g[:3])) for g in r.groups]
            missing = "list_filter([" + ", ".join(f"CASE WHEN NOT {h} THEN '{n}' END" for h, n in got) + "], lambda x: x IS NOT NULL)"
            hits = "list_filter([" + ", ".join(f"CASE WHEN {h} THEN '{n}' END" for h, n in got) + "], lambda x: x IS NOT NULL)"
            ok = " AND ".join(h for h, _ in got)
        return f"CASE WHEN list_contains({asked}, {i}) THEN {{'id': '{r.id}', 'label': '{r.label}', 'kind': '{r.kind}', 'weight': {1.5 if r.high else 1.0}::DOUBLE, 'ok': {ok}, 'missing': {missing}, 'hits': {hits}}} END"

    return "list_filter([" + ", ".join(one(i, r) for i, r in enumerate(RULES)) + "], lambda x: x IS NOT NULL)"
