"""Detection: rules to spans, overlaps to a decision, context rules, merges with a recogniser's entities."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Sequence
from itertools import groupby
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import ACCOUNT_WORDS, BANKS, BUSINESS_WORDS, CATEGORY, NEED, NEEDS, PASSWORD_WORDS, PRIORITY, RULES, Rule
from ..functions.spans import literal, matches_sql, offsets, spans
from ..functions.text import CHECKS, account_length_ok, biz_valid, ner_false_positive, strip_particle

DETECTION = (
    "struct<category:string,category_class:string,action:string,mask_style:string,start:int,end:int,original:string,"
    "detection_stage:string,rule_id:string,confidence:double,placeholder_token:string>"
)
EMPTY = f"array<{DETECTION}>"


def _detection(span: Column, category: str, rule_id: Column, confidence: float, stage: str) -> Column:
    c = CATEGORY[category]
    return F.struct(
        F.lit(category).alias("category"), F.lit(c.kind).alias("category_class"), F.lit(c.action).alias("action"), F.lit("tokenize").alias("mask_style"),
        span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("original"), F.lit(stage).alias("detection_stage"),
        rule_id.alias("rule_id"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("placeholder_token"),
    )


def active_rules(categories: Sequence[str] | None = None, min_confidence: float | None = None) -> list[Rule]:
    """Rules at or above their category's floor, or the one given, which replaces it."""
    return [r for r in RULES if (categories is None or r.category in categories) and r.confidence >= (CATEGORY[r.category].floor if min_confidence is None else min_confidence)]


def _bound(f: Callable, *values) -> Callable[[Column], Column]:
    """A one-argument function, as Spark's lambdas must be; binds loop variables now."""
    return lambda x: f(x, *values)


_FOUND = "array<struct<rule:int,rows:array<struct<gap:string,whole:string,prefix:string,value:string>>>>"


def candidates(text: Column, rules: Sequence[Rule], allow: Sequence[str] = (), checks: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """All detections, before overlaps are resolved, in the order of the rules. Only the patterns are apart; offsets, checks and the detections' other values are
    computed in one place for all rules, so the plan stays small."""
    checks = CHECKS | (checks or {})
    if not rules:
        return F.array().cast(EMPTY)
    numbered = list(enumerate(rules))
    parts = []
    for need, group in groupby(numbered, key=lambda x: NEED.get(x[1].rule_id)):
        # Most rules find nothing in a text, and then make nothing.
        tried = [f"CASE WHEN {gate} THEN array(named_struct('rule', {k}, 'rows', {rows})) ELSE CAST(array() AS {_FOUND}) END" for k, (gate, rows) in ((k, matches_sql(r)) for k, r in group)]
        some = f"concat({', '.join(tried)})"
        parts.append(f"CASE WHEN t RLIKE {literal(NEEDS[need][0])} THEN {some} ELSE CAST(array() AS {_FOUND}) END" if need else some)
    every = F.get(F.call_function("transform", F.array(text), F.expr(f"t -> concat({', '.join(parts)})")), F.lit(0))
    found = F.flatten(F.transform(every, lambda x: F.transform(offsets(x["rows"]), lambda s: F.struct(x["rule"].alias("rule"), s.alias("s")))))

    def good(x: Column) -> Column:
        value = x["s"]["value"]
        ok = F.length(value) > 0
        for pattern in allow:
            ok = ok & ~value.rlike(pattern)
        checked: dict[str, list[int]] = {}
        for k, r in numbered:
            if r.check:
                checked.setdefault(r.check, []).append(k)
        for name, ks in checked.items():
            ok = ok & (~x["rule"].isin(ks) | checks[name](value))
        return ok

    info = F.array(*(F.struct(F.lit(r.category).alias("category"), F.lit(CATEGORY[r.category].kind).alias("kind"), F.lit(CATEGORY[r.category].action).alias("action"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.confidence).alias("confidence")) for r in rules))

    def detection(x: Column) -> Column:
        r, s = F.get(info, x["rule"]), x["s"]
        return F.struct(
            r["category"].alias("category"), r["kind"].alias("category_class"), r["action"].alias("action"), F.lit("tokenize").alias("mask_style"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("original"),
            F.lit("stage1_regex_checksum").alias("detection_stage"), r["rule_id"].alias("rule_id"), r["confidence"].alias("confidence"), F.lit(None).cast("string").alias("placeholder_token"),
        )

    return F.transform(F.filter(found, good), detection)


def _kept(ordered: Column, get: Callable[[Column], Column]) -> Column:
    """Of spans in order, each that starts at or after the end of the last one kept."""
    begin = F.struct(F.lit(0).alias("end"), F.array().cast(EMPTY).alias("out"))

    def step(state: Column, item: Column) -> Column:
        d = get(item)
        return F.when(d["start"] >= state["end"], F.struct(d["end"].alias("end"), F.concat(state["out"], F.array(d)).alias("out"))).otherwise(state)

    return F.aggregate(ordered, begin, step, lambda s: s["out"])


def _ordered(dets: Column, key: Callable[[Column], list[Column]]) -> Column:
    keyed = F.transform(dets, lambda d, k: F.struct(*(c.alias(f"k{n}") for n, c in enumerate(key(d))), k.alias("seq"), d.alias("d")))
    return F.array_sort(keyed)


def resolve(dets: Column) -> Column:
    """Overlaps: the earlier start wins, then the category's priority, then the longer span, then the earlier rule."""
    rank = F.create_map(*(x for name, k in PRIORITY.items() for x in (F.lit(name), F.lit(k))))
    order = _ordered(dets, lambda d: [d["start"], F.coalesce(F.element_at(rank, d["category"]), F.lit(len(PRIORITY))), d["start"] - d["end"]])
    return _kept(order, lambda x: x["d"])


def merge_entities(stage1: Column, stage2: Column) -> Column:
    """Rule and recogniser detections: the earlier start, then the longer span, then the rule."""
    return _kept(_ordered(F.concat(stage1, stage2), lambda d: [d["start"], d["start"] - d["end"]]), lambda x: x["d"])


def proximity(text: Column, window: int = 25, account: Sequence[str] | None = None, business: Sequence[str] | None = None, passwords: Sequence[str] | None = None) -> Column:
    """Values that only the words around them mark: accounts, bare business numbers, labelled passwords."""
    labels = "|".join(re.escape(w) for w in passwords or PASSWORD_WORDS)
    plans = [
        (Rule("KR_ACCOUNT", "prox_kr_acct_generic", 0.70, r"(?<!\d)\d{2,6}(?:-\d{1,7}){2,3}(?!\d)", hint="-"), list(account or BANKS + ACCOUNT_WORDS), window, account_length_ok),
        (Rule("BIZ_NO", "prox_biz_bare10", 0.85, r"(?<!\d)\d{10}(?!\d)"), list(business or BUSINESS_WORDS), min(window, 20), biz_valid),
        (Rule("PASSWORD", "prox_password_kr", 0.85, r"""[^\s,，.。!?'"]{4,40}""", rf"(?:{labels})\s*[:=]?\s*"), [], 0, None),
    ]
    out = []
    for rule, words, reach, check in plans:
        found = spans(text, rule)
        if check:
            found = F.filter(found, _bound(lambda s, c: c(s["value"]), check))

        def named(s: Column, words=words, reach=reach, rule=rule) -> Column:
            if not words:
                return F.lit(rule.rule_id)
            around = F.substring(text, F.greatest(s["start"] - reach, F.lit(0)) + 1, s["end"] + reach - F.greatest(s["start"] - reach, F.lit(0)))
            first = F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(around, w))
            return F.concat(F.lit(rule.rule_id + "+"), F.get(first, F.lit(0)))

        dets = F.transform(found, _bound(lambda s, r, n: _detection(s, r.category, n(s), r.confidence, "stage1_proximity"), rule, named))
        dets = F.filter(dets, lambda d: d["rule_id"].isNotNull())
        # Most texts hold none of the words: a cheap test comes before the pattern.
        gate = F.lit(False)
        for w in words or list(passwords or PASSWORD_WORDS):
            if not re.search("[가-힣]", w):
                gate = gate | text.contains(w)
        gate = gate | text.rlike("[가-힣]")
        out.append(F.when(gate, dets).otherwise(F.array().cast(EMPTY)))
    return F.concat(*out)


def merge_proximity(base: Column, extra: Column) -> Column:
    """Each extra in turn: dropped if a kept span contains it or overlaps it in part; else it replaces what it contains."""

    def step(kept: Column, x: Column) -> Column:
        def over(b: Column) -> Column:
            return (b["start"] < x["end"]) & (b["end"] > x["start"])

        def inside(b: Column) -> Column:
            return (x["start"] <= b["start"]) & (b["end"] <= x["end"]) & ~((x["start"] == b["start"]) & (x["end"] == b["end"]))

        blocked = F.exists(kept, lambda b: over(b) & ~inside(b))
        return F.when(blocked, kept).otherwise(F.concat(F.filter(kept, lambda b: ~over(b)), F.array(x)))

    merged = F.aggregate(extra, base, step)
    return F.transform(_ordered(merged, lambda d: [d["start"]]), lambda x: x["d"])


#: Expressions over plain names, by session; the oldest go beyond BUILT_MOST.
_BUILT: WeakKeyDictionary[SparkContext, OrderedDict[tuple, Column]] = WeakKeyDictionary()
BUILT_MOST = 32


def _plain_name(text: Column) -> str | None:
    """The name of a column that is nothing but a name, which any table resolves for itself. A column of a table (table["x"]) has that table's identity, and
    any other expression may."""
    try:
        node = text._jc.node()
        return node.nameParts().mkString("`.`") if node.getClass().getSimpleName() == "UnresolvedAttribute" and node.planId().isEmpty() else None
    except Exception:  # noqa: BLE001 - other kinds of columns than these are built each time
        return None


def detect(text: Column, *, categories: Sequence[str] | None = None, allow: Sequence[str] = (), min_confidence: float | None = None, with_proximity: bool = True, context: dict | None = None, checks: dict | None = None) -> Column:
    """The detections of a text, in order, without overlaps. A null or empty text has none. context: window and word lists of the context rules, for proximity()."""
    # Building it takes thousands of calls into the JVM.
    name, session = None if checks else _plain_name(text), SparkContext._active_spark_context
    built = _BUILT.setdefault(session, OrderedDict()) if name is not None and session is not None else None
    key = (name, tuple(categories) if categories is not None else None, tuple(allow), min_confidence, with_proximity, repr(sorted((context or {}).items())))
    if built is not None and key in built:
        return built[key]
    text = F.coalesce(text, F.lit(""))
    found = resolve(candidates(text, active_rules(categories, min_confidence), allow, checks))
    out = merge_proximity(found, proximity(text, **(context or {}))) if with_proximity else found
    if built is not None:
        built[key] = out
        while len(built) > BUILT_MOST:
            built.popitem(last=False)
    return out


def entities_to_detections(entities: Column, labels: dict[str, str], min_score: float = 0.50) -> Column:
    """A recogniser's array<struct<start, end, label, score, text>> as detections: labels that aren't known, scores below the least, and what
    looks like code or an acronym go; Korean particles at the end go too, with the offsets."""
    names = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    known = F.filter(entities, lambda e: (e["score"] >= min_score) & F.element_at(names, e["label"]).isNotNull())

    def detection(e: Column, category: str) -> Column:
        value = strip_particle(e["text"])
        span = F.struct(e["start"].alias("start"), (e["start"] + F.length(value)).alias("end"), value.alias("value"))
        return _detection(span, category, F.concat(F.lit("ner_"), e["label"]), 0.0, "stage2_ner").withField("confidence", e["score"].cast("double"))

    every = []
    for category in dict.fromkeys(labels.values()):
        own = F.filter(known, _bound(lambda e, c: F.element_at(names, e["label"]) == c, category))
        good = F.filter(own, _bound(lambda e, c: ~ner_false_positive(F.lit(c), strip_particle(e["text"])), category))
        every.append(F.transform(good, _bound(detection, category)))
    return _by_start(F.concat(*every))


def _by_start(dets: Column) -> Column:
    return F.transform(_ordered(dets, lambda d: [d["start"], d["end"]]), lambda x: x["d"])


def dictionary_entities(text: Column, words: dict[str, str], score: float = 0.9) -> Column:
    """A deterministic recogniser, in place of a model: every occurrence of a listed word, as array<struct<start, end, label, score, text>>."""
    out = []
    for label in dict.fromkeys(words.values()):
        own = sorted((w for w, x in words.items() if x == label), key=lambda w: (-len(w), w))
        found = spans(text, Rule("", label, score, "|".join(re.escape(w) for w in own)))
        out.append(F.transform(found, _bound(lambda s, x: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(x).alias("label"), F.lit(score).alias("score"), s["value"].alias("text")), label)))
    return F.concat(*out)


def scan(text: Column, entities: Column | None = None, labels: dict[str, str] | None = None, gap_reason: Column | None = None, **options) -> Column:
    """struct(detections, coverage_gap, stage2_gap_reason): rules, context rules and a recogniser's entities. Without an answer of the recogniser (null)
    the rules alone count, and the gap says why."""
    rules = detect(text, **options)
    if entities is None:
        return F.struct(rules.alias("detections"), F.lit(False).alias("coverage_gap"), F.lit(None).cast("string").alias("stage2_gap_reason"))
    gap = entities.isNull()
    both = F.when(gap, rules).otherwise(merge_entities(rules, entities_to_detections(entities, labels or {})))
    reason = F.coalesce(gap_reason if gap_reason is not None else F.lit(None).cast("string"), F.lit("recogniser gave no answer"))
    return F.struct(both.alias("detections"), gap.alias("coverage_gap"), F.when(gap, reason).alias("stage2_gap_reason"))


def summary(dets: Column) -> Column:
    """struct(total, by_category, by_action, has_blocks, has_masks)."""

    def of(d: Column) -> Column:
        def counts(name: str) -> Column:
            values = F.array_sort(F.array_distinct(F.transform(d, lambda x: x[name])))
            return F.map_from_entries(F.transform(values, lambda v: F.struct(v.alias("key"), F.size(F.filter(d, lambda x: x[name] == v)).alias("value"))))

        return F.struct(
            F.size(d).alias("total"), counts("category").alias("by_category"), counts("action").alias("by_action"),
            F.exists(d, lambda x: x["action"] == "block").alias("has_blocks"), F.exists(d, lambda x: x["action"].isin("mask", "tokenize_roundtrip")).alias("has_masks"),
        )

    # A lambda's argument, so what finds the detections is in the plan once, and runs once a text.
    return F.get(F.transform(F.array(dets), of), F.lit(0))
