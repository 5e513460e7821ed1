"""Positions of all matches of a pattern, without a UDF.

Matches and the gaps between them interleave, so running sums of their lengths are the offsets. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import Rule

SPAN = "struct<start:int,end:int,value:string>"


MATCH = "array<struct<gap:string,whole:string,prefix:string,value:string>>"


def matches(text: Column, rule: Rule) -> Column:
    """The rule's matches with the gaps before them. Most texts have none: the pattern is tried once, and only if its literal is there."""
    p = F.lit(rule.pattern)
    whole, prefix, value = (F.regexp_extract_all(text, p, F.lit(k)) for k in range(3))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    gate = text.rlike(rule.pattern)
    if rule.hint:
        gate = (F.lower(text) if rule.ignore_case else text).contains(rule.hint) & gate
    return F.when(gate, F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), prefix.alias("prefix"), value.alias("value"))).otherwise(F.array().cast(MATCH))


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_sql(rule: Rule, text: str = "t") -> tuple[str, str]:
    """matches(), as SQL over a name, apart: whether there are any, and they. One call into the JVM builds the expressions of many rules."""
    p = literal(rule.pattern)
    whole, prefix, value = (f"regexp_extract_all({text}, {p}, {k})" for k in range(3))
    gate = f"{text} RLIKE {p}"
    if rule.hint:
        gate = f"contains({f'lower({text})' if rule.ignore_case else text}, {literal(rule.hint)}) AND {gate}"
    return gate, f"CAST(arrays_zip(slice(split({text}, {p}, -1), 1, size({whole})), {whole}, {prefix}, {value}) AS {MATCH})"


def offsets(rows: Column) -> Column:
    """Matches to array<struct<start, end, value>>."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        here = state["at"] + F.length(row["gap"])
        start = here + F.length(row["prefix"])
        one = F.struct(start.alias("start"), (start + F.length(row["value"])).alias("end"), row["value"].alias("value"))
        return F.struct((here + F.length(row["whole"])).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    return F.aggregate(rows, begin, step, lambda s: s["out"])


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, value>> of the rule's values, in order. Null for a null text."""
    return offsets(matches(text, rule))
