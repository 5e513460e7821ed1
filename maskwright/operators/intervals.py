"""Interval join: which spans of two tables overlap within a key, as equi-joins on bins of offsets.

A grid has levels of bins, each FACTOR times as wide as those below. A span belongs to the lowest level whose bins are as wide as it, so it touches at most
two of them there, and at most two of each level above. Two spans that overlap meet in a bin of the higher one's level, so each span is sent to the bins of its
own level and of those higher levels that the other table has. They are paired in the bin where their overlap begins, and in no other: no pair comes twice
and nothing is made distinct. What a bin pairs are the spans of its own level with those that touch it; never two that are both smaller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the lowest bins in characters, the ratio of levels, and their number: the widest bins hold any offset.
WIDTH, FACTOR, LEVELS = 64, 8, 10


def _level(size: Column) -> Column:
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(size <= WIDTH * FACTOR**k, k).otherwise(out)
    return out


def _width(level: Column) -> Column:
    return F.get(F.array(*(F.lit(WIDTH * FACTOR**k).cast("long") for k in range(LEVELS))), level)


def _binned(rows: DataFrame, start: str, end: str) -> DataFrame:
    """With __start and __end, without empty spans, and the level of each."""
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    return rows.withColumn("__start", s).withColumn("__end", e).where("__end > __start").withColumn("__own", _level(F.col("__end") - F.col("__start")))


def _spread(rows: DataFrame, levels: Sequence[int]) -> DataFrame:
    """A row for each bin that a span touches in the levels, from its own on."""
    out = rows.withColumn("__level", F.explode(F.filter(F.array(*(F.lit(k) for k in levels)), lambda k: k >= F.col("__own"))))
    width = _width(F.col("__level"))
    return out.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__start") / width), F.floor((F.col("__end") - 1) / width))))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *, left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end"), how: str = "overlaps") -> DataFrame:
    """Pairs (l, r), structs of the rows of both tables, with equal keys and spans [start, end) that overlap or, by how, where l contains r ("contains") or r
    contains l ("inside"). Empty spans and those without a start, an end or a key pair with nothing. Keys have the same names in both tables.

    A key that holds very many rows is no hot key: its rows are dealt by bin, too.
    """
    if how not in ("overlaps", "contains", "inside"):
        raise ValueError(f"how: overlaps, contains or inside, not {how!r}")
    a, b = _binned(left, *left_span), _binned(right, *right_span)
    # At most LEVELS numbers each.
    held = [sorted(r["__own"] for r in side.select("__own").distinct().collect()) for side in (a, b)]
    packed = lambda side, names, tag: side.select(*(F.col(f"`{k}`").alias(f"__key{n}") for n, k in enumerate(keys)), F.struct(*(F.col(f"`{c}`") for c in names)).alias(tag), F.col("__start").alias(f"__start_{tag}"), F.col("__end").alias(f"__end_{tag}"), "__own", "__level", "__bin")
    ls, rs = packed(_spread(a, sorted({*held[0], *held[1]})), left.columns, "l"), packed(_spread(b, sorted({*held[0], *held[1]})), right.columns, "r")
    on = [f"__key{n}" for n in range(len(keys))] + ["__level", "__bin"]
    own, higher = F.col("__own") == F.col("__level"), F.col("__own") < F.col("__level")
    pairs = ls.where(own).drop("__own").join(rs.drop("__own"), on).unionByName(ls.where(higher).drop("__own").join(rs.where(own).drop("__own"), on))
    begin, stop = F.greatest("__start_l", "__start_r"), F.least("__end_l", "__end_r")
    found = pairs.where((begin < stop) & (F.floor(begin / _width(F.col("__level"))) == F.col("__bin")))
    if how == "contains":
        found = found.where("__start_l <= __start_r and __end_r <= __end_l")
    elif how == "inside":
        found = found.where("__start_r <= __start_l and __end_l <= __end_r")
    return found.select("l", "r")
