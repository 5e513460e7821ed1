"""Placeholders: numbering per session or request, masking, and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_preserving_mask, partial_mask

PLACEHOLDER = r"\[[A-Z][A-Z0-9_]*_\d+(?:_BLOCKED)?\]"


def number_values(found: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """found: scope, order columns, original, category, blocked. One row per value of a scope: its first sighting fixes category and
    suffix, and values are numbered per category in the order of first sightings. Empty values and categories are left out."""
    pos = F.struct(*order)
    some = found.where((F.length("original") > 0) & (F.length("category") > 0))
    # min over structs combines on the map side, so a hot value is one row per task.
    first = some.groupBy(scope, "original").agg(F.min(F.struct(pos.alias("pos"), "category", "blocked")).alias("f"))
    first = first.select(scope, "original", "f.pos", "f.category", "f.blocked")
    numbered = first.withColumn("idx", F.row_number().over(Window.partitionBy(scope, "category").orderBy("pos", "original")))
    return numbered.select(scope, "original", "category", "blocked", "idx", F.concat("category", F.lit("_"), F.col("idx").cast("string"), F.when(F.col("blocked"), "_BLOCKED").otherwise("")).alias("token"))


def masked(style: Column, original: Column, token: Column) -> Column:
    """Unknown styles are tokenised."""
    return F.when(style == "partial", partial_mask(original)).when(style == "format_preserving", format_preserving_mask(original)).otherwise(F.concat(F.lit("["), token, F.lit("]")))


def redact(text: Column, dets: Column) -> Column:
    """dets: in order, without overlaps, with placeholder_token. What is allowed keeps its text."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, d: Column) -> Column:
        shown = F.when(d["action"] == "allow", d["original"]).otherwise(masked(d["mask_style"], d["original"], d["placeholder_token"]))
        return F.struct(d["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, d["start"] - s["at"]), shown).alias("out"))

    return F.aggregate(dets, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])))


_SEEN = "array<struct<k:int,first:int,category:string,blocked:boolean>>"
_NAMED = "array<struct<k:int,token:string>>"


def named(dets: Column) -> Column:
    """Detections with placeholder_token. A value's first sighting fixes category and suffix, and values are numbered per category in the order of
    first sightings. Two sorts and two passes, however many detections there are."""
    keyed = F.array_sort(F.transform(dets, lambda d, k: F.struct(d["original"].alias("original"), k.alias("k"), d["category"].alias("category"), (d["action"] == "block").alias("blocked"))))

    def sight(s: Column, x: Column) -> Column:
        old = s["original"].eqNullSafe(x["original"])
        first, category, blocked = (F.when(old, s[n]).otherwise(x[m]) for n, m in (("first", "k"), ("category", "category"), ("blocked", "blocked")))
        one = F.struct(x["k"].alias("k"), first.alias("first"), category.alias("category"), blocked.alias("blocked"))
        return F.struct(x["original"].alias("original"), first.alias("first"), category.alias("category"), blocked.alias("blocked"), F.concat(s["out"], F.array(one)).alias("out"))

    begin = F.struct(F.lit(None).cast("string").alias("original"), F.lit(0).alias("first"), F.lit("").alias("category"), F.lit(False).alias("blocked"), F.array().cast(_SEEN).alias("out"))
    seen = F.array_sort(F.transform(F.aggregate(keyed, begin, sight, lambda s: s["out"]), lambda x: F.struct(x["first"].alias("first"), x["k"].alias("k"), x["category"].alias("category"), x["blocked"].alias("blocked"))))

    def number(s: Column, x: Column) -> Column:
        again = s["first"] == x["first"]
        # At most as many entries as there are categories.
        n = F.coalesce(F.element_at(s["counts"], x["category"]), F.lit(0)) + 1
        counts = F.when(again, s["counts"]).otherwise(F.map_concat(F.map_filter(s["counts"], lambda c, _: c != x["category"]), F.create_map(x["category"], n)))
        token = F.when(again, s["token"]).otherwise(F.concat(x["category"], F.lit("_"), n.cast("string"), F.when(x["blocked"], "_BLOCKED").otherwise("")))
        return F.struct(x["first"].alias("first"), token.alias("token"), counts.alias("counts"), F.concat(s["out"], F.array(F.struct(x["k"].alias("k"), token.alias("token")))).alias("out"))

    begin = F.struct(F.lit(-1).alias("first"), F.lit("").alias("token"), F.create_map().cast("map<string,int>").alias("counts"), F.array().cast(_NAMED).alias("out"))
    tokens = F.array_sort(F.aggregate(seen, begin, number, lambda s: s["out"]))
    return F.zip_with(dets, tokens, lambda d, t: d.withField("placeholder_token", t["token"]))


def redact_documents(docs: DataFrame, dets: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One session per document: adds detections (with tokens), redacted_text and restoration_map. Numbering stays
    inside the row, so nothing is shuffled."""
    rows = docs.withColumn("detections", dets)
    rows = rows.withColumn("detections", named(F.col("detections")))
    pairs = F.array_distinct(F.transform("detections", lambda d: F.struct(d["placeholder_token"].alias("key"), d["original"].alias("value"))))
    return rows.withColumn("redacted_text", redact(F.col(text_col), F.col("detections"))).withColumn("restoration_map", F.map_from_entries(pairs))


def rehydrate(text: Column, restoration: Column) -> Column:
    """Placeholders to originals, longer tokens first."""
    entries = F.array_sort(F.transform(F.map_entries(restoration), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.aggregate(entries, text, lambda t, e: F.replace(t, F.concat(F.lit("["), e["key"], F.lit("]")), e["value"]))


def rehydrated_count(text: Column, restoration: Column) -> Column:
    """Distinct tokens present, not occurrences."""
    return F.size(F.filter(F.map_keys(restoration), lambda k: F.contains(text, F.concat(F.lit("["), k, F.lit("]")))))


def mask_payload_numbers(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spans numbered per document and category by position, repeats included."""
    return spans.where("end > start").withColumn("idx", F.row_number().over(Window.partitionBy(doc, "category").orderBy("start", "end", "original")))


def decoded(values: DataFrame, numbered: DataFrame, scope: str) -> DataFrame:
    """values: scope, token, with or without brackets. Adds original; null for a token that the scope doesn't know."""
    bare = values.withColumn("bare", F.regexp_replace("token", r"^\[(.*)\]\z", "$1"))
    known = numbered.select(scope, F.col("token").alias("bare"), "original")
    return bare.join(known, [scope, "bare"], "left").drop("bare")


def restoration_maps(numbered: DataFrame, scope: str) -> DataFrame:
    """(scope, restoration_map, counters): the map of a session, or of a request's vault, and the largest number of each category."""
    per = numbered.groupBy(scope, "category").agg(F.max("idx").alias("n"), F.collect_list(F.struct(F.col("token").alias("key"), F.col("original").alias("value"))).alias("pairs"))
    return per.groupBy(scope).agg(F.map_from_entries(F.array_sort(F.flatten(F.collect_list("pairs")))).alias("restoration_map"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("category").alias("key"), F.col("n").alias("value"))))).alias("counters"))


def mask_payload(text: Column, spans: Column) -> Column:
    """struct(masked, entries): spans, an array of struct<category, start, end>, replaced in the order of their starts by [CATEGORY_n], numbered per
    category, repeats included. Empty spans, and those that begin before the end of the last one replaced, stay as text. entries: of each placeholder the original."""
    ordered = F.array_sort(F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s, k: F.struct(s["start"].alias("start"), k.alias("k"), s["end"].alias("end"), s["category"].alias("category"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.create_map().cast("map<string,int>").alias("counts"), F.array().cast("array<struct<token:string,original:string>>").alias("entries"))

    def step(s: Column, x: Column) -> Column:
        n = F.coalesce(F.element_at(s["counts"], x["category"]), F.lit(0)) + 1
        token = F.concat(x["category"], F.lit("_"), n.cast("string"))
        one = F.struct(token.alias("token"), F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("original"))
        done = F.struct(
            x["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), token, F.lit("]")).alias("out"),
            F.map_concat(F.map_filter(s["counts"], lambda c, _: c != x["category"]), F.create_map(x["category"], n)).alias("counts"), F.concat(s["entries"], F.array(one)).alias("entries"),
        )
        return F.when(x["start"] >= s["at"], done).otherwise(s)

    return F.aggregate(ordered, begin, step, lambda s: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])).alias("masked"), s["entries"].alias("entries")))


def mask_with_vault(docs: DataFrame, dets: Column, *, text_col: str = "text") -> DataFrame:
    """Each row is a request with a vault of its own: adds masked (by each detection's style; unknown styles are tokenised), and the vault, a map of
    placeholders to originals, which gets an entry for every value, also where the style shows no placeholder."""
    rows = docs.withColumn("detections", named(dets))
    pairs = F.array_distinct(F.transform("detections", lambda d: F.struct(d["placeholder_token"].alias("key"), d["original"].alias("value"))))
    return rows.withColumn("masked", redact(F.col(text_col), F.col("detections"))).withColumn("vault", F.map_from_entries(pairs)).drop("detections")
