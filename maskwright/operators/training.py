"""Labelled spans to training rows: validation, tokens, splits without leakage; entities of a recogniser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import Rule
from ..functions.spans import spans
from ..functions.text import fingerprint

LABELS = ["PERSON", "ADDRESS", "ORGANIZATION"]
_TOKEN = Rule("", "token", 1.0, r"\w+|[^\w\s]")


def tokenize_offsets(text: Column) -> Column:
    """array<struct<start, end, value>>: runs of word characters, and single other characters."""
    return spans(text, _TOKEN)


def char_to_token(tokens: Column, start: Column, end: Column) -> Column:
    """struct(first, last) of the tokens that overlap [start, end); null if none does."""
    hits = F.filter(F.transform(tokens, lambda t, k: F.struct(k.alias("k"), t.alias("t"))), lambda x: (x["t"]["start"] < end) & (x["t"]["end"] > start))
    return F.when(F.size(hits) > 0, F.struct(F.get(hits, F.lit(0))["k"].alias("first"), F.element_at(hits, -1)["k"].alias("last")))


def invalid_spans(text: Column, labelled: Column) -> Column:
    """Of array<struct<start, end, label>>, those out of range or with an unknown label."""
    return F.filter(labelled, lambda s: ~((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & s["label"].isin(*LABELS)))


def without_leaks(train: DataFrame, held_out: DataFrame, text_col: str = "text") -> DataFrame:
    known = held_out.select(fingerprint(F.col(text_col)).alias("print")).distinct()
    return train.withColumn("print", fingerprint(F.col(text_col))).join(known, "print", "left_anti").drop("print")


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """(id, k, start, end, value): tokenize_offsets(), or all matches of a pattern, as rows, for long texts. Offsets are running sums over a document's tokens."""
    p = pattern or _TOKEN.pattern
    own = docs.select(F.col(id_col), F.regexp_extract_all(text_col, F.lit(p), F.lit(0)).alias("words"), F.split(text_col, p, -1).alias("gaps"))
    each = own.where(F.size("words") > 0).select(id_col, F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("words")).alias("gap"), F.col("words").alias("word"))).alias("k", "x"))
    w = Window.partitionBy(id_col).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Lengths come before the sort, so that words are in it only if they are asked for.
    sized = each.select(id_col, "k", (F.length("x.gap") + F.length("x.word")).alias("__step"), F.length("x.word").alias("__size"), F.col("x.word").alias("value"))
    end = F.sum("__step").over(w).cast("int")
    return sized.select(id_col, "k", (end - F.col("__size")).alias("start"), end.alias("end"), "value")


def split(rows: DataFrame, id_col: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split: of n rows in the order of a seeded hash of the id, the first int(n * train) are train, the next int(n * val) val, the rest test. Rows are
    ranked in about root-many ranges of the hash, with the counts of the ranges before, so no task holds more than its range."""
    key = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 16)
    ranges = max(1, int(rows.count() ** 0.5))
    share = F.conv(F.substring("_key", 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    keyed = rows.withColumn("_key", key).withColumn("_range", F.floor(share * ranges).cast("long"))
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_key", id_col)) + F.col("_before") - 1
    ranked = keyed.join(starts, "_range").withColumn("_rank", rank)
    n_train, n_val = F.floor(F.col("_all") * train), F.floor(F.col("_all") * val)
    return ranked.withColumn("split", F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < n_train + n_val, "val").otherwise("test")).drop("_key", "_range", "_before", "_all", "_rank")


# --- JSON lines -----------------------------------------------------------------------------------

def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, text, spans): raw documents, spans as array<array<string>> of start, end, label. line is the file's line; text is null where it isn't
    a document."""
    lines = spark.read.text(path).withColumnRenamed("value", "line").where(F.length(F.trim("line")) > 0)
    return lines.select("line", F.from_json("line", "text string, spans array<array<string>>").alias("d")).select("line", "d.text", F.coalesce("d.spans", F.array().cast("array<array<string>>")).alias("spans"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def document_errors(text: Column, spans: Column) -> Column:
    """array<string>: what is wrong with a raw document, as read_jsonl() gives it."""
    of = lambda s: (s[0].try_cast("int"), s[1].try_cast("int"))
    shape = lambda s: F.size(s) == 3

    def wrong(s: Column) -> Column:
        start, end = of(s)
        in_range = F.coalesce((start >= 0) & (start < end) & (end <= F.length(text)), F.lit(False))
        known = F.coalesce(F.get(s, F.lit(2)).isin(*LABELS), F.lit(False))
        return F.when(~shape(s), F.array(F.lit("a span is [start, end, label]"))).otherwise(F.filter(F.array(F.when(~in_range, "a span is out of range"), F.when(~known, "a label is not known")), lambda e: e.isNotNull()))

    return F.when(text.isNull(), F.array(F.lit("text is missing"))).otherwise(F.flatten(F.transform(spans, wrong)))


def ingest(raw: DataFrame, most_errors: int = 20) -> tuple[DataFrame, DataFrame]:
    """raw: as from read_jsonl(). (examples, stats). examples: (text, spans, tokenized_text, ner), ner as array<struct<first, last, label>>, inclusive; spans
    that meet no token are left out of it. stats, one row: in_docs, out_examples, rejected, spans, span_map_failures, negative_examples, errors (the first ones,
    in their own order)."""
    judged = raw.withColumn("errors", document_errors(F.col("text"), F.col("spans"))).withColumn("ok", F.size("errors") == 0)
    good = judged.where("ok").select("text", F.transform("spans", lambda s: F.struct(s[0].cast("int").alias("start"), s[1].cast("int").alias("end"), s[2].alias("label"))).alias("spans"))
    tokens = good.withColumn("tokens", tokenize_offsets(F.col("text")))
    placed = tokens.withColumn("placed", F.transform("spans", lambda s: F.struct(char_to_token(F.col("tokens"), s["start"], s["end"]).alias("at"), s["label"].alias("label"))))
    met = F.filter("placed", lambda p: p["at"].isNotNull())
    examples = placed.select("text", "spans", F.transform("tokens", lambda t: t["value"]).alias("tokenized_text"), F.transform(met, lambda p: F.struct(p["at"]["first"].alias("first"), p["at"]["last"].alias("last"), p["label"].alias("label"))).alias("ner"))
    counts = judged.agg(F.count("*").alias("in_docs"), F.count_if("ok").alias("out_examples"), F.count_if(~F.col("ok")).alias("rejected"))
    sums = examples.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans"), F.coalesce(F.sum(F.size("spans") - F.size("ner")), F.lit(0)).alias("span_map_failures"), F.count_if(F.size("spans") == 0).alias("negative_examples"))
    first = judged.select(F.explode("errors").alias("e")).orderBy("e").limit(most_errors).agg(F.array_sort(F.collect_list("e")).alias("errors"))
    return examples, counts.crossJoin(sums).crossJoin(first)  # one row each


def example_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


# Parts of made-up training sentences.
_PEOPLE, _PLACES, _FIRMS = ["김민수", "이서연", "박지훈", "최수빈"], ["서울특별시 강남구 테헤란로 12", "부산광역시 중구 광복로 7"], ["한빛소프트", "대성물산", "미래전자"]


def augmented(spark: SparkSession, positives: int, negatives: int, seed: int = 42) -> DataFrame:
    """(doc_id, text, spans): made-up sentences with a person, a place and a firm, or with none; a seed gives the same rows each time."""
    pick = lambda items, k: F.element_at(F.array(*(F.lit(x) for x in items)), (F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(len(items))) + 1).cast("int"))
    return sentences(spark.range(positives + negatives).select("id", (F.col("id") < positives).alias("positive"), pick(_PEOPLE, 1).alias("person"), pick(_PLACES, 2).alias("place"), pick(_FIRMS, 3).alias("firm")))


def sentences(rows: DataFrame) -> DataFrame:
    """rows: id, positive, person, place, firm, from any table of names. (doc_id, text, spans): a sentence with the three, whose spans are known, or one with none."""
    text = F.concat(F.lit("담당자 "), "person", F.lit(" 님은 "), "firm", F.lit(" 소속이며 주소는 "), "place", F.lit(" 입니다."))
    at = F.lit(4)
    firm = at + F.length("person") + 4
    place = firm + F.length("firm") + 10
    span = lambda start, value, label: F.struct(start.alias("start"), (start + F.length(value)).alias("end"), F.lit(label).alias("label"))
    spans = F.array(span(at, F.col("person"), "PERSON"), span(firm, F.col("firm"), "ORGANIZATION"), span(place, F.col("place"), "ADDRESS"))
    plain = F.concat(F.lit("회의 자료 "), F.col("id").cast("string"), F.lit("번을 검토해 주세요."))
    return rows.select(F.col("id").alias("doc_id"), F.when(F.col("positive"), text).otherwise(plain).alias("text"), F.when(F.col("positive"), spans).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>")).alias("spans"))


def verified(text: Column, spans: Column) -> Column:
    """Whether every span of array<struct<start, end, value>> has its value at its place."""
    return F.forall(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["value"])


def entity_islands(entities: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Entities (start, end, label, score): neighbours in order with one label and at most a gap of one character become one, with the
    largest end and score. Another label in between ends a run."""
    w = Window.partitionBy(doc).orderBy("start", "end", "label")
    rows = entities.withColumn("prev_label", F.lag("label").over(w))
    # The largest end of the current label run so far.
    rows = rows.withColumn("run", F.sum(F.when(F.col("prev_label") == F.col("label"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(doc, "run").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.max("end").over(inside))
    rows = rows.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach") + 1, 0).otherwise(1)).over(w))
    return rows.groupBy(doc, "island", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("island")
