"""Queries of sessions over batches, joins of spans, dictionaries, policy tables, guards, models, reports and the made-up corpus, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import spans
from ..operators import detect as D
from ..operators import intervals as I
from ..operators import matcher as M
from ..operators import payloads as P
from ..operators import policy as Pol
from ..operators import policy_tables as PT
from ..operators import recogniser as R
from ..operators import reports as Rep
from ..operators import training as Tr
from ..streaming import sessions as Se
from . import catalog as C
from . import corpus as Co
from .catalog import KEY, keys, query, read


# --- sessions -----------------------------------------------------------------------------------

@query(C._tokens_sql("session").replace("SELECT scope AS session", "SELECT CAST(scope AS VARCHAR) AS session"))
def session_stream_tokens(spark, sf_dir):
    """Every word of every turn as a sighting, through the stateful form: each word's token in its session."""
    w = C._words(spark, sf_dir).select(F.col("session").cast("string").alias("session"), (F.col("turn") * 1_000_000 + F.col("k")).cast("long").alias("order"), "original", "category", "blocked", F.lit(False).alias("reset"))
    return Se.session_stream(w, key=KEY).where("fresh").select("session", "original", "token")


# --- spans --------------------------------------------------------------------------------------

@query(f"SELECT a.id, a.k AS left_k, a.s AS left_start, b.s AS right_start, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM {C._SQL_SPANS} a JOIN {C._SQL_SPANS} b ON a.id = b.id AND a.s < b.e AND b.s < a.e AND b.k = 2 AND a.k < 2")
def span_overlap_join(spark, sf_dir):
    """Spans of two tables that overlap within an order."""
    rows = C._made_spans(spark, sf_dir).withColumnRenamed("id", "order_id")
    pairs = I.overlap_join(rows.where("k < 2"), rows.where("k = 2"), ["order_id"])
    shared = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    return pairs.select(F.col("l.order_id").alias("id"), F.col("l.k").alias("left_k"), F.col("l.start").alias("left_start"), F.col("r.start").alias("right_start"), shared.alias("shared"))


_WORD = r"[^\x20\x09-\x0D]+"


@query(rf"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws, string_split_regex(text, '{_WORD}') AS gs FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, ws, gs FROM m WHERE len(ws) > 0),
o AS (SELECT doc_id, k, ws[k] AS word, length(gs[k]) AS gap, length(ws[k]) AS size FROM w),
p AS (SELECT doc_id, k, word, CAST(sum(gap + size) OVER (PARTITION BY doc_id ORDER BY k) - size AS BIGINT) AS s, size FROM o),
e AS ({C.SQL["pii_email"].strip()})
SELECT e.doc_id, e.start_at, CAST(min(p.k) - 1 AS INTEGER) AS first_word, CAST(max(p.k) - 1 AS INTEGER) AS last_word FROM e JOIN p ON p.doc_id = e.doc_id AND p.s < e.start_at + length(e.value) AND e.start_at < p.s + p.size GROUP BY ALL""")
def email_words(spark, sf_dir):
    """The words of each document that each of its mail addresses touches, by their numbers: a join of two tables of spans."""
    # Words of documents without an address meet nothing: they are left out before they are made.
    docs = read(spark, sf_dir, "documents").where(F.col("text").contains("@") & F.col("text").rlike(C.RULE["email_rfc5322"].pattern))
    mails = docs.select("doc_id", F.explode(spans(F.col("text"), C.RULE["email_rfc5322"])).alias("s")).select("doc_id", "s.start", "s.end")
    pairs = I.overlap_join(mails, Tr.token_rows(docs, pattern=_WORD).select("doc_id", "k", "start", "end"), ["doc_id"])
    return pairs.groupBy(F.col("l.doc_id").alias("doc_id"), F.col("l.start").alias("start_at")).agg(F.min("r.k").alias("first_word"), F.max("r.k").alias("last_word"))


# --- dictionaries -------------------------------------------------------------------------------

#: Entries of the dictionary that a query reads from a table, at most; a larger table is an error.
MOST_WORDS = 200_000
_LONG_WORD = "[a-z]{6,}"


@query(f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_LONG_WORD}')) AS word FROM benchmark),
d AS (SELECT CASE WHEN length(word) % 2 = 0 THEN 'even' ELSE 'odd' END AS label, string_agg(word, '|' ORDER BY length(word) DESC, word) AS pattern FROM w GROUP BY 1),
f AS (SELECT doc_id, label, regexp_extract_all(text, pattern) AS found FROM documents, d WHERE text IS NOT NULL)
SELECT doc_id, label, len(found) AS n, CAST(list_sum(list_transform(found, lambda x: length(x))) AS BIGINT) AS chars FROM f WHERE len(found) > 0""")
def dictionary_scan(spark, sf_dir):
    """Every occurrence in the documents of a dictionary with all longer words of benchmark, inside words too: counts and characters by label."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(f"({_LONG_WORD})"), F.lit(1))).alias("word")).distinct()
    found = [r.word for r in words.limit(MOST_WORDS + 1).collect()]
    if len(found) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = M.with_entities(docs, {w: "odd" if len(w) % 2 else "even" for w in found}).select("doc_id", F.explode("entities").alias("e"))
    return rows.groupBy("doc_id", F.col("e.label").alias("label")).agg(F.count("*").alias("n"), F.sum(F.col("e.end") - F.col("e.start")).alias("chars"))


# --- policy -------------------------------------------------------------------------------------

@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'allow' WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'block' ELSE 'tokenize_roundtrip' END AS action, CASE WHEN c_custkey % 3 = 0 THEN 'pin_list:a' || c_custkey WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'pin_list:b' || c_custkey ELSE 'category_default:EMAIL' END AS reason FROM customer")
def policy_pins(spark, sf_dir):
    """A pin list with entries for half of the customers, some twice: the first entry wins."""
    k = keys(spark, sf_dir)
    value = F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@example.org"))
    pin = lambda where, seq, action, tag: k.where(where).select((F.col("id") + seq).alias("seq"), F.concat(F.lit("sha256:"), C.T.keyed_hash(value, KEY)).alias("hash"), F.lit("EMAIL").alias("category"), F.lit(action).alias("action"), F.concat(F.lit(tag), F.col("id").cast("string")).alias("label"))
    pins = pin("id % 3 = 0", 0, "allow", "a").unionByName(pin("id % 2 = 0 and id % 3 <> 2", 10**12, "block", "b"))
    found = k.select("id", F.lit("EMAIL").alias("category"), F.lit(0.95).alias("confidence"), F.concat(F.lit(" "), F.upper(value)).alias("original"))
    return PT.decide_rows(found, Pol.Policy(), pins=pins, key=KEY).select("id", "decision.action", "decision.reason")


@query("""
WITH f AS (SELECT c_custkey AS id, c_custkey % 50 AS doc, ['EMAIL', 'PHONE', 'KR_ACCOUNT', 'NEW'][c_custkey % 4 + 1] AS category, (c_custkey % 100) / 100.0 AS confidence, [0.9, 0.5, 0.8, 0.0][c_custkey % 4 + 1] AS floor FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY id) - 1 AS k, confidence < floor AS gone FROM f)
SELECT doc, count(*) FILTER (WHERE NOT gone) AS enforced, count(*) FILTER (WHERE gone) AS suppressed, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE gone), '') AS places, round(count(*) FILTER (WHERE NOT gone) / count(*), 4) AS rate FROM n GROUP BY doc""")
def policy_layer(spark, sf_dir):
    """What a policy enforces and suppresses of each document's findings, with the suppressed ones' places."""
    rows = C._judged(spark, sf_dir).withColumn("doc", F.col("id") % 50).withColumn("original", F.lit("x"))
    out = PT.apply_rows(rows, C._POLICY, ["doc"], "id")
    places = F.array_join(F.transform("suppressed", lambda x: x["idx"].cast("string")), ",")
    return out.select("doc", F.col("enforced_count").cast("long").alias("enforced"), F.col("suppressed_count").cast("long").alias("suppressed"), places.alias("places"), F.round("rate", 4).alias("rate"))


@query(f"SELECT CASE WHEN id % 3 = 0 THEN NULL ELSE id % 7 END AS request_id, id % 5 = 0 AS block, CASE WHEN id % 5 <> 0 THEN '{{\"messages\": [{{\"content\": \"to [EMAIL_1]\"}}]}}' END AS masked, CASE WHEN id % 5 <> 0 THEN mail END AS email_1 FROM {C._SQL_MAIL}")
def scrub_ids(spark, sf_dir):
    """Requests whose ids are null or repeat, and some that can't be read: each is masked or blocked by what it holds itself."""
    mail = next(x for x in C.S_.SAMPLES if x.rule_id == "email_rfc5322").value
    body = F.concat(F.lit('{"messages": [{"content": "to '), F.expr(mail), F.when(F.col("id") % 5 == 0, F.lit('"')).otherwise(F.lit('"}]}')))
    rows = keys(spark, sf_dir).select(F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("request_id"), F.lit("claude").alias("provider"), body.alias("payload"))
    return P.scrub(rows).select("request_id", "block", "masked", F.col("restoration_map")["EMAIL_1"].alias("email_1"))


# --- models -------------------------------------------------------------------------------------

class NameModel:
    """A recogniser that knows three names: what a model's interface is run with where there is no model."""

    NAMES = ("김민수", "이서연", "박준")

    def entities(self, texts):
        return [[{"start": t.find(n), "end": t.find(n) + len(n), "label": "person", "score": 0.9} for n in self.NAMES if n in t] for t in texts]


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '김민수' WHEN 1 THEN '이서연' WHEN 2 THEN '박준' END AS entity, false AS coverage_gap FROM customer")
def model_scan(spark, sf_dir):
    """Names that no rule knows, by a model in a process of its own."""
    text = F.concat(F.element_at(F.array(F.lit("담당 김민수 님"), F.lit("담당 이서연 님"), F.lit("담당 박준 님"), F.lit("담당 없음")), (F.col("id") % 4 + 1).cast("int")), F.lit(" no. "), F.col("id").cast("string"))
    out = R.scan_with(keys(spark, sf_dir).withColumn("text", text), NameModel, {"person": "PERSON"}, with_proximity=False, categories=["EMAIL"])
    return out.select("id", F.get("scan.detections", F.lit(0))["original"].alias("entity"), F.col("scan.coverage_gap").alias("coverage_gap"))


# --- reports ------------------------------------------------------------------------------------

def _reported(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("day"), F.col("event_type").alias("channel"), F.element_at(F.array(F.lit("EMAIL"), F.lit("CARD"), F.lit("PHONE")), (F.col("user_id") % 3 + 1).cast("int")).alias("category"), F.when(F.col("user_id") % 2 == 0, "block").otherwise("mask").alias("action"), F.col("user_id").cast("string").alias("value"))


_SQL_REPORTED = "(SELECT CAST(ts AS DATE) AS day, event_type AS channel, ['EMAIL', 'CARD', 'PHONE'][user_id % 3 + 1] AS category, CASE WHEN user_id % 2 = 0 THEN 'block' ELSE 'mask' END AS action, CAST(user_id AS VARCHAR) AS value FROM events)"


@query(f"SELECT channel, category, action, count(*) AS n FROM {_SQL_REPORTED} GROUP BY ROLLUP (channel, category, action)")
def report_rollup(spark, sf_dir):
    """Findings by channel, category and action with all subtotals, merged from one row per day and cell."""
    daily = Rep.daily(_reported(spark, sf_dir), "day", ["channel", "category", "action"], "value")
    return Rep.merged(daily, ["channel", "category", "action"]).select("channel", "category", "action", "n")


@query(f"SELECT channel, abs(count(DISTINCT value) - count(DISTINCT value)) = 0 AS close, count(*) AS n FROM {_SQL_REPORTED} GROUP BY channel")
def report_distinct(spark, sf_dir):
    """Different values by channel, from the days' sketches: within 5 % of the exact count."""
    rows = _reported(spark, sf_dir)
    merged = Rep.merged(Rep.daily(rows, "day", ["channel"], "value"), ["channel"], subtotals=False)
    exact = rows.groupBy("channel").agg(F.count_distinct("value").alias("exact"))
    return merged.join(exact, "channel").select("channel", (F.abs(F.col("values") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("close"), "n")


# --- made-up corpus -----------------------------------------------------------------------------

@query(Co.expected_sql())
def corpus_floors(spark, sf_dir):
    """The whole scan over the made-up corpus, positives and negatives: of each format how many texts, how many values found exactly, findings that are none, and whether
    the format's floor, or a negative's cap, holds."""
    return Co.by_format(Co.texts(C.spread(keys(spark, sf_dir))))


@query(Co.expected_category_sql())
def corpus_precision(spark, sf_dir):
    """Recall and precision by category over the same corpus, with their floors."""
    return Co.by_category(Co.texts(C.spread(keys(spark, sf_dir))))


