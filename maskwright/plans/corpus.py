"""A made-up corpus with known spans: formats of five categories in their templates, and negatives that only look like them, for every id of a table.

Texts are SQL expressions over a number id, which Spark and DuckDB read alike, so the corpus is as large as the table and the same in each run.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import detect
from .samples import BORN, RRN12, digits, quoted, rrn


class Format(NamedTuple):
    tag: str
    category: str  # of the value or, for a negative, what it looks like
    before: str
    value: str  # SQL over id; null: a negative, and before is its SQL
    after: str
    floor: float  # the least recall


_NAMES = "CASE id % 5 WHEN 0 THEN '김민수' WHEN 1 THEN '이서연' WHEN 2 THEN '박지훈' WHEN 3 THEN '최유진' ELSE '정하늘' END"
_STREETS = "(CASE id % 3 WHEN 0 THEN '서울특별시 강남구 테헤란로 ' WHEN 1 THEN '부산광역시 해운대구 센텀중앙로 ' ELSE '경기도 성남시 판교역로 ' END || CAST(id % 900 + 1 AS STRING))"
_RRN = f"({RRN12} || {rrn(RRN12)})"
_RRN_DASH = f"(substr({RRN12}, 1, 6) || '-' || substr({RRN12}, 7, 6) || {rrn(RRN12)})"
_ACCOUNTS = {
    "kookmin": f"({digits(6, 7)} || '-' || {digits(2, 3)} || '-' || {digits(6, 13)})", "shinhan": f"('1' || {digits(2, 7)} || '-' || {digits(6, 3)} || '-' || {digits(5, 13)})",
    "woori": f"('1' || {digits(3, 7)} || '-' || {digits(3, 3)} || '-' || {digits(6, 13)})", "hana": f"('2' || {digits(2, 7)} || '-' || {digits(6, 3)} || '-' || {digits(5, 13)})",
}

# The names of formats, and the least recall of each.
FORMATS = [
    Format("phone_mobile_dash", "PHONE", "휴대폰: ", f"('010-' || {digits(4, 7)} || '-' || {digits(4, 13)})", "", 0.8),
    Format("phone_mobile_bare", "PHONE", "휴대폰 ", f"('010' || {digits(4, 7)} || {digits(4, 13)})", "", 0.8),
    Format("phone_landline", "PHONE", "대표전화 ", f"('031-' || {digits(3, 7)} || '-' || {digits(4, 13)})", "", 0.8),
    Format("phone_international", "PHONE", "연락처 ", f"('+82-10-' || {digits(4, 7)} || '-' || {digits(4, 13)})", "", 0.8),
    Format("phone_mobile_dot", "PHONE", "전화 ", f"('010.' || {digits(4, 7)} || '.' || {digits(4, 13)})", "", 0.8),
    Format("phone_inline_sentence", "PHONE", "문의는 ", f"('010-' || {digits(4, 11)} || '-' || {digits(4, 17)})", " 번으로 주세요.", 0.8),
    Format("rrn_dash", "RRN", "주민번호: ", _RRN_DASH, "", 0.8),
    Format("rrn_bare", "RRN", "주민등록번호 ", _RRN, "", 0.8),
    Format("rrn_inline_form", "RRN", "신청인 ", _RRN_DASH, " 확인", 0.8),
    Format("rrn_space", "RRN", "주민번호 ", f"(substr({RRN12}, 1, 6) || ' ' || substr({RRN12}, 7, 6) || {rrn(RRN12)})", "", 0.8),
    *(Format(f"kr_acct_{bank}_{kind}", "KR_ACCOUNT", before, value, after, 0.8) for bank, value in _ACCOUNTS.items() for kind, before, after in (("kr_label", "계좌번호: ", ""), ("en_label", "Account No: ", ""), ("inline", "계좌 ", "로 입금해 주세요."))),
    *(Format(f"person_{label}_label", "PERSON", f"{label}: ", _NAMES, "", 0.8) for label in ("성명", "이름", "담당자", "신청인", "작성자")),
    Format("person_name_en_label", "PERSON", "Name: ", _NAMES, "", 0.0),
    Format("person_sentence", "PERSON", "어제 ", _NAMES, " 씨를 만났습니다.", 0.0),
    Format("address_bare", "ADDRESS", "", _STREETS, "", 0.8),
    Format("address_residence", "ADDRESS", "거주지: ", _STREETS, "", 0.8),
    Format("address_labeled", "ADDRESS", "주소: ", _STREETS, "", 0.5),
    Format("address_en_label", "ADDRESS", "Address: ", _STREETS, "", 0.6),
    Format("address_delivery", "ADDRESS", "배송지는 ", _STREETS, "입니다.", 0.6),
]

#: Negatives, as SQL: places, brands and nouns, short and formatted numbers, numbers whose check digit or date is wrong, parts of addresses, plain sentences.
NEGATIVES = {
    "neg_person": ["'대전역 앞에서 봅시다.'", "'남산 타워가 보입니다.'", "'우리은행 앱이 느립니다.'", "'현대자동차 실적 발표'", "'상담센터에 문의하세요.'"],
    "neg_phone": [f"('주문번호: ' || {digits(5, 7)})", "('버전: 2.' || CAST(id % 20 AS STRING) || '.1234')", f"('제품코드: 020' || {digits(4, 7)})", "('방 번호 ' || CAST(id % 900 + 100 AS STRING) || '호')", f"('1588-' || {digits(4, 7)} || ' 고객센터')", f"('ZIP code: ' || {digits(5, 3)})"],
    "neg_rrn": [f"('결제번호 ' || {BORN} || '-9' || {digits(6, 7)})", "'코드: 000000-0000000'", f"('일련번호: ' || {BORN} || '-0' || {digits(6, 31)})", f"('결제 ' || substr({RRN12}, 1, 6) || '-' || substr({RRN12}, 7, 6) || CAST(({rrn(RRN12)} + 1) % 10 AS STRING))"],
    "neg_address": ["'대구행 버스를 놓쳤습니다.'", "'제주 바람이 세네요.'", "'경기 시작 시각을 보세요.'", "'홍대입구역 9번 출구'", "'종로구 안내문'"],
    "neg_kr_account": ["('주문번호: 2024-03-' || " + digits(5, 7) + ")", "('모델명: KR-' || " + digits(4, 7) + " || '-' || " + digits(5, 3) + ")", "('일련번호: 12-34-' || " + digits(6, 7) + ")"],
    "neg_clean": ["'회의는 오후 4시입니다.'", "'완료 예정일은 2026년 3월입니다.'", "'가격은 89,000원입니다.'", "'파이썬 3.13을 쓰세요.'", "'문서: https://docs.example.com'", "'회사 이메일 형식은 이름@회사.com입니다.'", "'10자리 회원번호를 넣으세요.'", "'계좌이체 수수료는 700원입니다.'", "'비밀번호는 10자 이상이어야 합니다.'", "'주민등록번호 형식: YYMMDD-NNNNNNN'"],
}
#: False findings per id in each group of negatives, at most.
CAPS = {"neg_person": 0, "neg_phone": 0, "neg_rrn": 1, "neg_address": 0, "neg_kr_account": 1, "neg_clean": 0}
#: Least recall and precision by category.
FLOORS = {"PHONE": (0.9, 0.9), "RRN": (0.9, 0.9), "KR_ACCOUNT": (0.9, 0.9), "PERSON": (0.5, 0.85), "ADDRESS": (0.75, 0.85)}


def texts(ids: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """(id, tag, category, text, start, end, value) for each id: a row per format, and one per negative, whose category is null. tags: only these."""
    each = [F.struct(F.lit(f.tag).alias("tag"), F.lit(f.category).alias("category"), F.expr(f"{quoted(f.before)} || {f.value} || {quoted(f.after)}").alias("text"), F.lit(len(f.before)).alias("start"), F.expr(f.value).alias("value")) for f in FORMATS if tags is None or f.tag in tags]
    each += [F.struct(F.lit(tag).alias("tag"), F.lit(None).cast("string").alias("category"), F.expr(t).alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("value")) for tag, some in NEGATIVES.items() if tags is None or tag in tags for t in some]
    rows = ids.select("id", F.explode(F.array(*each)).alias("s")).select("id", "s.*")
    return rows.withColumn("end", F.col("start") + F.length("value"))


def _judged(rows: DataFrame) -> DataFrame:
    """With hit (the value was found exactly, as its category) and wrong, the findings of the five categories and their like that are none."""
    found = rows.withColumn("dets", detect(F.col("text")))
    right = lambda d: (d["category"] == F.col("category")) & (d["start"] == F.col("start")) & (d["end"] == F.col("end"))
    return found.withColumn("hit", F.when(F.col("category").isNotNull(), F.exists("dets", right))).withColumn("wrong", F.filter("dets", lambda d: ~F.coalesce(right(d), F.lit(False)))).drop("dets")


def by_format(rows: DataFrame) -> DataFrame:
    """By tag: texts, hits, false_findings, ok (recall at the floor, or no more false findings than the cap)."""
    out = _judged(rows).groupBy("tag").agg(F.count("*").alias("texts"), F.count_if("hit").alias("hits"), F.sum(F.size("wrong")).alias("false_findings"), F.count_distinct("id").alias("ids"))
    floors, caps = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in ({f.tag: f.floor for f in FORMATS}, CAPS))
    negative = F.col("tag").startswith("neg_")
    ok = F.when(negative, F.col("false_findings") <= F.element_at(caps, F.col("tag")) * F.col("ids")).otherwise(F.col("hits") >= F.element_at(floors, F.col("tag")) * F.col("texts"))
    return out.select("tag", "texts", "hits", "false_findings", ok.alias("ok"))


def by_category(rows: DataFrame) -> DataFrame:
    """By category: values, hits, false_findings (of the category, negatives included), and whether recall and precision are at their floors."""
    part = lambda category, value, hit, wrong: F.struct(category.alias("category"), value.alias("value"), hit.alias("hit"), wrong.alias("wrong"))
    zero, one = F.lit(0), F.lit(1)
    own = F.when(F.col("category").isNotNull(), F.array(part(F.col("category"), one, F.col("hit").cast("int"), zero))).otherwise(F.array())
    # Values and false findings in one pass, which scans each text once; the outer form keeps Spark from testing the array's size first.
    parts = _judged(rows).select(F.explode_outer(F.concat(own, F.transform("wrong", lambda d: part(d["category"], zero, zero, one)))).alias("p")).where("p is not null")
    out = parts.groupBy("p.category").agg(F.sum("p.value").alias("values"), F.sum("p.hit").alias("hits"), F.sum("p.wrong").alias("false_findings")).where("values > 0")
    recall, precision = (F.create_map(*(F.lit(x) for k, v in FLOORS.items() for x in (k, v[n]))) for n in (0, 1))
    enough = F.col("hits") >= F.element_at(recall, F.col("category")) * F.col("values")
    exact = F.col("hits") >= F.element_at(precision, F.col("category")) * (F.col("hits") + F.col("false_findings"))
    return out.select("category", "values", "hits", "false_findings", enough.alias("recall_ok"), exact.alias("precision_ok"))


#: Formats that rules alone can't find.
GAPS = ("person_name_en_label", "person_sentence")


def expected_sql() -> str:
    rows = [f"SELECT '{f.tag}' AS tag, 1 AS per, {int(f.tag not in GAPS)} AS found, 0 AS wrong" for f in FORMATS]
    rows += [f"SELECT '{tag}', {len(some)}, 0, 0" for tag, some in NEGATIVES.items()]
    return f"SELECT tag, per * n AS texts, found * n AS hits, wrong * n AS false_findings, true AS ok FROM ({' UNION ALL '.join(rows)}), (SELECT count(*) AS n FROM customer)"


def expected_category_sql() -> str:
    by: dict[str, list[int]] = {}
    for f in FORMATS:
        by.setdefault(f.category, []).append(int(f.tag not in GAPS))
    rows = " UNION ALL ".join(f"SELECT '{c}' AS category, {len(k)} AS per, {sum(k)} AS found" for c, k in by.items())
    return f"SELECT category, per * n AS values, found * n AS hits, CAST(0 AS BIGINT) AS false_findings, true AS recall_ok, true AS precision_ok FROM ({rows}), (SELECT count(*) AS n FROM customer)"
