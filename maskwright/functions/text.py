"""Checksums, masks, digests and other scalar functions, as column expressions."""

from __future__ import annotations

import functools
import hashlib
import sys
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .patterns import ENGLISH_STOP_WORDS, KOREAN_STOP_WORDS, PARTICLES

EDGE_SPACE = r"(?U)^\s+|\s+$"


@functools.cache
def _decimal_digits() -> tuple[str, str]:
    """Every decimal digit of any script but ASCII, and its value."""
    some = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(some), "".join(str(unicodedata.decimal(c)) for c in some)


def ascii_digits(value: Column) -> Column:
    return F.when(value.rlike(r"[^\x00-\x7F]"), F.translate(value, *_decimal_digits())).otherwise(value)


def digits(value: Column) -> Column:
    """Its digits, those of other scripts (full width, Arabic) as ASCII ones."""
    return F.regexp_replace(ascii_digits(value), "[^0-9]", "")


def _weighted(d: Column, weights: list[int]) -> Column:
    return sum((F.substring(d, k + 1, 1).cast("int") * w for k, w in enumerate(weights)), F.lit(0))


def luhn_valid(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) >= 13) & F.call_function("luhn_check", d)


def rrn_valid(value: Column) -> Column:
    """13 digits; the last is (11 - weighted sum mod 11) mod 10."""
    d = digits(value)
    total = _weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])
    return F.when(F.length(d) == 13, (11 - total % 11) % 10 == F.substring(d, 13, 1).cast("int")).otherwise(False)


def biz_valid(value: Column) -> Column:
    """10 digits; the ninth also counts with the tens of five times itself."""
    d = digits(value)
    total = _weighted(d, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + F.floor(F.substring(d, 9, 1).cast("int") * 5 / 10)
    return F.when(F.length(d) == 10, (10 - total % 10) % 10 == F.substring(d, 10, 1).cast("int")).otherwise(False)


def account_length_ok(value: Column) -> Column:
    return F.length(F.translate(value, "- ", "")).between(9, 14)


CHECKS = {"luhn": luhn_valid, "rrn": rrn_valid, "biz": biz_valid}


def normalised(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, EDGE_SPACE, ""))


def keyed_hash(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of the normalised value; only the two padded keys are made on the driver."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(normalised(value), "UTF-8")), 256))), 256)


def char_class_signature(value: Column) -> Column:
    """U, l, d or s per character, runs with their length."""
    classes = F.regexp_replace(value, r"(?s)[^\p{IsUppercase}\p{IsLowercase}\p{Nd}]", "\u0001")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(classes, r"\p{IsUppercase}", "U"), r"\p{IsLowercase}", "l"), r"\p{Nd}", "d")
    runs = F.regexp_extract_all(F.translate(classes, "\u0001", "s"), F.lit("(U+|l+|d+|s+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.substring(r, 1, 1), F.when(F.length(r) > 1, F.length(r).cast("string")).otherwise(""))), "")


def partial_mask(value: Column, reveal: int = 2) -> Column:
    n = F.length(value)
    k = F.least(F.lit(reveal), F.greatest(F.lit(1), F.floor(n / 4))).cast("int")
    return F.when(n <= 4, "***").otherwise(F.concat(F.substring(value, F.lit(1), k), F.lit("***"), F.substring(value, n - k + 1, k)))


def format_preserving_mask(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{IsUppercase}", "X"), r"\p{IsLowercase}", "x"), r"\p{Nd}", "0")


def fingerprint(value: Column) -> Column:
    """SHA-1 of the lower-cased text with its white space collapsed."""
    return F.sha1(F.trim(F.regexp_replace(F.lower(value), r"(?U)\s+", " ")))


def strip_particle(value: Column) -> Column:
    """Without the longest listed suffix, if two characters or more are left: the shortest prefix that a suffix completes."""
    return F.regexp_replace(value, f"(?s)^(.{{2,}}?)(?:{'|'.join(PARTICLES)})$", "$1")


def ner_false_positive(category: Column, value: Column, extra_words: tuple[str, ...] = (), enabled: bool = True) -> Column:
    """Whether what a recogniser calls a person, address or organisation is a code word, acronym, domain or blob."""
    if not enabled:
        return F.lit(False)
    t = F.regexp_replace(value, EDGE_SPACE, "")
    packed = F.replace(t, F.lit(" "), F.lit(""))
    wrong = (
        (t == "") | packed.isin(*KOREAN_STOP_WORDS, *extra_words) | F.lower(t).isin(*ENGLISH_STOP_WORDS)
        | t.rlike(r"[_()=;{}\[\]<>@/\\|&%$#`]") | t.rlike(r"(?iuU)\.(com|net|org|io|kr|co|ai|dev|gov|edu)\b")
        | t.rlike(r"^[A-Z]{2,5}\z")
        | ((F.length(packed) >= 16) & ~t.rlike("[가-힣]") & packed.rlike(r"^[A-Za-z0-9+/=]+\z"))
    )
    return category.isin("PERSON", "ADDRESS", "ORGANIZATION") & wrong


def could_be_placeholder_prefix(value: Column) -> Column:
    return value.rlike(r"^\[([A-Z][A-Z0-9_]*)?\z") & (F.length(value) <= 64)


def version_is_future(declared: Column, known: list[str], provider: str) -> Column:
    if not known:
        return F.lit(False)
    if provider == "claude":
        return declared.rlike(r"^\d{4}-\d{2}-\d{2}\z") & (declared > max(known))
    numbers = [int(m) for m in (("".join(c for c in k.lstrip("vV").split("b")[0].split("a")[0] if c.isdigit())) for k in known) if m]
    return F.coalesce(F.regexp_extract(declared, r"^[vV]?(\d+)", 1).try_cast("int") > max(numbers, default=2**31 - 1), F.lit(False))


def bracket(token: Column) -> Column:
    return F.concat(F.lit("["), token, F.lit("]"))


def unbracket(value: Column) -> Column:
    """The token inside; null for what isn't bracketed."""
    return F.when(value.rlike(r"(?s)^\[.+\]\z"), F.substring(value, F.lit(2), F.length(value) - 2))


def register(spark: SparkSession) -> None:
    """The scalars as SQL functions of the session, as SQL expressions, so Catalyst sees through them: mw_digits, mw_acct_len_ok, mw_luhn, mw_partial_mask,
    mw_fingerprint, mw_bracket, mw_unbracket."""
    many, few = _decimal_digits()
    only = f"regexp_replace(translate(v, '{many}', '{few}'), '[^0-9]', '')"
    for name, body, kind in (
        ("mw_digits", only, "STRING"),
        ("mw_acct_len_ok", "length(translate(v, '- ', '')) BETWEEN 9 AND 14", "BOOLEAN"),
        ("mw_luhn", f"length({only}) >= 13 AND luhn_check({only})", "BOOLEAN"),
        ("mw_partial_mask", "CASE WHEN length(v) <= 4 THEN '***' ELSE left(v, least(2, greatest(1, length(v) div 4))) || '***' || right(v, least(2, greatest(1, length(v) div 4))) END", "STRING"),
        ("mw_fingerprint", r"sha1(trim(regexp_replace(lower(v), '(?U)\\s+', ' ')))", "STRING"),
        ("mw_bracket", "'[' || v || ']'", "STRING"),
        ("mw_unbracket", r"CASE WHEN v rlike '(?s)^\\[.+\\]\\z' THEN substring(v, 2, length(v) - 2) END", "STRING"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {kind} RETURN {body}")
