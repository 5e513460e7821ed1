"""Detection rules as data. Regular expressions are in Java's dialect, run with (?U)."""

from __future__ import annotations

from typing import NamedTuple


class Category(NamedTuple):
    name: str
    kind: str
    action: str
    floor: float


class Rule(NamedTuple):
    category: str
    rule_id: str
    confidence: float
    value: str
    prefix: str = ""  # matched before the value, not part of it
    suffix: str = ""
    ignore_case: bool = False
    check: str = ""
    hint: str = ""  # a literal every match holds (lower case if ignore_case): a cheap test before the pattern

    @property
    def pattern(self) -> str:
        flags = "(?iuU)" if self.ignore_case else "(?U)"
        return f"{flags}({self.prefix})({self.value}){self.suffix}"


# Categories in order of priority, with class, action and least confidence.
CATEGORIES = [
    Category("PRIVATE_KEY", "secret", "block", 0.90),
    Category("AWS_SECRET", "secret", "block", 0.90),
    Category("GCP_KEY", "secret", "block", 0.90),
    Category("API_KEY", "secret", "block", 0.80),
    Category("TOKEN", "secret", "block", 0.85),
    Category("PASSWORD", "secret", "block", 0.80),
    Category("RRN", "korean_pii", "block", 0.85),
    Category("FOREIGN_REG", "korean_pii", "block", 0.85),
    Category("CARD", "pii", "block", 0.90),
    Category("PASSPORT", "korean_pii", "block", 0.75),
    Category("DRIVER_LICENSE", "pii", "block", 0.75),
    Category("EMAIL", "pii", "tokenize_roundtrip", 0.90),
    Category("PHONE", "pii", "tokenize_roundtrip", 0.80),
    Category("BIZ_NO", "korean_pii", "tokenize_roundtrip", 0.85),
    Category("KR_ACCOUNT", "korean_pii", "tokenize_roundtrip", 0.80),
    Category("PERSON", "pii", "tokenize_roundtrip", 0.80),
    Category("ADDRESS", "pii", "tokenize_roundtrip", 0.75),
    Category("IP_ADDRESS", "pii", "tokenize_roundtrip", 0.80),
    Category("HOSTNAME", "pii", "tokenize_roundtrip", 0.80),
    Category("ORGANIZATION", "korean_pii", "tokenize_roundtrip", 0.70),
]

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
REGIONS = "서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|전북|전남|경북|경남|제주"

# Patterns and confidences of the rules, in order.
RULES = [
    Rule("PRIVATE_KEY", "privkey_pem", 0.99, r"-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+|ENCRYPTED\s+|PGP\s+)?PRIVATE\s+KEY(?:\s+BLOCK)?-----", hint="-----BEGIN"),
    Rule("PRIVATE_KEY", "privkey_env", 0.92, r"""(?:PRIVATE[_\-]?KEY|private[_\-]?key)\s*(?:=|:)\s*'?"?(?:-----BEGIN[^'"]{20,}|[A-Za-z0-9+/]{200,}={0,2})'?"?""", ignore_case=True, hint="private"),
    Rule("AWS_SECRET", "aws_akid", 0.98, r"(?<![A-Z0-9])(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"),
    Rule("AWS_SECRET", "aws_secret_key", 0.97, r"[A-Za-z0-9/+=]{40}", r"""(?:aws[_\-]?secret[_\-]?access[_\-]?key|AWS_SECRET_ACCESS_KEY)\s*(?:=|:)\s*['"\\]?""", r"""['"\\]?""", True, hint="aws"),
    Rule("AWS_SECRET", "aws_session_token", 0.97, r"[A-Za-z0-9/+=]{100,}", r"""(?:aws[_\-]?session[_\-]?token|AWS_SESSION_TOKEN)\s*(?:=|:)\s*['"\\]?""", r"""['"\\]?""", True, hint="aws"),
    Rule("GCP_KEY", "gcp_api_key", 0.97, r"AIza[0-9A-Za-z\-_]{35}", hint="AIza"),
    Rule("GCP_KEY", "gcp_oauth_client", 0.96, r"(?:GOCSPX|GOCSB)-[a-zA-Z0-9\-_]{28,}", hint="GOCS"),
    Rule("GCP_KEY", "gcp_sa_key_id", 0.97, r"[a-f0-9]{40}", r'"private_key_id"\s*:\s*"', '"', True, hint="private_key_id"),
    Rule("API_KEY", "apikey_anthropic", 0.98, r"sk-ant-(?:api\d{2}-)?[a-zA-Z0-9\-_]{40,}", hint="sk-ant-"),
    Rule("API_KEY", "apikey_openai", 0.95, r"sk-(?:proj-)?[a-zA-Z0-9\-_]{20,}", hint="sk-"),
    Rule("API_KEY", "apikey_github", 0.97, r"(?:ghp|gho|ghu|ghs|ghr|github_pat)_[a-zA-Z0-9]{20,}", hint="gh"),
    Rule("API_KEY", "apikey_stripe", 0.97, r"(?:sk|pk|rk)_(?:live|test)_[a-zA-Z0-9]{24,}", hint="k_"),
    Rule("API_KEY", "apikey_assignment", 0.85, r"[a-zA-Z0-9\-_\.]{20,}", r"""(?:api[_\-]?key|apikey|api[_\-]?secret|app[_\-]?secret)\s*(?:=|:)\s*['"]?""", r"""['"]?""", True),
    Rule("API_KEY", "apikey_hf", 0.97, r"hf_[a-zA-Z0-9]{36,}", hint="hf_"),
    Rule("API_KEY", "apikey_hex32", 0.80, r"[0-9a-fA-F]{32,64}", r"""(?:key|token|secret|api)[_\-]?\s*[:=]\s*['"]{0,1}""", r"""['"]{0,1}""", True),
    Rule("TOKEN", "token_jwt", 0.97, r"eyJ[a-zA-Z0-9\-_]{8,}\.[a-zA-Z0-9\-_]{3,}\.[a-zA-Z0-9\-_]{3,}", hint="eyJ"),
    Rule("TOKEN", "token_bearer", 0.92, r"[a-zA-Z0-9\-_.~+/]{20,}", r"""(?:authorization|auth)\s*[:=]\s*["']?Bearer\s+""", "", True, hint="auth"),
    Rule("TOKEN", "token_assignment", 0.88, r"[a-zA-Z0-9\-_.~+/=%]{30,}", r"""(?:access[_\-]?token|refresh[_\-]?token|auth[_\-]?token|bearer[_\-]?token|id[_\-]?token)\s*(?:=|:)\s*['"]?""", r"""['"]?""", True, hint="token"),
    Rule("TOKEN", "token_slack", 0.97, r"xox[baprs]-[a-zA-Z0-9\-]{10,}", hint="xox"),
    Rule("TOKEN", "token_twilio", 0.95, r"SK[a-f0-9]{32}|AC[a-f0-9]{32}"),
    Rule("PASSWORD", "password_assignment", 0.82, r"""[^\s'",;|&>]{6,}""", r"""(?:password|passwd|passphrase|secret|pwd|[a-z0-9]+_pass(?:word|wd)?)\s*(?:=|:)\s*['"]?(?!\s*$)(?!\s*\*)""", r"""['"]?""", True),
    Rule("PASSWORD", "password_url", 0.92, r"[^@\s/]{6,}", r"(?:https?|ftp|postgresql|mysql|mongodb|redis|amqp)://[^:@\s]+:", r"@[^\s]+", True, hint="://"),
    Rule("RRN", "rrn_kr", 0.90, r"(?<!\d)[0-9]{6}[-\s]?[1-4][0-9]{6}(?!\d)", check="rrn"),
    Rule("FOREIGN_REG", "foreign_reg_kr", 0.88, r"(?<!\d)[0-9]{6}[-\s]?[5-8][0-9]{6}(?!\d)"),
    Rule("CARD", "card_pan", 0.90, r"(?<!\d)(?:4\d{3}|5[1-5]\d{2}|2(?:2[2-9]\d|[3-6]\d{2}|7[01]\d|720)|3[47]\d{2}|3(?:0[0-5]|[68]\d)\d|6(?:011|5\d{2})|(?:2131|1800|35\d{3}))(?:[-\s]?\d{4}){2}[-\s]?\d{3,4}(?!\d)", check="luhn"),
    Rule("PASSPORT", "passport_kr", 0.85, r"(?<![A-Za-z0-9])[MSF][A-Z]?\d{7,8}(?![A-Za-z0-9])"),
    Rule("PASSPORT", "passport_us", 0.80, r"(?<![A-Za-z0-9])[A-Z]\d{8}(?![A-Za-z0-9])"),
    Rule("PASSPORT", "passport_generic", 0.75, r"(?<![A-Za-z0-9])[A-Z]{1,2}\d{6,9}(?![A-Za-z0-9])"),
    Rule("PASSPORT", "passport_labeled", 0.90, r"[A-Z0-9]{7,10}", r"(?:passport|여권)\s*(?:no\.?|number|번호)?\s*[:：]\s*", "", True),
    Rule("DRIVER_LICENSE", "dl_kr", 0.85, r"(?<!\d)\d{2}[-\s]?\d{2}[-\s]?\d{6}[-\s]?\d{2}(?!\d)"),
    Rule("DRIVER_LICENSE", "dl_labeled", 0.90, r"[A-Z0-9][\d\-\s]{8,16}[A-Z0-9]", r"(?:driver['\s]?s?\s+licen[sc]e|운전\s*면허)\s*(?:no\.?|number|번호)?\s*[:：]\s*", "", True),
    Rule("DRIVER_LICENSE", "dl_us", 0.75, r"(?<!\w)[A-Z]\d{3}[-\s]\d{3}[-\s]\d{4}(?!\w)"),
    Rule("EMAIL", "email_rfc5322", 0.95, r"(?<![/@\w])[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}(?!\.[a-zA-Z])", hint="@"),
    Rule("PHONE", "phone_kr_mobile", 0.95, r"(?<!\d)01[016789][-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)"),
    Rule("PHONE", "phone_kr_landline", 0.88, r"(?<!\d)0[2-9]\d{0,1}[-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)"),
    Rule("PHONE", "phone_intl", 0.85, r"\+\d{1,3}[\s\-.]?\(?\d{1,4}\)?[\s\-.]?\d{3,4}[\s\-.]?\d{4}(?!\d)", hint="+"),
    Rule("PHONE", "phone_us", 0.80, r"(?<!\d)\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?!\d)"),
    Rule("BIZ_NO", "biz_no_kr", 0.90, r"(?<!\d)\d{3}[-]\d{2}[-]\d{5}(?!\d)", check="biz", hint="-"),
    Rule("KR_ACCOUNT", "kr_acct_kookmin", 0.88, r"(?<!\d)\d{6}-\d{2}-\d{6}(?!\d)"),
    Rule("KR_ACCOUNT", "kr_acct_3_6_5", 0.85, r"(?<!\d)\d{3}-\d{6}-\d{5}(?!\d)"),
    Rule("KR_ACCOUNT", "kr_acct_4_3_6", 0.85, r"(?<!\d)\d{4}-\d{3}-\d{6}(?!\d)"),
    Rule("KR_ACCOUNT", "kr_acct_labeled", 0.80, r"\d[\d\-\s]{8,15}\d", r"(?:계좌\s*번호|account\s*(?:no\.?|number))\s*[:：]?\s*", "", True),
    Rule("PERSON", "person_labeled_en", 0.85, r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}", r"(?:(?:full\s+)?name|patient|author|signed?\s*by|prepared\s*by|contact)\s*[:：]\s*", "", True),
    Rule("PERSON", "person_labeled_kr", 0.90, r"[가-힣]{2,5}", r"(?:성명|이름|담당자|작성자|신청인|피해자|원고|피고)\s*[:：]\s*"),
    Rule("ADDRESS", "address_kr", 0.85, rf"(?:{REGIONS})(?:특별시|광역시|특별자치시|도)?\s*[가-힣\d\s\-\.]+(?:구|군|시)\s*[가-힣\d\s\-\.]+(?:동|읍|면|로|길)\s*[\d\-]+"),
    Rule("ADDRESS", "address_us", 0.75, r"\b\d{1,5}\s+[A-Za-z0-9\s]{3,40}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct|Place|Pl)\.?(?:\s*,\s*[A-Za-z\s]+)?(?:\s*,\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?)?", ignore_case=True),
    Rule("IP_ADDRESS", "ipv4", 0.85, rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?![\d.])", hint="."),
    Rule("HOSTNAME", "hostname_internal", 0.85, r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+(?:internal|local|corp|lan|intranet)\b", ignore_case=True),
]

#: What every match of some rules holds; one cheap test then spares the patterns of all of them.
NEEDS = {
    "digit": (r"\p{Nd}", {"phone_intl", "phone_us", "biz_no_kr", "kr_acct_labeled", "address_us", "ipv4"}),
    "twelve digits": (r"(?U)\d(?:[-\s]?\d){11}", {"rrn_kr", "foreign_reg_kr", "card_pan", "dl_kr", "kr_acct_kookmin", "kr_acct_3_6_5", "kr_acct_4_3_6"}),
    "nine digits": (r"(?U)0\d(?:[-.\s]?\d){7}", {"phone_kr_mobile", "phone_kr_landline"}),
    "capital and digit": (r"[A-Z]\p{Nd}", {"passport_kr", "passport_us", "passport_generic", "dl_us"}),
    "key id": ("A(?:KI|BI|CC|SI)A", {"aws_akid"}),
    "account id": ("(?:SK|AC)[a-f0-9]", {"token_twilio"}),
    "inner dot": (r"(?iu)\.(?:internal|local|corp|lan|intranet)", {"hostname_internal"}),
    "mark": (r"[:=：]", {
        "privkey_env", "aws_secret_key", "aws_session_token", "gcp_sa_key_id", "apikey_assignment", "apikey_hex32", "token_bearer", "token_assignment",
        "password_assignment", "password_url", "passport_labeled", "dl_labeled", "person_labeled_en", "person_labeled_kr",
    }),
    "hangul": ("[가-힣]", {"address_kr"}),
}
NEED = {rule_id: name for name, (_, ids) in NEEDS.items() for rule_id in ids}

# Words near a value that make it an account or business number, labels of passwords.
BANKS = ["국민", "신한", "우리", "하나", "농협", "기업", "카카오뱅크", "카카오", "토스뱅크", "토스", "케이뱅크", "SC", "씨티", "산업", "수협", "새마을", "신협", "우체국", "대구", "부산", "경남", "광주", "전북", "제주"]
ACCOUNT_WORDS = ["계좌", "입금", "이체", "송금", "환불", "예금주", "수령", "받을", "보낼", "보내"]
BUSINESS_WORDS = ["사업자"]
PASSWORD_WORDS = ["비밀번호", "비번", "암호"]

# What a name recogniser mistakes for entities, and suffixes of Korean nouns.
KOREAN_STOP_WORDS = ["주석", "리턴값", "로깅", "수익자", "여권번호", "문진표", "생년월일", "네고", "유선", "프라이빗", "비밀번호", "비번", "암호", "담당자", "수신자", "발신자", "참조", "첨부", "본문", "제목", "회신"]
ENGLISH_STOP_WORDS = ["rotate", "admin", "root", "user", "test", "null", "true", "false", "config", "debug", "release", "build", "deploy", "commit"]
PARTICLES = ["이", "가", "을", "를", "은", "는", "의", "에", "에서", "으로", "로", "와", "과", "이나", "나", "도", "만", "까지", "부터", "이라", "라", "에게", "한테", "께", "에서는", "에게서", "씨", "님"]

CATEGORY = {c.name: c for c in CATEGORIES}
PRIORITY = {c.name: k for k, c in enumerate(CATEGORIES)}
