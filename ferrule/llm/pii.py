"""Personal data and secrets: expressions propose spans, checksums confirm them, context words adjust their score.

Card numbers are confirmed by Luhn's rule, bank accounts by mod-97, addresses by their ranges, national
numbers by the ranges that are given out, and values of passwords and tokens by their mix of characters
(letters and digits, no word). Kinds of the same start are listed in the order of ``KINDS``; spans of
different kinds may overlap.

Null and empty texts have no spans; rows are independent, so repeated rows get equal spans, an
empty table gives an empty table, and all other columns pass through (a column named like the
output is replaced). Every expression is linear in the text, whatever its length.
"""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Kinds in the order that breaks ties of the start; the first four are the base ones.
KINDS = ("email", "ip", "card", "phone", "iban", "phone_local", "ipv6", "national_id", "access_key", "secret")
BASE = KINDS[:4]

# Score of a confirmed span without context, and the words that raise it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "phone_local": 0.3, "ipv6": 0.6, "national_id": 0.3, "access_key": 0.8, "secret": 0.6}
CONTEXT = {
    "email": "email e-mail mail contact write address courriel correo adresse",
    "ip": "ip address host server login adresse servidor",
    "card": "card visa mastercard amex credit debit payment carte karte tarjeta",
    "phone": "phone tel call mobile fax telephone telefon téléphone teléfono",
    "iban": "iban bank account konto compte cuenta transfer swift bic",
    "phone_local": "phone tel call mobile fax telephone telefon téléphone teléfono",
    "ipv6": "ip address host server login adresse servidor",
    "national_id": "ssn social security taxpayer",
    "access_key": "aws key access credential",
    "secret": "login user username account credential auth bearer",
}
CONTEXT_BONUS, CONTEXT_REACH, LEAST = 0.3, 40, 0.5

# The possessive forms take the same spans as the plain greedy ones, in linear time.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
PHONE_LOCAL = re.compile(r"(?<![0-9+])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key|private[_-]?key))[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9+/_.-]{8,}+)")
LEAST_BITS = 2.5
WORDS = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v.split())) + r")(?!\w)", re.IGNORECASE) for k, v in CONTEXT.items()}
DIGIT, NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each at-sign: the local part is the run of its characters before it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        end = m.end()
        while end > m.start():  # a following upper-case word may look like one more group
            code = text[m.start() : end].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE_LOCAL.finditer(text):
        yield m.span()


def _ipv6s(text: str) -> Iterator[tuple[int, int]]:
    for m in IPV6.finditer(text):
        try:
            if ipaddress.IPv6Address(m[0]).packed.strip(b"\0"):
                yield m.span()
        except ValueError:
            pass


def _national_ids(text: str) -> Iterator[tuple[int, int]]:
    for m in NATIONAL.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield m.span()


def random_looking(value: str) -> bool:
    """Letters and digits, and ``LEAST_BITS`` of entropy a character or more."""
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return bits >= LEAST_BITS and any(map(str.isdigit, value)) and any(map(str.isalpha, value))


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in SECRET.finditer(text):
        if random_looking(m[1]):
            yield m.span(1)


def find_spans(text: str | None) -> list[dict]:
    """All spans of a text, by start, then kind as listed; base spans always stay, others need a score of ``LEAST``."""
    if not text:
        return []
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(a, b, 1) for a, b in _ips(text)]
        found += [(a, b, 2) for a, b in _cards(text)]
        phones = list(_phones(text)) if "+" in text else []
        found += [(a, b, 3) for a, b in phones]
        found += [(a, b, 4) for a, b in _ibans(text)]
        taken = {i for a, b in phones for i in (a, b)}
        found += [(a, b, 5) for a, b in _local_phones(text) if b not in taken]
        found += [(a, b, 6) for a, b in _ipv6s(text)] if "::" in text or text.count(":") >= 7 else []
        found += [(a, b, 7) for a, b in _national_ids(text)]
        found += [(m.start(), m.end(), 8) for m in ACCESS_KEY.finditer(text)]
        found += [(a, b, 9) for a, b in _secrets(text)]
    out = []
    for a, b, k in sorted(found, key=lambda x: (x[0], x[2])):
        kind = KINDS[k]
        near = text[max(0, a - CONTEXT_REACH) : a] + "\n" + text[b : b + CONTEXT_REACH]
        score = round(min(1.0, PRIOR[kind] + (CONTEXT_BONUS if WORDS[kind].search(near) else 0.0)), 2)
        if kind in BASE or score >= LEAST:
            out.append({"kind": kind, "start": a, "end": b, "score": score})
    return out


def detect_pii(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """df with ``out``: array of (kind, start, end, score); offsets in code points, end exclusive."""

    @F.pandas_udf(SPANS)
    def spans(text: pd.Series) -> pd.Series:
        return text.map(find_spans, na_action=None)

    return df.withColumn(out, spans(F.col(text_col)))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii", out: str = "redacted") -> DataFrame:
    """df with ``out``: the text, each span replaced by its kind in brackets; of overlapping spans the first counts."""

    @F.pandas_udf("string")
    def cover(text: pd.Series, spans: pd.Series) -> pd.Series:
        done = []
        for t, found in zip(text, spans, strict=True):
            parts, at = [], 0
            for s in found if t is not None and found is not None else []:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                    at = s["end"]
            done.append(t if t is None else "".join(parts) + t[at:])
        return pd.Series(done, dtype=object)

    return df.withColumn(out, cover(F.col(text_col), F.col(spans_col)))


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_pii(texts(table(spark, sf_dir, "documents"))).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(_joined(F.filter("pii", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
        F.concat_ws(",", F.transform("pii", lambda x: F.format_string("%.2f", x["score"]))).alias("scores"),
    )
