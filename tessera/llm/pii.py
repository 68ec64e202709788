"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping per kind; a match that fails its validator is
dropped and the search goes on behind it. Added kinds (iban with mod-97, ssn, shorter Luhn cards, keys and tokens) carry a score: a base value for the
pattern, more for a confirmed checksum or high entropy, more or less for words nearby; they stay from `threshold` on. Every scan is linear in the text,
also for texts that are one long run of letters or digits.

Nulls count as empty texts; empty texts have no spans; rows are independent, so repeated rows and extra columns change nothing; an
empty table gives an empty result. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "short_card", "secret")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts at the start of a run of digits, or it would have been found there; runs are never given back.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Keys and tokens: long runs without a space, confirmed by their entropy; forms that services publish for their keys need no context.
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
HEX = re.compile(r"[0-9a-fA-F]+")
KNOWN_SECRET = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}")
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
#: Words that raise or lower the score of a span with one of them among the `CONTEXT` characters before it.
RAISE = {"iban": ("iban", "account", "bank", "konto", "compte", "cuenta"), "ssn": ("ssn", "social", "security", "tax"), "short_card": ("card", "visa", "amex", "credit", "karte", "carte", "tarjeta"), "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials")}
LOWER = ("order", "invoice", "isbn", "serial", "part", "version", "sku")
CONTEXT = 40
PATTERN_SCORE = {"iban": 0.3, "ssn": 0.4, "short_card": 0.1, "secret": 0.0}
CHECK_SCORE = {"iban": 0.5, "ssn": 0.0, "short_card": 0.2, "secret": 0.2}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    rest = 0
    for c in s:
        rest = (rest * 10 + ord(c) - 48) % 97 if c <= "9" else (rest * 100 + ord(c) - 55) % 97
    return rest == 1


def entropy(s: str) -> float:
    """Bits a character, of the string's own distribution of characters."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def random_looking(s: str) -> bool:
    """Letters and digits mixed, with the entropy of generated keys: hexadecimal ones have at most 4 bits a character, others more."""
    mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    return mixed and entropy(s) >= (3.0 if HEX.fullmatch(s) else 3.6)


def secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """start, end, score."""
    for m in PRIVATE_KEY.finditer(text):
        yield *m.span(), 1.0
    for m in SECRET.finditer(text):
        if KNOWN_SECRET.fullmatch(m[0]):
            yield *m.span(), 1.0
        elif random_looking(m[0]):
            yield *m.span(), PATTERN_SCORE["secret"] + CHECK_SCORE["secret"] + context_score("secret", text, m.start())


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match ends its local part at an `@`, so each `@` is looked at once and the run before it is walked back."""
    at, done = text.find("@"), 0
    while at >= 0:
        if at >= done and (m := DOMAIN.match(text, at)):
            i = at
            while i > done and text[i - 1] in LOCAL:
                i -= 1
            if i < at:
                yield i, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def digit_groups(text: str) -> Iterator[tuple[int, int, str]]:
    for m in CARD.finditer(text):
        yield *m.span(), only_digits(m[0])


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(only_digits(m[0])) <= 15:
            yield m.span()


def context_score(kind: str, text: str, start: int) -> float:
    near = set(re.findall(r"[^\W\d_]+", text[max(0, start - CONTEXT) : start].lower()))
    return 0.4 * any(w in near for w in RAISE[kind]) - 0.3 * any(w in near for w in LOWER)


def find(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score), base kinds first, then by start. Base spans that their validator confirms score 1."""
    if not text:
        return []
    groups = list(digit_groups(text))
    out = [("email", a, b, 1.0) for a, b in emails(text)]
    out += [("ip", a, b, 1.0) for a, b in ips(text)] if "." in text else []
    out += [("card", a, b, 1.0) for a, b, d in groups if 16 <= len(d) <= 19 and luhn(d)]
    out += [("phone", a, b, 1.0) for a, b in phones(text)] if "+" in text else []
    if groups:
        proposed = [("iban", *m.span(), mod97(m[0].replace(" ", ""))) for m in IBAN.finditer(text)]
        proposed += [("ssn", *m.span(), m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000") for m in SSN.finditer(text)]
        proposed += [("short_card", a, b, luhn(d)) for a, b, d in groups if 13 <= len(d) <= 15]
        for kind, a, b, ok in proposed:
            score = PATTERN_SCORE[kind] + CHECK_SCORE[kind] + context_score(kind, text, a)
            if ok and score >= threshold:
                out.append((kind, a, b, round(min(1.0, score), 3)))
    out += [("secret", a, b, round(min(1.0, score), 3)) for a, b, score in sorted(secrets(text)) if score >= threshold]
    return out


def joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: the key and `spans`, an array of (kind, start, end, score)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "spans": [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find(t, threshold)] for t in pdf["text"]]})

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInPandas(run, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>").withColumnRenamed("key", key)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every whole text, in digest form."""
    from pyspark.sql import functions as F

    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda xs: F.concat_ws(",", F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), *[count(k) for k in ADDED_KINDS])


def brute(text: str | None) -> tuple[list[int], str]:
    """The base kinds as the patterns say, for tests: finditer, then the validators."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    valid = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 16 <= len(only_digits(s)) <= 19 and luhn(only_digits(s)), "phone": lambda s: 8 <= len(only_digits(s)) <= 15}
    got = {k: [m.span() for m in re.finditer(p, text or "") if valid[k](m[0])] for k, p in patterns.items()}
    return [len(got[k]) for k in BASE_KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in BASE_KINDS for a, b in got[k]).encode()).hexdigest()
