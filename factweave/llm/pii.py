"""Operator 2: personal data.

Regular expressions propose spans, checksums and ranges confirm them (Luhn for cards, mod-97 for account numbers,
entropy for secrets), and words nearby raise or lower the score. Documents are scanned where they are read, with no shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, read_table
from .tokens import steps

#: Kinds in the order that breaks ties of start; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "national_phone", "access_key", "secret")
BASE = KINDS[:4]
#: Kinds that may overlap base spans, as a secret may hold digits that look like a card.
SECRETS = KINDS[7:]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
ALPHANUMERIC = CAPITALS | frozenset("abcdefghijklmnopqrstuvwxyz")
#: The part of an address from its @ on: an address starts as far left of it as LOCAL goes.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match always starts a run of digits, as its last part takes a whole run: so it is looked for only there.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: Characters of a country's account numbers, without spaces.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27,
    "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")
#: Public formats of access keys.
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")
#: A value given to a name that says secret, confirmed by its entropy.
ASSIGNED = re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\x20?[=:]\x20?[\"']?([^\x00-\x20\"']{8,})")
LEAST_BITS = 2.5
#: Score of a confirmed span, and words that raise or lower it when they stand within CONTEXT characters.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "national_phone": 0.4, "access_key": 0.9, "secret": 0.9}
RAISING = {
    "email": ("mail", "contact", "write", "correo"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto"), "ssn": ("ssn", "social security", "tax id"), "national_phone": ("phone", "tel", "call", "mobile", "fax"),
    "access_key": ("key", "token", "access"), "secret": ("login", "user", "credentials"),
}
LOWERING = ("version", "example", "isbn", "order no", "serial")
CONTEXT = 40
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length; those of other countries end at the last boundary, within 15 to 34 characters, that mod-97 holds at."""
    at = 0
    while m := IBAN.search(text, at):
        at = m.start() + 1
        length = IBAN_LENGTHS.get(m[0][:2])
        ends, end, n = [], m.end(), 4
        while n < (length or 34):
            step = end + text.startswith(" ", end)
            if step >= len(text) or text[step] not in CAPITALS:
                break
            end, n = step + 1, n + 1
            if n >= (length or 15) and not (end < len(text) and text[end] in ALPHANUMERIC):
                ends.append(end)
        for end in reversed(ends):
            if mod97(text[m.start() : end]):
                yield m.start(), end
                at = end
                break


def random_looking(value: str) -> bool:
    """Whether a value has letters and digits, and at least LEAST_BITS bits of entropy a character."""
    if not (re.search("[A-Za-z]", value) and re.search("[0-9]", value)):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= LEAST_BITS


def byte_sized(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, kind by kind."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    for m in IP.finditer(text):
        if all(map(byte_sized, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(only_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for a, b in ibans(text):
        yield "iban", a, b
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", m.start(), m.end()
    for m in NATIONAL.finditer(text):
        yield "national_phone", m.start(), m.end()
    for m in ACCESS_KEY.finditer(text):
        yield "access_key", m.start(), m.end()
    for m in ASSIGNED.finditer(text):
        value = m[1].rstrip(".,;:)]}>")
        if len(value) >= 8 and random_looking(value):
            yield "secret", m.start(1), m.start(1) + len(value)


def scored(text: str, kind: str, start: int, end: int) -> float:
    around = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    up = any(re.search(rf"\b{w}", around) for w in RAISING[kind])
    down = any(re.search(rf"\b{w}", around) for w in LOWERING)
    return round(min(1.0, max(0.0, SCORES[kind] + 0.3 * up - 0.3 * down)), 6)


def spans_of(text: str, threshold: float = 0.6) -> list[dict]:
    """Spans by start, then kind. A base span stays whatever its score; a further one needs `threshold` and, but for secrets, must not overlap a base span."""
    found = [{"kind": k, "start": a, "end": b, "score": scored(text, k, a, b)} for k, a, b in proposed(text)] if text else []
    base = [x for x in found if x["kind"] in BASE]
    starts = [x["start"] for x in sorted(base, key=lambda x: x["start"])]
    ends = list(accumulate((x["end"] for x in sorted(base, key=lambda x: x["start"])), max))
    more = []
    for x in found:
        before = bisect_left(starts, x["end"])
        if x["kind"] not in BASE and x["score"] >= threshold and (x["kind"] in SECRETS or not before or ends[before - 1] <= x["start"]):
            more.append(x)
    return sorted(base + more, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def find_pii(docs: DataFrame, *, threshold: float = 0.6, key: str = "doc_id") -> DataFrame:
    """One row per row of `docs` (key and text are read): key, and spans (kind, start, end in code points, score).

    Null and empty texts have no spans. Repeated rows get equal spans. Other columns are left out; `key` must not be "spans". Whole texts are scanned, in time that is linear in
    them. An empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for part in steps(batch):
                found = [spans_of(t or "", threshold) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(found, kind)], [key, "spans"])

    rows = docs.select(key, F.col("text").cast("string").alias("text"))
    return in_arrow(rows, scan, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, **options) -> DataFrame:
    """The texts with each span that starts outside an earlier one replaced by its kind in brackets: doc_id, text.

    Null texts stay null, empty ones empty; repeated rows get equal texts, and texts of any length are rewritten whole. Other
    columns are left out. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    threshold = options.get("threshold", 0.6)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                out = []
                for text in part.column("text").to_pylist():
                    parts, at = [], 0
                    for s in spans_of(text or "", threshold):
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"[{s['kind']}]"]
                            at = s["end"]
                    out.append(None if text is None else "".join(parts) + text[at:])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return in_arrow(rows, rewrite, rows.schema)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_pii(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    secrets = F.size(F.filter("spans", lambda s: s["kind"].isin(*SECRETS))).cast("long").alias("n_secret")
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), secrets)
