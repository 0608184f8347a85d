"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carry, schema_with, slices

#: Kinds in the order of results. The first four are the base; a base span that passes its check always stays.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "national_id", "secret")
BASE = KINDS[:4]

# No pattern starts inside a run that its own first element could have started: each text is scanned in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
#: A value that is set, and the names that make it a secret.
_SET = re.compile(r"[:=]\s{0,3}[\"']?([A-Za-z0-9+/_~-]{16,}=*)")
_SECRET_NAME = re.compile(r"(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?[\"']?\s{0,3}$", re.I)

#: Chances before context, and words within CONTEXT characters before a span that raise or lower them.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.6, "national_id": 0.4, "secret": 0.7}
FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "bank", "account"), "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "national_id": ("ssn", "social", "security", "id"), "secret": ("token", "key", "auth", "login", "bearer"),
}
AGAINST = {"ip": ("version", "release", "section"), "card": ("order", "serial", "isbn", "tracking"), "phone": ("offset", "range"), "national_id": ("part", "model"), "secret": ("example", "placeholder")}
CONTEXT, RAISE, LOWER, LEAST = 40, 0.2, 0.3, 0.5
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(t: str):
    at, last = t.find("@"), 0
    while at >= 0:
        s = at
        while s > last and t[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(t, at + 1)):
            last = m.end()
            yield s, last
        at = t.find("@", max(at + 1, last))


def _passing(pattern: re.Pattern, ok):
    return lambda t: ((m.start(), m.end()) for m in pattern.finditer(t) if ok(m[0]))


def _secrets(t: str):
    """Values of named secrets: letters and digits mixed, no run of few characters."""
    for m in _SET.finditer(t):
        v = m[1]
        if len(set(v)) >= 8 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and _SECRET_NAME.search(t, max(0, m.start() - 24), m.start()):
            yield m.start(1), m.end(1)


_FIND = {
    "email": _emails,
    "ip": _passing(_IP, lambda s: all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in s.split("."))),
    "card": _passing(_CARD, lambda s: 13 <= len(d := _digits(s)) <= 19 and luhn(d)),
    "phone": _passing(_PHONE, lambda s: 9 <= len(_digits(s)) <= 15),
    "iban": _passing(_IBAN, mod97),
    "local_phone": _passing(_LOCAL_PHONE, lambda s: True),
    "national_id": _passing(_NATIONAL_ID, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"),
    "secret": _secrets,
}


def _score(kind: str, t: str, start: int) -> float:
    near = _WORD.findall(t[max(0, start - CONTEXT) : start].lower())
    p = PRIOR[kind] + RAISE * any(w in FOR[kind] for w in near) - LOWER * any(w in AGAINST.get(kind, ()) for w in near)
    return round(min(1.0, max(0.0, p)), 2)


def find(t: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; code points, end exclusive.

    Added kinds need a score of LEAST; spans of added kinds that overlap a base span are left out, but for secrets, of
    which no part may stay when a text is redacted.
    """
    has_digit = _DIGIT.search(t) is not None
    out, taken = [], []
    for kind in KINDS:
        if kind == "email" and "@" not in t or kind != "email" and not has_digit or kind == "phone" and "+" not in t or kind == "local_phone" and "(" not in t:
            continue
        for s, e in _FIND[kind](t):
            p = _score(kind, t, s)
            if kind in BASE:
                taken.append((s, e))
            elif p < LEAST or kind != "secret" and any(s < b and a < e for a, b in taken):
                continue
            out.append((kind, s, e, p))
    return out


def redact(t: str, spans: list[tuple[str, int, int, float]]) -> str:
    """t with each span replaced by [KIND]; of overlapping spans, the first and, of these, the longest."""
    parts, at = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [t[at:s], f"[{kind.upper()}]"]
            at = e
        elif e > at:  # the rest of an overlapping span goes with the first
            at = e
    return "".join([*parts, t[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None, redacted: str | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with spans added, and the redacted text in column redacted if named.

    Null and empty texts have no spans, and a null text stays null when redacted. Every row is treated by itself:
    repeated rows get the same spans, and a text of any length is scanned whole. Columns of the added names go.
    """
    added = ["spans", *([redacted] if redacted else [])]
    kept = [c for c in (keep or docs.columns) if c not in added]
    schema = schema_with(docs, kept, f"spans {SPANS}" + (f", `{redacted}` string" if redacted else ""))

    def run(batches):
        for batch in batches:
            for part, _ in slices(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                found = [find(t) if t else [] for t in texts]
                new = [pa.array([[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in x] for x in found], _SPAN)]
                if redacted:
                    new.append(pa.array([redact(t, x) if x else t for t, x in zip(texts, found)], pa.string()))
                yield carry(part, kept, added, new)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of base spans and all spans as text, in Spark expressions."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )
