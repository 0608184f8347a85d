"""Licence scans: an Aho-Corasick automaton finds tags and notice phrases, a shunting-yard parser reads expressions."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_ANY_CASE, carry, schema_with, slices

#: Phrases whose words stand consecutively, with their labels. The base:
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: and those that the method adds.
PHRASES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit", "apache license": "apache-2.0", "mozilla public license": "mpl-2.0",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "cc0": "cc0", "creative commons attribution": "cc-by", "public domain": "public-domain", "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd-3-clause", "bsd 2 clause": "bsd-2-clause", "isc license": "isc", "unlicense": "unlicense", "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
#: How much a licence restricts the use of a text, 0 to 1; others 0.5.
RESTRICTS = {
    "mit": 0.1, "apache-2.0": 0.1, "bsd": 0.1, "bsd-2-clause": 0.1, "bsd-3-clause": 0.1, "isc": 0.1, "cc0": 0.0, "unlicense": 0.0, "public-domain": 0.0, "0bsd": 0.0,
    "cc-by": 0.2, "cc-by-sa": 0.4, "cc-by-nc": 0.8, "cc-by-nd": 0.8, "mpl-2.0": 0.4, "lgpl": 0.5, "gpl": 0.7, "agpl": 0.9, "reserved": 1.0, "proprietary": 1.0,
    "cc-by-nc-sa": 0.8, "cc-by-nc-nd": 0.9, "zlib": 0.1, "bsl-1.0": 0.1, "wtfpl": 0.1, "ncsa": 0.1, "postgresql": 0.1, "psf-2.0": 0.1, "python-2.0": 0.1, "afl": 0.2, "artistic": 0.3,
    "odc-by": 0.2, "odbl": 0.4, "epl": 0.5, "eupl": 0.5, "cddl": 0.5, "cpl": 0.5, "ms-pl": 0.3, "ms-rl": 0.5, "ofl": 0.3, "openssl": 0.2, "gfdl": 0.7, "sspl": 0.9, "busl": 0.9,
}
_BY_LENGTH = sorted((x for x in RESTRICTS if x not in ("reserved", "proprietary", "public-domain")), key=len, reverse=True)

_SPACED = bytes(ord(chr(b).lower()) if ALNUM_ANY_CASE[b] and b < 128 else b if ALNUM_ANY_CASE[b] else 32 for b in range(256))
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\- \t]+)", re.I)
_PART = re.compile(r"\(|\)|[A-Za-z0-9.+\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
_EXCEPTION = re.compile(r"[a-z0-9.\-]*(?:exception|syscall-note)[a-z0-9.\-]*")


def to_postfix(parts: list[str]) -> list[str]:
    """Shunting-yard: operands and operators in postfix order, lower-cased. ValueError if it is no licence expression."""
    out, stack, operand = [], [], True
    for part in map(str.lower, parts):
        if part in _RANK:
            if operand:
                raise ValueError("operator without operand")
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[part]:
                out.append(stack.pop())
            stack.append(part)
            operand = True
        elif part == "(":
            if not operand:
                raise ValueError("missing operator")
            stack.append(part)
        elif part == ")":
            if operand:
                raise ValueError("operator without operand")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unbalanced )")
            stack.pop()
        else:
            if not operand:
                raise ValueError("missing operator")
            out.append(part)
            operand = False
    if operand or "(" in stack:
        raise ValueError("incomplete")
    return out + stack[::-1]


@functools.lru_cache(1 << 12)
def family(licence: str) -> str | None:
    """The label of an identifier: versions of one family share it. None if it is no known licence."""
    x = licence.lower().rstrip("+")
    if x.startswith("licenseref-") and x != "licenseref-":
        return x
    return next((known for known in _BY_LENGTH if x == known or x.startswith(known + "-")), None)


def evaluate(parts: list[str]) -> tuple[list[str], float]:
    """Labels of the licences named, and how much the whole restricts: the most of an and, the least of an or.

    An exception after with lowers its licence by 0.2.
    """
    labels: list[str] = []
    stack: list[float] = []
    for part in to_postfix(parts):
        if part not in _RANK:
            labels.append(family(part) or part)
            stack.append(RESTRICTS.get(labels[-1], 0.5))
            continue
        right, left = stack.pop(), stack.pop()
        if part == "with":
            labels.pop()  # with binds tightest, so its exception is the operand read last
        stack.append(max(0.0, left - 0.2) if part == "with" else max(left, right) if part == "and" else min(left, right))
    return list(dict.fromkeys(labels)), stack[0]


def leading(text: str) -> list[str]:
    """The longest run of parts at the front that is an expression of known licences: prose after a tag does no harm.

    One pass: it ends at the first part that cannot follow, or is neither a known licence nor, after with, an exception.
    """
    parts: list[str] = []
    depth, operand, exception, whole = 0, True, False, 0
    for m in _PART.finditer(text):
        part = m[0]
        low = part.lower()
        if low in _RANK or part == ")":
            if operand or part == ")" and not depth:
                break
            depth -= part == ")"
            operand = exception = False
            if part != ")":
                operand, exception = True, low == "with"
        elif not operand or part == "(" and exception:
            break
        elif part == "(":
            depth += 1
        elif not (_EXCEPTION.fullmatch(low) if exception else family(part)):
            break
        else:
            operand = exception = False
        parts.append(part)
        if not operand and not depth:
            whole = len(parts)
    return parts[:whole]


_built: list = []


def _automaton():
    if not _built:
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase in {*BASE_PHRASES, *PHRASES, TAG}:
            a.add_word(f" {phrase} ", phrase)
        a.make_automaton()
        _built.append(a)
    return _built[0]


def scan(text: str) -> tuple[int, list[tuple[str, str, bool, int]], list[tuple[str, float]]]:
    """(n_words, hits, expressions): hits are (phrase, label, base, first word), by place; expressions (text, restriction)."""
    words = text.encode("utf-8", "surrogatepass").translate(_SPACED).split()
    spaced = b" " + b" ".join(words) + b" "
    hits, expressions, tagged, seen, at = [], [], False, 0, 0
    for end, phrase in _automaton().iter(spaced.decode("latin-1")):
        start = end - len(phrase) - 1  # of the space before its first word
        seen, at = (seen + spaced.count(b" ", at, start), start) if start >= at else (spaced.count(b" ", 0, start), start)
        if phrase == TAG:
            tagged = True
            continue
        label = BASE_PHRASES.get(phrase) or PHRASES[phrase]
        hits.append((phrase, label, phrase in BASE_PHRASES, seen))
    if tagged:
        for m in _EXPRESSION.finditer(text):
            if e := leading(m[1]):
                expressions.append((" ".join(e), *evaluate(e)))
    hits.sort(key=lambda h: (h[3], h[0]))
    return len(words), hits, expressions


_HITS = pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64())]))
_EXPRS = pa.list_(pa.struct([("expression", pa.string()), ("labels", pa.list_(pa.string())), ("restriction", pa.float64())]))
ADDED = "n_words bigint, hits array<struct<phrase:string,label:string,base:boolean,word:bigint>>, expressions array<struct<expression:string,labels:array<string>,restriction:double>>, restriction double"


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with n_words, hits, expressions and restriction (0 to 1) added.

    restriction is the largest over the labels found and expressions read; 0 where none is found. Null and empty
    texts: no words, no hits. Each row is treated by itself, its text whole. Columns of the added names go.
    """
    added = ["n_words", "hits", "expressions", "restriction"]
    kept = [c for c in (keep or docs.columns) if c not in added]

    def run(batches):
        for batch in batches:
            for part, arr in slices(batch, text):
                found = [scan(t) for t in arr.to_pylist()]
                new = [
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"phrase": p, "label": x, "base": b, "word": w} for p, x, b, w in h] for _, h, _ in found], _HITS),
                    pa.array([[{"expression": t, "labels": x, "restriction": r} for t, x, r in e] for _, _, e in found], _EXPRS),
                    pa.array([max([0.0, *(RESTRICTS.get(x, 0.5) for _, x, _, _ in h), *(r for _, _, r in e)]) for _, h, e in found], pa.float64()),
                ]
                yield carry(part, kept, added, new)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema_with(docs, kept, ADDED))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("hits", lambda h: h["base"])
    at = F.transform(base, lambda h: h["word"])
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        join(F.transform(base, lambda h: h["label"])).alias("base_labels"),
        join(F.concat(F.transform("hits", lambda h: h["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))).alias("labels"),
        F.col("restriction").alias("score"),
    )
