"""The audit against SQL on the tables and against plain counting on odd rows."""

import collections
import itertools
import re

import duckdb
import pytest

from leafmill.llm import filter_audit, queries

from .test_llm import DIR, ODD, empty, labels, odd


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cur = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = queries.queries()[name](spark, DIR)
    assert sorted(columns) == sorted(got.columns)
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == collections.Counter(cur.fetchall())


def by_hand(rows, marks):
    """Filters applied one after another to lists of rows."""
    def fails(i):
        d, t, part = rows[i]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        out["E"] = d is not None and any(x[0] is not None and x[0] < d and x[1] == t for x in rows)
        return {k for k, v in out.items() if v}

    failed = [fails(i) for i in range(len(rows))]
    out, removed_in = {}, collections.Counter()
    for part in {r[2] for r in rows}:
        own = [i for i, r in enumerate(rows) if r[2] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failed[i]]
                left = [i for i in left if f not in failed[i]]
                lost = lambda k: sum(any(m[0] == rows[i][0] is not None and m[k] == 1 for m in marks) for i in gone)  # noqa: E731, B023
                removed_in[part, f] += len(gone)
                redundant = sum(f in failed[i] for i in own) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(failed[i] == {f} for i in own), lost(1), lost(2)]
    return {k: (*v, removed_in[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HEAVY", 4)  # classes of more than a quarter of the rows are dealt
    same = [(100 + i, "Same Text #1 of MANY", "en", "s" if i % 2 else None, 0) for i in range(20)]
    rows = [*ODD, *same, (7, "same length a", "en", "s", 0), (8, "same length b", "en", "s", 0), (9, "x" * 70 + "a", "en", "s", 0), (10, "x" * 70 + "b", "en", "s", 0), (11, "y" * 3000 + "b", "en", "s", 0), (12, "y" * 3000 + "c", "en", "s", 0), (13, "y" * 3000 + "c", "en", "s", 0), (None, "same length a", "en", "s", 0), (0, "Lorem " * 60, "en", "", 0)]
    marks = [(101, 1, 1), (101, 0, 0), (102, 1, None), (None, 1, 1), (13, 1, 0), (4, 1, 1), (0, None, 1)]
    got = filter_audit.audit(odd(spark, rows), labels(spark, marks)).collect()
    want = by_hand([(r[0], r[1] or "", r[3] or "") for r in rows], marks)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(empty(spark), labels(spark)).count() == 0


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    real, seeds = filter_audit._signature, []

    def weak(text, seed):
        seeds.append(seed)
        from pyspark.sql import functions as F

        return real(text, seed) if seed else [F.lit(1).alias(c) for c in filter_audit.SIGNATURE]

    monkeypatch.setattr(filter_audit, "_signature", weak)
    rows = filter_audit.failing(odd(spark, [(1, "a", "", "", 0), (2, "b", "", "", 0), (3, "a", "", "", 0)]))
    assert {r.doc_id: r.mask & 16 for r in rows.collect()} == {1: 0, 2: 0, 3: 16} and seeds == [0, 1]
