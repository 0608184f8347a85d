"""Collocations against plain counting on random texts, with hot pairs dealt, small flushes and spilling buckets."""

import collections
import random
import re

import pyarrow as pa
import pytest

from leafmill.llm import collocations as co

from .test_llm import ODD, empty, odd


def by_hand(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang, text = lang if lang is not None else "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for i in range(len(w)) for k in range(1, 5) if i + k <= len(w))
    phrases = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = collections.defaultdict(list)
    for g, a in phrases.items():
        cuts = [(2000000 * a // (f[g[: k + 1]] + f[g[:1] + g[k + 1 :]]), k, f[g[: k + 1]], f[g[:1] + g[k + 1 :]]) for k in range(1, len(g) - 1)]
        if any(b[0] == g[0] and len(b) > len(g) and 100 * m >= 80 * a and any(b[i : i + len(g) - 1] == g[1:] for i in range(1, len(b) - len(g) + 2)) for b, m in phrases.items()):
            continue
        score, _, l, r = min(cuts)  # noqa: E741
        out[g[0]].append((-score, -a, " ".join(g[1:]).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])}


def texts(seed, n, words, sep):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "l\n1"]), "s", 0) for i in range(n)]


@pytest.mark.parametrize("heavy", [256, 8])
def test_against_counting(spark, monkeypatch, heavy):
    """heavy = 8: pairs of more than an eighth of all runs are dealt by their third word."""
    monkeypatch.setattr(co, "HEAVY", heavy)
    monkeypatch.setattr(co, "BUCKET_RUNS", 500)
    monkeypatch.setattr(co, "FLUSH_RUNS", 300)
    rows = texts(1, 150, ["The", "of", "É", "b|1", "x\x00y", "new york", "a b a b"], [" ", " ", "  ", "\t", ". ", ",", "\n"]) + [(9, "Hot Pair " + w, "en", "s", 0) for w in "abcdefgh" for _ in range(60)] + ODD
    got = co.collocations(odd(spark, rows), least=8, top=60).collect()
    assert {tuple(r) for r in got} == by_hand(rows, 8, 60) and len(got) > 100
    assert co.collocations(empty(spark)).count() == 0


def test_hot_pairs_are_found(spark):
    found = spark.createDataFrame([("en", f"hot pair w{i}", 1) for i in range(500)] + [("en", f"a{i} b{i}", 1) for i in range(500)], "lang string, piece string, m long")
    assert 1 <= len(co._heavy_pairs(found)) <= 2


def test_bucket_spills(tmp_path, monkeypatch):
    monkeypatch.setattr(co, "MEMORY", "24MB")
    rng = random.Random(5)
    pieces = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 9))) for _ in range(60000)]
    t = pa.table({"lang": ["en"] * len(pieces), "piece": pieces, "m": [1] * len(pieces)})
    out = co._count((b for _, b in co._tables(t, 1, co.np.zeros(0, int))), 3, str(tmp_path))
    f = collections.Counter(" ".join(w[i : i + k]) for w in (p.split() for p in pieces) for i in range(len(w)) for k in range(1, 5) if i + k <= len(w))
    assert dict(zip(out["phrase"].to_pylist(), out["f"].to_pylist())) == {g: n for g, n in f.items() if n >= 3}
    assert not any(tmp_path.iterdir())
    monkeypatch.setattr(co, "MEMORY", "384MB")
    assert co._count((b for _, b in co._tables(t, 1, co.np.zeros(0, int))), 3, "").num_rows == out.num_rows  # without a folder to spill to


def test_bucket_spills_into_a_folder_that_is_not_there_yet(tmp_path, monkeypatch):
    """The first bucket beyond MEMORY failed: nothing had made the folder for what it spills."""
    monkeypatch.setattr(co, "MEMORY", "24MB")
    rng = random.Random(5)
    t = pa.table({"lang": ["en"] * 60000, "piece": [" ".join(f"w{rng.randrange(300)}" for _ in range(6)) for _ in range(60000)], "m": [1] * 60000})
    count = lambda folder: co._count((b for _, b in co._tables(t, 1, co.np.zeros(0, int))), 3, folder)
    below, there = tmp_path / "leafmill" / "duckdb", tmp_path / "there"
    there.mkdir()
    assert sorted(map(str, count(str(below)).to_pylist())) == sorted(map(str, count(str(there)).to_pylist()))
    assert not any(below.iterdir())
