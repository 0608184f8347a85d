"""Packing against plain encoding, and placement against the definition."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from leafmill.llm import packing, queries

from .test_llm import DIR, ODD, empty, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_stretches_give_the_same_ids():
    e, rng = packing.Encoder(PATH), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "B", "don't", "é", " ", "　", "1", "!", "😀", "\x1c", "\x85", "<|endoftext|>", "word", "\r\n", "日"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "x  ", "a"]
    ids, at = e.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert e.tokenizer.encode(t, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist(), repr(t)


def test_level_is_the_best_by_definition():
    rng, p = random.Random(2), packing.Packer(16, most_open=10**6)
    squares = lambda n: sum(x * x for x in n[1:16])
    for i in range(2000):
        n, level = rng.randint(1, 16), p.level.copy()
        after = []
        for fill in (f for f in range(17 - n) if f == 0 or level[f]):
            now = level.copy()
            now[fill] -= fill > 0
            now[fill + n] += 1
            after.append(squares(now))
        list(p.add(i, np.ones(n, "<u4")))
        assert squares(p.level) == min(after)


def pieces_fit(rows, want):
    """Each document's ids lie in one piece each, sequences have no gaps, and all but powers of two are full."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, ids in want.items():
        own, at = sorted(docs.pop(doc_id), key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not docs
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0


def test_query(spark):
    e = packing.Encoder(PATH).tokenizer
    want = {r.doc_id: [*e.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    pieces_fit(queries.op12_packing(spark, DIR).collect(), want)


def test_odd_rows_and_many_open_windows(spark):
    rows = packing.pack(odd(spark), PATH, keep=["doc_id", "row"]).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ODD} and {r.row for r in rows} == {"w"}
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert [(r.length, np.frombuffer(r.ids, "<u4").tolist()) for r in rows if r.doc_id == 2] == [(1, [0])]
    assert packing.digest(packing.pack(empty(spark), PATH)).count() == 0
    p, rng = packing.Packer(1024, most_open=8), random.Random(3)
    docs = [np.arange(rng.randint(1, 3000), dtype="<u4") for _ in range(500)]
    out = [w for i, d in enumerate(docs) for w in p.add(i, d)]
    assert p.level.sum() <= 8
    out += p.rest()
    for i, d in enumerate(docs):
        assert np.array_equal(np.concatenate([x[2] for x in sorted((x for w in out for x in w if x[0] == i), key=lambda x: x[1])]), d)
    assert all(n == 1024 or n & (n - 1) == 0 for n in (sum(len(x[2]) for x in w) for w in out)) and len(out) < 1.01 * sum(map(len, docs)) / 1024 + 10
