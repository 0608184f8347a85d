"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary is a byte trie with failure links. A state also holds how many pieces its failure transition pops
off the front, so a word costs one transition a byte and one addition a failure: piece counts come without pieces.
The method is the linear-time longest-match automaton for word pieces (failure links with precomputed pops).
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import NOT_SPACE, Words, carry, schema_with, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file (base64 piece, rank); read on the driver."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Counts of greedy longest-match pieces of byte strings.

    unknown: a byte that starts no piece counts as one piece of one byte. Every single byte is added to the
    vocabulary for that, so a match always exists.
    """

    def __init__(self, pieces: list[bytes]):
        child: list[dict[int, int]] = [{}]
        is_piece, depth, parent_byte = [False], [0], [(0, 0)]
        for p in [*pieces, *(bytes([b]) for b in range(256))]:
            at = 0
            for c in p:
                nxt = child[at].get(c)
                if nxt is None:
                    nxt = child[at][c] = len(child)
                    child.append({})
                    is_piece.append(False)
                    depth.append(depth[at] + 1)
                    parent_byte.append((at, c))
                at = nxt
            if at:
                is_piece[at] = True
        n = len(child)
        self.child, self.fail, self.pops = child, [0] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            # fail[v]: the state of what is left of v's string once its longest-match pieces are popped off the
            # front as far as is settled; pops[v]: how many are popped.
            if is_piece[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            u, c = parent_byte[v]
            at, popped = self.fail[u], self.pops[u]
            while c not in self.child[at]:
                popped += self.pops[at]
                at = self.fail[at]
            self.fail[v], self.pops[v] = self.child[at][c], popped

    def count(self, word: bytes) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        at = n = 0
        for c in word:
            nxt = child[at].get(c)
            while nxt is None:
                n += pops[at]
                at = fail[at]
                nxt = child[at].get(c)
            at = nxt
        while at:
            n += pops[at]
            at = fail[at]
        return n


#: A worker process keeps its automaton for the next task, and counts of words it has met, this many at most.
_MEMO_WORDS = 200_000
_kept: dict[tuple, tuple[Automaton, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, pieces: list[bytes] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns keep of docs (all by default) with n_words, n_tokens and n_bytes (long); older ones so named go.

    Words are `[^\\x20\\x09-\\x0D]+`; each is matched with one space before it unless its text begins with it, as
    byte-level vocabularies spell words. Other white space counts no token. Null and empty texts: 0, 0, 0. Repeated
    rows are counted each; a word of any length costs time in proportion to its bytes. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces if pieces is not None else load_pieces(vocabulary))
    added = ["n_words", "n_tokens", "n_bytes"]
    kept = [c for c in (keep or docs.columns) if c not in added]
    schema = schema_with(docs, kept, "n_words bigint, n_tokens bigint, n_bytes bigint")

    def run(batches):
        pieces = shared.value
        key = (len(pieces), hash(tuple(pieces)))
        if key not in _kept:
            _kept.clear()
            _kept[key] = (Automaton(pieces), {})
        auto, memo = _kept[key]
        for batch in batches:
            for part, arr in slices(batch, text):
                w = Words(arr, NOT_SPACE)
                raw, own = w.data.tobytes(), np.zeros(len(w), np.int64)
                some = np.flatnonzero(w.counts() > 0)
                first = w.doc_at[some]
                heads = set(first[w.start[first] == w.off[some]].tolist())
                for i, (s, e) in enumerate(zip(w.start.tolist(), w.end.tolist())):
                    word = raw[s:e] if i in heads else b" " + raw[s:e]
                    n = memo.get(word)
                    if n is None:
                        n = auto.count(word)
                        if len(word) <= 64:
                            if len(memo) >= _MEMO_WORDS:
                                memo.clear()
                            memo[word] = n
                    own[i] = n
                sums = np.concatenate([[0], np.cumsum(own)])
                tokens = sums[w.doc_at[1:]] - sums[w.doc_at[:-1]]
                yield carry(part, kept, added, [pa.array(w.counts(), pa.int64()), pa.array(tokens, pa.int64()), pa.array(np.diff(w.off), pa.int64())])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)
