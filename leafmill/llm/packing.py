"""Packing documents into sequences of one length: sum-of-squares placement over an array of fill levels.

Each task is a packer of its own over the rows it reads, so nothing is shuffled. A document gives as many full windows
as it can; what is left of it, shorter than a window, goes to the fill level where the sum of the squared numbers of
partly filled windows grows least. At the end of its rows a packer joins the windows that are still open end to end
and cuts them again; the last tokens form windows whose lengths are powers of two. So nothing at all is padded.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes, schema_with, slices

#: Open windows of a packer; when there are more they are joined and cut, so a packer's memory is bounded.
MOST_OPEN = 4096
#: Distinct stretches that are encoded as one text.
_JOINED = 4096
#: Bytes that surely begin a character that is no white space: where one follows a space, byte-level splitting begins a
#: new token at that space, whatever stands before it.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:0xF5] = True


class Encoder:
    """Ids of texts by a byte-level tokenizer file; texts are encoded by stretches between sure token borders, each distinct one once a slice."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the names of special tokens are ordinary text in a text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a character of a token's name is a byte

    def _ids(self, stretches: pa.StringArray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches on end and how many each has; `many` are encoded as one text, which their borders allow."""
        data, off = raw_bytes(stretches)
        texts = [data[off[i] : off[min(i + many, len(stretches))]].tobytes().decode() for i in range(0, len(stretches), many)]
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, "<u4"), *ids])
        return flat, np.diff(np.searchsorted(np.cumsum(self.bytes_of[flat]), off, "right"))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's begin (one more entry: the end)."""
        data, off = raw_bytes(texts)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        free = np.zeros(len(data) + 1, bool)
        free[:-2] = (data[:-1] == 0x20) & _SOLID[data[1:]]
        free[off[1:] - 1] = False  # the last of a text, whatever the next begins with
        border = free.copy()
        border[off] = True
        at = np.flatnonzero(border)
        every = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        codes, begins = every.indices.to_numpy(), np.zeros(len(every.dictionary), bool)
        begins[codes] = free[at[:-1]]  # a stretch that begins so does everywhere
        order = np.argsort(~begins, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        n = int(begins.sum())
        (some, a), (others, b) = self._ids(every.dictionary.take(pa.array(order[:n])), _JOINED), self._ids(every.dictionary.take(pa.array(order[n:])), 1)
        flat, sizes, codes = np.concatenate([some, others]), np.concatenate([a, b]), place[codes]
        begin, ends = np.cumsum(sizes) - sizes, np.concatenate([[0], np.cumsum(sizes[codes])])
        out = flat[np.repeat(begin[codes] - ends[:-1], sizes[codes]) + np.arange(ends[-1])]
        return out, ends[np.searchsorted(at, off)]


class Packer:
    """Windows of `size` ids at most. A piece is (owner, start, ids, tokens of the owner); closed windows are lists of pieces."""

    def __init__(self, size: int = 1024, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.level = np.zeros(size + 1, np.int64)  # open windows by fill
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def _best(self, n: int) -> int:
        """The fill level that takes n more ids where the sum of squares grows least; 0: a new window. Of equals, the fullest."""
        at = np.flatnonzero(self.level[1 : self.size - n + 1]) + 1
        if not len(at):
            return 0
        grows = 2 * (self.level[at + n] - self.level[at]) + np.where(at + n == self.size, 1, 2)
        i = len(at) - 1 - int(np.argmin(grows[::-1]))
        return int(at[i]) if grows[i] <= 2 * self.level[n] + 1 else 0

    def _put(self, window: list, fill: int) -> Iterator[list]:
        if fill == self.size:
            yield window
        else:
            self.open[fill].append(window)
            self.level[fill] += 1

    def add(self, owner, ids: np.ndarray) -> Iterator[list]:
        """Windows that the document fills."""
        whole = len(ids) - len(ids) % self.size
        for at in range(0, whole, self.size):
            yield [(owner, at, ids[at : at + self.size], len(ids))]
        if whole < len(ids):
            n = len(ids) - whole
            fill = self._best(n)
            window = self.open[fill].pop() if fill else []
            self.level[fill] -= fill > 0
            window.append((owner, whole, ids[whole:].copy(), len(ids)))
            yield from self._put(window, fill + n)
            if self.level.sum() > self.most_open:
                yield from self.rest(last=False)

    def rest(self, last: bool = True) -> Iterator[list]:
        """The open windows on end, cut into full ones; last: then into powers of two, and those that are one as they are."""
        pieces = []
        for fill, windows in enumerate(self.open):
            if last and fill & (fill - 1) == 0:
                yield from windows
            else:
                pieces += [p for w in windows for p in w]
        self.open, self.level[:] = [[] for _ in range(self.size + 1)], 0
        left = sum(len(p[2]) for p in pieces)
        while left:
            room = min(self.size, left)
            if last and room < self.size:
                room = 1 << (room.bit_length() - 1)
            window, fill = [], 0
            while fill < room:
                owner, start, ids, tokens = pieces.pop()
                n = min(room - fill, len(ids))
                window.append((owner, start, ids[:n], tokens))
                if n < len(ids):
                    pieces.append((owner, start + n, ids[n:], tokens))
                fill += n
            left -= room
            yield from [window] if last else self._put(window, room)


_kept: dict[str, Encoder] = {}
#: Ids in one Arrow batch of the result.
_BATCH_IDS = 1 << 20


def pack(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row a piece: the columns keep of its document (all by default) with start, length, ids, doc_tokens,
    sequence_id and offset added; older columns so named go.

    A document's ids are those of its text by the tokenizer file `vocabulary`, then end_id. start: ids of the document
    before the piece; ids: binary, unsigned 32-bit little-endian; doc_tokens: of the document, end_id included;
    offset: place in the sequence, without gaps from 0. A sequence holds `size` ids, but for the last few of a packer,
    which hold a power of two. sequence_id: the packer's number * 2**32 + the sequence's, so a task that runs again
    gives the same rows. A row of any id, null too, is a document; a null or empty text is end_id alone; repeated rows
    are packed each; an empty table gives none. A packer holds at most MOST_OPEN open windows and one slice of texts.
    """
    added = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kept = [c for c in (keep or docs.columns) if c not in added]
    schema = schema_with(docs, kept, "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")

    def run(batches):
        encoder = _kept.get(vocabulary) or _kept.setdefault(vocabulary, Encoder(vocabulary))
        packer, sequence = Packer(size), TaskContext.get().partitionId() << 32
        rows, held, own = [], 0, None

        def batch():
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in cols[0]], own[i]) for i in range(len(kept))] + [pa.array(c, t) for c, t in zip(cols[1:], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])], [*kept, *added]
            )

        def windows():
            nonlocal own
            for b in batches:
                own = own or [b.schema.field(c).type for c in kept]
                for part, arr in slices(b, text, 1 << 23):
                    ids, at = encoder.encode(arr)
                    owners = list(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in kept))) if kept else [()] * len(arr)
                    for i, owner in enumerate(owners):
                        yield from packer.add(owner, np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4", copy=False))
            yield from packer.rest()

        for window in windows():
            offset = 0
            for owner, start, ids, tokens in window:
                rows.append((owner, start, len(ids), ids.tobytes(), tokens, sequence, offset))
                offset += len(ids)
            sequence += 1
            held += offset
            if held >= _BATCH_IDS:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum for their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
