"""Words of UTF-8 texts as arrays: ASCII letters (lower-cased), digits and every character above ASCII.

No byte of a character above ASCII is an ASCII byte, so texts are split as bytes. Words are told apart by their
bytes, through an Arrow dictionary; no hash stands for a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from codelode.llm.common import rows_of

# every byte as itself if it can stand in a word, capital letters as small ones, the others as a blank
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32 for b in range(256))
PIECE = 1 << 24  # bytes split at once


class Words:
    """Words of a few texts, one after the other: code of each word in ``terms``, and the first word of each text."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, terms: pa.Array):
        self.codes, self.first, self.terms = codes, first, terms

    def __len__(self) -> int:
        return len(self.codes)

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _split(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """(start of each word, words) of folded bytes."""
    a = np.frombuffer(data, np.uint8)
    inside = a != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, length = edge[::2], edge[1::2] - edge[::2]
    ends = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=ends[1:])
    return start, pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(a[inside])])


def split(texts: list[bytes], piece: int = PIECE) -> Words:
    """The words of texts. Long texts are split in pieces that end between words, so little but codes is held at once."""
    data = b"\n".join([*texts, b""]).translate(_FOLD)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, words, at = [], [], 0
    while at < len(data):
        end = min(at + piece, len(data))
        if end < len(data):
            end = data.find(b" ", end) + 1 or len(data)
        start, found = _split(data[at:end])
        if len(start):
            starts.append(start + at)
            words.append(found)
        at = end
    if not words:
        return Words(np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64), pa.array([], pa.binary()))
    coded = pa.chunked_array(words).dictionary_encode().unify_dictionaries()
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int32, copy=False)
    return Words(codes, np.searchsorted(np.concatenate(starts), bounds), coded.chunk(coded.num_chunks - 1).dictionary)


def gathered(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows of batches in groups of about ``most`` bytes of text, a longer text in a group of its own; with their texts as bytes."""
    held, size = [], 0
    for batch in batches:
        at = 0
        sizes = np.array([x or 0 for x in pa.compute.binary_length(batch.column(text).cast(pa.binary())).to_pylist()])
        for k, n in enumerate(sizes.tolist()):
            if size and size + n > most:
                held.append(batch.slice(at, k - at))
                yield _group(held, text)
                held, size, at = [], 0, k
            size += n
        held.append(batch.slice(at))
    if sum(b.num_rows for b in held):
        yield _group(held, text)


def _group(held: list[pa.RecordBatch], text: str) -> tuple[pa.Table, list[bytes]]:
    t = pa.Table.from_batches([b for b in held if b.num_rows])
    out = t, [x for b in t.to_batches() for x in rows_of(b, text)]
    pa.default_memory_pool().release_unused()
    return out
