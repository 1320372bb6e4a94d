"""Spans of the texts of a batch by classes of bytes, and each span's number in a dictionary; no loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of bytes; 0 separates words.
BLANK = 0
SPACES = b"\x20\t\n\x0b\x0c\r"


def classes(blank: bytes = SPACES, **more: bytes) -> np.ndarray:
    """A table of 256 classes: 0 for blanks, then a number for each further set in the order given, and the last for all other bytes."""
    out = np.full(256, len(more) + 1, np.uint8)
    out[list(blank)] = BLANK
    for i, of in enumerate(more.values()):
        out[list(of)] = i + 1
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each starts, with the end. Null is empty."""
    a = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, at - at[0]


def word_starts(inside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where stretches of True start; none goes on from one text into the next."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(inside)]
    first[edge] = inside[edge]
    return np.flatnonzero(first)


def numbered(buf: np.ndarray, inside: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each span in a dictionary of the distinct ones. Spans end at the next start or where `inside` does."""
    spans = spans_of(buf, inside, start).dictionary_encode()
    return spans.indices.to_numpy(), spans.dictionary


def spans_of(buf: np.ndarray, inside: np.ndarray, start: np.ndarray) -> pa.Array:
    """The spans' bytes."""
    place = np.cumsum(inside, dtype=np.int64)
    at = np.append(place[start] - 1, place[-1] if len(place) else 0)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(buf[inside])])


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut apart into ones of some `most` bytes of text; a longer text is one of its own."""
    held, size = [], 0
    for b in batches:
        at = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(text).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False))])
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most - size, "right")) - 1)
            held.append(b.slice(i, j - i))
            size += int(at[j] - at[i])
            i = j
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        out = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield from out[:1]
