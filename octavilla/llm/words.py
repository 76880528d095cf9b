"""Words of many texts at once, cut out of the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once; a longer text is taken alone.
AT_ONCE = 4 << 20


def byte_table(inside: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    table = np.zeros(256, bool)
    table[np.frombuffer(inside, np.uint8)] = True
    return table


@dataclass
class Words:
    """Words of some texts: their letters in a row, each word's size, and where each text's words begin."""

    letters: np.ndarray
    sizes: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.sizes)

    def of_text(self) -> np.ndarray:
        """The number of the text each word is from."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def array(self) -> pa.Array:
        offsets = np.zeros(len(self.sizes) + 1, np.int32)
        np.cumsum(self.sizes, out=offsets[1:])
        return pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer(offsets), pa.py_buffer(self.letters)])

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Per text its kept words, joined by one space."""
        sizes = self.sizes[keep]
        total = np.concatenate([[0], np.cumsum(keep)])[self.bounds]  # kept words before each text
        letters = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
        word = np.repeat(np.arange(len(sizes)), sizes)
        letters[np.arange(len(word)) + word] = self.letters[np.repeat(keep, self.sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes + 1)])[total]
        # the space after a text's last word goes
        drop = ends[1:][np.diff(total) > 0] - 1
        whole = np.ones(len(letters), bool)
        whole[drop] = False
        gone = np.concatenate([[0], np.cumsum(np.diff(total) > 0)])
        return pa.Array.from_buffers(pa.large_string(), len(total) - 1,
                                     [None, pa.py_buffer((ends - gone).astype(np.int64)), pa.py_buffer(letters[whole])])


def split_words(data: np.ndarray, ends: np.ndarray, inside: np.ndarray, as_byte: np.ndarray | None = None) -> Words:
    """Longest stretches of bytes of ``inside``; ``ends`` holds where texts begin and where the last one ends."""
    within = inside[data]
    begins = within.copy()
    begins[1:] &= ~within[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = within[first]
    letters = data[within]
    start = np.flatnonzero(begins[within])
    sizes = np.diff(np.append(start, len(letters)))
    bounds = np.searchsorted(np.flatnonzero(begins), ends)
    return Words(letters if as_byte is None else as_byte[letters], sizes, bounds)


def text_parts(column: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, where texts begin) of some rows at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        after = max(int(np.searchsorted(ends, ends[row] + at_once, side="right")) - 1, row + 1)
        yield row, after, data[ends[row]:ends[after]], ends[row:after + 1] - ends[row]
        row = after
