"""Vectorised word tables over Arrow text columns, shared by the text operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Those six are ASCII, so splitting UTF-8 bytes gives the same
words as splitting code points. Everything here works on one Arrow batch inside a task, in slices of about a megabyte of text.

A word's hash has 128 bits in two halves. It is made of eight bytes at a time, and runs of words are hashed by joining the hashes
of halves, both through a scrambling that is not linear, so no arrangement of letters or of words cancels out as it does in
polynomials modulo a power of two. Each half depends on two differently salted passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Salts of the two passes over a word's bytes. All workers of a job have to use the same.
SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
#: Bytes above which a word is hashed as a whole and not eight bytes at a time.
LONG_WORD = 128
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # masks of the first k bytes
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order; for either one given it is a bijection of the other."""
    return mix(x * np.uint64(0xD6E8FEB86659FD93) + mix(y + np.uint64(0x9E3779B97F4A7C15)))


@dataclass
class Words:
    """The words of consecutive rows: bytes, byte ranges of words, and the range of words of each row."""

    first_row: int
    data: np.ndarray
    row_bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row_words: np.ndarray

    def rows(self) -> list[bytes]:
        raw = self.data.tobytes()
        edges = self.row_bytes.tolist()
        return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def hashes(self) -> np.ndarray:
        """The two halves of each word's hash, one row each."""
        n = len(self.starts)
        if not n:
            return np.zeros((2, 0), np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
        left = self.ends - self.starts
        out = [mix(left.astype(np.uint64) + salt) for salt in SALTS]
        todo = np.flatnonzero(left <= LONG_WORD)
        at, left = self.starts[todo], left[todo]
        for k in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():  # rare; a digest of the whole word
            whole = blake2b(self.data[self.starts[k] : self.ends[k]], digest_size=16, key=SALTS.tobytes()).digest()
            out[0][k], out[1][k] = np.frombuffer(whole, "<u8")
        while len(todo):
            more = left - 8 > 0
            chunk = eight[at] & _KEEP[np.minimum(left, 8)]
            for half, salt in zip(out, SALTS, strict=True):
                half[todo] = joined(half[todo], chunk ^ salt)
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return np.stack([joined(out[0], out[1]), joined(out[1], out[0])])

    def numbers(self) -> np.ndarray:
        """A number for each word; equal words of the slice have equal ones, and different words different ones."""
        hashes = self.hashes()
        order = np.lexsort(hashes)
        new = (hashes[:, order[1:]] != hashes[:, order[:-1]]).any(axis=0)
        out = np.zeros(len(order), np.int64)
        out[order[1:]] = np.cumsum(new)
        return out


def text_column(column: pa.Array) -> pa.Array:
    """The column as one contiguous string array from offset zero, nulls empty."""
    column = column.cast(pa.large_string()).fill_null("")
    return pa.concat_arrays([column]) if column.offset else column


def slices(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Word tables of the rows of a text column, about SLICE_BYTES of text in each, whole rows only."""
    column = text_column(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        yield words_of(row, _LOWER[part] if lower else part, offsets[row : stop + 1] - offsets[row])
        row = stop


def words_of(first_row: int, data: np.ndarray, row_bytes: np.ndarray) -> Words:
    """The word table of rows whose bytes lie one after another in data."""
    word = ~_SPACE[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    heads = row_bytes[:-1][np.diff(row_bytes) > 0]  # first bytes of rows that have any
    begin[heads] = word[heads]
    tails = heads[1:] - 1
    end[tails] = word[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(first_row, data, row_bytes, starts, ends, np.searchsorted(starts, row_bytes))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of `size` consecutive word hashes; element i is the run that starts at word i.

    Runs of 1, 2, 4, ... words come from two of half their length; the powers of two in size are joined.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, power, out, covered = words, 1, None, 0
    while True:
        if size & power:
            part = have[covered : covered + n]
            out = part if out is None else joined(out, part)
            covered += power
        if 2 * power > size:
            return mix(out ^ np.uint64(size))
        have = joined(have[: len(have) - power], have[power:])
        power *= 2


def codes(*columns: np.ndarray) -> np.ndarray:
    """One number for each combination of the columns' values (not negative), different ones for different combinations."""
    out, size = columns[0], int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if size * width >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            size = int(out.max(initial=0)) + 1
        out, size = out * width + c, size * width
    return out
