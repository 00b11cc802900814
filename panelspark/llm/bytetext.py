"""Vectorised helpers over Arrow string columns, for use inside tasks.

A batch of texts is one UTF-8 buffer plus offsets.  Words, hashes of words and
hashes of windows of words come from a handful of numpy passes over that
buffer, so no Python code runs per word.  Separators are the six ASCII
characters ``[\\x20\\x09-\\x0D]``; every other byte belongs to a word, which is
the same on bytes as on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task (arrays of that many numbers fit a core's cache); one longer text is handled alone.
CHUNK_BYTES = 1 << 18
#: Longest table of powers that is kept (eight of them, of 4 MB each, in a worker).
_KEPT = 1 << 19

_MASK = (1 << 64) - 1
_PRIME = np.uint64((1 << 31) - 1)
_BITS = np.uint64(31)
#: Bases of the two lanes, and of two more for hashes of their own; any numbers drawn at random below the prime do.
_BASES = (1_583_458_089, 784_588_716, 1_914_544_919, 305_368_281)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different salts give independent values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(256, dtype=np.uint64), 77)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, but for a few multiples: below 2**31 + 2**(bits of x - 31)."""
    return (x & _PRIME) + (x >> _BITS)


def _power(n: int, lane: int, inverse: bool) -> np.ndarray:
    """The first n powers of a lane's base (or of its inverse) modulo the prime."""
    key = f"{lane}{inverse}"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size, prime = max(n, CHUNK_BYTES + 1), int(_PRIME)
        base = pow(_BASES[lane], -1, prime) if inverse else _BASES[lane]
        have = np.ones(1, np.uint64)
        while len(have) < size:
            more = have * np.uint64(pow(base, len(have), prime)) % _PRIME
            have = np.concatenate([have, more])
        have = have[:size]
        if size <= _KEPT:  # those of one huge text aren't kept
            _powers[key] = have
    return have[:n]


@dataclass
class Prefix:
    """Prefix sums of a sequence, in both lanes (0 and 1, or 2 and 3)."""

    sums: tuple[np.ndarray, np.ndarray]
    lane: int

    def __len__(self) -> int:
        return len(self.sums[0])


def prefix_hash(values: np.ndarray, other: bool = False) -> Prefix:
    """Prefix sums from which :func:`span_hash` takes the hash of any span.

    A span's hash is a polynomial in its values, taken twice: modulo the prime
    2**31 - 1 at two bases, with 31 other bits of each value.  Different spans of
    n values agree by chance with a probability of at most (n / 2**31) ** 2; the
    other pair of bases gives a hash that agrees by chance independently.
    """
    out, first = [], 2 * other
    for lane, part in enumerate((values & _PRIME, values >> np.uint64(33)), first):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(_fold(part * _power(len(values), lane, False)), out=sums[1:])  # terms below 2**32
        out.append(sums)
    return Prefix(tuple(out), first)


def span_hash(prefix: Prefix, start: np.ndarray | slice, end: np.ndarray | slice, salt: int = 0) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span lies; slices stand for consecutive places."""
    out = None
    for lane, sums in enumerate(prefix.sums, prefix.lane):
        inverse = _power(len(prefix), lane, True)
        x = _fold(_fold(_fold(_fold(sums[end] - sums[start])) * inverse[start]))
        x = np.where(x >= _PRIME, x - _PRIME, x)
        out = x if out is None else out | (x << _BITS)
    if isinstance(start, slice):
        length = np.full(1, end.start - start.start, np.uint64)
    else:
        length = (end - start).astype(np.uint64)
    return mix(out ^ (length * np.uint64(0xD6E8FEB86659FD93)), salt)


@dataclass
class Texts:
    """Some texts: their bytes, where each begins, and the rows they came from."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(column: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cuts a string column into pieces of about chunk_bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


@dataclass
class Words:
    """Words of some texts: byte spans, hashes, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def words(t: Texts, lower: bool = False, separator: np.ndarray = _SEPARATOR) -> Words:
    data = _LOWER[t.data] if lower else t.data
    n = len(data)
    inside = ~separator[data]
    begins = np.zeros(n + 1, bool)
    begins[t.offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    start = np.flatnonzero(after & (begins | ~before))
    end = np.flatnonzero(before & (begins | ~after))
    h = span_hash(prefix_hash(_BYTE_VALUE[data]), start, end)
    return Words(start, end, np.searchsorted(start, t.offsets), data, h)


def windows(w: Words, size: int, salts: tuple[int, ...] = (1, 2)) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of all windows of ``size`` words inside one text, and one hash array per salt."""
    length = np.diff(w.offsets)
    count = np.maximum(length - size + 1, 0)
    start = np.repeat(w.offsets[:-1] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    return start, [span_hash(prefix_hash(mix(w.hash, 100 + s)), start, start + size, s) for s in salts]


def join_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray, between: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces data[start:end] of each text (count says how many) with one byte between them, as bytes and offsets."""
    length = end - start + 1
    to = np.cumsum(length)
    source = np.repeat(start - (to - length), length) + np.arange(int(length.sum()))
    out = np.append(data, np.uint8(between))[source]
    out[to - 1] = between
    ends = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(count)])]
    some = count > 0
    out = np.delete(out, ends[1:][some] - 1)  # the byte after each text's last piece
    return out, ends - np.concatenate([[0], np.cumsum(some)])


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which numbers are among the known ones, which rise."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct numbers, rising, by a sort (which is much faster than hashing here)."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
