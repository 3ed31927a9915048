"""Words, lines and their 64-bit hashes, straight from the bytes of an Arrow text column.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. Hashes are
polynomials over the bytes, so they are the same in every task; nothing is kept per
distinct word and memory follows the size of a slice, not of the vocabulary.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds; a longer text makes a slice of its own. What is worked out
#: of a slice takes up to 60 times as much, and two workers share an executor's memory.
SLICE_BYTES = 1 << 20
_BLOCK = 1 << 18
_STEP = 0x9E3779B97F4A7C15
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers, as a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size:size + more] = out[:more] * np.uint64(pow(base, size, 1 << 64))
        size += more
    return out


_UP = _powers(_STEP, _BLOCK)
_DOWN = _powers(pow(_STEP, -1, 1 << 64), _BLOCK)
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
#: The same values for A-Z as for a-z.
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LINE_ENDS = np.zeros(256, bool)
LINE_ENDS[10] = True


class Runs(NamedTuple):
    """Runs of all texts of a slice in order; ``first[i]:first[i + 1]`` are those of text i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterable[pa.RecordBatch], column: str, size: int | None = None,
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``size`` (SLICE_BYTES) bytes of text, in order."""
    size = size or SLICE_BYTES
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        _, offsets = text_bytes(texts)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def runs(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES,
    values: np.ndarray = BYTES,
) -> Runs:
    """Maximal runs of bytes outside ``breaks``, never across texts."""
    inner = offsets[1:-1]
    all_starts, all_ends, all_sums = [], [], []
    carry = None  # start and hash of a run that reaches the end of the block
    for low in range(0, len(data), _BLOCK):
        block = data[low:low + _BLOCK]
        n = len(block)
        word = ~breaks[block]
        cut = inner[np.searchsorted(inner, low):np.searchsorted(inner, low + n)] - low
        head = word.copy()
        head[1:] &= ~word[:-1]
        head[cut] = word[cut]
        tail = word.copy()
        tail[:-1] &= ~word[1:]
        before = cut[cut > 0] - 1
        tail[before] = word[before]
        starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[block] * _UP[:n], out=sums[1:])
        found = (sums[ends] - sums[starts]) * _DOWN[starts]
        starts, ends = starts + low, ends + low
        if carry is not None:
            if len(starts) and starts[0] == low and not (len(cut) and cut[0] == 0):
                gap = pow(_STEP, low - carry[0], 1 << 64)
                found[0] = np.uint64((carry[1] + gap * int(found[0])) % (1 << 64))
                starts[0] = carry[0]
            else:
                starts = np.append(carry[0], starts)
                ends = np.append(low, ends)
                found = np.append(np.uint64(carry[1]), found)
            carry = None
        if len(ends) and ends[-1] == low + n and low + n < len(data):
            carry = (int(starts[-1]), int(found[-1]))
            starts, ends, found = starts[:-1], ends[:-1], found[:-1]
        all_starts.append(starts)
        all_ends.append(ends)
        all_sums.append(found)
    none = np.zeros(0, np.int64)
    starts = np.concatenate(all_starts) if all_starts else none
    all_starts.clear()
    ends = np.concatenate(all_ends) if all_ends else none
    all_ends.clear()
    found = np.concatenate(all_sums) if all_sums else np.zeros(0, np.uint64)
    all_sums.clear()
    found += (ends - starts).astype(np.uint64)
    return Runs(starts, ends, mix64(found), np.searchsorted(starts, offsets))


def words(column: pa.Array, fold: bool = False) -> Runs:
    """Words of a text column; ``fold`` hashes A-Z as a-z."""
    data, offsets = text_bytes(column)
    return runs(data, offsets, SPACES, FOLDED if fold else BYTES)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each place on; empty if there are fewer."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    total = None
    have, length = hashes, 1  # have: sums over ``length`` values
    base, done = int(_GRAM), 0
    bits = size
    while bits:
        if bits & 1:
            if total is None:
                total, done = have.copy(), length
            else:
                # earlier ``done`` values, then the next ``length``
                keep = len(hashes) - done - length + 1
                shift = np.uint64(pow(base, done, 1 << 64))
                total = total[:keep] + have[done:done + keep] * shift
                done += length
        bits >>= 1
        if bits:
            keep = len(have) - length
            have = have[:keep] + have[length:] * np.uint64(pow(base, length, 1 << 64))
            length *= 2
    return mix64(total + np.uint64(size))


def within(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Whether the ``size`` values from each place on belong to one text."""
    places = max(total - size + 1, 0)
    if not places:
        return np.zeros(0, bool)
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    return owner[:places] == owner[size - 1:]


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over the runs of each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[np.minimum(first[1:], len(flags))] - sums[np.minimum(first[:-1], len(flags))]


def covered(marks: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` values lie in a window of ``size`` that starts at a marked place."""
    edges = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(edges, at, 1)
    np.add.at(edges, np.minimum(at + size, total), -1)
    return np.cumsum(edges[:-1]) > 0


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as a string array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    picked = data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(picked)])


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``values[first[i]:first[i + 1]]`` as row i of a list array."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    held = np.sort(values)
    return held[np.append(True, held[1:] != held[:-1])] if len(held) else held


def distinct_parts(
    data: np.ndarray, offsets: np.ndarray, cut: np.ndarray, ordered: bool = False,
) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut before the marked bytes: code of each part, first part of each text, parts,
    in byte order if ``ordered``."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = cut
    inside[offsets] = True
    cuts = np.flatnonzero(inside)
    found = pa.Array.from_buffers(
        pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    found = found.dictionary_encode()
    codes, parts = found.indices.to_numpy().astype(np.int64), found.dictionary
    if ordered:
        order = pc.sort_indices(parts)
        rank = np.empty(len(parts), np.int64)
        rank[order.to_numpy()] = np.arange(len(parts))
        codes, parts = rank[codes], parts.take(order)
    return codes, np.searchsorted(cuts, offsets), parts.to_pylist()


_HELD: list[tuple[object, object]] = []


def held_for(shared, make: Callable, key: str | None = None):
    """What ``make`` builds from a broadcast value, once per worker; the last four are held.

    Values that come again in other broadcasts, as in another run in the same session, are
    known by ``key`` if they have one: then only one of them is held.
    """
    value = shared.value
    for known, made in _HELD:
        # a value may be an array, which == compares one by one
        if known is value or (key is not None and type(known) is type(key) and known == key):
            return made
    made = make(value)
    _HELD.append((value if key is None else key, made))
    del _HELD[:-4]
    return made


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not every C library has it
    _trim = None


def give_back() -> None:
    """Free memory of the C library and of Arrow goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the values in order, equal ones as they come; number of the distinct value at each
    of those places; where in that order each distinct value begins.

    Takes half the memory of np.unique with all its results.
    """
    order = np.argsort(values, kind="stable")
    held = values[order]
    heads = np.ones(len(held), bool)
    np.not_equal(held[1:], held[:-1], out=heads[1:])
    del held
    return order, np.cumsum(heads, dtype=np.int32) - np.int32(1), np.flatnonzero(heads)


def released(batches: Iterator[pa.RecordBatch], forget: Callable[[], None]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one, or when no more are asked for, ``forget`` is called and
    free Arrow memory goes back to the system.

    Workers stay for the tasks that follow, of whatever query, and what they hold counts there.
    """
    try:
        yield from batches
    finally:
        forget()
        pa.default_memory_pool().release_unused()
