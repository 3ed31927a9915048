"""The prefix encoding of ``bpe`` for all words of a slice at once, place by place.

Words lie in byte order, so a prefix that words share is one row at its place. For each place the
rows take one step of the automaton, then try the tokens that end there, longest first, against
the last token of the prefix before; arrays take the part of the codec's dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from lodeworks.llm.words import SPACES, text_bytes

#: Words that are worked on at once, and their most symbols; longer ones go one by one.
BLOCK_WORDS = 1 << 16
MOST_SYMBOLS = 48
#: Places for results of pair tests, as a power of two; a later pair takes an earlier one's.
PAIR_BITS = 19
_SYMBOL_BITS = 9
_ID_BITS = 32
#: Rank of what no merge follows.
NEVER = 1 << 40
_MIX = np.uint64(0x9E3779B97F4A7C15)
# classes of bytes: white space, letters (with the two bytes of those from U+00C0 to U+00FF),
# digits, others
_CLASS = np.full(256, 3, np.uint8)
_CLASS[SPACES] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_LEAD = 0xC3


def ranges(lists: Iterable[list]) -> tuple[np.ndarray, list]:
    """The lists one after another, and where each begins."""
    first, flat = [0], []
    for values in lists:
        flat += values
        first.append(len(flat))
    return np.array(first, np.int64), flat


def gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of each code in turn (``sizes`` of them a code, in ``flat``), and how many."""
    n = sizes[codes]
    at = np.repeat((np.cumsum(sizes) - sizes)[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return flat[at], n


def joined(texts: pa.Array, codes: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts ``codes[first[i]:first[i + 1]]`` joined to one text i."""
    taken = texts.take(pa.array(codes))
    _, ends, data = taken.buffers()
    ends = np.frombuffer(ends, np.int64)[first] if len(codes) else np.zeros(len(first), np.int64)
    return pa.Array.from_buffers(
        texts.type, len(first) - 1, [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])


def cut_plain(parts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of plain parts in lower case, the part each belongs to, and the other parts.

    Plain parts hold ASCII and the letters from U+00C0 to U+00FF only, which no rule of
    composition touches, and neither an apostrophe nor what may begin a special token.
    """
    data, offsets = text_bytes(parts)
    n = len(data)
    before = np.append(np.uint8(0), data[:-1]) if n else data
    second = (before == _LEAD) & (data >= 128) & (data < 192)
    odd = ((data >= 128) & (data != _LEAD) & ~second) | (data == 39) | (data == 60)
    odd |= second & ((data == 0x97) | (data == 0xB7))
    sums = np.append(0, np.cumsum(odd))
    other = sums[offsets[1:]] > sums[offsets[:-1]]
    kind = _CLASS[data]
    kind[np.repeat(other, np.diff(offsets))] = 0
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= kind == 2
    new[offsets[:-1][offsets[:-1] < n]] = True
    cuts = np.append(np.flatnonzero(new), n)
    small = data.copy()
    small[((data >= 65) & (data <= 90)) | (second & (data < 0x9F))] += 32
    all_runs = pa.Array.from_buffers(
        pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(small)])
    kept = np.flatnonzero(kind[cuts[:-1]])
    owners = np.searchsorted(offsets, cuts[kept], "right") - 1
    return all_runs.take(pa.array(kept)), owners, np.flatnonzero(other)


class Columns:
    """Automaton, token sizes, merges and spines of a codec as arrays."""

    def __init__(self, first_state, length: dict, merged: dict, rank: dict, right: dict, left: dict):
        states = [first_state]
        for state in states:
            states.extend(state.values())
        number = {id(state): i for i, state in enumerate(states)}
        steps = sorted(
            (i << _SYMBOL_BITS | ord(symbol), number[id(after)])
            for i, state in enumerate(states) for symbol, after in state.items())
        self._steps, self._after = (np.array(x, np.int64) for x in zip(*steps))
        self._shorter = np.array([number.get(id(state.shorter), 0) for state in states])
        self._found_first, found = ranges([token for token, _ in state.found] for state in states)
        self._found = np.array([*found, 0], np.int64)
        top = max(length) + 1
        self._length = np.zeros(top, np.int64)
        self._length[list(length)] = list(length.values())
        pairs = sorted((a << _ID_BITS | b, rank[token]) for (a, b), token in merged.items())
        self._pairs, self._ranks = (np.array(x, np.int64) for x in zip(*pairs, (1 << 62, 0)))
        self._right, self._left = (self._spines(x, top) for x in (right, left))
        self.forget()

    @staticmethod
    def _spines(spines: dict, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, flat = ranges(spines.get(token, []) for token in range(top))
        return first, *(np.array(x, np.int64) for x in zip(*flat))

    def forget(self) -> None:
        """Empty the results of pair tests."""
        self._known = None

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(rows):
            key = state << _SYMBOL_BITS | symbol
            at = np.minimum(np.searchsorted(self._steps, key), len(self._steps) - 1)
            hit = self._steps[at] == key
            out[rows[hit]] = self._after[at[hit]]
            on = ~hit & (state > 0)
            rows, state, symbol = rows[on], self._shorter[state[on]], symbol[on]
        return out

    def _test(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Codec.compatible`` of each pair."""
        result, rows = np.ones(len(left), bool), np.arange(len(left))
        (first, ends, ends_next), (second, starts, starts_next) = self._right, self._left
        i, j = first[left], second[right]
        while len(rows):
            a_next, b_next = ends_next[i], starts_next[j]
            key = ends[i] << _ID_BITS | starts[j]
            at = np.searchsorted(self._pairs, key)
            rank = self._ranks[at]
            across = (self._pairs[at] == key) & (rank < a_next) & (rank <= b_next)
            result[rows[across]] = False
            inner = a_next <= b_next
            on = ~across & ((a_next < NEVER) | ~inner)
            i, j, rows = (i + inner)[on], (j + ~inner)[on], rows[on]
        return result

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the text of both tokens of each pair is encoded as these two."""
        known = self._known  # held here: caches may be emptied while pairs are tested
        if known is None:
            known = self._known = np.full(1 << PAIR_BITS, -1, np.int64)
        key = left << _ID_BITS - 1 | right
        place = (key.astype(np.uint64) * _MIX) >> np.uint64(64 - PAIR_BITS)
        held = known[place]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            out[new] = self._test(left[new], right[new])
            known[place[new]] = key[new] << 1 | out[new]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids of all; the words are ranges of bytes."""
        n = len(sizes)
        places = int(sizes.max(initial=0))
        last = np.empty((places, n), np.int32)  # last token of each word's prefix to that place
        held = last.reshape(-1)
        rows, node, state = np.arange(n), np.zeros(n, np.int64), np.zeros(1, np.int64)
        for place in range(places):
            on = sizes[rows] > place
            rows, node = rows[on], node[on]
            symbol = data[starts[rows] + place] + ((sizes[rows] == place + 1) << 8)
            new = np.ones(len(rows), bool)
            new[1:] = (node[1:] != node[:-1]) | (symbol[1:] != symbol[:-1])
            heads = np.flatnonzero(new)
            state = self._step(state[node[heads]], symbol[heads])
            node = np.cumsum(new) - 1
            last[place, rows] = self._last(held, n, place, rows[heads], state)[node]
        counts, at, taken = np.zeros(n, np.int64), sizes - 1, []
        rows = np.arange(n)
        while len(rows):
            token = held[at * n + rows]
            if token.min() < 0:
                raise ValueError("the vocabulary lacks a byte")
            taken.append((rows, token))
            counts[rows] += 1
            at = at - self._length[token]
            on = at >= 0
            rows, at = rows[on], at[on]
        ends = np.cumsum(counts)
        flat = np.empty(counts.sum(), np.int32)
        for back, (rows, token) in enumerate(taken, 1):
            flat[ends[rows] - back] = token
        return counts, flat

    def _last(self, held: np.ndarray, n: int, place: int, words: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Last token of each prefix up to ``place``, given a word with it and its state."""
        out, rows = np.full(len(words), -1, np.int32), np.arange(len(words))
        at, stop = self._found_first[state], self._found_first[state + 1]
        while True:
            on = at < stop
            rows, words, at, stop = rows[on], words[on], at[on], stop[on]
            if not len(rows):
                return out
            token = self._found[at]
            size = self._length[token]
            fits = size > place  # the whole prefix
            inner = np.flatnonzero(~fits)
            left = held[(place - size[inner]) * n + words[inner]].astype(np.int64)
            inner, left = inner[left >= 0], left[left >= 0]
            fits[inner] = self.compatible(left, token[inner])
            out[rows[fits]] = token[fits]
            on = ~fits
            rows, words, at, stop = rows[on], words[on], at[on] + 1, stop[on]
