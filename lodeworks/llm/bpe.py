"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A sequence of tokens is an encoding exactly if each neighbouring pair is the encoding of the
pair's own text, so every prefix of a word has one last token. An Aho-Corasick automaton over
the vocabulary reports the tokens that are suffixes of the text up to each place, longest
first; the one that is compatible with the last token of the prefix before it is stored, and
following those back from the end gives the ids. No merge loop runs over a text. A prefix that
a word shares with the one before it has the same last tokens, so those are kept. The words of a
slice take these steps together (``bpe_columns``); very long ones go by themselves.

No piece of the tokenizer holds white space, so texts are cut at it and each distinct part is
cut into the tokenizer's own pieces (special tokens, NFC, lower case by code point, its
pattern) once per slice, in sorted order, so that words that begin alike follow one another.
Pieces met before come from a cache of bounded size, which ends with its task: workers go on to
other stages, and hold one codec of a vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodeworks.llm.bpe_columns import (
    BLOCK_WORDS, MOST_SYMBOLS, NEVER, Columns, cut_plain, gathered, joined, ranges)
from lodeworks.llm.words import SPACES, distinct_parts, held_for, lists, released, slices, text_bytes

#: Pieces that each of a worker's two cache generations holds.
CACHE_PIECES = 1 << 16
#: Bytes of text that are digested at once; the more, the fewer parts come again.
DIGEST_BYTES = 1 << 22
#: Results of pair tests that a worker holds.
CACHE_PAIRS = 1 << 20
_ID_BITS = 32
# White space and piece pattern of the vocabulary's tokenizer; letters and digits
# that the regex module knows but the tokenizer does not; upper-case letters that the tokenizer
# knows but this Python does not (first, last, distance to the small letter).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PIECES = rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+"
#: The same over lower-cased ASCII, where the plain module does.
_ASCII_PIECES = re.compile(rf"{_CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC),
    (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]
_NEW_UPPER = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
_END = "</w>"


class Vocabulary(NamedTuple):
    """What a tokenizer file says; its size is fixed by the file, not by the data."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    specials: dict[str, int]
    #: digest of the file, by which workers know it
    digest: str | None = None


def read_vocabulary(path: str) -> Vocabulary:
    """Vocabulary of a word-end BPE file; refuses files of another kind."""
    with open(path, "rb") as file:
        raw = file.read()
    spec = json.loads(raw)
    model = spec["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != _END or spec["decoder"] is not None:
        raise ValueError("not a BPE vocabulary with word ends")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
    return Vocabulary(model["vocab"], merges, specials, hashlib.sha256(raw).hexdigest())


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], more = chr(more), more + 1
    return [letters[b] for b in range(256)]


def _span_text(spans: list[tuple[int, int]]) -> str:
    """Spans of code points as the inside of a character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


class State(dict):
    """State of the automaton: the next one by symbol, the state of the longest suffix, and the
    tokens (id, size) that end here, longest first."""

    __slots__ = ("shorter", "found")


def automaton(words: list[tuple[str, int]]) -> State:
    """Aho-Corasick automaton over the tokens' symbols; returns its first state."""
    first = State()
    first.shorter, first.found = None, ()
    for symbols, token in words:
        state = first
        for symbol in symbols:
            after = state.get(symbol)
            if after is None:
                after = state[symbol] = State()
                after.found = ()
            state = after
        state.found = ((token, len(symbols)),)
    level = [first]
    while level:
        following = []
        for state in level:
            for symbol, after in state.items():
                shorter = state.shorter
                while shorter is not None and symbol not in shorter:
                    shorter = shorter.shorter
                after.shorter = first if shorter is None else shorter[symbol]
                after.found += after.shorter.found
                following.append(after)
        level = following
    return first


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        letters = _byte_letters()
        byte_of = {letter: chr(b) for b, letter in enumerate(letters)}
        self.token_text = {i: t for t, i in vocabulary.ids.items()}
        self.token_text.update({i: t for t, i in vocabulary.specials.items()})
        self._specials = vocabulary.specials
        self._cut = regex.compile("|".join(map(regex.escape, vocabulary.specials)) or r"(?!)")
        self._pieces = regex.compile(_PIECES)
        spans = [*_NEWER, *((a, b) for a, b, _ in _NEW_UPPER)]
        self._unusual = regex.compile(f"[{_span_text(spans)}]")
        new = f"[{_span_text(_NEWER)}]"
        self._careful = regex.compile(
            rf"{_CONTRACTIONS}|(?:(?!{new})\p{{L}})+|(?!{new})\p{{N}}|(?:{new}|[^{_WHITE}\p{{L}}\p{{N}}])+")
        self._lower = {
            c: c + by for first, to, by in _NEW_UPPER for c in range(first, to + 1)
            if chr(c).lower() == chr(c)}
        self._length: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        self._merged: dict[tuple[int, int], int] = {}
        self._rank: dict[int, int] = {}
        for rank, (left, right) in enumerate(vocabulary.merges):
            pair = (vocabulary.ids[left], vocabulary.ids[right])
            token = vocabulary.ids[left + right]
            parts[token], self._merged[pair], self._rank[token] = pair, token, rank
        words = []
        for text, token in vocabulary.ids.items():
            ended = text.endswith(_END) and text != _END
            body = text[: -len(_END)] if ended else text
            if (token not in parts and len(body) != 1) or any(c not in byte_of for c in body):
                continue  # no bytes and merges lead to it
            symbols = "".join(byte_of[c] for c in body)
            if ended:  # the last byte of a word is a symbol of its own
                symbols = symbols[:-1] + chr(256 + ord(symbols[-1]))
            words.append((symbols, token))
            self._length[token] = len(symbols)
        self._automaton = automaton(words)
        # the word before, with the state and the last token at each of its places
        self._word, self._states, self._last = "", [], []
        # each token's last (first) symbol, then what it merges into on the way to the token,
        # with the rank at which the next merge comes
        self._right = {t: self._spine(t, parts, 1) for t in self._length}
        self._left = {t: self._spine(t, parts, 0) for t in self._length}
        self._tests: dict[int, bool] = {}
        self._columns = Columns(
            self._automaton, self._length, self._merged, self._rank, self._right, self._left)
        self._new: dict[str, list[int]] = {}
        self._old: dict[str, list[int]] = {}
        # texts of the tokens, with the space that joins them to the next one
        texts = [self.token_text.get(i, "") for i in range(max(self.token_text) + 1)]
        self._id_texts = pa.array([f"{i} ".encode() for i in range(len(texts))], pa.large_binary())
        self._spaced = pa.array([f"{text} ".encode() for text in texts], pa.large_binary())

    def _spine(self, token: int, parts: dict, side: int) -> list[tuple[int, int]]:
        spine = [(token, NEVER)]
        while token in parts:
            rank = self._rank[token]
            token = parts[token][side]
            spine.append((token, rank))
        return spine[::-1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of both tokens is encoded as these two tokens."""
        known = self._tests.get(left << _ID_BITS | right)
        if known is not None:
            return known
        result, i, j = True, 0, 0
        ending, starting, merged, rank = self._right[left], self._left[right], self._merged, self._rank
        while True:
            (a, a_next), (b, b_next) = ending[i], starting[j]
            token = merged.get((a, b))
            if token is not None and rank[token] < a_next and rank[token] <= b_next:
                result = False  # a merge across the border comes before both inner ones
                break
            if a_next <= b_next:
                if a_next == NEVER:
                    break
                i += 1
            else:
                j += 1
        if len(self._tests) >= CACHE_PAIRS:
            self._tests.clear()
        self._tests[left << _ID_BITS | right] = result
        return result

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of a word given as one symbol a byte."""
        same = 0
        for one, other in zip(self._word, symbols):
            if one != other:
                break
            same += 1
        last, states, state = self._last, self._states, self._automaton
        del last[same:], states[same:]
        if same:
            state = states[-1]
        self._word, self._states, self._last = symbols, states, last
        tests, compatible = self._tests, self.compatible
        for end in range(same, len(symbols)):
            symbol = symbols[end]
            while (after := state.get(symbol)) is None and state.shorter is not None:
                state = state.shorter
            if after is not None:
                state = after
            states.append(state)
            for token, size in state.found:
                if size > end:
                    break  # the whole prefix
                left = last[end - size]
                if left >= 0:
                    fits = tests.get(left << _ID_BITS | token)
                    if compatible(left, token) if fits is None else fits:
                        break
            else:
                token = -1
            last.append(token)
        length = self._length
        ids, at = [], len(symbols) - 1
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= length[token]
        return ids[::-1]

    def _encode_piece(self, text: str) -> list[int]:
        if text[0] == " ":
            return [self._specials[text[1:]]]
        raw = text.encode("utf-8").decode("latin-1")
        return self.encode_symbols(raw[:-1] + chr(256 + ord(raw[-1])))

    def piece(self, text: str) -> list[int]:
        """Ids of one of the texts that ``cut`` gives."""
        found = self._new.get(text)
        if found is None:
            found = self._old.get(text) or self._encode_piece(text)
            if len(self._new) >= CACHE_PIECES:
                self._old, self._new = self._new, {}
            self._new[text] = found
        return found

    def cut(self, text: str) -> list[str]:
        """Pieces of a whole text in order, special tokens with a space before them."""
        if "<" not in text:
            return self._cut_text(text)
        at, out = 0, []
        for special in self._cut.finditer(text):
            out += self._cut_text(text[at:special.start()])
            out.append(f" {special.group()}")
            at = special.end()
        return out + self._cut_text(text[at:])

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each part of a text, and the ids of all; sorted parts go faster."""
        plain, owners, others = cut_plain(pa.array(parts, pa.large_string()))
        first, more = ranges(map(self.cut, map(parts.__getitem__, others.tolist())))
        found = pa.concat_arrays([plain, pa.array(more, pa.large_string())]).dictionary_encode()
        owners = np.append(owners, np.repeat(others, np.diff(first)))
        order = np.argsort(owners, kind="stable")
        sizes, flat = self._encode_pieces(found.dictionary)
        ids, n = gathered(flat, sizes, found.indices.to_numpy()[order])
        return np.bincount(owners[order], n, len(parts)).astype(np.int64), ids

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(pieces)
        starts, lengths = offsets[:-1], np.diff(offsets)
        alone = lengths > MOST_SYMBOLS
        alone[~alone] = data[starts[~alone]] == 32
        sizes, flat = np.zeros(len(pieces), np.int64), []
        together = np.flatnonzero(~alone)
        for low in range(0, len(together), BLOCK_WORDS):
            own = together[low:low + BLOCK_WORDS]
            sizes[own], ids = self._columns.encode(data, starts[own], lengths[own])
            flat.append(ids)
        rest = np.flatnonzero(alone)
        found = [self.piece(text) for text in pieces.take(pa.array(rest)).to_pylist()]
        sizes[rest] = list(map(len, found))
        flat.append(np.fromiter(chain.from_iterable(found), np.int32, sizes[rest].sum()))
        # back from the order in which they were encoded
        done = np.append(together, rest)
        back = np.empty(len(done), np.int64)
        back[done] = np.arange(len(done))
        return sizes, gathered(np.concatenate(flat), sizes[done], back)[0]

    def texts(self, sizes: np.ndarray, ids: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Texts of the ids and of the tokens of each part, each with a space after it."""
        first = np.append(0, np.cumsum(sizes))
        return joined(self._id_texts, ids, first), joined(self._spaced, ids, first)

    def _cut_text(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_PIECES.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # code point by code point: no rule for a sigma at the end of a word
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        if self._unusual.search(text):
            return self._careful.findall(text.translate(self._lower))
        return self._pieces.findall(text)

    def forget(self) -> None:
        """Empty the caches."""
        self._tests.clear()
        self._columns.forget()
        self._new, self._old = {}, {}
        self._word, self._states, self._last = "", [], []

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.cut(text) for i in self.piece(piece)]

    def decode(self, ids) -> str:
        """Token texts joined by a space, as the vocabulary has no decoder; unknown ids vanish."""
        return " ".join(t for t in map(self.token_text.get, ids) if t is not None)


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    return held_for(shared, Codec, shared.value.digest)


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut where words begin: code of each part, first part of each text, sorted parts."""
    data, offsets = text_bytes(texts)
    cut = np.zeros(len(data), bool)
    cut[1:] = SPACES[data[:-1]] & ~SPACES[data[1:]]
    return distinct_parts(data, offsets, cut, ordered=True)


def _per_text(values: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(values[codes]))
    return sums[first[1:]] - sums[first[:-1]]


def _sha256(texts: pa.Array) -> list[str]:
    """Digests of the texts without their last byte, a space; an empty one has none."""
    _, offsets, data = texts.buffers()
    data = memoryview(data)
    ends = np.frombuffer(offsets, np.int64).tolist()
    return [hashlib.sha256(data[a:max(b - 1, a)]).hexdigest() for a, b in zip(ends, ends[1:])]


def encode_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids: token ids of each whole text; a null text is empty.

    One row per row, ids of empty texts are an empty list; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def encoded(batches, codec):
        for batch in slices(batches, "text"):
            codes, first, parts = _parts(batch.column(1))
            sizes, flat = codec.encode_parts(parts)
            ends = np.append(0, np.cumsum(_per_text(sizes, codes, first)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(gathered(flat, sizes, codes)[0], ends, pa.int32())],
                names=["doc_id", "ids"])

    def encode(batches):
        codec = _codec(shared)
        return released(encoded(batches, codec), codec.forget)

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, text: decoded texts of ``ids``; null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def decode(batches):
        codec = _codec(shared)
        for batch in batches:
            texts = [codec.decode(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def token_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded then decoded.

    The digests are of the ids joined by a space and of the decoded text; both are made of
    the texts of the distinct parts. One row per row; null and empty texts have no tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def digest(batches, codec):
        for batch in slices(batches, "text", DIGEST_BYTES):
            codes, first, parts = _parts(batch.column(1))
            sizes, ids = codec.encode_parts(parts)
            digests = [_sha256(joined(texts, codes, first)) for texts in codec.texts(sizes, ids)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_per_text(sizes, codes, first), pa.int64()),
                 *(pa.array(x, pa.string()) for x in digests)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def digest_all(batches):
        codec = _codec(shared)
        return released(digest(batches, codec), codec.forget)

    return docs.select("doc_id", "text").mapInArrow(
        digest_all, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
