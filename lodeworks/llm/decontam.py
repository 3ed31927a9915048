"""Benchmark decontamination by word windows, template windows and slot consistency.

Every item with a word or a number is searched word for word (case and punctuation aside), by
windows of its tokens; an item shorter than a window is one window, whatever its length and
words. Besides, texts become templates: numbers, names (capitals, neighbours as one) and units
after a number turn into typed placeholders. Item and document are read the same way, and in
three ways: capitals at sentence starts are plain words, or names, or no capital is a name
(titles, texts in capitals). Windows of documents are joined by hash with those of the
benchmark's items. Along each alignment of a document with an item, slot values of a type must
map one to one; so a question with other numbers or names is found, and a chance meeting of
templates is not.

Windows of documents are first looked up in the sorted hashes of a block of items, a
broadcast of at most ``BLOCK_WINDOWS`` numbers whatever the benchmark's size; a larger
benchmark is searched block by block. Only windows that hit are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.words import BYTES, FOLDED, grams, runs, slices, text_bytes, within
from lodeworks.session import stage_table

WINDOW = 8
#: Templates of fewer tokens are too short to tell; such items are searched word for word only.
MIN_TOKENS = 5
#: Share of an item's tokens that a document must hold.
MIN_COVER = 0.5
#: Readings of a text: its own tokens, and templates by what counts as a name.
WORDS, INNER_NAMES, ALL_NAMES, NO_NAMES = range(4)
BLOCK_WINDOWS = 1 << 20

_UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers g mg kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces "
    "ton tons l ml liter liters litre litres s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years dollar dollars cent cents euro euros percent degree "
    "degrees v w kw j kj n pa hz"
).split()
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[0x80:] = True
_SENTENCE_ENDS = np.zeros(256, bool)
_SENTENCE_ENDS[[ord(c) for c in ".!?:\n\r\""]] = True
_NUMBER, _NAME, _UNIT = (np.uint64(0xA5A5A5A500000000 + i) for i in range(3))
_POINT, _COMMA = 0xFE, 0xFF  # marks inside a number; no UTF-8 text has these bytes
_NUMERALS = _DIGITS.copy()
_NUMERALS[[_POINT, _COMMA]] = True
_KINDS = " #@%"  # plain word, number, name, unit


def _unit_hashes() -> np.ndarray:
    data, offsets = text_bytes(pa.array(_UNITS))
    return np.unique(runs(data, offsets, ~_LETTERS, FOLDED).hashes)


_UNIT_HASHES = _unit_hashes()


class Template(NamedTuple):
    """Tokens of all texts of a slice in one reading: ``first[i]:first[i + 1]`` are those of text i."""

    codes: np.ndarray
    kinds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def slots(self, at: int, size: int) -> list[str]:
        """Values of the placeholders of a window, their type in front."""
        out = []
        for t in range(at, at + size):
            if self.kinds[t]:
                raw = self.data[self.starts[t]:self.ends[t]].tobytes().decode("utf-8", "replace")
                out.append(_KINDS[self.kinds[t]] + " ".join(raw.split()))
        return out


def templates(column: pa.Array) -> list[Template]:
    """All readings of a text column; punctuation is no token."""
    data, offsets = text_bytes(column)
    whole = data
    if len(data) > 2:  # marks inside a number belong to it
        inner = ((data[1:-1] == 46) | (data[1:-1] == 44)) & _DIGITS[data[:-2]] & _DIGITS[data[2:]]
        if inner.any():
            whole = data.copy()
            whole[1:-1][inner] = np.where(data[1:-1][inner] == 46, _POINT, _COMMA)
    numbers = runs(whole, offsets, ~_NUMERALS, BYTES)
    letters = runs(data, offsets, ~_LETTERS, FOLDED)
    starts = np.concatenate([numbers.starts, letters.starts])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    ends = np.concatenate([numbers.ends, letters.ends])[order]
    own = np.concatenate([numbers.hashes, letters.hashes])[order]
    number = order < len(numbers.starts)
    first = np.searchsorted(starts, offsets)
    after = np.zeros(len(starts), bool)  # follows another token of its text
    after[1:] = True
    after[first[:-1][first[:-1] < len(starts)]] = False
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SENTENCE_ENDS[data], out=stops[1:])
    inside = after.copy()
    inside[1:] &= stops[starts[1:]] == stops[ends[:-1]]
    capital = np.zeros(len(starts), bool)
    if len(starts):
        capital = (data[starts] >= 65) & (data[starts] <= 90) & ~number
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & after[1:] & ~number[1:]
    unit &= np.isin(own, _UNIT_HASHES)
    out = [Template(own, np.zeros(len(starts), np.int8), starts, ends, first, data)]
    for name in (capital & inside & ~unit, capital & ~unit, np.zeros(len(starts), bool)):
        kinds = number + 2 * name + np.int8(3) * unit
        codes = np.where(number, _NUMBER, np.where(name, _NAME, np.where(unit, _UNIT, own)))
        more = np.zeros(len(starts), bool)  # goes on with a name
        more[1:] = name[1:] & name[:-1] & inside[1:]
        keep = ~more
        last = np.append(np.flatnonzero(keep)[1:], len(starts)) - 1
        out.append(Template(
            codes[keep], kinds[keep], starts[keep], ends[last] if len(starts) else ends,
            np.append(0, np.cumsum(keep))[first], data))
    return out


def _telling(made: Template, low: int, high: int, size: int, reading: int) -> list[int]:
    """Places of an item's windows to search: all of its words; of a template, those half of
    plain words or, if it has none, those with a plain word."""
    places = range(low, high - size + 1)
    if reading == WORDS:
        return list(places)
    plain = [int((made.kinds[at:at + size] == 0).sum()) for at in places]
    least = -(-size // 2) if max(plain, default=0) * 2 >= size else 1
    return [at for at, n in zip(places, plain) if n >= least]


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of the items: reading, size, hash, item_id, place, item's tokens, slot values.

    An item shorter than a window is one window of its own length.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, rows = batch.column(0).to_pylist(), []
            for reading, made in enumerate(templates(batch.column(1))):
                counts = np.diff(made.first)
                sizes = np.minimum(counts, window)
                for size in np.unique(sizes[sizes >= (1 if reading == WORDS else MIN_TOKENS)]).tolist():
                    hashes = grams(made.codes, size)
                    for i in np.flatnonzero(sizes == size).tolist():
                        low, high = int(made.first[i]), int(made.first[i + 1])
                        for at in _telling(made, low, high, size, reading):
                            rows.append((reading, size, int(hashes[at].view(np.int64)), ids[i],
                                         at - low, high - low, made.slots(at, size)))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(_ITEM.names, row)) for row in rows], schema=_ITEM)

    return benchmark.select("item_id", "text").where("item_id is not null").mapInArrow(
        cut, "reading int, size int, hash long, item_id long, item_at int, item_tokens int, "
        "item_slots array<string>")


_ITEM = pa.schema([
    ("reading", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("item_id", pa.int64()), ("item_at", pa.int32()),
    ("item_tokens", pa.int32()), ("item_slots", pa.list_(pa.string())),
])
_HIT = pa.schema([
    ("doc_id", pa.int64()), ("reading", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()),
    ("at", pa.int64()),
    ("slots", pa.list_(pa.string())),
])


def _hits(docs: DataFrame, known: dict[tuple[int, int], np.ndarray], window: int) -> DataFrame:
    """Windows of the documents whose hash is among the known ones of their reading and size."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def look_up(batches):
        for batch in slices(batches, "text"):
            ids, rows = batch.column(0).to_pylist(), []
            read = templates(batch.column(1))
            owned = [np.repeat(np.arange(len(ids)), np.diff(made.first)) for made in read]
            for (reading, size), hashes in shared.value.items():
                made, owners = read[reading], owned[reading]
                own = grams(made.codes, size)
                places = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                found = np.flatnonzero(within(made.first, size, len(made.codes)) & (hashes[places] == own))
                if reading == WORDS and size < window:  # whole items: once a text tells all
                    pairs = np.stack([owners[found].astype(np.uint64), own[found]])
                    found = found[np.unique(pairs, axis=1, return_index=True)[1]]
                for at in found.tolist():
                    rows.append((ids[owners[at]], reading, size, int(own[at].view(np.int64)),
                                 at - int(made.first[owners[at]]), made.slots(at, size)))
            if rows:
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(_HIT.names, row)) for row in rows], schema=_HIT)

    return docs.mapInArrow(
        look_up, "doc_id long, reading int, size int, hash long, at long, slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, windows, cover, exact: each item that a document holds.

    ``cover`` is the share of the item's tokens found in consistent windows, at least
    ``MIN_COVER``, in the reading in which it is largest; ``exact`` says that all slot values
    found there are the item's own, otherwise the item is re-parameterised. Null and empty texts
    and items, and items of punctuation only, hold nothing; items without an id
    are left out; rows that share an id are searched together. Columns other than ids and
    texts are not looked at.
    """
    docs = docs.select("doc_id", "text")
    items = stage_table(item_windows(benchmark, window), "items")
    blocks = -(-items.count() // BLOCK_WINDOWS)
    number = F.pmod(F.hash("hash"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    found = []
    for block in range(blocks):
        known: dict[tuple[int, int], list[int]] = {}
        own = items.where(number == block).select("reading", "size", "hash").distinct()
        for reading, size, value in own.collect():
            known.setdefault((reading, size), []).append(value)
        found.append(_hits(docs, {
            kind: np.sort(np.array(values, np.int64).view(np.uint64)) for kind, values in known.items()},
            window))
    if not found:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, windows long, cover double, exact boolean")
    hits = stage_table(reduce(DataFrame.union, found), "hits")
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots"))))
    aligned = hits.join(items, ["reading", "size", "hash"]).groupBy(
        "doc_id", "item_id", "item_tokens", "reading", "size", (F.col("at") - F.col("item_at")).alias("shift"),
    ).agg(F.collect_set("item_at").alias("places"), pairs.alias("pairs"))
    one_to_one = (
        (F.size("pairs") == F.size(F.array_distinct("pairs.item_slots")))
        & (F.size("pairs") == F.size(F.array_distinct("pairs.slots"))))
    same = F.forall("pairs", lambda p: p["item_slots"] == p["slots"])
    return (
        aligned.where(one_to_one)
        .groupBy("doc_id", "item_id", "item_tokens", "reading", "size")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.every(same).alias("exact"))
        .withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform(
            "places", lambda p: F.sequence(p, p + F.col("size") - 1))))))
        .withColumn("cover", F.col("covered") / F.col("item_tokens"))
        .where(F.col("cover") >= MIN_COVER)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("cover", "exact", F.size("places").cast("long").alias("windows"))).alias("best"))
        .select("doc_id", "item_id", "best.windows", F.round("best.cover", 4).alias("cover"), "best.exact")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; null ids stay."""
    found = leaks(docs, benchmark, window).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
