"""Quality rules: divergence of a document from the references of its language.

Two histograms of a document, one over character classes and one over the common words of
its language, are compared with the language's own by Jensen-Shannon distance (base 2, so
from 0 to 1). References are sums over all documents, found by one grouped aggregation in
which a document weighs as much as ``VOTE_WORDS`` words and ``VOTE_CHARS`` code points at
most, so that a few very long ones do not make the language; words are told apart by a hash of ``WORD_BITS`` bits, which bounds what a task holds and
shuffles to one fixed table per language.

Guards: a document of fewer than ``min_words`` words, or of a language that has fewer than
``reference_words`` such weighed words in all, is not judged by distance. Histograms of few words are noisy, so a limit grows by ``slack / sqrt(n)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.words import (
    LINE_ENDS, SPACES, covered, grams, mix64, per_text, runs, slices, text_bytes, within,
)

WORD_BITS = 14
COMMON_WORDS = 100
MIN_WORDS = 50
#: Weighed words that make a reference, however large other languages are; the languages with
#: most words that have one.
REFERENCE_WORDS, LANGUAGES = 1000, 1000
VOTE_WORDS = 500
VOTE_CHARS = 3000
_UNIT = 1 << 14  # weights are whole numbers, so sums do not depend on their order
CHAR_LIMIT = 0.25
WORD_LIMIT = 0.45
SLACK = 1.5
#: Languages that a task sums up before it passes the sums on.
_HELD = 64

_CLASSES = 9
_OTHER_BYTE = 255


def _class_table() -> np.ndarray:
    """Class of each lead byte: space, lower, upper, digit, stop, quote, symbol, control, beyond ASCII."""
    table = np.full(256, 7, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    for characters, kind in ((".,;:!?", 4), ("'\"()-", 5), ("#*$%&|<>@=+/\\^_`{}[]~", 6)):
        table[[ord(c) for c in characters]] = kind
    table[0xC0:] = 8
    table[0x80:0xC0] = _OTHER_BYTE  # continues a code point
    return table


_TABLE = _class_table()
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


class Reference(NamedTuple):
    """Of one language: shares of character classes, its common words and their shares."""

    classes: np.ndarray
    words: np.ndarray
    shares: np.ndarray


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each class in each text."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    kinds = _TABLE[data]
    real = kinds != _OTHER_BYTE
    flat = owner[real] * _CLASSES + kinds[real]
    return np.bincount(flat, minlength=n * _CLASSES).reshape(n, _CLASSES)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _weights(sizes: np.ndarray, most: int) -> np.ndarray:
    return np.maximum(np.minimum(sizes, most) * _UNIT // np.maximum(sizes, 1), 1)


def _language_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush():
        for lang, (classes, counts) in held.items():
            at = np.flatnonzero(counts)
            kinds = np.arange(_CLASSES)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(at) + _CLASSES)),
                pa.array(np.concatenate([at, -1 - kinds])),
                pa.array(np.concatenate([counts[at], classes])),
            ], names=["lang", "bin", "total"])
        held.clear()

    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column(1))
        found = runs(data, offsets)
        classes, bins = class_counts(data, offsets), _buckets(found.hashes)
        langs = batch.column(0).to_pylist()
        owners = found.owners()
        votes = _weights(np.diff(found.first), VOTE_WORDS)
        char_votes = _weights(classes.sum(axis=1), VOTE_CHARS)
        named = {lang: i for i, lang in enumerate(dict.fromkeys(x for x in langs if x is not None))}
        index = np.array([named.get(x, -1) for x in langs], np.int64)
        for lang, i in named.items():
            sums = held.setdefault(
                lang, (np.zeros(_CLASSES, np.int64), np.zeros(1 << WORD_BITS, np.int64)))
            sums[0][:] += char_votes[index == i] @ classes[index == i]
            own = index[owners] == i
            sums[1][:] += np.bincount(
                bins[own], votes[owners[own]], minlength=1 << WORD_BITS).astype(np.int64)
            if len(held) >= _HELD:
                yield from flush()
    yield from flush()


def references(
    docs: DataFrame, common_words: int = COMMON_WORDS, reference_words: int = REFERENCE_WORDS,
) -> dict[str, Reference]:
    """References of all languages that have ``reference_words`` words or more.

    Reads ``lang`` and ``text`` of every document. At most LANGUAGES languages come to
    the driver, each as a fixed number of figures. Null languages have no reference.
    """
    sums = (
        docs.select("lang", "text").mapInArrow(_language_sums, "lang string, bin long, total long")
        .groupBy("lang", "bin").agg(F.sum("total").alias("total"))
    )
    by_lang = Window.partitionBy("lang")  # a fixed number of bins each
    in_order = by_lang.orderBy(F.col("bin") < 0, F.desc("total"), "bin")
    ranked = (
        sums.withColumn("words", F.sum(F.when(F.col("bin") >= 0, F.col("total"))).over(by_lang))
        .withColumn("place", F.row_number().over(in_order))
        .where((F.col("bin") < 0) | (F.col("place") <= common_words))
        .groupBy("lang").agg(
            F.max("words").alias("words"),
            F.sort_array(F.collect_list(F.struct("bin", "total"))).alias("bins"))
    )
    rows = ranked.where(F.col("words") >= reference_words * _UNIT).orderBy(
        F.desc("words"), "lang").limit(LANGUAGES).collect()
    out = {}
    for row in rows:
        classes = np.zeros(_CLASSES)
        for x in row["bins"]:
            if x["bin"] < 0:
                classes[-1 - x["bin"]] = x["total"]
        words = np.array([x["bin"] for x in row["bins"] if x["bin"] >= 0], np.int64)
        counts = np.array([x["total"] for x in row["bins"] if x["bin"] >= 0], float)
        shares = np.append(counts, row["words"] - counts.sum()) / row["words"]
        out[row["lang"]] = Reference(classes / classes.sum(), words, shares)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from ``q``."""
    middle = (p + q) / 2

    def towards(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / middle), 0.0).sum(axis=-1)

    return np.sqrt(np.clip((towards(p) + towards(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def measures(texts: pa.Array, langs: list, refs: dict[str, Reference]) -> dict[str, np.ndarray]:
    """Counts and distances of each text; a distance is NaN where there is no reference."""
    data, offsets = text_bytes(texts)
    found = runs(data, offsets)
    n, total = len(offsets) - 1, len(found.starts)
    owners = found.owners()
    classes = class_counts(data, offsets)
    lead = (_TABLE[data] != _OTHER_BYTE) & ~SPACES[data]
    n_words = np.diff(found.first)

    lines = runs(data, offsets, LINE_ENDS)
    inked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACES[data], out=inked[1:])
    with_word = inked[lines.ends] > inked[lines.starts]
    line_owner = lines.owners()[with_word]
    keys = mix64(lines.hashes[with_word] + line_owner.astype(np.uint64) * np.uint64(_CLASSES | 2**40))
    _, first_at = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first_at] = False

    fives = grams(found.hashes, 5)
    inside = np.flatnonzero(within(found.first, 5, total))
    keys = mix64(fives[inside] + owners[inside].astype(np.uint64) * np.uint64(2**40 + 11))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(fives), bool)
    marks[inside[twice]] = True

    char_distance, word_distance = np.full(n, np.nan), np.full(n, np.nan)
    bins = _buckets(found.hashes)
    for lang in set(langs) & set(refs):
        rows = np.array([x == lang for x in langs]) & (n_words > 0)
        if not rows.any():
            continue
        ref = refs[lang]
        char_distance[rows] = js_distance(
            classes[rows] / np.maximum(classes[rows].sum(axis=1, keepdims=True), 1), ref.classes)
        k = len(ref.words)
        place = np.full(1 << WORD_BITS, k)
        place[ref.words] = np.arange(k)
        local = np.cumsum(rows) - 1
        own = rows[owners]
        flat = local[owners[own]] * (k + 1) + place[bins[own]]
        counts = np.bincount(flat, minlength=int(rows.sum()) * (k + 1)).reshape(-1, k + 1)
        word_distance[rows] = js_distance(counts / counts.sum(axis=1, keepdims=True), ref.shares)
    return {
        "n_words": n_words,
        "word_chars": _sums(lead, offsets),
        "n_symbols": _sums(_SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_owner[again], minlength=n),
        "n_repeat_words": per_text(covered(marks, 5, total), found.first),
        "char_distance": char_distance,
        "word_distance": word_distance,
    }


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def verdicts(
    found: dict[str, np.ndarray], min_words: int, char_limit: float, word_limit: float,
) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of each text."""
    n = found["n_words"]
    base_failed = (n < 10) | (100 * found["n_repeat_words"] > 20 * n)
    slack = SLACK / np.sqrt(np.maximum(n, 1))
    odd = (found["char_distance"] > char_limit + slack / 2) | (
        found["word_distance"] > word_limit + slack)
    return base_failed, ~base_failed & ~((n >= min_words) & odd)


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = (
    "doc_id long, " + ", ".join(f"{x} long" for x in _LONGS)
    + ", base_failed boolean, kept boolean, char_distance double, word_distance double"
)


def quality_report(
    docs: DataFrame, refs: dict[str, Reference] | None = None, min_words: int = MIN_WORDS,
    char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT,
) -> DataFrame:
    """One row per document with its counts, distances and verdict.

    Null and empty texts have no words and fail the base rule; a null or unknown language
    is judged by the base rule alone, its distances are null. Repeated rows and ids are
    judged row by row. Columns other than doc_id, text and lang are not looked at.
    """
    refs = references(docs) if refs is None else refs

    def report(batches):
        for batch in slices(batches, "text"):
            found = measures(batch.column(2), batch.column(1).to_pylist(), refs)
            base_failed, kept = verdicts(found, min_words, char_limit, word_limit)
            distances = [
                pa.array(found[x], mask=np.isnan(found[x]))
                for x in ("char_distance", "word_distance")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[x].astype(np.int64)) for x in _LONGS),
                 pa.array(base_failed), pa.array(kept), *distances],
                names=["doc_id", *_LONGS, "base_failed", "kept", "char_distance", "word_distance"])

    return docs.select("doc_id", "lang", "text").mapInArrow(report, SCHEMA)


def keep_good(
    docs: DataFrame, min_words: int = MIN_WORDS, char_limit: float = CHAR_LIMIT,
    word_limit: float = WORD_LIMIT,
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; no shuffle of texts."""
    refs = references(docs)
    names = docs.columns

    def keep(batches):
        for batch in slices(batches, "text"):
            langs = batch.column(names.index("lang")).to_pylist()
            found = measures(batch.column(names.index("text")), langs, refs)
            yield batch.filter(pa.array(verdicts(found, min_words, char_limit, word_limit)[1]))

    return docs.mapInArrow(keep, docs.schema)
