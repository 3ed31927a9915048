"""Repeated word windows, found level by level, and their removal.

A window of ``window`` words that starts in two places holds repeated windows of every
shorter length. Levels run from a short length to twice that length and so on up to
``window``: only windows whose short parts were found repeated go on to the next length, and
the search ends early when no candidates survive.

Below the last level, a window is stood for by its least-hashed part of the level's length,
which is the same part wherever the window's words occur; so a level shuffles few parts of a
text, and none of a window's occurrences is missed. Repeats are found by grouped minimum and
maximum, never by gathering places. Texts with equal words are searched once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.words import Runs, covered, grams, runs, slices, text_bytes
from lodeworks.session import stage_table

WINDOW = 35
_NONE = np.zeros(0, np.int64)
#: Marks that go to Spark at a time, and what a row without a doc_id is looked up by.
_BATCH = 1 << 16
_UNNAMED = -(1 << 63)


def levels(window: int) -> list[int]:
    """Lengths to search, each at most twice the one before: half the window, then the window."""
    return [(window + 1) // 2, window] if window > 1 else [window]


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Least value of each ``span`` neighbours."""
    size = 1
    while size * 2 <= span:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = span - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_marks(hashes: np.ndarray, window: int, level: int) -> np.ndarray:
    """For each window of one text, the hash of the part that stands for it."""
    parts = grams(hashes, level)
    return _least(parts, window - level + 1) if len(parts) > window - level else parts[:0]


def _word_hashes(found: Runs, i: int) -> np.ndarray:
    return found.hashes[found.first[i]:found.first[i + 1]]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    flat = np.concatenate(values) if values else _NONE
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64), pa.int64()))


def _marked(hashes: np.ndarray, window: int, level: int, alive: np.ndarray | None, last: int):
    """Distinct marks at ``level`` of the windows still alive, and those that occur twice.

    Parts of one text are told apart by place: a mark counts twice only if two places hold it.
    """
    if len(hashes) < window:
        return _NONE.view(np.uint64), np.zeros(0, bool)
    marks = window_marks(hashes, window, level)
    if alive is not None:
        marks = marks[np.isin(window_marks(hashes, window, last), alive)]
    distinct = np.unique(marks)
    parts = np.sort(grams(hashes, level))
    places = np.searchsorted(parts, distinct, "right") - np.searchsorted(parts, distinct)
    return distinct, places > 1


def _word_text(data: np.ndarray, found: Runs, i: int, keep: np.ndarray | None = None) -> bytes:
    at = slice(found.first[i], found.first[i + 1])
    starts, ends = found.starts[at], found.ends[at]
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return b""
    # each word and one byte for the space after it
    lengths = ends - starts + 1
    stops = np.cumsum(lengths)
    places = np.arange(stops[-1]) + np.repeat(starts - (stops - lengths), lengths)
    out = data[np.minimum(places, len(data) - 1)]
    out[stops - 1] = 32
    return out[:-1].tobytes()


def _surveyed(docs: DataFrame, window: int, level: int) -> DataFrame:
    """Each row's digest of its words, marks of the first level, and the marks repeated within."""
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column(2))
            found = runs(data, offsets)
            n = len(offsets) - 1
            pairs = [_marked(_word_hashes(found, i), window, level, None, 0) for i in range(n)]
            digests = [hashlib.sha256(_word_text(data, found, i)).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.diff(found.first)), pa.array(digests, pa.binary()),
                _lists([m for m, _ in pairs]), _lists([m[t] for m, t in pairs]),
            ], names=["doc_id", "sight", "n_words", "digest", "marks", "twice"])

    return docs.select("doc_id", F.xxhash64("text").alias("sight"), "text").mapInArrow(
        survey, "doc_id long, sight long, n_words long, digest binary, marks array<long>, twice array<long>")


def _repeated(marks: DataFrame) -> DataFrame:
    """key, alive: the marks of each text that start in two places of the corpus."""
    places = marks.groupBy("mark").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.max("within").alias("within"))
    again = places.where("low <> high or within").select("mark")
    return marks.join(again, "mark").groupBy("key").agg(F.collect_set("mark").alias("alive"))


def _texts(batches: Iterator[pa.RecordBatch]):
    """(key, digest, alive, word hashes, data, runs, place) of each text that is the one meant.

    A text is looked up by doc_id and a hash of the text; should another text share both, its
    words tell it apart.
    """
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
        found = runs(data, offsets)
        keys, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, alive in enumerate(batch.column(2)):
            if hashlib.sha256(_word_text(data, found, i)).digest() == digests[i]:
                known = alive.values.to_numpy().view(np.uint64)
                yield keys[i], digests[i], known, _word_hashes(found, i), data, found, i


def _next_marks(alive: DataFrame, window: int, level: int, last: int) -> DataFrame:
    """Marks at ``level`` of the windows whose marks at level ``last`` are repeated."""
    def extend(batches):
        keys, marks, within, held = [], [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys)), pa.array(np.concatenate(marks).view(np.int64)),
                pa.array(np.concatenate(within)),
            ], names=["key", "mark", "within"])

        for key, _, known, hashes, *_ in _texts(batches):
            own, twice = _marked(hashes, window, level, known, last)
            keys.append(np.full(len(own), key, np.int64))
            marks.append(own)
            within.append(twice)
            held += len(own)
            if held >= _BATCH:
                yield batch()
                keys, marks, within, held = [], [], [], 0
        if held:
            yield batch()

    return alive.select("key", "digest", "alive", "text").mapInArrow(
        extend, "key long, mark long, within boolean")


def _cut(alive: DataFrame, window: int) -> DataFrame:
    """digest, n_removed, kept_text of the texts that lose words to their ``alive`` windows."""
    def cut(batches):
        for _, digest, known, hashes, data, found, i in _texts(batches):
            gone = covered(np.isin(grams(hashes, window), known), window, len(hashes))
            yield pa.RecordBatch.from_arrays([
                pa.array([digest], pa.binary()), pa.array([int(gone.sum())], pa.int64()),
                pa.array([_word_text(data, found, i, ~gone)], pa.binary()).cast(pa.string()),
            ], names=["digest", "n_removed", "kept_text"])

    return alive.select("key", "digest", "alive", "text").mapInArrow(
        cut, "digest binary, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row per row of ``docs``.

    Every word covered by a window of ``window`` words that also starts elsewhere is removed,
    judged on the input; kept words are joined by one space. kept_text is given where a text
    lost words and null where it is as it was. Null, empty and short texts lose nothing.
    Repeated rows are copies of each other, so they lose all words if they hold a window;
    rows with an equal or a null doc_id count like any other. Other columns are not looked at.
    """
    named = F.coalesce("doc_id", F.lit(_UNNAMED))
    docs = docs.select("doc_id", "text")
    steps = levels(window)
    survey = stage_table(_surveyed(docs, window, steps[0]), "survey")
    found_as = survey.groupBy("digest", named.alias("ref"), "sight").agg(F.count("*").alias("rows"))
    groups = stage_table(
        found_as.groupBy("digest").agg(
            F.min(F.struct("ref", "sight", "rows")).alias("head"), F.sum("rows").alias("copies"))
        .select("digest", "head.*", "copies", F.xxhash64("digest").alias("key")), "copies")
    repeated_rows = not groups.where("rows > 1").isEmpty()

    def once(rows: DataFrame) -> DataFrame:
        """One row a key, where a text stands in several rows of one id."""
        if not repeated_rows:
            return rows
        return rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates(["key"]))

    # one row stands for all texts of the same words
    heads = once(survey.withColumn("ref", named).join(groups, ["digest", "ref", "sight"]))
    marks = heads.select("key", "twice", F.explode("marks").alias("mark")).select(
        "key", "mark", F.array_contains("twice", F.col("mark")).alias("within"))
    alive = _repeated(marks).join(groups, "key")
    texts = docs.select(named.alias("ref"), F.xxhash64("text").alias("sight"), "text")
    alive = once(texts.join(alive, ["ref", "sight"])).select("key", "digest", "alive", "text", "copies")
    alive = stage_table(alive, "alive")
    last = steps[0]
    for level in steps[1:]:
        found = stage_table(_next_marks(alive, window, level, last), "marks")
        alive = alive.drop("alive").join(_repeated(found), "key")
        last = level
        if level != steps[-1]:
            alive = stage_table(alive, "alive")
            if alive.isEmpty():
                break
    cut = _cut(alive.where("copies = 1"), window).groupBy("digest").agg(
        F.first("n_removed").alias("cut_words"), F.first("kept_text").alias("cut_text"))
    cut = cut.select("digest", "cut_words", "cut_text", F.sha2("cut_text", 256).alias("cut_sha256"))
    copied = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return (
        survey.select("doc_id", "n_words", "digest")
        .join(groups.select("digest", "copies"), "digest").join(cut, "digest", "left")
        .select(
            "doc_id", "n_words",
            F.when(copied, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0)))
            .cast("long").alias("n_removed"),
            F.when(copied, F.sha2(F.lit(""), 256))
            .otherwise(F.coalesce("cut_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
            F.when(copied, F.lit("")).otherwise(F.col("cut_text")).alias("kept_text"))
    )
