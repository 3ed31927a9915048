"""Toxicity grades by cumulative-link ordinal regression on sparse words.

P(grade > k) = sigmoid(w.x - theta_k): one weight a term, shared by all ordered thresholds.
Features are log counts of the terms that set toxic rows apart: words (letter runs, A-Z as
a-z) and the first 4, 5 or 6 bytes of longer words, told apart by a hash of ``HASH_BITS`` bits. The model is fitted on a bounded sample of the
labelled rows and scores every document in one pass without a shuffle. Penalty and limit are
those that do best on parts of the sample left out of choosing terms and fitting.

Labels that have no ``severity`` are graded from ``toxic``: 0 stays 0, and toxic rows are
grade 1 or 2 by whether marking terms are less or more dense in them than in their median.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.words import FOLDED, mix64, runs, slices, text_bytes

#: Labelled rows the model is fitted on at most: those of the smallest hashes of doc_id.
SAMPLE_ROWS = 6000
HASH_BITS = 18
_STEMS = (4, 5, 6)
#: Terms kept as features, and toxic texts a term must occur in.
FEATURES, MIN_TEXTS = 512, 5
#: Penalties tried, parts of the sample and steps of a trial; the better on rows left out is taken.
PENALTIES, PARTS, TRIAL_STEPS = (5e-5, 5e-4, 2e-3), 3, 250
#: Clean rows left out that may count as toxic, and the least chance of a grade above 0 that counts.
WRONG_SHARE, TOXIC_FROM = 0.01, 0.5
_BREAKS = np.ones(256, bool)
_BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[0x80:] = False


class Model(NamedTuple):
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    toxic_from: float = TOXIC_FROM


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of each term, and the number of words in each text."""
    data, offsets = text_bytes(column)
    found = runs(data, offsets, _BREAKS, FOLDED)
    words = found.owners()
    owners, hashes = [words], [found.hashes]
    ends = found.ends - found.starts
    stem = np.zeros(len(words), np.uint64)
    for n in range(max(_STEMS) + 1):
        if n in _STEMS:
            long = ends > n
            owners.append(words[long])
            hashes.append(mix64(stem[long] + np.uint64(n)))
        at = np.minimum(found.starts + n, len(data) - 1)
        stem = stem * np.uint64(0x9E3779B97F4A7C15) + FOLDED[data[at]]
    buckets = np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)
    return np.concatenate(owners), buckets.astype(np.int64), np.diff(found.first)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        owners, buckets, n_words = _terms(batch.column(1))
        pairs, counts = np.unique(owners << HASH_BITS | buckets, return_counts=True)
        ends = np.searchsorted(pairs >> HASH_BITS, np.arange(len(n_words) + 1)).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
            for x in (pairs & ((1 << HASH_BITS) - 1), counts)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words), *lists], names=["grade", "n", "buckets", "counts"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def chances(margin: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each threshold k, one row a text."""
    return _sigmoid(margin[:, None] - thresholds[None, :])


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
    penalty: float = PENALTIES[0], steps: int = 800,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of sparse rows by penalised likelihood (Adam)."""
    top = max(int(grades.max()), 1)
    share = [np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(top)]
    start = np.log((1 - np.array(share)) / np.array(share))
    steps_up = np.log(np.maximum(np.diff(start), 1e-2))
    params = np.concatenate([np.zeros(n_features), start[:1], steps_up])
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = len(grades)
    for step in range(1, steps + 1):
        w, theta = params[:n_features], _ordered(params[n_features:])
        margin = np.bincount(rows, w[columns] * values, minlength=n)
        above = np.column_stack([np.ones(n), chances(margin, theta), np.zeros(n)])
        p = np.maximum(above[np.arange(n), grades] - above[np.arange(n), grades + 1], 1e-12)
        slope = above * (1 - above)
        low, high = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        by_margin = -(low - high) / p / n
        grad_w = np.bincount(columns, by_margin[rows] * values, minlength=n_features) + penalty * w
        by_theta = np.zeros(top)
        for k in range(top):
            by_theta[k] = ((low / p)[grades == k + 1].sum() - (high / p)[grades == k].sum()) / n
        tail = np.cumsum(by_theta[::-1])[::-1]
        grad = np.concatenate([grad_w, tail[:1], tail[1:] * np.exp(params[n_features + 1:])])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        params = params - 0.05 * (first / (1 - 0.9 ** step)) / (
            np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return params[:n_features], _ordered(params[n_features:])


def _ordered(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.append(raw[:1], np.exp(raw[1:])))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model of at most ``sample_rows`` labelled documents.

    Rows without a text or label are left out. With no labelled or no toxic row, nothing is
    toxic. An integer ``severity`` of ``labels`` from 0 up is used as it is.
    """
    graded = "severity" in labels.columns
    sample = (
        labels.select("doc_id", F.col("severity" if graded else "toxic").cast("long").alias("grade"))
        .where("doc_id is not null and grade >= 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # a sample of bounded size
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    found = texts.select("grade", "text").mapInArrow(
        _counted, "grade long, n long, buckets array<long>, counts array<long>").toArrow()
    grades = found["grade"].to_numpy()
    if not len(grades) or not (grades > 0).any():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([np.inf]))
    buckets = found["buckets"].combine_chunks()
    sample_terms = Terms(
        np.repeat(np.arange(len(grades)), pc.list_value_length(buckets).to_numpy()), buckets.flatten().to_numpy(),
        found["counts"].combine_chunks().flatten().to_numpy().astype(float), found["n"].to_numpy(), grades, graded)
    penalty, toxic_from = _tuned(sample_terms)
    return _fitted(sample_terms, np.ones(len(grades), bool), penalty)._replace(toxic_from=toxic_from)


class Terms(NamedTuple):
    """The sample: text, bucket and count of each term, words and grade of each text."""

    rows: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    grades: np.ndarray
    graded: bool


def _fitted(terms: Terms, use: np.ndarray, penalty: float, steps: int = 800) -> Model:
    """Terms chosen and weights fitted on the texts of ``use`` alone."""
    at = use[terms.rows]
    rows, buckets, counts = terms.rows[at], terms.buckets[at], terms.counts[at]
    toxic, size = terms.grades > 0, 1 << HASH_BITS
    hit = np.bincount(buckets[toxic[rows]], minlength=size)
    told = np.bincount(buckets, counts * toxic[rows], minlength=size)
    other = np.bincount(buckets, counts, minlength=size) - told
    scale = max(terms.words[use & ~toxic].sum(), 1) / max(terms.words[use & toxic].sum(), 1)
    # log ratio of the rates in toxic and other texts, weighed by how many toxic texts agree
    odds = np.log((told + 0.5) / (other + 0.5) * scale)
    strength = np.where(hit >= MIN_TEXTS, odds * np.sqrt(hit), -np.inf)
    chosen = np.argsort(-strength, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[strength[chosen] > 0])
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[buckets] >= 0
    rows, columns, counts = rows[keep], place[buckets[keep]], counts[keep]
    grades = terms.grades
    if not terms.graded:
        telling = odds[chosen][columns] > 2
        dense = np.bincount(rows[telling], counts[telling], minlength=len(grades)) / np.maximum(terms.words, 1)
        grades = np.where(toxic, 1 + (dense > np.median(dense[use & toxic])), 0)
    number = np.cumsum(use) - 1
    weights, thresholds = fit_ordinal(
        number[rows], columns, np.log1p(counts), grades[use], len(chosen), penalty, steps)
    return Model(chosen, weights, thresholds)


def _tuned(terms: Terms) -> tuple[float, float]:
    """Penalty and limit that do best on texts left out of choosing terms and of fitting."""
    toxic, n = terms.grades > 0, len(terms.grades)
    part = np.arange(n) % PARTS
    best = None
    for penalty in PENALTIES:
        chance = np.zeros(n)
        for left in range(PARTS):
            if not (toxic & (part != left)).any():
                return PENALTIES[0], TOXIC_FROM
            model = _fitted(terms, part != left, penalty, TRIAL_STEPS)
            out = part[terms.rows] == left
            margin = _weighted(terms.rows[out], terms.buckets[out], terms.counts[out], model, n)
            chance[part == left] = chances(margin, model.thresholds)[part == left, 0]
        sure = np.clip(np.where(toxic, chance, 1 - chance), 1e-6, 1)
        loss = -np.log(sure).mean()
        if best is None or loss < best[0]:
            clean = np.sort(chance[~toxic])
            over = clean[max(len(clean) - 1 - int(WRONG_SHARE * len(clean)), 0)] if len(clean) else 0.0
            best = (loss, penalty, float(np.clip(over * (1 + 1e-9), TOXIC_FROM, 0.95)))
    return best[1:]


def _weighted(rows: np.ndarray, buckets: np.ndarray, counts: np.ndarray, model: Model, n: int) -> np.ndarray:
    place = np.full(1 << HASH_BITS, -1)
    place[model.buckets] = np.arange(len(model.buckets))
    own = place[buckets]
    held = own >= 0
    return np.bincount(rows[held], model.weights[own[held]] * np.log1p(counts[held]), minlength=n)


def margins(column: pa.Array, model: Model) -> np.ndarray:
    """Weighted sum of each text."""
    owners, buckets, n_words = _terms(column)
    pairs, counts = np.unique(owners << HASH_BITS | buckets, return_counts=True)
    return _weighted(pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1), counts, model, len(n_words))


def grade_documents(docs: DataFrame, model: Model, toxic_from: float | None = None) -> DataFrame:
    """doc_id, expected_severity, grade, toxic, kept: one row per document.

    The grade is the most likely one; kept is the opposite of toxic. Null and empty texts have
    no words and get the grade of such a text. Repeated rows and ids are scored row by row.
    """
    limit = model.toxic_from if toxic_from is None else toxic_from

    def score(batches):
        for batch in slices(batches, "text"):
            above = chances(margins(batch.column(1), model), model.thresholds)
            ends = np.column_stack([np.ones(len(above)), above, np.zeros(len(above))])
            toxic = above[:, 0] >= limit
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.round(above.sum(axis=1), 6)),
                pa.array((ends[:, :-1] - ends[:, 1:]).argmax(axis=1), pa.int32()), pa.array(toxic),
                pa.array(~toxic),
            ], names=["doc_id", "expected_severity", "grade", "toxic", "kept"])

    return docs.select("doc_id", "text").mapInArrow(
        score, "doc_id long, expected_severity double, grade int, toxic boolean, kept boolean")
