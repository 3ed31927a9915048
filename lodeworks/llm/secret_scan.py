"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more key characters with a digit, or any such run that a secret
word assigns. Features are its length, the transitions between its character classes, how
well a dictionary of letter trigrams covers it, its path (the row's source) and the words
next to it. The dictionary is a table of fixed size counted over all texts. The forest is
trained on labelled findings, at most ``TRAIN_ROWS`` of each label; where none are given,
findings that clear rules can tell (assigned keys; addresses, numbers and plain words) are
labelled by them, and the forest judges the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.words import FOLDED, slices, text_bytes
from lodeworks.session import stage_table

TRAIN_ROWS = 5000
TREES, DEPTH, SEED = 40, 8, 7
#: Probability from which a finding counts as a secret.
SECRET_FROM = 0.5
MASK = "<SECRET>"
_RUN = re.compile(r"[A-Za-z0-9+/_\-=]{16,}")
_KEY_WORDS = (
    "token secret password passwd pwd apikey api_key key auth authorization bearer credential "
    "credentials access_key private_key client_secret"
).split()
_ASSIGNED = re.compile(
    r"(?i)\b([a-z_]*(?:" + "|".join(_KEY_WORDS) + r"))[\"']?\s{0,3}(?:=>|:=|=|:|\s)\s{0,3}[\"']?$")
_TEST_PATHS = re.compile(r"(?i)test|example|sample|fixture|mock|doc")
_FEATURES = (
    "length", "digits", "uppers", "transitions", "kinds", "entropy", "coverage", "longest_letters",
    "hex_only", "assigned", "quoted", "after_at", "dots", "test_path", "path_depth",
)
FINDING_SCHEMA = (
    "doc_id long, start long, length long, finding string, "
    + ", ".join(f"f_{x} double" for x in _FEATURES) + ", rule int"
)
_A = np.full(256, -1, np.int64)
_A[65:91] = _A[97:123] = np.arange(26)


def _trigram_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(26 ** 3, np.int64)
    for batch in slices(batches, "text"):
        data, _ = text_bytes(batch.column(0))
        if len(data) < 3:
            continue
        code = _A[data]
        use = (code[:-2] >= 0) & (code[1:-1] >= 0) & (code[2:] >= 0)
        keys = (code[:-2] * 676 + code[1:-1] * 26 + code[2:])[use]
        total += np.bincount(keys, minlength=26 ** 3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def dictionary(docs: DataFrame) -> np.ndarray:
    """Which of the 17,576 letter trigrams are as frequent as in plain words of all texts."""
    rows = docs.select("text").where("text is not null").mapInArrow(
        _trigram_sums, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(26 ** 3)
    for row in rows:
        counts[row["gram"]] = row["n"]
    return counts > counts.sum() / 26 ** 3 / 4 if counts.any() else counts > 0


def _classes(text: str) -> str:
    return "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in text)


def features(text: str, start: int, end: int, path: str, common: np.ndarray) -> tuple[list[float], int]:
    """Features of a candidate, and what clear rules say of it: 1, 0, or -1 for nothing."""
    found, before = text[start:end], text[max(0, start - 40):start]
    kinds = _classes(found)
    n = len(found)
    letters = [len(x) for x in re.findall(r"[A-Za-z]+", found)]
    codes = _A[np.frombuffer(found.encode("ascii"), np.uint8)]
    covered = np.zeros(n, bool)
    for i in range(n - 2):
        a, b, c = codes[i:i + 3]
        if a >= 0 and b >= 0 and c >= 0 and common[a * 676 + b * 26 + c]:
            covered[i:i + 3] = True
    _, counts = np.unique(codes if not any(k == "d" for k in kinds) else np.frombuffer(
        found.encode(), np.uint8), return_counts=True)
    shares = counts / n
    digits = kinds.count("d") / n
    hex_only = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", found))
    assigned = bool(_ASSIGNED.search(before))
    quoted = before[-1:] in "\"'`" and bool(before) and text[end:end + 1] == before[-1:]
    after_at = "@" in before.split()[-1] if before.split() and not before[-1:].isspace() else False
    dots = text[end:end + 1] in "." and end < len(text) and text[end + 1:end + 2].isalnum() or before[-1:] == "."
    values = [
        float(n), digits, kinds.count("u") / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / (n - 1),
        float(len(set(kinds))), float(-(shares * np.log2(shares)).sum()), covered.sum() / n,
        float(max(letters, default=0)), float(hex_only), float(assigned), float(quoted),
        float(after_at), float(bool(dots)), float(bool(_TEST_PATHS.search(path))), float(path.count("/")),
    ]
    mixed = digits > 0.1 and letters and max(letters) <= 12
    if assigned and mixed:
        rule = 1
    elif after_at or digits == 1 or (digits == 0 and covered.mean() > 0.8) or (dots and not assigned):
        rule = 0
    else:
        rule = -1
    return values, rule


def candidates(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """All candidates with their features; ``start`` and ``length`` count code points."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    path = F.col("source") if "source" in docs.columns else F.lit("")

    def search(batches):
        names = [part.split()[0] for part in FINDING_SCHEMA.split(", ")]
        for batch in slices(batches, "text"):
            rows = []
            for doc, text, where in zip(*(c.to_pylist() for c in batch.columns)):
                for m in _RUN.finditer(text or ""):
                    found = m.group()
                    has_digit = any(c.isdigit() for c in found)
                    if not has_digit and not _ASSIGNED.search(text[max(0, m.start() - 40):m.start()]):
                        continue
                    values, rule = features(text, m.start(), m.end(), where or "", shared.value)
                    rows.append(dict(zip(names, (doc, m.start(), len(found), found, *values, rule))))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    return docs.select("doc_id", "text", path.cast("string").alias("path")).mapInArrow(search, FINDING_SCHEMA)


_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("finding", pa.string())]
    + [(f"f_{x}", pa.float64()) for x in _FEATURES] + [("rule", pa.int32())])


def train_forest(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """Forest of a bounded sample of labelled findings (feature columns and ``label`` 0 or 1)."""
    ordered = [F.xxhash64("doc_id", "start"), F.col("doc_id"), F.col("start")]
    sample = reduce_union([
        labelled.where(F.col("label") == x).orderBy(*ordered).limit(train_rows) for x in (0, 1)])
    stages = [
        VectorAssembler(inputCols=[f"f_{x}" for x in _FEATURES], outputCol="features"),
        RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED),
    ]
    return Pipeline(stages=stages).fit(sample.withColumn("label", F.col("label").cast("double")))


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    return parts[0].unionByName(parts[1])


def scan(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, start, length, finding_sha256, probability, secret: one row per candidate.

    ``labels`` may hold labelled findings (doc_id, start, label). Null and empty texts hold no
    candidate; a null source is an empty path; repeated rows and ids are scanned row by row.
    With labels of one kind only there is nothing to learn, and that kind is the verdict.
    """
    found = stage_table(candidates(docs, dictionary(docs)), "findings")
    if labels is None:
        labelled = found.where("rule >= 0").withColumn("label", F.col("rule"))
    else:
        labelled = found.join(labels.select("doc_id", "start", "label"), ["doc_id", "start"])
    seen = {r["label"] for r in labelled.select("label").distinct().collect()}
    result = ["doc_id", "start", "length", F.sha2("finding", 256).alias("finding_sha256"), "probability"]
    if seen == {0, 1}:
        scored = train_forest(labelled, train_rows).transform(found.drop("probability"))
        scored = scored.withColumn("probability", F.round(vector_to_array("probability")[1], 4))
    else:
        scored = found.withColumn("probability", F.lit(1.0 if seen == {1} else 0.0))
    return scored.select(*result).withColumn("secret", F.col("probability") >= SECRET_FROM)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mask; all columns and rows stay.

    ``n_chars``, where there is such a column, follows the text. Findings are gathered per
    text, so a row meets its own only; rows that share an id share their findings' places.
    """
    found = scan(docs).where("secret").groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "length")).alias("_found"))
    names = docs.columns
    joined = docs.join(found, "doc_id", "left")

    def mask(batches):
        for batch in slices(batches, "text"):
            texts = batch.column(names.index("text")).to_pylist()
            places = batch.column(batch.num_columns - 1).to_pylist()
            out = [_masked(t, p) if t and p else t for t, p in zip(texts, places)]
            columns = dict(zip(names, batch.columns))
            columns["text"] = pa.array(out, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(
                    [len(t) if p and t else c for t, p, c in zip(out, places, columns["n_chars"].to_pylist())],
                    columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[x] for x in names], names=names)

    return joined.select(*names, "_found").mapInArrow(mask, docs.schema)


def _masked(text: str, places: list[dict]) -> str:
    for place in sorted(places, key=lambda p: -p["start"]):
        start, end = place["start"], place["start"] + place["length"]
        if _RUN.fullmatch(text, start, end):
            text = text[:start] + MASK + text[end:]
    return text
