"""Alignment of two tokenizers over a corpus, with corpus-wide counts of linked token pairs.

Both tokenizers cover the same bytes, a space and the text. Byte offsets at which a token of
each ends cut the two sequences into groups, and every pair of tokens within a group is linked.
The count of a pair of ids is the number of documents that hold it linked.

Neither vocabulary has a token in which a space follows a printable ASCII character, so texts
are cut there and each distinct unit is aligned once per slice. The distinct pairs get a
minimal perfect hash (levels of bit arrays; a key is placed where it is alone), built per
bucket of keys; partial counts become dense vectors indexed by that hash, and the vectors are
summed in a tree. Every look-up verifies the key that is stored at its slot. A second pass
aligns the documents again and looks the counts up.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.words import distinct, distinct_parts, held_for, lists, mix64, slices, text_bytes
from lodeworks.session import stage_table

#: Key buckets; each holds that share of all possible pairs of ids at most.
BUCKETS = 64
#: Bytes of text that are aligned at once; the more, the fewer units come again.
SLICE_BYTES = 1 << 23
#: Units that are encoded at once.
_UNITS = 1 << 14
#: Distinct pairs that a task holds before it hands its partial counts on.
PART_KEYS = 1 << 20
#: Keys whose counts the second pass has in memory at once; more are taken in several rounds.
ROUND_KEYS = 1 << 22
#: Groups with more links than this are linked by distinct ids.
_WIDE = 1 << 12
_BITS_PER_KEY = 2
_SPACE = "▁"
# The pre-tokenizer pattern of byte-level vocabularies.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _letter_bytes() -> dict[str, int]:
    """Byte of each printable letter of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteTokenizer:
    """A byte-level BPE file whose ids follow the order of its merges."""

    def __init__(self, spec: str):
        made = json.loads(spec)
        letters = _letter_bytes()
        specials = {x["content"] for x in made["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in made["model"]["vocab"].items() if token not in specials}
        self.size = max(made["model"]["vocab"].values()) + 1
        self.tokens = [b""] * self.size
        for token, i in ranks.items():
            self.tokens[i] = token
        self._encoding = tiktoken.Encoding(
            "byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, units: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(unit) for unit in units]


class PieceTokenizer:
    """A sentence-piece model that puts a space before each text."""

    def __init__(self, model: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self._model.vocab_size()
        self.tokens = []
        for i in range(self.size):
            piece = self._model.id_to_piece(i)
            self.tokens.append(
                bytes([int(piece[3:5], 16)]) if self._model.is_byte(i)
                else piece.replace(_SPACE, " ").encode())
        self._lone = [self._model.piece_to_id(_SPACE)]

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of units that start with a space; the model adds that space itself."""
        found = self._model.encode([unit[1:] for unit in units], num_threads=1)
        return [ids if unit != " " else self._lone for unit, ids in zip(units, found, strict=True)]


def _splits(tokens: list[bytes]) -> bool:
    """Whether no token has a space after a printable ASCII character."""
    return not any(b == 32 and 33 <= a <= 126 for t in tokens for a, b in zip(t, t[1:]))


def _flat_lists(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum()), sizes


class Aligned(NamedTuple):
    """The distinct units of a slice of texts, aligned."""

    codes: np.ndarray  # unit of each occurrence
    first: np.ndarray  # text i has the occurrences first[i]:first[i + 1]
    good: np.ndarray  # whether the text's tokens make up its bytes
    n_a: np.ndarray  # tokens, groups and links of each unit
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    keys: np.ndarray  # linked pairs of unit u: keys[key_first[u]:key_first[u + 1]]
    times: np.ndarray
    key_first: np.ndarray
    groups: list[str]


class Aligner:
    """Both tokenizers and the alignment of slices of texts."""

    def __init__(self, files: tuple[str, bytes]):
        self.a, self.b = ByteTokenizer(files[0]), PieceTokenizer(files[1])
        if not (_splits(self.a.tokens) and _splits(self.b.tokens)):
            raise ValueError("a vocabulary has tokens that go on after a space")
        self._names = [f"{i}{c}" for i in range(self.a.size) for c in ",|"]
        self._names += [f"{i}{c}" for i in range(self.b.size) for c in ",;"]

    def align(self, texts: pa.Array, with_groups: bool = True) -> Aligned:
        filled = pc.fill_null(texts, "")
        empty = np.asarray(pc.equal(pc.binary_length(filled), 0))
        data, offsets = text_bytes(pc.binary_join_element_wise("", filled, " "))
        cut = np.zeros(len(data), bool)
        cut[1:] = (data[1:] == 32) & (data[:-1] >= 33) & (data[:-1] <= 126)
        codes, first, units = distinct_parts(data, offsets, cut)
        good = np.zeros(len(units), bool)
        parts = []
        for low in range(0, len(units), _UNITS):  # lists of ids take far more room than arrays
            own = units[low:low + _UNITS]
            a, b = self.a.encode(own), self.b.encode(own)
            for u, (unit, x, y) in enumerate(zip(own, a, b, strict=True)):
                raw = unit.encode()
                good[low + u] = (b"".join([self.a.tokens[i] for i in x]) == raw
                                 and b"".join([self.b.tokens[i] for i in y]) == raw)
            for u in np.flatnonzero(~good[low:low + _UNITS]):
                a[u], b[u] = [], []
            parts.append([_flat_lists(x) for x in (a, b)])
        bad = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(~good[codes], out=bad[1:])
        whole = (bad[first[1:]] == bad[first[:-1]]) & ~empty
        sides = [[np.concatenate([np.zeros(0, np.int64), *(p[side][i] for p in parts)]) for i in (0, 1)]
                 for side in (0, 1)]
        return Aligned(codes, first, whole, *self._units(*sides, with_groups))

    def _units(self, a: list[np.ndarray], b: list[np.ndarray], with_groups: bool) -> tuple:
        """From the ids of all units, one after the other, and how many each unit has."""
        (ids_a, n_a), (ids_b, n_b) = a, b
        size_a = np.array([len(t) for t in self.a.tokens])
        size_b = np.array([len(t) for t in self.b.tokens])
        end_a, end_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        # groups: tokens of group g are first_a[g]:first_a[g + 1] and first_b[g]:first_b[g + 1]
        first_a = np.append(0, np.searchsorted(end_a, ends, "right"))
        first_b = np.append(0, np.searchsorted(end_b, ends, "right"))
        unit_ends = np.append(0, np.cumsum(np.bincount(
            np.repeat(np.arange(len(n_a)), n_a), weights=size_a[ids_a], minlength=len(n_a)).astype(np.int64)))
        group_first = np.searchsorted(ends, unit_ends, "right")
        group_first[0] = 0
        per_group = np.diff(first_a) * np.diff(first_b)
        keys, times, owner = self._links(ids_a, ids_b, first_a, first_b)
        n_groups = np.diff(group_first)
        links = np.append(0, np.cumsum(per_group))[group_first]
        unit_of_group = np.repeat(np.arange(len(n_a)), n_groups)
        key_first = np.searchsorted(unit_of_group[owner], np.arange(len(n_a) + 1))
        return (n_a, n_b, n_groups, np.diff(links), keys, times, key_first,
                self._texts(ids_a, ids_b, first_a, first_b, n_a + n_b) if with_groups else [])

    def _links(self, ids_a, ids_b, first_a, first_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair keys, how often each is linked and its group, in the order of the groups."""
        in_a, in_b = np.diff(first_a), np.diff(first_b)
        n = in_a * in_b
        wide = np.flatnonzero(n > _WIDE)
        n[wide] = 0
        group = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        keys = (ids_a[first_a[group] + nth // in_b[group]] * self.b.size
                + ids_b[first_b[group] + nth % in_b[group]])
        times = np.ones(len(keys), np.int64)
        if len(wide):
            parts = [(keys, times, group)]
            for g in wide:
                x, n_x = np.unique(ids_a[first_a[g]:first_a[g + 1]], return_counts=True)
                y, n_y = np.unique(ids_b[first_b[g]:first_b[g + 1]], return_counts=True)
                made = (x[:, None] * self.b.size + y).ravel()
                parts.append((made, np.outer(n_x, n_y).ravel(), np.full(len(made), g)))
            keys, times, group = map(np.concatenate, zip(*parts, strict=True))
            order = np.argsort(group, kind="stable")
            keys, times, group = keys[order], times[order], group[order]
        return keys, times, group

    def _texts(self, ids_a, ids_b, first_a, first_b, n_tokens) -> list[str]:
        """The groups of each unit as text; every group ends with a semicolon."""
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[first_a[1:] - 1] = last_b[first_b[1:] - 1] = True
        out = np.zeros(len(ids_a) + len(ids_b), np.int64)
        at_a = np.arange(len(ids_a)) + np.repeat(first_b[:-1], np.diff(first_a))
        at_b = np.arange(len(ids_b)) + np.repeat(first_a[1:], np.diff(first_b))
        out[at_a] = 2 * ids_a + last_a
        out[at_b] = 2 * (self.a.size + ids_b) + last_b
        names = list(map(self._names.__getitem__, out.tolist()))
        cuts = [0, *np.cumsum(n_tokens).tolist()]
        return ["".join(names[x:y]) for x, y in zip(cuts, cuts[1:])]


def _aligner(shared) -> Aligner:
    return held_for(shared, Aligner)


def _document_keys(found: Aligned) -> np.ndarray:
    """The distinct pairs of each good text, one text after the other."""
    text = np.repeat(np.arange(len(found.good)), np.diff(found.first))
    n_units = len(found.n_a)
    held = distinct((text * n_units + found.codes)[found.good[text]])
    unit = held % n_units
    n = found.key_first[unit + 1] - found.key_first[unit]
    at = np.repeat(found.key_first[unit] - np.cumsum(n) + n, n) + np.arange(n.sum())
    # a text's number above, the key below: keys of 50,000 by 32,000 ids take 31 bits
    both = distinct((np.repeat(held // n_units, n) << np.int64(40)) + found.keys[at])
    return both & np.int64((1 << 40) - 1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    values = np.concatenate([v for _, v in parts])
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[heads], np.add.reduceat(values, heads) if len(heads) else values


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _part_rows(keys: np.ndarray, values: np.ndarray, part: int) -> pa.RecordBatch:
    bucket = _bucket(keys)
    order = np.argsort(bucket, kind="stable")
    held, first = np.unique(bucket[order], return_index=True)
    first = np.append(first, len(keys))
    return pa.RecordBatch.from_arrays(
        [pa.array(held, pa.int32()), pa.array(np.full(len(held), part), pa.int32()),
         lists(keys[order], first, pa.int64()), lists(values[order], first, pa.int64())],
        names=["bucket", "part", "keys", "counts"])


def _partial_counts(docs: DataFrame, shared) -> DataFrame:
    """bucket, part, keys, counts: how many of a task's documents hold each pair."""
    def count(batches):
        aligner, part = _aligner(shared), TaskContext.get().partitionId()
        held, size = [], 0
        for batch in slices(batches, "text", SLICE_BYTES):
            found = aligner.align(batch.column(0), with_groups=False)
            keys, n = np.unique(_document_keys(found), return_counts=True)
            held.append((keys, n.astype(np.int64)))
            size += len(keys)
            if size > 2 * PART_KEYS:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > PART_KEYS:
                    yield _part_rows(*held[0], part)
                    held, size = [], 0
        if size:
            yield _part_rows(*_merged(held), part)

    return docs.select("text").mapInArrow(
        count, "bucket int, part int, keys array<long>, counts array<long>")


class PairHash:
    """Minimal perfect hash of distinct keys: one slot below ``len(keys)`` for each."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self._ranks, at = [], 0
        for bits in levels:
            self._ranks.append(np.cumsum(bits, dtype=np.int64) + at - 1)
            at += int(bits.sum())
        self.size = at

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = mix64(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (mix64(keys.astype(np.uint64) ^ seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PairHash:
        levels = []
        while len(keys):
            size = max(64, _BITS_PER_KEY * len(keys))
            place = cls._places(keys, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not hashed gets any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            place = self._places(keys[left], level, len(bits))
            hit = bits[place]
            out[left[hit]] = self._ranks[level][place[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def packed(self) -> list[bytes]:
        return [np.int64(len(b)).tobytes() + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> PairHash:
        return cls([
            np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int(np.frombuffer(x[:8], np.int64)[0]))
            .astype(bool) for x in levels])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a list column."""
    return np.concatenate([np.zeros(0, np.int64), *(x.flatten().to_numpy() for x in column.chunks)])


def pair_counts(docs: DataFrame, shared) -> DataFrame:
    """bucket, levels, keys, counts: hash of a bucket's pairs; keys and counts by slot."""
    parts = stage_table(_partial_counts(docs, shared), "pair-parts")
    # the tree: parts of a lane, then lanes, about as many of the one as of the other
    last = parts.agg(F.max("part")).first()[0] or 0
    lanes = math.isqrt(last) + 1
    parts = parts.withColumn("lane", F.col("part") % lanes)

    def merged(table: pa.Table) -> pa.Table:
        keys = np.unique(_flat(table["keys"]))
        return pa.table({"bucket": pa.array(table["bucket"][:1]), "keys": lists(keys, [0, len(keys)], pa.int64())})

    def hashed(table: pa.Table) -> pa.Table:
        keys = np.unique(_flat(table["keys"]))
        made = PairHash.build(keys)
        placed = np.zeros(len(keys), np.int64)
        placed[made.slots(keys)] = keys
        return pa.table({
            "bucket": pa.array(table["bucket"][:1]), "levels": pa.array([made.packed()], pa.list_(pa.binary())),
            "keys": lists(placed, [0, len(keys)], pa.int64())})

    def vector(parts: pa.Table, hashes: pa.Table) -> pa.Table:
        slots = PairHash.unpacked(hashes["levels"][0].as_py())
        total = np.zeros(slots.size, np.int64)
        for keys, n in zip(parts["keys"], parts["counts"], strict=True):
            total[slots.slots(keys.values.to_numpy())] += n.values.to_numpy()
        made = pa.table({
            "bucket": pa.array(hashes["bucket"][:1]), "counts": lists(total, [0, len(total)], pa.int64())})
        return made if parts.num_rows else made[:0]

    def summed(vectors: pa.Table, hashes: pa.Table) -> pa.Table:
        total = sum(x.values.to_numpy() for x in vectors["counts"])
        return pa.table({
            "bucket": pa.array(hashes["bucket"][:1]), "levels": pa.array(hashes["levels"]),
            "keys": pa.array(hashes["keys"]), "counts": lists(total, [0, len(total)], pa.int64())})

    by_lane = parts.groupBy("bucket", "lane")
    hashes = stage_table(
        by_lane.applyInArrow(merged, "bucket int, keys array<long>")
        .groupBy("bucket").applyInArrow(hashed, "bucket int, levels array<binary>, keys array<long>"),
        "pair-hashes")
    spread = hashes.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "levels")
    vectors = by_lane.cogroup(spread.groupBy("bucket", "lane")).applyInArrow(
        vector, "bucket int, counts array<long>")
    return stage_table(
        vectors.groupBy("bucket").cogroup(hashes.groupBy("bucket")).applyInArrow(
            summed, "bucket int, levels array<binary>, keys array<long>, counts array<long>"),
        "pair-counts")


class PairTable:
    """Counts of the buckets of one round; pairs of other buckets count nothing."""

    def __init__(self, rows: list[tuple[int, list[bytes], bytes, bytes]]):
        self._rows = {
            bucket: (PairHash.unpacked(levels), np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64))
            for bucket, levels, keys, counts in rows}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        buckets = _bucket(keys)
        order = np.argsort(buckets, kind="stable")
        edges = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))
        for bucket, (made, stored, counts) in self._rows.items():
            at = order[edges[bucket]:edges[bucket + 1]]
            slots = made.slots(keys[at])
            known = slots >= 0
            known[known] = stored[slots[known]] == keys[at[known]]
            out[at[known]] = counts[slots[known]]
        return out


def _pair_table(shared) -> PairTable:
    return held_for(shared, lambda value: PairTable(value[0]))


def _rounds(counts: DataFrame) -> Iterator[list[int]]:
    """Buckets whose keys fit in memory together; there are at most BUCKETS rows to plan with."""
    taken, size = [], 0
    for row in counts.select("bucket", F.size("keys").alias("n")).orderBy("bucket").collect():
        if taken and size + row["n"] > ROUND_KEYS:
            yield taken
            taken, size = [], 0
        taken.append(row["bucket"])
        size += row["n"]
    yield taken


_SUMS = ["n_best", "count_sum"]
_BASE = ["n_a", "n_b", "n_groups", "n_links"]


def align_documents(docs: DataFrame, a_path: str, b_path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (or groups_sha256).

    ``a_path`` is a byte-level BPE file, ``b_path`` a sentence-piece model that adds a space.
    One row per row. Null and empty texts, and texts that a tokenizer does not give back byte
    for byte, have no tokens: zeros and an empty text (unhashed). Repeated rows count as
    documents of their own, null ids stay null, other columns are not looked at. n_best counts
    links whose pair has the highest count of its first id in the corpus, ties included.
    """
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), b.read()))
    counts = pair_counts(docs, shared)
    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    # one number per id of the first vocabulary
    pairs = counts.select(F.explode(F.arrays_zip("keys", "counts")).alias("p"))
    best = pairs.groupBy(F.floor(F.col("p.keys") / n_b).cast("long").alias("a")).agg(F.max("p.counts").alias("top"))
    tops = {r["a"]: r["top"] for r in best.collect()}
    highest = np.zeros(max(tops, default=0) + 1, np.int64)
    highest[list(tops)] = list(tops.values())
    rounds = list(_rounds(counts))
    rows = docs.select("doc_id", "text")
    if len(rounds) > 1:
        rows = stage_table(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "align-rows")
    last = "groups_sha256" if digests else "groups"
    schema = ", ".join([f"{c} long" for c in [*rows.columns[:-1], *_BASE, *_SUMS]]) + f", {last} string"
    made = None
    for buckets in rounds:
        part = counts.where(F.col("bucket").isin(buckets)).select("bucket", "levels", "keys", "counts")
        held = [
            (r["bucket"].as_py(), r["levels"].as_py(), r["keys"].values.to_numpy().tobytes(),
             r["counts"].values.to_numpy().tobytes())
            for b in part.toArrow().to_batches()
            for r in ({c: b.column(c)[i] for c in b.schema.names} for i in range(b.num_rows))]
        table = spark.sparkContext.broadcast((held, highest))
        once = rows.mapInArrow(_look_up(shared, table, len(rows.columns) - 1, digests, n_b), schema)
        made = once if made is None else made.unionByName(once)
    if len(rounds) > 1:
        made = made.groupBy("row").agg(
            *[F.first(c).alias(c) for c in ["doc_id", *_BASE]], *[F.sum(c).alias(c) for c in _SUMS],
            F.first(last).alias(last))
    return made.select("doc_id", *_BASE, *_SUMS, last)


def _look_up(shared, table, n_kept: int, digests: bool, n_b: int):
    def run(batches):
        aligner, pairs, highest = _aligner(shared), _pair_table(table), table.value[1]
        for batch in slices(batches, "text", SLICE_BYTES):
            found = aligner.align(batch.column(n_kept))
            keys, inverse = np.unique(found.keys, return_inverse=True)
            number = pairs.counts(keys)
            best = (number > 0) & (number == highest[np.minimum(keys // n_b, len(highest) - 1)])
            unit = np.repeat(np.arange(len(found.n_a)), np.diff(found.key_first))
            size = len(found.n_a)
            n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(n_best, unit, found.times * best[inverse])
            np.add.at(count_sum, unit, found.times * number[inverse])
            columns = []
            for value in (found.n_a, found.n_b, found.n_groups, found.n_links, n_best, count_sum):
                sums = np.append(0, np.cumsum(value[found.codes]))
                total = sums[found.first[1:]] - sums[found.first[:-1]]
                columns.append(pa.array(np.where(found.good, total, 0), pa.int64()))
            texts = []
            for i, good in enumerate(found.good.tolist()):
                own = found.codes[found.first[i]:found.first[i + 1]].tolist() if good else ()
                text = "".join([found.groups[u] for u in own])[:-1]
                texts.append(hashlib.sha256(text.encode()).hexdigest() if digests and good else text)
            kept = [batch.column(i) for i in range(n_kept)]
            names = [*batch.schema.names[:n_kept], *_BASE, *_SUMS, "groups_sha256" if digests else "groups"]
            yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array(texts, pa.string())], names=names)

    return run
