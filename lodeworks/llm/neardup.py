"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity.

A document's set holds its distinct word shingles. Two permutations make all signature
coordinates: sigma places a shingle on a ring of 2^32 places, pi orders the places, and
coordinate k is the least pi over the set after the ring is turned by k. Documents that
agree on a band of coordinates share a bucket; links are confirmed on full sets.

Copies are one node from the start. Buckets are not turned into pairs: their members are
compared with one leader each. Only buckets that then still hold several components are
looked at whole, in blocks of bounded size: members outside a block's component that is largest
at its start are compared with all others there, and only links that join components come out. So no link
between candidates is lost that could change a component. The chance that two documents at
the limit share no bucket is (1 - 0.85^rows)^bands, 4e-7 as set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.components import components
from lodeworks.llm.words import grams, mix64, slices, within, words
from lodeworks.session import stage_table

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Links need 100 * shared shingles >= PERCENT * all shingles.
PERCENT = 85
#: Shingles that a block of bucket members holds on average; pairs of blocks meet in one task.
BLOCK_SHINGLES = 1 << 20
_CHUNK = 1 << 16


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words make one shingle."""
    found = words(texts, fold=True)
    n = np.diff(found.first)
    all_grams = grams(found.hashes, size)
    short = {k: grams(found.hashes, k) for k in range(1, size) if (n == k).any()}
    out = []
    for at, count in zip(found.first[:-1].tolist(), n.tolist()):
        if count >= size:
            out.append(np.unique(all_grams[at:at + count - size + 1]))
        else:
            out.append(short[count][at:at + 1] if count else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], n_coordinates: int) -> np.ndarray:
    """Coordinates of each non-empty set, one row a set."""
    out = np.empty((len(sets), n_coordinates), np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sets):
        floor = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, floor + _CHUNK, "right")))
        places = (mix64(np.concatenate(sets[at:to])) >> np.uint64(32)).astype(np.uint32)  # sigma
        starts = ends[at:to] - sizes[at:to] - floor
        x, y = np.empty_like(places), np.empty_like(places)
        for k in range(n_coordinates):
            np.subtract(places, np.uint32(k), out=x)  # turn the ring
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):  # pi
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[at:to, k] = np.minimum.reduceat(x, starts)
        at = to
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, the band's number in it."""
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def document_signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and band keys."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1))
            full = [s for s in sets if len(s)]
            counts = np.array([len(s) for s in sets], np.int64)
            keys = band_keys(signatures(full, bands * rows), bands, rows) if full else np.zeros(0)
            offsets = np.append(0, np.cumsum((counts > 0) * bands)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts),
                pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel(), pa.int64())),
            ], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one, other = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(other, "b").join(one, "a")

    def confirm(batches):
        for batch in slices(batches, "text_b"):
            ids = batch.column(0).to_numpy()
            # equal ids in a row share one set, so a leader is cut into shingles once
            new = np.append(True, (ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
            first_sets = shingle_sets(batch.column(2).filter(pa.array(new)))
            which = np.cumsum(new) - 1
            ok = np.zeros(len(ids), bool)
            for i, own in enumerate(shingle_sets(batch.column(3))):
                led = first_sets[which[i]]
                if not len(own) or not len(led):
                    continue
                at = np.minimum(np.searchsorted(led, own), len(led) - 1)
                shared = int((led[at] == own).sum())
                ok[i] = 100 * shared >= percent * (len(led) + len(own) - shared)
            kept = batch.select(["a", "b"]).filter(pa.array(ok))
            if kept.num_rows:
                yield kept

    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    A-Z count as a-z. Documents without words or text have an empty set and are their own
    component. component_id is the smallest doc_id reachable over links. Repeated rows get
    equal results; rows that share a doc_id but not a text pool their links. A row without a
    doc_id is linked with nothing: its component_id is null and it is kept. Other columns
    are not looked at.
    """
    docs = docs.select("doc_id", "text")
    signed = stage_table(document_signatures(docs, bands, rows), "signatures")
    sets = signed.where("digest is not null and doc_id is not null")
    nodes = stage_table(sets.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    heads = nodes.join(
        sets.select("digest", F.col("doc_id").alias("node"), "n_shingles", "bands"), ["digest", "node"])
    filed = heads.select(F.explode("bands").alias("bucket"), "node", "n_shingles")
    shared = filed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    members = stage_table(
        filed.join(shared.where("low <> high"), "bucket")
        .select("bucket", "node", "n_shingles", "low"), "buckets")
    ties = _ties(docs, members, percent)
    labelled = nodes if ties is None else nodes.join(ties, "node", "left")
    component = F.col("node") if ties is None else F.coalesce("component", "node")
    of_set = labelled.select("digest", component.alias("component"))
    return signed.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _similar_size(percent: int):
    small, large = F.least("n", "m"), F.greatest("n", "m")
    return 100 * small >= percent * large


def _ties(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame | None:
    """Components over all links inside buckets; None if no bucket is shared."""
    if members.isEmpty():
        return None
    texts = stage_table(docs.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id"), "texts")
    sizes = members.select(F.col("node").alias("low"), F.col("n_shingles").alias("m")).distinct()
    tested = stage_table(
        members.where("node <> low").groupBy("low", "node").agg(F.min("n_shingles").alias("n"))
        .join(sizes, "low").where(_similar_size(percent))
        .select(F.col("low").alias("a"), F.col("node").alias("b")), "pairs")
    links = stage_table(_linked(tested, texts, percent), "confirmed")
    found = stage_table(components(links), "components")
    labelled = members.join(found, "node", "left").select(
        "bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    split = labelled.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    # two members have been compared; more may be linked past the leader
    split = split.where("low <> high and members > 2").select(
        "bucket", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.hash("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    blocks = (
        labelled.join(split, "bucket").withColumn("own", own).withColumn("other", other)
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                F.col("node").alias("doc_id"), "component")
        .join(texts, "doc_id")
    )
    more = blocks.groupBy("bucket", "i", "j").applyInArrow(
        _closer(percent), "a long, b long").distinct()
    return components(links.union(more))


def _closer(percent: int):
    """Links that tie together the components of a block of bucket members."""
    def close(table: pa.Table) -> pa.Table:
        ids, labels = (table.column(x).to_numpy() for x in ("doc_id", "component"))
        sets = shingle_sets(table.column("text").combine_chunks())
        sizes = np.array([len(s) for s in sets], np.int64)
        _, places = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        label = np.unique(labels, return_inverse=True)[1]
        pairs = []
        held = np.zeros(int(places.max()) + 1, bool)
        # all members but those of one component meet every member, whatever has merged since
        in_largest = label == np.bincount(label).argmax()
        for x in np.flatnonzero(~in_largest):
            own = places[starts[x]:starts[x] + sizes[x]]
            held[own] = True
            shared = np.add.reduceat(held[places], starts, dtype=np.int64)
            held[own] = False
            near = 100 * shared >= percent * (sizes + sizes[x] - shared)
            for other in np.unique(label[near & (label != label[x])]):
                y = np.flatnonzero(near & (label == other))[0]
                pairs.append((ids[x], ids[y]))
                label[label == other] = label[x]
        return pa.table({k: pa.array([p[i] for p in pairs], pa.int64()) for i, k in enumerate("ab")})

    return close
