"""Phrase collocations by set-oriented mining (SETM) over sorted occurrence relations.

Texts are cut into pieces and words. The relation of length k says at which places of which
pieces a phrase of k words starts. It is kept in blocks, each a run of whole documents of one
language with the places in order and a gap between pieces, so joining the phrases at a place
and at the next one is one pass over two sorted columns. Each block counts its extended
phrases, the counts are summed by phrase over all blocks, and only places whose phrase is
frequent go into the relation that is extended next.

Frequent phrases of a length are numbered; a longer phrase is the pair of the numbers of its
two overlapping halves, so phrases are told apart exactly. Words meet as text, too; only the
distinct words of one block are found by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.words import SPACES, cut_out, folded, lists, runs, slices, text_bytes
from lodeworks.session import discard, stage_table

#: Longest phrase, fewest occurrences and rows returned per language.
LONGEST, FEWEST, TOP = 4, 30, 2000
#: A longer candidate with this percentage of a candidate's occurrences stands for it.
CONTAINED = 80
UNKNOWN = "und"
#: Bytes of text that one block covers; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 23
#: Blocks that a task extends, one after another, and leaves in one file.
BLOCKS_PER_TASK = 4
#: Rows (phrases of blocks) that are numbered together.
ROWS_PER_BUCKET = 500_000
_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BREAKS = _PIECE_ENDS | SPACES


def _word_block(texts: pa.Array, lang: str, block: int) -> pa.RecordBatch | None:
    """First relation of texts of one language: places in order, -1 between pieces."""
    data, offsets = text_bytes(texts)
    data = folded(data)
    found = runs(data, offsets, _BREAKS)
    n = len(found.starts)
    if not n:
        return None
    hashes, first, codes, counts = np.unique(
        found.hashes, return_index=True, return_inverse=True, return_counts=True)
    ends = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_PIECE_ENDS[data], out=ends[1:])
    owner = found.owners()
    gap = np.zeros(n, np.int64)
    gap[1:] = (ends[found.starts[1:]] > ends[found.ends[:-1]]) | (owner[1:] != owner[:-1])
    place = np.arange(n) + np.cumsum(gap)
    out = np.full(place[-1] + 1, -1, np.int32)
    out[place] = codes
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([n], pa.int64()),
         lists(out, [0, len(out)], pa.int32()),
         pa.ListArray.from_arrays(
             pa.array([0, len(first)], pa.int32()),
             cut_out(data, found.starts[first], found.ends[first]).cast(pa.string())),
         lists(counts, [0, len(counts)], pa.int32())],
        names=["block", "lang", "n", "codes", "words", "counts"])


def _blocks(docs: DataFrame) -> DataFrame:
    def cut(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BLOCK_BYTES):
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                made = _word_block(batch.column(1).take(np.flatnonzero(codes == code)), lang, block)
                if made is not None:
                    yield made
                    block += 1

    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(
        cut, "block long, lang string, n long, codes array<int>, words array<string>, counts array<int>")


def _extend(blocks: DataFrame, kept: DataFrame, count: int) -> DataFrame:
    """Next relation: phrases at two neighbouring places, both frequent, make a longer one.

    ``codes`` are places in a block's ``pairs``, the numbers of both halves in one. Workers are
    given one of the ``count`` blocks at a time.
    """
    kind = pa.schema({
        "block": pa.int64(), "codes": pa.list_(pa.int32()), "pairs": pa.list_(pa.int64()),
        "counts": pa.list_(pa.int32())})

    def join(places: pa.Table, frequent: pa.Table) -> pa.Table:
        if not places.num_rows or not frequent.num_rows:
            return kind.empty_table()
        codes = places.column("codes")[0].values.to_numpy()
        held = frequent.column("code").to_numpy()
        # the number of each code; the last place stands for no phrase
        number = np.full(max(codes.max(), held.max()) + 2, -1, np.int64)
        number[held] = frequent.column("number").to_numpy()
        here = number[codes]
        at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
        if not len(at):
            return kind.empty_table()
        pairs, inverse, counts = np.unique(
            (here[at] << 32) | here[at + 1], return_inverse=True, return_counts=True)
        out = np.full(len(codes), -1, np.int32)
        out[at] = inverse
        return pa.Table.from_arrays(
            [pa.array(places.column("block")[:1].to_numpy()), lists(out, [0, len(out)], pa.int32()),
             lists(pairs, [0, len(pairs)], pa.int64()), lists(counts, [0, len(counts)], pa.int32())],
            schema=kind)

    tasks = count // BLOCKS_PER_TASK + 1
    places, frequent = (
        table.select("block", *columns).repartition(tasks, "block").groupBy("block")
        for table, columns in ((blocks, ["codes"]), (kept, ["code", "number"])))
    return places.cogroup(frequent).applyInArrow(
        join, "block long, codes array<int>, pairs array<long>, counts array<int>")


def _frequent(rows: DataFrame, key: list[str], fewest: int, total: int, label: str) -> DataFrame:
    """The rows (key, block, code, n) of phrases that occur often enough in all blocks, with
    their occurrences ``f`` and a ``number`` of the phrase.

    Phrases are dealt to buckets by hash and numbered within each; rows are shuffled once.
    """
    buckets = total // ROWS_PER_BUCKET + 1
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).repartition("bucket")
    counted = dealt.withColumn("f", F.sum("n").over(Window.partitionBy("bucket", *key)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*key))
    return stage_table(
        counted.where(F.col("f") >= fewest).withColumn("number", (rank - 1) * F.lit(buckets) + F.col("bucket"))
        .select(*key, "block", "code", "f", "number"), label)


def _phrases(table: DataFrame, label: str) -> DataFrame:
    table = stage_table(table, label)
    if (table.agg(F.max("number")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more frequent phrases than half an id can number")
    return table


def frequent_phrases(
    docs: DataFrame, longest: int = LONGEST, fewest: int = FEWEST,
) -> tuple[list[DataFrame], DataFrame]:
    """One table per length (lang, number, phrase, last, f, heads, tails; left and right from
    two words on), and the words of each language (lang, n).

    ``heads`` and ``tails`` are the occurrences of the first and of the last 1, 2, ... words.
    """
    blocks = stage_table(_blocks(docs), "phrase-blocks")
    totals = stage_table(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    rows, count = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.count(F.lit(1))).first()
    kept = _frequent(
        blocks.select("lang", "block", "counts", F.posexplode("words").alias("code", "word")).select(
            "lang", "word", "block", "code", F.get("counts", "code").cast("long").alias("n")),
        ["lang", "word"], fewest, rows, "phrase-words")
    tables = [_phrases(
        kept.groupBy("lang", "number", F.col("word").alias("phrase")).agg(F.first("f").alias("f")).select(
            "lang", "number", "phrase", F.col("phrase").alias("last"), "f",
            F.array("f").alias("heads"), F.array("f").alias("tails")), "phrases-1")]
    for length in range(2, longest + 1):
        longer = stage_table(_extend(blocks, kept, count), f"phrase-pairs-{length}")
        discard(blocks)
        discard(kept)
        rows, count = longer.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0)), F.count(F.lit(1))).first()
        kept = _frequent(
            longer.select("block", "counts", F.posexplode("pairs").alias("code", "pair")).select(
                "pair", "block", "code", F.get("counts", "code").cast("long").alias("n")),
            ["pair"], fewest, rows, f"phrase-rows-{length}")
        found = kept.groupBy("number", "pair").agg(F.first("f").alias("f")).select(
            "number", "f", F.shiftright("pair", 32).alias("left"),
            F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("right"))
        left, right = (
            tables[-1].select(F.col("number").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
            for side, columns in (("left", ["lang", "phrase", "heads"]), ("right", ["last", "tails"])))
        tables.append(_phrases(
            found.join(left, "left").join(right, "right").select(
                F.col("left_lang").alias("lang"), "number",
                F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"), F.col("right_last").alias("last"),
                "f", F.concat("left_heads", F.array("f")).alias("heads"),
                F.concat("right_tails", F.array("f")).alias("tails"), "left", "right"), f"phrases-{length}"))
        blocks = longer
    discard(blocks)
    discard(kept)
    return tables, totals


def collocations(
    docs: DataFrame, longest: int = LONGEST, fewest: int = FEWEST, top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Texts are lower-cased (A-Z) and cut at ``. , ; : ! ?`` and line ends into pieces, those at
    spaces and tabs into words; a null language is ``und``, a null text is empty. A phrase
    scores floor(2000000 a / (l + r)) at its worst cut, ties to the shortest first part. It
    goes if a longer candidate that contains it has 80 per cent of its occurrences or more.
    Repeated rows count as often as they are there; ids and other columns are not looked at.
    Ranks go by score, occurrences (both falling) and phrase in byte order. An empty table,
    or one without a frequent phrase, gives no rows.
    """
    tables, totals = frequent_phrases(docs, longest, fewest)
    scored = []
    for length, table in enumerate(tables[1:], start=2):
        # whole numbers of up to 38 digits: the product may pass 64 bits
        cuts = [
            F.struct(
                F.expr(f"cast(2000000 as decimal(7)) * cast(f as decimal(19)) div "
                       f"cast(heads[{k - 1}] + tails[{length - k - 1}] as decimal(20))").alias("score"),
                F.lit(k).alias("k"), F.get("heads", F.lit(k - 1)).alias("l"),
                F.get("tails", F.lit(length - k - 1)).alias("r"))
            for k in range(1, length)]
        cut = F.least(*cuts) if length > 2 else cuts[0]
        scored.append(table.select(F.lit(length).alias("length"), "number", "lang", "phrase", "f", cut.alias("cut")))
    union = scored[0]
    for more in scored[1:]:
        union = union.unionByName(more)
    # what holds a phrase of all longer ones holds its next longer ones too
    longer = None
    for length, table in enumerate(tables[2:], start=2):
        halves = table.select(
            F.lit(length).alias("length"), F.explode(F.array("left", "right")).alias("number"),
            F.col("f").alias("inside"))
        longer = halves if longer is None else longer.unionByName(halves)
    if longer is not None:
        most = longer.groupBy("length", "number").agg(F.max("inside").alias("inside"))
        union = union.join(most, ["length", "number"], "left").where(
            F.col("inside").isNull() | (100 * F.col("inside") < CONTAINED * F.col("f")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = union.select(
        "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score",
    ).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
