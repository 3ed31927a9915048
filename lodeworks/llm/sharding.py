"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table, given by
two hashes of its name (offset and skip). Shards take turns claiming their next free slot;
a shard of weight w takes w turns a round. A row's key hashes to a slot, so placement is one
look-up in a table of fixed size, and adding or removing a shard moves few other keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; a prime, and at least 100 for each shard keeps shares within a few per cent.
SLOTS = 65537
_MOST_SLOTS = 1 << 22  # keeps the broadcast table within tens of megabytes


def _hash(name: str, role: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{role}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(
    shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None,
) -> np.ndarray:
    """Index of the shard that owns each slot; does not depend on the order of ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named apart")
    if not _is_prime(slots) or not len(shards) <= slots <= _MOST_SLOTS:
        raise ValueError("slots must be a prime, not below the shards nor above 4 million")
    turns = list(weights) if weights is not None else [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("each shard takes at least one turn")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: _hash(shards[i], "offset") % slots for i in order}
    skip = {i: _hash(shards[i], "skip") % (slots - 1) + 1 for i in order}
    table = np.full(slots, -1, np.int32)
    free = slots
    while True:
        for i in order:
            for _ in range(turns[i]):
                slot = at[i]
                while table[slot] >= 0:
                    slot = (slot + skip[i]) % slots
                table[slot] = i
                at[i] = (slot + skip[i]) % slots
                free -= 1
                if not free:
                    return table


def table_frame(spark: SparkSession, shards: Sequence[str], table: np.ndarray) -> DataFrame:
    """slot, shard of every slot."""
    return spark.createDataFrame(
        [(slot, shards[i]) for slot, i in enumerate(table.tolist())], "slot long, shard string")


def slot_of(*key: str | Column, slots: int = SLOTS) -> Column:
    """Slot of a row's key; null parts count as a value of their own."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    marked = [x for p in parts for x in (p, p.isNull())]
    return F.pmod(F.xxhash64(*marked), F.lit(slots))


def place(
    rows: DataFrame, key: Sequence[str], shards: Sequence[str], slots: int = SLOTS,
    weights: Sequence[int] | None = None,
) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; columns of these names are replaced.

    The table has ``slots`` rows whatever the data, so it is broadcast; rows do not move.
    Equal keys share a shard. Rows with a null key are placed like any other key, and an empty
    table gives an empty result.
    """
    owners = table_frame(rows.sparkSession, shards, fill_table(shards, slots, weights))
    rows = rows.drop("slot", "shard").withColumn("slot", slot_of(*key, slots=slots))
    return rows.join(F.broadcast(owners), "slot").select(*rows.columns, "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder a shard; a shard's rows are spread over ``files_per_shard`` tasks by slot."""
    spread = F.pmod(F.col("slot"), F.lit(files_per_shard))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
