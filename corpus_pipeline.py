"""From raw documents to token ids: five operators of the training-data subpackage in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared
folder as Parquet and rereads it as the next stage's input. All but the last return the columns
of ``documents``. Nulls, empty texts, repeated rows and extra columns are handled as the
operators say: rows without words go with the first stage. Stages that tell rows apart number
them first, so rows that share an id, or have none, are judged and masked one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.bpe import encode_documents
from lodeworks.llm.decontam import leaks
from lodeworks.llm.neardup import near_duplicates
from lodeworks.llm.quality import keep_good
from lodeworks.llm.secret_scan import mask_secrets
from lodeworks.session import stage_table

#: Near duplicates share four fifths of their shingles; so many bands miss 1 in 8 million of them.
PERCENT, BANDS, ROWS = 80, 40, 5
VOCABULARY = "word_bpe_49k.json"
#: Tokenizing and the model fits have no form in SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with their ids as ``_own_id`` and numbers of their own as ``doc_id``, staged."""
    return stage_table(docs.withColumns(
        {"_own_id": F.col("doc_id"), "doc_id": F.monotonically_increasing_id()}), "numbered")


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("_own_id")).select(docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays."""
    rows = _numbered(docs)
    gone = near_duplicates(rows, PERCENT, BANDS, ROWS).where(~F.col("kept")).select("doc_id")
    return _named(rows.join(gone, "doc_id", "left_anti"), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = _numbered(docs)
    held = leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return _named(rows.join(held, "doc_id", "left_anti"), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; all documents stay."""
    return _named(mask_secrets(_numbered(docs)), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    encoded = encode_documents(docs, public_tokenizers.path(VOCABULARY))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicate_groups),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secrets),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
