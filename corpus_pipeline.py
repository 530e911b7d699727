"""From raw documents to packed training sequences, a stage at a time.

Each stage calls one operator of ``tallywell.llm`` on all that the stage before it
has kept, and its decisions take effect: documents that a quality rule rejects and
near copies go, repeated passages are cut out, secrets are replaced by their
kind, and what is left is packed.  Texts that lose all they have stay as empty
documents.  Near copies are texts whose 5-word shingles overlap by 0.8 or more: SimHash's
grid finds those at 2 or fewer bits, shared shingles the rest, and all are verified.
``op1_simhash`` keeps its contract's 3 words and 2 differing bits.

Null texts are rejected by the quality rules like empty ones; ids may be null, and
such rows are never taken for copies; repeated rows count as copies of each other, and
rows that share no more than the id do not.
An empty table goes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.llm import copies, packing, quality, secrets, suffix
from tallywell.llm.common import Workspace

#: Of the table ``documents``; all stages but the last return them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """With n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.judged(docs, verdict="_rejected_by").where(F.col("_rejected_by").isNull()).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates, and all without an id."""
    rows, groups = copies.near_copies(docs)
    named, nameless = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    place = F.struct("doc_id", F.xxhash64("text", "lang", "source").alias("h"), "_row")  # an id may have several rows
    first = named.select("_row", place.alias("place")).join(groups, "_row").groupBy("_group").agg(F.min("place").alias("first"))
    first = first.select(F.col("first._row").alias("_row"))
    return named.join(first.hint("shuffle_hash"), "_row", "left_semi").select(*COLUMNS).union(nameless.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that an earlier one has."""
    return _documents(suffix.without_repeats(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by its kind."""
    return _documents(secrets.without_secrets(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Fingerprints and suffix order are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for place, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = work.save(out, name)
            if place:
                work.drop(STAGES[place - 1][0])
    return out
