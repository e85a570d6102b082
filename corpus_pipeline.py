"""A corpus pipeline: quality, near-duplicates, benchmark passages, secrets, mixture.

Defined results: a document is a row, whatever its id. Ids may be null or repeat; two rows with one id, or
with none, are kept, dropped and copied each on its own. Of a group of near-duplicates the row with the least id
stays, rows without id last, and of rows with one id any. Null, empty and word-free texts are no duplicates,
hold no passages and secrets, and have no words for the mixture to take, so its last stage leaves them out.
Texts are read whole. Empty tables give none. Of other columns none is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textledger.llm import cotraining, fm_index, minhash, mixing, secrets
from textledger.llm.common import delete, shared_path, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "_row"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written, so that every reading has the same."""
    return written(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return cotraining.filter_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group of near-duplicates (five words, 0.8)."""
    rows = keyed(docs)
    groups = minhash.near_duplicates(rows, id_col=ROW).select(ROW, "component_id")
    named = groups.join(rows.select(ROW, "doc_id").hint("shuffle_hash"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))
    kept = named.groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(kept.hint("shuffle_hash"), ROW, "left_semi").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return fm_index.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), action="drop")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced; n_chars is counted anew."""
    docs = docs.select(*COLUMNS)
    ledger = secrets.BlobLedger(spark, shared_path(spark, "secret-ledger"))
    found = ledger.findings(ledger.update(docs))
    clean = secrets.redact(docs, found).select(*COLUMNS)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with how many copies of each."""
    rows = keyed(docs)
    taken = mixing.mix(rows, keep=(ROW,)).where("copies > 0").select(ROW, "copies")
    return rows.join(taken.hint("shuffle_hash"), ROW).select(*COLUMNS, "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secret_scan),
    ("mixture", mixture),
]

#: The classifier is trained, which SQL can't express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not first:
            delete(before)
    return STAGES[-1][1](spark, docs, sf_dir)
