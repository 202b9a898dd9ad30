"""documents -> clean packed sequences, in five stages; each is written as Parquet and reread as the next one's input.

Every stage but the last returns the columns of documents. A stage judges what its predecessor kept; where it learns
(the toxicity model) it learns from its own input and the labels. Decisions are taken and carried out row by row, so
rows without a doc_id, or with one that other rows have too, are judged by their own text.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import DOCUMENT_COLUMNS, materialize, table
from chronoweave.llm.decontaminate import contamination
from chronoweave.llm.minhash import near_duplicates
from chronoweave.llm.packing import pack_documents
from chronoweave.llm.pii import pseudonymize
from chronoweave.llm.toxicity import score_toxicity

#: Ids of 8 bytes that may be sent to every executor; with more, a decision is joined by shuffle.
BROADCAST_IDS = 2_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ``row``, a number of its own for each row that stays the same however often and in what parts the table is read.

    It is made of a row's file and its place there; a table that isn't read from files as it stands is stored first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = materialize(docs, "rows")
    placed = docs.select(*DOCUMENT_COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    # from an Arrow table: rows of Python objects would start a second set of Python workers on every executor, which stays beside the operators' own
    numbers = docs.sparkSession.createDataFrame(pa.table({"_n": pa.array(range(len(files)), pa.int64()), "_file": pa.array(files, pa.string())}))
    return placed.join(F.broadcast(numbers), "_file").select(*DOCUMENT_COLUMNS, (F.shiftleft("_n", 40) + F.col("_at")).alias("row"))


def _by_row(keyed: DataFrame) -> DataFrame:
    """What the operators judge: each row as a document of its own."""
    return keyed.select(F.col("row").alias("doc_id"), "text")


def _without(keyed: DataFrame, rows: DataFrame, tag: str) -> DataFrame:
    """The documents but for those whose row is among ``rows`` (row)."""
    rows = materialize(rows.select("row"), tag)
    few = rows.count() <= BROADCAST_IDS
    return keyed.join(F.broadcast(rows) if few else rows, "row", "left_anti").select(*DOCUMENT_COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    keyed = _keyed(docs)
    scored = score_toxicity(_by_row(keyed), table(spark, sf_dir, "labels"), corpus=docs)
    return _without(keyed, scored.where("predicted = 1").select(F.col("doc_id").alias("row")), "toxic")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that with the smallest doc_id, and of those the first."""
    keyed = _keyed(docs)
    found = near_duplicates(_by_row(keyed)).select(F.col("doc_id").alias("row"), "component_id")
    found = materialize(found.join(keyed.select("row", "doc_id"), "row"), "groups-of-rows")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")).alias("f")).select("f.row")
    return _without(keyed, found.join(first, "row", "left_anti"), "copies")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    keyed = _keyed(docs)
    judged = contamination(_by_row(keyed), table(spark, sf_dir, "benchmark"))
    return _without(keyed, judged.where("contaminated").select(F.col("doc_id").alias("row")), "leaks")


def pseudonymize_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become pseudonyms; n_chars follows the text."""
    out = pseudonymize(docs)
    return out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row for each piece of a document."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", pseudonymize_pii), ("packing", pack)]

#: The stages' decisions (a learned lexicon, MinHash, keyed permutations, tokenizer ids) are beyond SQL; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
