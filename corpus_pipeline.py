"""From raw documents to token ids: filter, deduplicate, redact, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage's result is written as Parquet to the shared folder and read again as the next one's docs, so a lost executor
costs at most the stage that runs; it is deleted when the next one is written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setgraph.llm import bagminhash, bpe, mixing, secrets, toxicity
from setgraph.llm.common import DOCUMENT_COLUMNS, table
from setgraph.plans.lineage import cut_lineage, remove_folder, shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; the grammar is learned from the labelled ones among them."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    grammar = toxicity.learn_from(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity(grammar) < 0.5)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near-duplicates; of rows that share an id, the least text."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    dropped = cut_lineage(bagminhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id"))
    kept = docs.join(dropped, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)
    repeated = cut_lineage(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    one = kept.join(repeated, "doc_id", "left_semi").withColumn("_first", first).filter("_first = 1").drop("_first")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(one).select(*DOCUMENT_COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return secrets.redacted(docs.select(*DOCUMENT_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their slots."""
    return in_order(docs).select(*DOCUMENT_COLUMNS)


def in_order(docs: DataFrame) -> DataFrame:
    """docs with their slots, sorted by them. A slot follows from a document's source, its id and the sources' sizes alone."""
    placed = mixing.mix(docs.select(*DOCUMENT_COLUMNS)).withColumnRenamed("_slot", "slot")
    return placed.repartitionByRange("slot", "doc_id").sortWithinPartitions("slot", "doc_id")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests and its slot of the mix, in the order of the slots.

    The columns of documents have no place for a slot and files no order that a reader must keep, so it is computed again.
    """
    return bpe.encode_documents(in_order(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("slot",))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Learned grammars, signatures and merges have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for all documents of sf_dir."""
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for at, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(written := f"{folder}/{at}_{name}")
        docs = spark.read.parquet(written)
        if before:
            remove_folder(spark, before)
        before = written
    return docs
