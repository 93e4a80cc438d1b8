"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import packing, quality_rules, secret_scan, substring_dedup
from gaugework.llm.common import documents, small_side
from gaugework.llm.ngram_join import JaccardJoin, jaccard_join
from gaugework.session import cut_lineage


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the model is learnt from the labels beside the documents."""
    model = quality_rules.train(docs, documents(spark, sf_dir, "labels"))
    judged = quality_rules.quality_rules(docs, model, into="_quality")
    return judged.where("_quality.kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one with the smallest doc_id (five words, similarity 0.8).

    doc_id is taken for a key; equal rows stay once.  Rows without one stay, equal texts among them once.
    """
    groups = jaccard_join(docs, JaccardJoin())
    own = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    own = cut_lineage(own)
    once, often = own.where("n = 1").select("doc_id"), own.where("n > 1").select("doc_id")
    kept = docs.join(small_side(once), "doc_id", "left_semi")
    repeated = docs.join(small_side(often), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    unnamed = docs.where("doc_id IS NULL").dropDuplicates(["text"])
    return kept.unionByName(repeated).unionByName(unnamed)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut from the text; a document may become empty."""
    left = substring_dedup.remove_repeats(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    changed = F.col("n_removed") > 0
    return _with_text(left, docs.columns, F.when(changed, F.col("kept")).otherwise(F.col("text")), changed)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret becomes a placeholder."""
    own = docs.select(F.struct("*").alias("_row"), "text")
    return _with_text(secret_scan.redact(own), docs.columns, F.col("text"), ~F.col("text").eqNullSafe(F.col("_row.text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    path = public_tokenizers.path
    pieces = packing.token_pieces(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return packing.pack(packing.written(pieces.select("doc_id", "piece", "start", length, F.crc32("ids").alias("ids_crc32"))))


def _with_text(rows: DataFrame, columns: list[str], text, changed) -> DataFrame:
    made = {"text": text, "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("_row")["n_chars"])}
    return rows.select(*[(made[c] if c in made else F.col("_row")[c]).alias(c) for c in columns])


STAGES = [
    ("quality_rules", drop_bad_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The quality model cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the whole of documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
