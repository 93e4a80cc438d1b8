"""One query for each text operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import decontamination, divergence, fingerprints, ngram_join, packing, quality_crf, quality_rules
from gaugework.llm import secret_scan, sentencepiece_codec, sharding, substring_dedup, url_filter, vector_codes
from gaugework.llm.common import documents, text_or_empty

PIECES = "piece_bpe_32k.model"
BYTE_BPE, BYTE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of each text, and whether decoding them gives the text back."""
    model = public_tokenizers.path(PIECES)
    texts = documents(spark, sf).select("doc_id", text_or_empty().alias("text"))
    coded = sentencepiece_codec.round_trip(texts, model)
    same = (F.col("coded.decoded") == F.col("text")).alias("round_trip")
    return coded.select("doc_id", F.size("coded.ids").cast("long").alias("n_tokens"), "coded.ids", same)


def _joined(spans: str, *kinds: str) -> Column:
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf).select("doc_id", "text"))
    base = [k[0] for k in secret_scan.KINDS]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, base), F.sha2(_joined("spans", *base), 256).alias("base_sha256"),
        _joined("spans", *base, secret_scan.RANDOM).alias("spans"),
    )


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    ids = packing.token_pieces(
        documents(spark, sf), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(BYTE_RANKS)
    )
    slim = ids.select("doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
                      F.crc32("ids").alias("ids_crc32"))
    return packing.pack(packing.written(slim))


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_filter.judge_urls(documents(spark, sf, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = text_or_empty()
    docs = documents(spark, sf).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.shard_by_bytes(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.jaccard_join(documents(spark, sf), ngram_join.JaccardJoin(words=4, num=85, den=100))


def op8_quality_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    scored = quality_crf.score_quality(docs, quality_crf.train(docs, documents(spark, sf, "labels")))
    return scored.select(
        "doc_id", (quality_crf.fold(F.col("doc_id")) == quality_crf.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = substring_dedup.remove_repeats(documents(spark, sf).select("doc_id", "text"), joined=True)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    judged = quality_rules.quality_rules(docs, quality_rules.train(docs, documents(spark, sf, "labels")))
    return judged.select("doc_id", "quality.*")


def op11_divergence_audit(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(documents(spark, sf).select("lang", "source", "text"))


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = vector_codes.compress(documents(spark, sf, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(books.decimals()), 256).alias("codebooks_sha256"))


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.find_benchmark(documents(spark, sf).select("doc_id", "text"), documents(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_sentencepiece, op2_secret_scan, op3_best_fit_packing, op4_url_filter, op5_sharding, op6_fingerprints,
        op7_ngram_jaccard_join, op8_quality_crf, op9_substring_dedup, op10_quality_rules, op11_divergence_audit, op12_vector_codes,
        op13_decontamination,
    )
    return {f.__name__: f for f in found}
