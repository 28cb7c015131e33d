"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align_tokenizers
from .bpe import encode_digests
from .chat import PREFERENCES_SQL, format_preferences, neighbour_pairs
from .common import documents, is_held_out
from .imatch import build_lexicon, compare_with_edits
from .language import identify_language, train_language
from .line_dedup import LINE_DEDUP_SQL, line_dedup
from .ngram_join import NGRAM_JOIN_SQL, ngram_jaccard_join
from .ogg import media_digests
from .packing import pack_documents
from .pii import BASE_KINDS, base_digest, find_pii, train_pii
from .quality import score_quality, train_quality
from .spelling import SPELLING_SQL, spelling_variants
from .token_counts import count_tokens


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    forest = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.select("doc_id", "text"), forest)
    return scored.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(neighbour_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"), train_pii(spark))
    return found.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], base_digest().alias("base_sha256"), "spans", "n_added", "n_spans")


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return compare_with_edits(docs, build_lexicon(docs))


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify_language(docs.select("doc_id", "text"), train_language(docs))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["begin"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score", F.array_join(spans, ",").alias("spans")
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_chat_preferences": op3_chat_preferences,
    "op4_pii": op4_pii,
    "op5_imatch": op5_imatch,
    "op6_ogg": op6_ogg,
    "op7_language": op7_language,
    "op8_bpe": op8_bpe,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_packing": op10_packing,
    "op11_alignment": op11_alignment,
    "op12_spelling": op12_spelling,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL = {
    "op1_line_dedup": LINE_DEDUP_SQL,
    "op3_chat_preferences": PREFERENCES_SQL,
    "op9_ngram_jaccard_join": NGRAM_JOIN_SQL,
    "op12_spelling": SPELLING_SQL,
}
