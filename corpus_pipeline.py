"""A corpus from raw documents to packed sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.line_dedup import line_dedup
from cellarium.llm.ngram_join import ngram_classes, row_key
from cellarium.llm.packing import pack_documents
from cellarium.llm.pii import find_pii, redact, train_pii
from cellarium.llm.quality import score_quality, train_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of 0.5 or more).

    Null and empty texts have the score of an empty text and share its fate; repeated rows are
    judged alike; an empty table stays one. Columns other than those of documents are dropped.
    """
    forest = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, forest, score_col="_score").where(F.col("_score") >= 0.5).select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated lines. A document of which no line is
    left goes: all it said stands in earlier ones. Null and empty texts stay."""
    thinned = line_dedup(docs)
    return _documents(thinned.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that links of word 5-gram likeness 0.8 make: the first by
    (id, hash of the text), null ids last. Rows that repeat both are one document. Documents
    without words make one class."""
    found = ngram_classes(docs)
    kept = found.where(F.col("row") == F.col("class_row")).select(F.col("row").alias("_row"))
    keyed = docs.withColumn("_row", row_key())
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets replaced by a mark, and ``n_chars`` counted anew.

    No row goes: null texts stay null, empty ones empty, repeated rows are treated alike, and an
    empty table stays one. Columns other than those of documents are dropped.
    """
    return _documents(redact(find_pii(docs, train_pii(spark))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens.

    Null and empty texts are the end id alone; repeated rows are packed each for itself; an empty
    table gives no rows. Only the id and the text are read, so no other column is kept.
    """
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("packing", packing),
]

#: The scores, spans and tokens of the stages can't be said in SQL; tests hold the rows
#: against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is kept in the shared checkpoint folder."""
    from cellarium.llm.common import cut_lineage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
