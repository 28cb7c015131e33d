"""Quality scores of documents from boosted trees over text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gbdt
from .common import is_held_out, tidy

#: Classes of UTF-8 bytes whose shares are features.
UPPER, LOWER, DIGIT, SPACE, STOP, BAR, MARK, SYMBOL, HIGH, OTHER = range(10)
FEATURES = [
    "upper", "lower", "digit", "space", "stop", "bar", "mark", "symbol", "high", "other",
    "log_bytes", "log_words", "word_length", "distinct_words", "longest_word",
    "log_lines", "line_length", "distinct_lines", "short_lines", "capital_words",
]


def _byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for kind, chars in (
        (UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        (LOWER, "abcdefghijklmnopqrstuvwxyz"),
        (DIGIT, "0123456789"),
        (SPACE, " \t\n\r"),
        (STOP, ".,;:'\"-()?"),
        (BAR, "|"),
        (MARK, "!"),
        (SYMBOL, "#$%&*@^~<>{}[]=+_/\\`"),
    ):
        table[list(chars.encode())] = kind
    table[128:] = HIGH
    return table


BYTE_CLASSES = _byte_classes()


def statistics(text: str | None) -> np.ndarray:
    """The features of one text; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    words, lines = text.split(), text.split("\n")
    n_words, n_lines = len(words), len(lines)
    shares = np.bincount(BYTE_CLASSES[raw], minlength=10) / max(len(raw), 1)
    return np.concatenate(
        [
            shares,
            [
                np.log1p(len(raw)),
                np.log1p(n_words),
                (len(text) - text.count(" ")) / max(n_words, 1),
                len(set(words)) / max(n_words, 1) ** 0.8,
                max(map(len, words), default=0),
                np.log1p(n_lines),
                np.log1p(len(text) / n_lines),
                len(set(lines)) / n_lines,
                sum(len(x) < 40 for x in lines) / n_lines,
                sum(map(str.isupper, words)) / max(n_words, 1),
            ],
        ]
    )


def _features(texts: pd.Series) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = 20_000,
    **settings,
) -> gbdt.Forest:
    """Fit the trees on at most ``sample`` labelled documents.

    Never learns from rows that ``is_held_out``. The sample is the rows with the
    smallest hash of their id, so it does not depend on the order or place of rows.
    Only it is broadcast (16 bytes a row) and only its statistics reach the driver.
    Labels other than 0 and 1 and null ids are left out; a document with both
    labels counts as two rows.
    """
    label = F.col(label_col).cast("int")
    chosen = (
        labels.select(F.col(id_col).alias("_q_id"), label.alias("_q_label"))
        .where(F.col("_q_id").isNotNull() & F.col("_q_label").isin(0, 1) & ~is_held_out("_q_id"))
        .distinct()
        .orderBy(F.xxhash64("_q_id"), "_q_id", "_q_label")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("_q_id"), F.col(text_col).alias("_q_text"))
    labelled = texts.join(F.broadcast(chosen), "_q_id").select("_q_id", "_q_label", "_q_text")

    @tidy
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = pd.DataFrame(_features(batch["_q_text"]), columns=FEATURES)
            yield pd.concat([batch[["_q_id", "_q_label"]].reset_index(drop=True), x], axis=1)

    schema = T.StructType(
        [T.StructField("_q_id", labels.schema[id_col].dataType), T.StructField("_q_label", T.IntegerType())]
        + [T.StructField(f, T.DoubleType()) for f in FEATURES]
    )
    rows = labelled.mapInPandas(measure, schema)
    rows = rows.orderBy(F.xxhash64("_q_id"), "_q_id", "_q_label", *FEATURES).limit(sample).toPandas()
    return gbdt.fit(rows[FEATURES].to_numpy(), rows["_q_label"].to_numpy(), **settings)


def score_quality(docs: DataFrame, forest: gbdt.Forest, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score``: how likely each whole text has label 1.

    Only the text counts. Null and empty texts get the score of an empty text. An
    input column named like the score is replaced; other columns stay. Rows are independent, so
    repeated rows and equal texts get equal scores; an empty table gives no rows. Texts are
    measured whole, however long, in batches of Arrow, and take some times their size in memory.
    """

    @F.pandas_udf("double")
    @tidy
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(forest.score(_features(texts))[: len(texts)])

    return docs.withColumn(score_col, scored(F.col(text_col)))
