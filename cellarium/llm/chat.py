"""Preference records from pairs of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running

ROLE_BEGIN, ROLE_END, TURN_END = "<|", "|>\n", "\n<|end|>\n"


def render(turn: Column) -> Column:
    """One turn as text: its role in a header, its text, an end mark. Nulls are empty."""
    return F.concat(
        F.lit(ROLE_BEGIN),
        F.coalesce(turn["role"], F.lit("")),
        F.lit(ROLE_END),
        F.coalesce(turn["text"], F.lit("")),
        F.lit(TURN_END),
    )


def format_preferences(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One record a pair of conversations.

    ``turns`` has ``pair_id``, ``side`` (0 chosen, 1 rejected), ``conv_id``, ``turn``,
    ``role`` and ``text``. Turns are ordered by (turn, role, text), nulls first. The longest
    common prefix is that of turns with equal role and text (null equals null); it is
    rendered once. Returns ``pair_id``, ``chosen_id``, ``rejected_id``, ``prompt_turns``,
    ``prompt``, and for each side the rest, ``chosen`` and ``rejected``, with masks:
    ``chosen_mask`` and ``rejected_mask`` list as begin:end, comma-joined, the code points
    of the completion to train on, which are the texts of turns of ``trained_role`` with
    their end marks, not their headers.

    A side without turns has a null id and an empty completion, and the prompt is empty.
    If one side is a prefix of the other its completion is empty. Turns with a null
    ``pair_id`` belong to no pair: each is a record of its own, however many there are.
    Repeated turns stay, in a row, and ties in the order are turns that are equal. A pair's
    turns meet in one row, as its record does, with texts of any length; there is no other
    limit. Other columns are not read; an empty table gives no rows.
    """
    lone = F.when(F.col("pair_id").isNull(), F.monotonically_increasing_id())
    turns = turns.select("pair_id", "side", "conv_id", "turn", "role", "text", lone.alias("_lone"))
    content = F.struct("turn", "role", "text")
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, content)))
    first = lambda k: F.min(F.when(F.col("side") == k, F.col("conv_id")))
    pairs = turns.groupBy("pair_id", "_lone").agg(
        first(0).alias("chosen_id"), first(1).alias("rejected_id"), side(0).alias("a"), side(1).alias("b")
    )
    said = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    same = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & said(x).eqNullSafe(said(y)))
    pairs = pairs.withColumn("_same", same)
    pairs = pairs.withColumn(
        "prompt_turns",
        F.coalesce(
            F.nullif(F.array_position("_same", False).cast("int"), F.lit(0)) - 1, F.size("_same")
        ),
    )

    def rest(name: str) -> Column:
        return F.slice(F.col(name), F.col("prompt_turns") + 1, F.greatest(F.size(name), F.lit(1)))

    pairs = pairs.withColumns({"_ra": rest("a"), "_rb": rest("b")})
    written = lambda xs: F.array_join(F.transform(xs, render), "")

    def mask(xs: str) -> Column:
        length = F.transform(F.col(xs), lambda x: F.length(render(x)))
        head = lambda x: F.length(F.coalesce(x["role"], F.lit(""))) + len(ROLE_BEGIN) + len(ROLE_END)
        spans = F.zip_with(
            F.col(xs),
            running(length, lambda a, b: a + b, F.lit(0)),
            lambda x, end: F.when(
                x["role"] == trained_role,
                F.concat_ws(":", (end - F.length(render(x)) + head(x)).cast("string"), end.cast("string")),
            ),
        )
        return F.array_join(spans, ",")

    return pairs.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        written(F.slice("a", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        written(F.col("_ra")).alias("chosen"),
        written(F.col("_rb")).alias("rejected"),
        mask("_ra").alias("chosen_mask"),
        mask("_rb").alias("rejected_mask"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Turns dealt to pairs: conversation 2k is the chosen, 2k + 1 the rejected side of
    pair k. Turns with a null id are chosen sides without a pair."""
    return conversations.select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"),
        F.coalesce(F.pmod("conv_id", F.lit(2)).cast("int"), F.lit(0)).alias("side"),
        "conv_id",
        "turn",
        "role",
        "text",
    )


PREFERENCES_SQL = r"""
WITH dealt AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 AS side, conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS shown,
    length(coalesce(role, '')) + 5 AS head
  FROM conversations
), pairs AS (
  SELECT pair_id, min(conv_id) FILTER (side = 0) AS chosen_id, min(conv_id) FILTER (side = 1) AS rejected_id,
    greatest(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS longest
  FROM dealt GROUP BY pair_id
), places AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k,
    coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM dealt WHERE side = 0) a FULL JOIN (SELECT * FROM dealt WHERE side = 1) b
    ON a.pair_id = b.pair_id AND a.k = b.k
), prefix AS (
  SELECT p.pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS prompt_turns
  FROM pairs p JOIN places q ON p.pair_id = q.pair_id GROUP BY p.pair_id
), rest AS (
  SELECT d.*, sum(length(shown)) OVER (PARTITION BY conv_id ORDER BY d.k) - length(shown) AS begins
  FROM dealt d JOIN prefix USING (pair_id) WHERE d.k > prompt_turns
), sides AS (
  SELECT pair_id, side, string_agg(shown, '' ORDER BY k) AS completion,
    string_agg(CAST(begins + head AS BIGINT) || ':' || CAST(begins + length(shown) AS BIGINT), ',' ORDER BY k)
      FILTER (role = 'assistant') AS mask
  FROM rest GROUP BY pair_id, side
)
SELECT p.pair_id, p.chosen_id, p.rejected_id, f.prompt_turns,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM dealt d
            WHERE d.pair_id = p.pair_id AND d.side = 0 AND d.k <= f.prompt_turns), '') AS prompt,
  coalesce(a.completion, '') AS chosen, coalesce(b.completion, '') AS rejected,
  coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask
FROM pairs p JOIN prefix f USING (pair_id)
LEFT JOIN sides a ON a.pair_id = p.pair_id AND a.side = 0
LEFT JOIN sides b ON b.pair_id = p.pair_id AND b.side = 1
"""
