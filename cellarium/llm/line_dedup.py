"""Removal of repeated passages of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, null_safe

KEY = ["_ld_first", "_ld_second"]
WHO = ["_ld_id", "_ld_text"]
COMMON_RUNS = 1000


def shares(n: Column, each: int = 2000, most: int = 4096) -> Column:
    """Over how many tasks the ``n`` occurrences of a run are dealt."""
    return F.least(F.ceil(n / each), F.lit(most)).cast("int")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Drop lines that lie in a later occurrence of a run of ``window`` lines.

    Every run of ``window`` consecutive lines of every document is hashed (128
    bits). Of the occurrences of a run, the first in order of (id, hash of the
    text, line number) stays; the lines covered by any other are removed, also
    where runs overlap. A removed line thus always has an earlier copy that stays.

    Returns the columns of ``docs`` with the text replaced, and ``n_lines`` and
    ``n_removed``. Lines are what lies between line feeds; blank lines count.

    * null text: stays null, both counts are 0; empty text: one empty line.
    * texts of fewer than ``window`` lines have no run and stay as they are.
    * a null id comes first in the order; rows with the same id and text count as
      one document: each of them keeps the same lines.
    * an input column named like an added one is replaced; texts count whole, however long,
      and an empty table gives no rows.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    named = docs.withColumns(
        {"_ld_id": F.col(id_col), "_ld_text": F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))}
    )
    hashed = named.where(F.col(text_col).isNotNull()).select(
        *WHO,
        F.transform(lines, lambda x: F.xxhash64(x)).alias("a"),
        F.transform(lines, lambda x: F.xxhash64(F.lit("second"), x)).alias("b"),
    )
    hashed = hashed.where(F.size("a") >= window)
    at = lambda c, i: F.xxhash64(*[F.get(F.col(c), i + k) for k in range(window)])
    runs = hashed.select(
        *WHO,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.size("a") - window),
                lambda i: F.struct(at("a", i).alias(KEY[0]), at("b", i).alias(KEY[1])),
            )
        ).alias("_ld_at", "run"),
    ).select(*WHO, "_ld_at", "run.*")
    place = F.struct(*WHO, "_ld_at")
    repeated = (
        runs.groupBy(*KEY).agg(F.min(place).alias("_ld_kept"), F.count("*").alias("_ld_n")).where("_ld_n > 1")
    )
    repeated = cut_lineage(repeated)
    # The commonest runs (a fixed number, so that they can be broadcast) are dealt over several
    # tasks: their occurrences by document, their first place to each of them.
    common = repeated.orderBy(F.desc("_ld_n"), *KEY).limit(COMMON_RUNS).select(*KEY, shares(F.col("_ld_n")).alias("_ld_of"))
    common = common.where("_ld_of > 1")
    salted = runs.join(F.broadcast(common), KEY, "left")
    salt = F.pmod(F.xxhash64(*WHO), F.coalesce(F.col("_ld_of"), F.lit(1))).cast("int")
    salted = salted.withColumn("_ld_salt", salt)
    dealt = repeated.join(F.broadcast(common), KEY, "left").withColumn(
        "_ld_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ld_of"), F.lit(1)) - 1))
    )
    later = salted.join(dealt.select(*KEY, "_ld_salt", "_ld_kept"), [*KEY, "_ld_salt"])
    later = later.where(~place.eqNullSafe(F.col("_ld_kept")))
    covered = later.groupBy(*WHO).agg(F.sort_array(F.collect_set("_ld_at")).alias("_ld_starts"))

    starts = F.coalesce(F.col("_ld_starts"), F.expr("cast(array() as array<int>)"))
    whole = F.col("_ld_lines")
    free = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(starts, lambda s: s + window)),
        F.concat(starts, F.array(F.size(whole))),
        lambda begin, end: F.slice(whole, begin + 1, F.greatest(end - begin, F.lit(0))),
    )
    joined = named.join(covered, null_safe(named, covered, WHO), "left").select(named["*"], covered["_ld_starts"])
    hit = F.col("_ld_starts").isNotNull()
    out = joined.withColumn("_ld_lines", lines).withColumn(
        "_ld_kept_lines", F.when(hit, F.flatten(free)).otherwise(whole)
    )
    return out.withColumns(
        {
            text_col: F.when(hit, F.array_join("_ld_kept_lines", "\n")).otherwise(F.col(text_col)),
            "n_lines": F.greatest(F.coalesce(F.size(whole), F.lit(0)), F.lit(0)).cast("long"),
            "n_removed": F.greatest(
                F.coalesce(F.size(whole) - F.size("_ld_kept_lines"), F.lit(0)), F.lit(0)
            ).cast("long"),
        }
    ).drop(*WHO, "_ld_starts", "_ld_lines", "_ld_kept_lines")


LINE_DEDUP_SQL = r"""
WITH lined AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos, len(ls) AS n FROM lined
), runs AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
  QUALIFY pos + 2 < n
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM runs
), covered AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (SELECT unnest(range(3)) AS d) WHERE k > 1
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.pos IS NULL AS keep
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
), rebuilt AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '') AS text,
         count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, r.text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""
