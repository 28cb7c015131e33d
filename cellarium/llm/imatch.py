"""I-Match fingerprints: hashes of a document's mid-frequency terms, for several lexicons.

All of it is column expressions, joins and aggregates; no Python runs on the executors.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, let, may_be_among


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case words (runs of letters and digits), sorted."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def build_lexicon(
    docs: DataFrame, text_col: str = "text", most: float = 0.25, least: float = 0.01, size: int = 32_768, slots: int = 65_536
) -> Lexicon:
    """The terms in a band of document frequency, as a lookup column and, if they are many, a table.

    Frequencies are counted over the distinct texts of all documents (told apart by a
    64-bit hash), so that copies don't push their own terms out. Terms in more than a
    share ``most`` or less than a share ``least`` of them are out; all others make the
    lexicon, at most the mean number of distinct terms a text over ``least``. Up to
    ``size`` of them, the most frequent ones, are sent to the tasks, 8 bytes a term; what is
    more is a table with the column ``t``, to be joined. None of those is in more than one in ``size`` of
    all (text, term) pairs, so none is a hot key. The column is a constant, an array of
    ``slots`` short arrays: a term's hash is looked up in the slot that it falls in.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    hashed = docs.select(text).withColumn("hash", F.xxhash64("text"))
    copies = cut_lineage(hashed.groupBy("hash").count())
    total = copies.count()
    copied = may_be_among(F.col("hash"), copies.where("count > 1"), "hash")  # the others need no shuffle of their text
    once = hashed.where(copied).groupBy("hash").agg(F.first("text").alias("text"))
    texts = hashed.where(~copied).select("text").union(once.select("text"))
    found = texts.select(F.explode(terms(F.col("text"))).alias("t"))
    counted = found.groupBy("t").agg(F.count("*").alias("df"))
    band = counted.where(F.col("df").between(math.ceil(total * least), math.floor(total * most)))
    kept = band.select("t", "df").limit(size + 1).collect()
    rest = None
    if len(kept) > size:
        band = cut_lineage(band)
        kept = band.orderBy(F.desc("df"), "t").limit(size).collect()
        least_common = F.struct(-F.lit(kept[-1]["df"]).cast("long"), F.lit(kept[-1]["t"]).cast("long"))
        rest = band.where(F.struct(-F.col("df"), F.col("t")) > least_common).select("t")
    in_slot: list[list[int]] = [[] for _ in range(slots)]
    for t in sorted(row["t"] for row in kept):
        in_slot[t % slots].append(t)
    common = F.from_json(F.lit(json.dumps(in_slot, separators=(",", ":"))), "array<array<bigint>>")
    return Lexicon(common, rest)


class Lexicon(NamedTuple):
    """Terms as a lookup column, and the rest of them, if there are more, as a table."""

    common: Column
    rest: DataFrame | None


def in_lexicon(found: Column, lexicon: Column, slots: int = 65_536) -> Column:
    return F.filter(
        found,
        lambda t: F.array_contains(F.get(lexicon, F.pmod(t, F.lit(slots)).cast("int")), t),
    )


def signatures(
    found: Column, kept: Column, text: Column, subsets: int = 24, share: int = 56, covered: int = 16
) -> Column:
    """Hashes of a document's lexicon terms ``kept``, the first over all of them, the others over
    randomised subsets of the lexicon.

    A hash deals the terms to ``share`` parts, of which the first are the subsets: no two
    share a term, and a term is hashed once for all of them. A subset with no term of the document gives null. Where less than one in ``covered`` of a
    document's terms is in the lexicon (near copies that make a large part of the rows, a
    rare language), all its terms stand in for the lexicon terms, in the first signature
    and in the subsets; it is like others of its kind then, but not like a text of which
    only a part is of that kind. A document without terms gets one signature from its
    characters.
    """
    few = lambda own: F.size(own) * covered < F.size(found)

    def of(own: Column) -> Column:
        dealt = F.transform(
            own, lambda t: F.struct(F.pmod(F.xxhash64(F.lit(1), t), F.lit(share)).alias("part"), t.alias("t"))
        )
        parts = let(
            F.filter(dealt, lambda d: d["part"] < subsets - 1),
            lambda some: F.transform(
                F.sequence(F.lit(0), F.lit(subsets - 2)),
                lambda k: let(
                    F.filter(some, lambda d: d["part"] == k), lambda s: F.when(F.size(s) > 0, F.xxhash64(k, s))
                ),
            ),
        )
        whole = F.when(F.size(own) > 0, F.xxhash64(F.lit(0), own)).otherwise(F.xxhash64(F.lit(-2), text))
        return F.concat(F.array(whole), parts)

    return let(let(kept, lambda own: F.when(few(own), found).otherwise(own)), of)


def fingerprint_text(sigs: Column) -> Column:
    """Signatures in hexadecimal, joined by dots; an empty subset is a minus sign."""
    return F.array_join(F.transform(sigs, lambda s: F.coalesce(F.lower(F.lpad(F.hex(s), 16, "0")), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among those that at least one side has."""
    both = F.zip_with(
        a,
        b,
        lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(x.eqNullSafe(y).cast("int")),
    )
    seen = F.filter(both, lambda x: x.isNotNull())
    return F.aggregate(seen, F.lit(0), lambda s, x: s + x).cast("double") / F.greatest(F.size(seen), F.lit(1))


def fingerprint(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "signatures") -> DataFrame:
    """``docs`` with the array ``signatures``. Only the text counts: equal texts have
    equal signatures; null counts as empty. An input column of that name is replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("_im_terms", terms(text))
    kept = in_lexicon(F.col("_im_terms"), lexicon.common)
    if lexicon.rest is not None:
        found = found.withColumns({"_im_hash": F.xxhash64(text), "_im_common": kept})
        others = found.select("_im_hash", F.explode(F.array_except("_im_terms", "_im_common")).alias("t"))
        others = others.join(lexicon.rest, "t", "left_semi").groupBy("_im_hash").agg(F.collect_set("t").alias("_im_kept"))
        found = found.join(others, "_im_hash", "left")
        kept = F.array_sort(F.concat("_im_common", F.coalesce("_im_kept", F.expr("cast(array() as array<bigint>)"))))
    return found.withColumn(out, signatures(F.col("_im_terms"), kept, text)).drop("_im_terms", "_im_hash", "_im_kept", "_im_common")


def next_keys(keys: DataFrame) -> DataFrame:
    """``key`` and ``next``, the key after it in descending order (nulls last within
    it); after the last comes the first. ``keys`` has one column of distinct structs.

    Keys are range-partitioned; the window runs inside partitions, and the last key of
    each takes the first of the next partition. One row a partition meets in one task.
    """
    order = [F.col(f"key.{name}").desc_nulls_last() for name in keys.schema["key"].dataType.names]
    parts = cut_lineage(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    led = cut_lineage(
        parts.select("*", F.lead("key").over(inside).alias("next"), F.row_number().over(inside).alias("rank"))
    )
    firsts = led.where("rank = 1").select("part", F.col("key").alias("first"))
    by_part = Window.orderBy("part")
    after = F.coalesce(
        F.lead("first").over(by_part),
        F.first("first").over(by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    ring = firsts.select("part", after.alias("after"))
    return led.join(ring, "part").select("key", F.coalesce("next", "after").alias("next"))


def compare_with_edits(
    docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first as many
    (or all) of the next document, in descending order of (id, hash of the text) with
    null ids last; after the last comes the first. Returns the id, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``. Null counts as empty. Rows with the same id and text are in one place
    of the order and get equal results; a lone document is its own next. Other columns
    are not read. An empty table gives no rows; texts are cut into words whole, however long, and
    a text and its edited one are held with their words for as long as their row is worked on.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select(F.struct("id", F.xxhash64("text").alias("hash")).alias("key"), "text")
    sized = base.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    sized = cut_lineage(sized)
    links = next_keys(sized.select("key")).join(sized, "key")
    asked = links.select(F.col("next").alias("key"), F.struct("key", F.floor(F.col("n") / 2).cast("int").alias("half")).alias("by"))
    marked = fingerprint(base.join(asked, "key"), lexicon)
    head = marked.select(
        F.col("by.key").alias("key"),
        F.substring("text", F.lit(1), F.col("by.half")).alias("piece"),
        F.col("signatures").alias("next_signatures"),
    ).dropDuplicates(["key"])
    joined = marked.select("key", "text", "signatures").join(head, "key")
    n = F.length("text")
    kept = F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int"))
    edited = fingerprint(joined.withColumn("edited", F.concat(kept, "piece")), lexicon, "edited", "edited_signatures")
    return edited.select(
        F.col("key.id").alias(id_col),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("signatures")).alias("fingerprint"),
        fingerprint_text(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
