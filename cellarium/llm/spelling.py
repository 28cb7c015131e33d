"""Spelling variants of the words of a corpus: words one edit apart, grouped under the common form.

Counting, joins and grouping are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: A letter, in the pattern's own words.
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Three bands of BAND_BITS bits. Common letters are dealt over the bands in turn (fixed order:
#: about their frequency in western languages); letters above 191 share the upper bits.
_COMMON, BANDS, BAND_BITS = "enaotirhsulcdfgbmzwyxvqpkj", 3, 20


def _bit(letter: int) -> int:
    at = _COMMON.find(chr(letter))
    band, bit = (at % BANDS, at // BANDS) if at >= 0 else (letter % BANDS, 9 + letter // BANDS % 11)
    return band * BAND_BITS + bit


def parity_mask(word: Column) -> Column:
    """One bit a letter, set where the letter's number of occurrences is odd."""
    bits = F.array(*[F.lit(1 << _bit(c)) for c in range(256)])
    return F.aggregate(
        F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.coalesce(F.get(bits, F.ascii(c)), F.lit(0)).cast("long"))
    )


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int = 199, least_letters: int = 6, least_count: int = 5
) -> DataFrame:
    """``word`` and ``n`` of all runs of letters of all texts, A to Z as a to z.

    A run whose crc32 with its document's id is divisible by ``drop_one_in`` loses one letter
    there (made-up slips, so that there is something to find; None for the words as they are).
    Counts are added up before they are shuffled, so a common word is a row a task.
    """
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    runs = docs.select(F.col(id_col).cast("string").alias("_sv_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("word"))
    if drop_one_in:
        h = F.crc32(F.concat(F.coalesce("_sv_id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = runs.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _keys(words: DataFrame, bucket: int) -> DataFrame:
    """``words`` under each of their keys: band, half and length of the shorter word of a pair.

    An edit changes at most two letters' parities, so one of three bands of the mask stays as
    it is; and it lies in one half of a word, so the other half stays too. Two words of a pair
    share a key of (band, its bits, half, its letters, length of the shorter), and a word looks
    for words as long as itself and for those one letter shorter. Words under a key are
    dealt to ``_sv_salt`` blocks of about ``bucket`` where many share it.
    """
    words = words.withColumns({"length": F.length("word"), "mask": parity_mask(F.col("word"))})
    wide = F.array(*[
        F.struct(F.lit(shorter).alias("shorter"), F.lit(band).alias("band"), F.lit(half).alias("half"))
        for shorter in (0, 1) for band in range(BANDS) for half in (0, 1)
    ])
    keyed = words.withColumn("k", F.explode(wide)).select("word", "n", "mask", "length", "k.*")
    short = F.col("length") - F.col("shorter")
    kept = F.when(F.col("half") == 0, F.floor(short / 2)).otherwise(short - F.floor(short / 2)).cast("int")
    letters = F.when(F.col("half") == 0, F.substring(F.col("word"), F.lit(1), kept)).otherwise(F.substring(F.col("word"), -kept, kept))
    bits = F.shiftright(F.col("mask"), 0)
    for band in range(1, BANDS):
        bits = F.when(F.col("band") == band, F.shiftright(F.col("mask"), band * BAND_BITS)).otherwise(bits)
    bits = bits.bitwiseAND((1 << BAND_BITS) - 1)
    return keyed.withColumn("key", F.xxhash64("band", "half", short, bits, letters)).select("word", "n", "mask", "shorter", "band", "half", "key")


def _first_key(a: str, b: str) -> Column:
    """Number of the first (band, half) that two words share."""
    x = F.col(f"{a}.mask").bitwiseXOR(F.col(f"{b}.mask"))
    band = F.lit(2)
    for k in (1, 0):
        band = F.when(x.bitwiseAND(((1 << BAND_BITS) - 1) << (k * BAND_BITS)) == 0, k).otherwise(band)
    short = F.floor(F.least(F.length(f"{a}.word"), F.length(f"{b}.word")) / 2).cast("int")
    same = F.substring(F.col(f"{a}.word"), F.lit(1), short) == F.substring(F.col(f"{b}.word"), F.lit(1), short)
    return band * 2 + F.when(same, 0).otherwise(1)


def near_words(words: DataFrame, bucket: int = 512) -> DataFrame:
    """``word``, ``n``, ``other`` and ``other_n`` for all pairs of words one edit apart, both ways.

    Words meet by equal bands and an equal half, with the length filter as part of the key, and
    are verified by edit distance where they meet; each pair is taken at the first key that it
    shares. A key that more than ``bucket`` words share is dealt: the words that look are split
    over blocks, and the words looked for are copied to each block.
    """
    keyed = _keys(words, bucket)
    own, all_ = keyed.where(F.col("shorter") == 0), keyed
    sizes = all_.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > bucket)
    blocks = F.coalesce(F.ceil(F.col("size") / bucket), F.lit(1)).cast("int")
    own = own.join(sizes, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), blocks - 1)))
    looking = all_.join(sizes, "key", "left").withColumn("salt", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    a, b = looking.alias("a"), own.alias("b")
    met = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.salt") == F.col("b.salt"))
        & (F.col("a.band") == F.col("b.band"))
        & ((F.col("a.shorter") == 1) | (F.col("a.word") < F.col("b.word")))
        & (F.length("a.word") - F.length("b.word") == F.col("a.shorter"))
        & (F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask"))) <= 2)
        & (F.col("a.band") * 2 + F.col("a.half") == _first_key("a", "b"))
        & (F.levenshtein("a.word", "b.word", 1) == 1),
    )
    pair = lambda x, y: F.struct(
        F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("other"), F.col(f"{y}.n").alias("other_n")
    )
    return met.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("p")).select("p.*")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    drop_one_in: int = 199,
    least_letters: int = 6,
    least_count: int = 5,
    times: int = 5,
) -> DataFrame:
    """Each word of at least ``least_letters`` letters and ``least_count`` occurrences with the
    word that it is taken to be a spelling of.

    Returns ``word``, ``form`` (of the words one inserted, deleted or replaced code point away the
    most frequent, ties by code points, if it is at least ``times`` as frequent; else null),
    ``root`` (the last of the forms of forms, the word itself without one), ``n``, ``n_near`` and
    ``form_n``. Null and empty texts have no words, a null id counts as an empty one; repeated
    rows count as often as they come; an empty table gives no rows; other columns are not read,
    whatever their names. Runs are searched whole, however long. Counts rise ``times`` fold from form to form,
    so chains are short: their ends are found in rounds that double what each skips.
    """
    words = cut_lineage(word_counts(docs, id_col, text_col, drop_one_in, least_letters, least_count))
    best = near_words(words).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("back"), F.col("other").alias("form"))).alias("best")
    )
    fits = -F.col("best.back") >= times * F.col("n")
    best = cut_lineage(best.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.back")).alias("form_n")))
    roots = _roots(best.where(F.col("form").isNotNull()).select("word", "form"))
    whole = words.join(best, "word", "left").join(roots, "word", "left")
    return whole.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of all words with a form."""
    jumps = forms.select("word", F.col("form").alias("root"))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut_lineage(jumps.join(further, "root", "left"))
        jumps = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.where(F.col("next").isNotNull()).isEmpty():
            return jumps


#: The same in DuckDB. crc32 has no function there: it is folded over the bytes of code points
#: below 256. Near words share what is left when each loses a letter.
SPELLING_SQL = r"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k:
       CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, v)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch:
    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END)) AS b FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1]), 4294967295), 4294967295) AS h
  FROM (SELECT run, n, list_transform(b, lambda v: v::BIGINT) AS b, t FROM bytes, steps)),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::BIGINT AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min(struct_pack(back := -other_n, form := other)) AS top FROM near GROUP BY word),
formed AS (SELECT word, n_near, CASE WHEN -top.back >= 5 * n THEN top.form END AS form, CASE WHEN -top.back >= 5 * n THEN -top.back END AS form_n FROM best),
chain AS (SELECT word, form AS root, 1 AS depth FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM words w LEFT JOIN formed f USING (word) LEFT JOIN roots r USING (word)
"""
