"""Language of documents: word scores, and Viterbi paths that label spans of mixed text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, is_held_out, sliced, tidy

#: First code point, last code point and script of Unicode ranges. What
#: lies between ranges has no script of its own here.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]
SCRIPTS = sorted({name for _, _, name in SCRIPT_RANGES})
_FIRSTS = np.array([a for a, _, _ in SCRIPT_RANGES])
_LASTS = np.array([b for _, b, _ in SCRIPT_RANGES])
_NAMES = np.array([SCRIPTS.index(n) for _, _, n in SCRIPT_RANGES])

#: Words of these scripts aren't parted by spaces; their runs are cut after so many letters.
UNSPACED, RUN = ("han", "kana", "thai"), 4
_BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
_RUNS = re.compile(
    "|".join(
        "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, n in SCRIPT_RANGES if n == name) + r"\W\d_]" + (f"{{1,{RUN}}}" if name in UNSPACED else "+")
        for name in SCRIPTS
    )
    + "|.",
    re.DOTALL,
)

SLOTS = 1 << 15
UNDETERMINED = "und"


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Place in SCRIPTS of each code point, -1 for none."""
    at = np.searchsorted(_FIRSTS, points, side="right") - 1
    return np.where((at >= 0) & (points <= _LASTS[np.maximum(at, 0)]), _NAMES[np.maximum(at, 0)], -1)


def words_of(text: str | None) -> list[str]:
    """Lower-case words: what white space separates, cut where the script changes."""
    words = (text or "").lower().split()
    if not text or text.isascii() or not _BEYOND_LATIN.search(text):
        return words
    return [p for w in words for p in (_RUNS.findall(w) if _BEYOND_LATIN.search(w) else (w,))]


@dataclass
class Words:
    """Different words, cut to their letters: slots of their letter trigrams, number of
    letters, script."""

    slots: np.ndarray
    starts: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def measure(words: list[str]) -> Words:
    """A word of n letters has n trigrams, those over its ends included; case doesn't count."""
    kept = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]
    letters = np.array([len(w) for w in kept], np.int64)
    points = np.frombuffer("".join(f" {w} " for w in kept).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(letters + 2)])[:-1]
    starts = np.concatenate([[0], np.cumsum(letters)])
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], letters) + np.repeat(first, letters)
    if not len(at):
        return Words(np.zeros(0, np.int64), starts, letters, np.full(len(words), -1))
    mixed = (points[at] * np.uint64(0x9E3779B1) + points[at + 1]) * np.uint64(0x85EBCA77) + points[at + 2]
    slots = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)
    script = np.where(letters > 0, scripts_of(points[np.minimum(first + 1, len(points) - 1)].astype(np.int64)), -1)
    return Words(slots, starts, letters, script)


@dataclass(frozen=True)
class LanguageModel:
    """Log chances of trigram slots by language, and which scripts a language uses."""

    languages: list[str]
    table: np.ndarray  # slots x languages
    uses: np.ndarray  # scripts x languages
    penalty: float = 14.0

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words x languages) and letters of each word. A language that doesn't use
        the word's script is out, unless none does; words without letters score 0."""
        m = measure(words)
        out = np.zeros((len(words), len(self.languages)), np.float64)
        has = np.flatnonzero(m.letters)
        if len(has):
            for k in range(len(self.languages)):
                out[has, k] = np.add.reduceat(self.table[m.slots, k], m.starts[has])
            narrowed = (m.script >= 0) & self.uses[np.maximum(m.script, 0)].any(axis=1)
            out[narrowed] = np.where(self.uses[m.script[narrowed]], out[narrowed], -1e6)
        return out, m.letters

    def label(self, docs: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The best path of each document: the language's place for each word; letters by
        language on the path (documents x languages); sums of word scores."""
        order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
        known: dict[str, int] = {}
        n_langs = len(self.languages)
        lengths = np.array([len(docs[k]) for k in order], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        word = np.fromiter(
            (known.setdefault(w, len(known)) for k in order for w in docs[k]), np.int64, int(starts[-1])
        )
        scores, letters = self.word_scores(list(known))
        steps = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # documents longer than t
        value = np.zeros((len(docs), n_langs))
        # Whether the best way to (word, language) switches: a bit each.
        moved = np.zeros((int(starts[-1]), -(-n_langs // 8)), np.uint8)
        source = np.zeros(int(starts[-1]), np.int16)  # and from where
        for t in range(steps):
            m = active[t]
            at = starts[:m] + t
            v = value[:m]
            if t:
                best = v.argmax(axis=1)
                switch = v[np.arange(m), best] - self.penalty
                moved[at] = np.packbits(v < switch[:, None], axis=1)
                source[at] = best
                v = np.maximum(v, switch[:, None])
            value[:m] = v + scores[word[at]]
        path = np.zeros(int(starts[-1]), np.int16)
        now = value.argmax(axis=1) if n_langs else np.zeros(len(docs), int)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            at = starts[:m] + t
            path[at] = now[:m]
            switched = moved[at, now[:m] >> 3] >> (7 - (now[:m] & 7)) & 1
            now[:m] = np.where(switched, source[at], now[:m])
        row = np.repeat(np.arange(len(docs)), lengths)
        by_language = np.zeros((len(docs), n_langs))
        np.add.at(by_language, (row, path), letters[word])
        sums = np.zeros((len(docs), n_langs))
        for k in range(n_langs):
            sums[:, k] = np.bincount(row, scores[word, k], len(docs))
        back = np.empty(len(docs), int)
        back[order] = np.arange(len(docs))
        paths = [path[starts[k] : starts[k + 1]] for k in back]
        return paths, by_language[back], sums[back]


def train_language(
    docs: DataFrame,
    sample: int = 2_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    smooth: float = 0.5,
    least_share: float = 0.02,
    most_languages: int = 512,
) -> LanguageModel:
    """Count letter trigrams of at most ``sample`` documents a language.

    Never learns from rows that ``is_held_out``, nor from null languages, ids or texts.
    The sample is the documents with the smallest hash of their id in each language;
    only their ids and languages are broadcast. What reaches the driver is at most a
    number for each slot and language; more than ``most_languages`` languages are an error.
    Of rows that repeat an id in a language one is learned from, that of the least text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    fit = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out("id"))
    ids = fit.select("id", "lang").distinct()
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    # Only ids whose hash lies below a language's cut, about twice the sample, are ranked.
    shares = [F.when(F.col("lang") == lang, 2 * sample / n) for lang, n in sorted(sizes.items()) if n > 2 * sample]
    below = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.coalesce(*shares, F.lit(1.0)) * float(1 << 30)
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id")
    chosen = ids.where(below).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)
    texts = fit.join(F.broadcast(chosen.select("id", "lang")), ["id", "lang"])
    texts = texts.where(F.col("text").isNotNull()).groupBy("id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    @tidy
    def count(batches: Batches) -> Batches:
        for batch in sliced(batches):
            for lang in dict.fromkeys(batch["lang"].to_pylist()):
                mine = batch.filter(pc.equal(batch["lang"], lang))
                words = [w for t in mine["text"].to_pylist() for w in words_of(t)]
                m = measure(words)
                slots = np.bincount(m.slots, minlength=SLOTS)
                scripts = np.bincount(m.script[m.script >= 0], m.letters[m.script >= 0], len(SCRIPTS)).astype(np.int64)
                both = np.concatenate([slots, scripts])
                at = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(both[at])], ["lang", "slot", "n"]
                )

    counted = texts.mapInArrow(count, "lang string, slot long, n long")
    got = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in got})
    place = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((SLOTS + len(SCRIPTS), len(languages)))
    for r in got:
        counts[r["slot"], place[r["lang"]]] = r["n"]
    table = counts[:SLOTS] + smooth
    table = np.log(table / table.sum(axis=0))
    scripts = counts[SLOTS:]
    uses = scripts >= least_share * np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(languages, table, uses)


def identify_language(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", batch_words: int = 1_500_000
) -> DataFrame:
    """The id, ``lang_pred``, ``score`` and ``spans`` of every whole text.

    Words are what white space separates, cut where the script changes. The path over them with the best sum of word
    scores, less a penalty for each switch, labels spans; the language with most letters
    is predicted. ``score`` is its share of the letters times its chance by the word
    scores alone. ``spans`` is an array of (lang, begin, end) in words, end exclusive.
    Null texts and texts without a letter are ``und`` with score 0 and no spans, as is
    everything where no language was learned. Texts are labelled for about ``batch_words`` words
    at a time, fewer as the model has more than eight languages. Only the text counts, so equal texts have
    equal results; ties go to the language first by name. Other columns are not read,
    whatever their names; texts are labelled whole, and an empty table gives no rows.
    """
    span = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("spans", T.ArrayType(span)),
        ]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Batches) -> Batches:
        fitted = sent.value
        names = np.array([*fitted.languages, UNDETERMINED], object)
        most = max(1, 8 * batch_words // max(8, len(fitted.languages)))
        for batch in sliced(batches):
            ids, texts = batch.columns
            words = [words_of(t) for t in texts.to_pylist()]
            order = sorted(range(len(words)), key=lambda k: -len(words[k]))  # alike lengths step together
            pred, score = [UNDETERMINED] * len(words), [0.0] * len(words)
            spans: list[list[dict]] = [[] for _ in words]
            at = 0
            while at < len(order) and fitted.languages:
                end, size = at, 0
                while end < len(order) and (end == at or size + len(words[order[end]]) <= most):
                    size += len(words[order[end]])
                    end += 1
                part = order[at:end]
                at = end
                paths, by_language, sums = fitted.label([words[k] for k in part])
                total = by_language.sum(axis=1)
                best = by_language.argmax(axis=1)
                chance = np.exp(sums - sums.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                for j, k in enumerate(part):
                    if not total[j]:
                        continue
                    pred[k] = names[best[j]]
                    score[k] = float(by_language[j, best[j]] / total[j] * chance[j, best[j]])
                    cuts = np.flatnonzero(paths[j][1:] != paths[j][:-1]) + 1
                    edges = [0, *cuts.tolist(), len(paths[j])]
                    spans[k] = [
                        {"lang": names[paths[j][a]], "begin": a, "end": b} for a, b in zip(edges, edges[1:], strict=False)
                    ]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], schema.names
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
