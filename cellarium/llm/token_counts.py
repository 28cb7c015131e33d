"""Token counts of texts: words that are tokens as they stand are counted, only the rest is merged."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BytePairEncoder, encoder
from .common import Batches, sliced, tidy
from .words import parts


def whole_tokens(bpe: BytePairEncoder) -> pa.Array:
    """The strings of the vocabulary that, encoded alone, are one token.

    Each string of the vocabulary is encoded: it counts only if the pattern leaves it one word
    and its merges end in the one token that it names. Tokens that aren't valid UTF-8 never are
    a whole word, and special tokens are found before words are. This is proved once for a
    vocabulary, before any text is read.
    """
    names = {}
    for k in bpe.vocab.values():
        if k in bpe.special.values():
            continue
        try:
            names[bpe.decode_strict(k)] = k
        except UnicodeDecodeError:
            continue
    texts = [t for t in names if bpe.words.findall(t) == [t]]
    encoded = bpe.encode_words(texts)
    return pa.array([t for t, ids in zip(texts, encoded, strict=True) if ids == np.uint32(names[t]).astype("<u4").tobytes()], pa.string())


@lru_cache(maxsize=2)
def proved_tokens(path: str) -> pa.Array:
    return whole_tokens(encoder(path))


class TokenCounter:
    """How many tokens texts have.

    A piece of a text, or a word of a piece, that is one of ``whole`` is one token. Other pieces
    are cut into words and merged; their counts are remembered in about ``most_bytes`` at most,
    of pieces of up to ``longest`` bytes. When that is full, what was remembered goes.
    """

    def __init__(self, bpe: BytePairEncoder, whole: pa.Array, most_bytes: int = 16 << 20, longest: int = 64):
        self.bpe, self.whole, self.most_bytes, self.longest = bpe, whole, most_bytes, longest
        self._known = set(whole.to_pylist())
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.counts = pa.array([], pa.string()), np.zeros(0, np.int64)

    def merged(self, pieces: pa.Array) -> np.ndarray:
        """Counts of different pieces that are no whole tokens."""
        special, known = self.bpe.special, self._known
        split = [[p] if p in special else self.bpe.words.findall(p) for p in pieces.to_pylist()]
        rest = list(dict.fromkeys(w for s in split for w in s if w not in known and w not in special))
        sizes = {w: len(ids) // 4 for w, ids in zip(rest, self.bpe.encode_words(rest), strict=True)}
        return np.fromiter((sum([sizes.get(w, 1) for w in s]) for s in split), np.int64, len(split))

    def of_pieces(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        different = coded.dictionary
        out = np.ones(len(different), np.int64)
        rest = np.flatnonzero(pc.is_null(pc.index_in(different, value_set=self.whole)).to_numpy(zero_copy_only=False))
        others = different.take(pa.array(rest))
        at = pc.index_in(others, value_set=self.pieces)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        out[rest[~new]] = self.counts[at.drop_null().to_numpy()]
        added = others.filter(pa.array(new))
        out[rest[new]] = self.merged(added)
        self._keep(added, out[rest[new]])
        return out[coded.indices.to_numpy()]

    def _keep(self, pieces: pa.Array, counts: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(pieces), self.longest).to_numpy(zero_copy_only=False)
        pieces, counts = pieces.filter(pa.array(short)), counts[short]
        if self.pieces.nbytes + self.counts.nbytes + pieces.nbytes + counts.nbytes > self.most_bytes:
            self._forget()
        if pieces.nbytes + counts.nbytes <= self.most_bytes:
            self.pieces, self.counts = pa.concat_arrays([self.pieces, pieces]), np.concatenate([self.counts, counts])

    def of(self, texts: list[str], chars: int = 12_000_000) -> np.ndarray:
        """Tokens of each text, worked on in slices of about ``chars`` characters."""
        out, text = np.zeros(len(texts), np.int64), 0
        for part in parts(texts, chars):
            pieces, edges = self.bpe.split([piece for piece, _ in part])
            ends = np.concatenate([[0], np.cumsum(self.of_pieces(pieces))])[edges]
            last = np.array([is_last for _, is_last in part])
            texts_of = text + np.cumsum(last) - last
            np.add.at(out, texts_of, np.diff(ends))
            text = int(texts_of[-1]) + int(last[-1])
        return out


def count_tokens(
    docs: DataFrame,
    limit: int = 1024,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_chars: int = 12_000_000,
) -> DataFrame:
    """Tokens of every whole text: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Null counts as empty; an empty text has no tokens. A special token's text inside a text is
    that token, as by the library's default. ``path`` names a byte-level vocabulary; the proof
    which of its strings are tokens alone is made on the driver and sent along (a bounded list:
    the vocabulary). Rows are independent: repeats and equal ids get equal results, nothing is
    shuffled, an empty table gives no rows, and other columns are not read, whatever their
    names. Very long texts are worked on in slices.
    """
    whole = proved_tokens(path or public_tokenizers.path("byte_bpe_50k.json"))

    @tidy
    def run(batches: Batches) -> Batches:
        counter = TokenCounter(encoder(path or public_tokenizers.path("byte_bpe_50k.json")), whole)
        for batch in sliced(batches, batch_chars):
            ids, texts = batch.columns
            n = counter.of([t or "" for t in texts.to_pylist()], batch_chars)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, size, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_tc_id"), F.col(text_col).alias("_tc_text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
