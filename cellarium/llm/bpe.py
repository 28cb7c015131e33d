"""Byte-level byte-pair encoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, sliced, tidy
from .words import WordIds, encode_texts, packed, ragged

#: Ranks and vocabularies stay below 2^20; places below 2^40.
NO_RANK, PLACE_BITS = np.int64(1) << 20, 40


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files, and back: printable
    bytes stand for themselves, the others for the letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTree:
    """Least rank of the adjacent pairs of one long word: a segment tree.

    The root holds (rank, place) packed in one number, so its minimum is the
    leftmost pair of the lowest rank; a change of a pair walks up to the root. It is a flat
    array of 16 to 32 bytes a pair.
    """

    def __init__(self, ranks: np.ndarray):
        size = self.size = 1 << max(len(ranks) - 1, 1).bit_length()
        self.none = int(NO_RANK) << PLACE_BITS
        tree = np.full(2 * size, self.none, np.int64)
        tree[size : size + len(ranks)] = np.where(
            ranks < NO_RANK, (ranks << PLACE_BITS) | np.arange(len(ranks)), self.none
        )
        low = size
        while low > 1:
            low >>= 1
            tree[low : 2 * low] = np.minimum(tree[2 * low : 4 * low : 2], tree[2 * low + 1 : 4 * low : 2])
        self.tree = array("q", tree.tobytes())

    def set(self, place: int, rank: int) -> None:
        tree, k = self.tree, self.size + place
        tree[k] = (rank << PLACE_BITS) | place if rank < NO_RANK else self.none
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def best(self) -> int:
        """Place of the leftmost pair of lowest rank, -1 if no pair can be merged."""
        return self.tree[1] & ((1 << PLACE_BITS) - 1) if self.tree[1] < self.none else -1


class BytePairEncoder:
    """Encoder and decoder for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        letters = _byte_letters()
        names = self.vocab | self.special
        tokens = [b""] * (max(names.values()) + 1)
        for name, k in self.vocab.items():
            tokens[k] = bytes(letters[c] for c in name)
        for name, k in self.special.items():
            tokens[k] = name.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.array(list(map(len, tokens)), np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = self.vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        keys = np.array([self._key(self.vocab[a], self.vocab[b]) for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.rank_of = {int(k): i for i, k in enumerate(keys)}
        self.words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def _key(a, b):
        return (a << 20) | b

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where the pair can't be merged or a side is missing."""
        key = self._key(a, b)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], NO_RANK)

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word, for long ones: each merge costs the logarithm of the length."""
        first = self.byte_ids[np.frombuffer(word, np.uint8)]
        n = len(first)
        tree = PairTree(self._ranks(first[:-1], first[1:]))
        ids = array("q", first.tobytes())
        before, after = array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        rank = lambda i, j: self.rank_of.get((ids[i] << 20) | ids[j], int(NO_RANK))
        while (i := tree.best()) >= 0:
            j = after[i]
            ids[i] = int(self.merged[tree.tree[1] >> PLACE_BITS])
            ids[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if j < n - 1:
                tree.set(j, int(NO_RANK))
            tree.set(i, rank(i, after[i]) if after[i] < n else int(NO_RANK))
            if before[i] >= 0:
                tree.set(before[i], rank(before[i], i))
        return [k for k in ids if k >= 0]

    def _encode_equal(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of many words of at most ``width`` bytes (a power of two): one segment
        tree a word, all of them stepped together."""
        rows = np.arange(len(words))
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[raw], -1)
        after = np.minimum(np.arange(1, width + 1), lengths[:, None])
        before = np.tile(np.arange(-1, width - 1), (len(words), 1))
        places = np.arange(width)
        next_ids = np.concatenate([ids[:, 1:], np.full((len(words), 1), -1)], axis=1)
        tree = np.full((len(words), 2 * width), NO_RANK * width, np.int64)
        tree[:, width:] = self._ranks(ids, next_ids) * width + places
        for low in [width >> k for k in range(1, width.bit_length())]:
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        limit = NO_RANK * width

        def put(r: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
            k = width + place
            tree[r, k] = rank * width + place
            while k[0] > 1:
                k = k >> 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

        live = rows[tree[:, 1] < limit]
        while len(live):
            root = tree[live, 1]
            i = root % width
            j = after[live, i]
            ids[live, i] = self.merged[root // width]
            ids[live, j] = -1
            k = after[live, j]
            after[live, i] = k
            inside = k < lengths[live]
            before[live[inside], k[inside]] = i[inside]
            put(live, j, np.full(len(live), NO_RANK))
            right = np.where(inside, ids[live, np.minimum(k, width - 1)], -1)
            put(live, i, self._ranks(ids[live, i], right))
            b = before[live, i]
            has = b >= 0
            if has.any():
                put(live[has], b[has], self._ranks(ids[live[has], b[has]], ids[live[has], i[has]]))
            live = live[tree[live, 1] < limit]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), kept.sum(axis=1).cumsum() * 4
        return [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each as little-endian 32-bit numbers."""
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(raw):
            groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()) if len(w) > 1 else 1, []).append(k)
        for width, members in groups.items():
            if width == 1:
                got = [np.array([self.byte_ids[raw[k][0]]], "<u4").tobytes() for k in members]
            elif width > 64:
                got = [np.array(self.encode_word(raw[k]), "<u4").tobytes() for k in members]
            else:
                got = [
                    ids
                    for at in range(0, len(members), 8192)
                    for ids in self._encode_equal([raw[k] for k in members[at : at + 8192]], width)
                ]
            for k, ids in zip(members, got, strict=True):
                out[k] = ids
        return out

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pieces of texts that no word of the pattern reaches over, and where each text's begin.

        A text is cut before single spaces between non-spaces; where other spaces or special
        tokens make that less plain, it is cut into its words.
        """
        whole = pa.array(texts, pa.string())
        lists = pc.split_pattern(pc.replace_substring(whole, " ", "\0 "), "\0")
        pieces, edges = lists.values, lists.offsets.to_numpy().astype(np.int64)
        inner = np.ones(len(pieces), np.int64)
        inner[edges[:-1]] = 0  # a text's first piece has no space before it
        size = pc.binary_length(pieces).to_numpy()
        bare = pc.binary_length(pc.utf8_trim_whitespace(pieces)).to_numpy()
        plain = np.logical_and.reduceat((bare > 0) & (bare == size - inner), edges[:-1]) if len(texts) else np.zeros(0, bool)
        for mark in ("\0", *self.special):
            plain &= ~pc.match_substring(whole, mark).to_numpy(zero_copy_only=False)
        if plain.all():
            return pieces, edges
        odd = [self._words(t) for t, p in zip(texts, plain.tolist(), strict=True) if not p]
        both = pa.concat_arrays([lists.filter(pa.array(plain)), pa.array(odd, pa.list_(pa.string()))])
        both = both.take(pa.array(np.argsort(np.argsort(~plain, kind="stable"))))
        return both.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(both).to_numpy(), dtype=np.int64)])

    def _words(self, text: str) -> list[str]:
        parts = self.parts.split(text) if self.parts and any(s in text for s in self.special) else [text]
        return [w for p in parts if p for w in ([p] if p in self.special else self.words.findall(p))]

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces or special tokens, and how many each has."""
        split = [[p] if p in self.special else self.words.findall(p) for p in pieces.to_pylist()]
        atoms = list(dict.fromkeys(a for s in split for a in s if a not in self.special))
        known = dict(zip(atoms, self.encode_words(atoms), strict=True))
        known |= {name: np.array([k], "<u4").tobytes() for name, k in self.special.items()}
        return packed([known[s[0]] if len(s) == 1 else b"".join([known[a] for a in s]) for s in split])

    def encode(self, texts: list[str], words: WordIds | None = None, chars: int = 12_000_000) -> Iterator[np.ndarray]:
        """Ids of texts, in their order."""
        return encode_texts(texts, self.split, words or WordIds(self.encode_pieces), chars)

    def decode_strict(self, token: int) -> str:
        """A token's text; UnicodeDecodeError where its bytes are none."""
        start = int(self.token_starts[token])
        return self.token_bytes[start : start + int(self.token_sizes[token])].tobytes().decode("utf-8")

    def decode(self, ids: np.ndarray) -> str:
        raw = self.token_bytes[ragged(self.token_starts[ids], self.token_sizes[ids])].tobytes()
        return raw.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def encode_digests(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 12_000_000
) -> DataFrame:
    """Encode and decode every whole text; returns the id and digests of both.

    Columns: id, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit
    numbers) and ``decoded_sha256``. Null counts as empty; an empty text has no ids.
    A special token's text inside a text is that token. ``path`` names a byte-level
    vocabulary on every node; by default it is found on the node. Rows are
    independent: repeats get equal results. Other columns are not read, whatever their
    names; an empty table gives no rows. Long texts are worked on in slices; one word
    without white space takes about 60 bytes of a worker's memory a byte.
    """

    @tidy
    def run(batches: Batches) -> Batches:
        bpe = encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
        words = WordIds(bpe.encode_pieces)
        for batch in sliced(batches, batch_chars):
            row_ids, texts = batch.columns
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode([t or "" for t in texts.to_pylist()], words, batch_chars):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [row_ids, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_bpe_id"), F.col(text_col).alias("_bpe_text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
