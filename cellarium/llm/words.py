"""Ids of the words of many texts, from arrays of words that are remembered between batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where a long text is cut: white space after something else.
_SPACE = re.compile(r"(?<=\S)[ \t\n\r]")

#: Where a text is cut into chunks.
_CHUNK = re.compile(r"(?<=\S)(?= )")


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, .. of each k, counts[k] of them, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


def packed(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids given as little-endian 32-bit numbers: all of them, and how many each item has."""
    return np.frombuffer(b"".join(encoded), "<u4"), np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4


class WordIds:
    """Ids of words by ``encode``, which gives those of different words: all ids, and how many
    each word has.

    What is remembered takes about ``most_bytes`` at most and belongs to the object, so
    that it goes with the task that made it; words of over ``longest`` bytes are never
    kept. When it is full, the words of the last batch stay.
    """

    def __init__(
        self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most_bytes: int = 32 << 20, longest: int = 64
    ):
        self.encode, self.most_bytes, self.longest = encode, most_bytes, longest
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    @property
    def bytes(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.sizes.nbytes

    def find(self, words: pa.Array) -> "Found":
        coded = words.dictionary_encode()
        different, index = coded.dictionary, coded.indices.to_numpy()
        at = pc.index_in(different, value_set=self.words)
        unknown = pc.is_null(at).to_numpy(zero_copy_only=False)
        new = different.filter(pa.array(unknown))
        added, counts = self.encode(new)
        ids = np.concatenate([self.ids, added.astype(np.uint32, copy=False)])
        sizes = np.concatenate([self.sizes, counts.astype(np.int32)])
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[unknown] = len(self.words) + np.arange(len(new))
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        found = Found(ids, starts[place], sizes[place].astype(np.int64), index)
        if len(new):
            self._keep(different, new, place, ids, sizes, starts)
        return found

    def _keep(self, different, new, place, ids, sizes, starts) -> None:
        known = len(self.words)
        short = pc.less_equal(pc.binary_length(new), self.longest).to_numpy(zero_copy_only=False)
        added = new.filter(pa.array(short))
        at = known + np.flatnonzero(short)
        if self.bytes + added.nbytes + 4 * int(sizes[at].sum()) + 4 * len(at) > self.most_bytes:
            self._forget()  # what this batch has stays, if that is not too much itself
            short = pc.less_equal(pc.binary_length(different), self.longest).to_numpy(zero_copy_only=False)
            added, at = different.filter(pa.array(short)), place[short]
            if added.nbytes + 4 * int(sizes[at].sum()) + 4 * len(at) > self.most_bytes:
                return
        self.words = pa.concat_arrays([self.words, added])
        self.ids = np.concatenate([self.ids, ids[ragged(starts[at], sizes[at].astype(np.int64))]])
        self.sizes = np.concatenate([self.sizes, sizes[at]])


@dataclass(frozen=True)
class Found:
    """The ids of a batch of words: of the k-th, sizes[index[k]] ids from starts[index[k]] on."""

    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    index: np.ndarray

    def of(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words a to b, one after the other, and how many each has."""
        counts = self.sizes[self.index[a:b]]
        return self.ids[ragged(self.starts[self.index[a:b]], counts)], counts


def encode_texts(
    texts: list[str],
    cut: Callable[[list[str]], tuple[pa.Array, np.ndarray]],
    words: WordIds,
    chars: int = 12_000_000,
    together: int = 500_000,
) -> Iterator[np.ndarray]:
    """The ids of each text, in its order.

    ``cut`` gives the words of texts, one after the other, and where each text's begin
    (and the last ends). Words are looked up for about ``chars`` characters at a time and
    their ids put together for about ``together`` words; a longer text is cut before white
    space into slices, so words must not depend on what lies beyond white space on either
    side of a cut.
    """
    held: list[np.ndarray] = []
    for part in parts(texts, chars):
        flat, edges = cut([piece for piece, _ in part])
        found = words.find(flat)
        groups = np.flatnonzero(np.diff(edges[1:] // together)) + 1  # slices in which about so many words end
        for first, end in pairwise([0, *groups.tolist(), len(part)]):
            ids, counts = found.of(edges[first], edges[end])
            ends = np.concatenate([[0], np.cumsum(counts)])[edges[first : end + 1] - edges[first]].tolist()
            for (_, last), a, b in zip(part[first:end], ends[:-1], ends[1:], strict=True):
                if last and not held:
                    yield ids[a:b]
                    continue
                held.append(ids[a:b])
                if last:
                    yield np.concatenate(held)
                    held = []


def parts(texts: list[str], chars: int) -> Iterator[list[tuple[str, bool]]]:
    """Lists of (slice, whether it is its text's last)."""
    part, size = [], 0
    for piece, last in chain.from_iterable(_slices(t, chars) for t in texts):
        part.append((piece, last))
        size += len(piece)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def space_chunks(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before each space that follows something else than white space, and where each
    text's pieces begin (and the last ends)."""
    whole = pa.array(texts, pa.string())
    lists = pc.split_pattern(pc.replace_substring(whole, " ", "\0 "), "\0")
    pieces, edges = lists.values, lists.offsets.to_numpy().astype(np.int64)
    # A piece that ends in white space, or is nothing else, must not be cut from what follows.
    size, bare = (pc.binary_length(p).to_numpy() for p in (pieces, pc.utf8_rtrim_whitespace(pieces)))
    last = np.zeros(len(pieces), bool)
    last[edges[1:] - 1] = True
    odd = np.logical_or.reduceat((bare != size) & ~last, edges[:-1]) if len(texts) else np.zeros(0, bool)
    for found in (pc.match_substring(whole, "\0"), pc.starts_with(whole, " ")):
        odd |= found.to_numpy(zero_copy_only=False)
    if not odd.any():
        return pieces, edges
    cut = [_CHUNK.split(t) for t, o in zip(texts, odd.tolist(), strict=True) if o]
    both = pa.concat_arrays([lists.filter(pa.array(~odd)), pa.array(cut, pa.list_(pa.string()))])
    both = both.take(pa.array(np.argsort(np.argsort(odd, kind="stable"))))
    return both.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(both).to_numpy(), dtype=np.int64)])


def _slices(text: str, chars: int) -> Iterator[tuple[str, bool]]:
    at = 0
    while len(text) - at > chars and (found := _SPACE.search(text, at + chars)):
        yield text[at : found.start()], False
        at = found.start()
    yield text[at:], True


def flat_words(lists: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(chain.from_iterable(lists), pa.string()), np.concatenate([[0], np.cumsum(list(map(len, lists)), dtype=np.int64)])
