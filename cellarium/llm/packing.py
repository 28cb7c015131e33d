"""Packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import Batches, cut_lineage, sliced, tidy
from .words import WordIds, encode_texts, flat_words, packed, ragged

class WordTokenizer:
    """Ids by the tokenizers library for a vocabulary whose words never hold white space.

    The library normalises white space to spaces and drops it, so a text's ids are
    those of its white-space separated parts, one after the other. Each different
    part is encoded once as long as it is remembered.
    """

    def __init__(self, path: str):
        # A task has one core: threads of the library's own would only take memory and wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[k for name, k in names.items() if name.endswith("</w>")]] = True

    def _encode(self, texts: list[str], together: int = 64) -> list[bytes]:
        parts = (texts[a : a + together] for a in range(0, len(texts), together))  # encodings are large
        found = (e for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))
        return [array("I", e.ids).tobytes() for e in found]

    def _encode_letters(self, words: list[str], together: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters: many are one text, cut where a token ends a word. Where
        the ends are not one a word (rare letters normalise to several words), one by one."""
        parts = [words[a : a + together] for a in range(0, len(words), together)]
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part, encoded in zip(parts, self._encode([" ".join(p) for p in parts]), strict=True):
            got = np.frombuffer(encoded, "<u4")
            counts = np.diff(np.flatnonzero(self.ends_word[got]), prepend=-1)
            if len(counts) != len(part):
                got, counts = packed(self._encode(part))
            ids.append(got)
            sizes.append(counts)
        return np.concatenate(ids), np.concatenate(sizes)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, and how many each has. One of letters before a full stop
        or comma is that word and the mark."""
        marked = pc.or_(pc.ends_with(words, "."), pc.ends_with(words, ","))
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words)
        plain = pc.utf8_is_alpha(stems)
        # Marks that stand for themselves, words of other signs, then stems of letters.
        other = pc.filter(words, pc.invert(plain)).to_pylist()
        letters = pc.filter(stems, plain)
        letters = pc.if_else(pc.string_is_ascii(letters), pc.ascii_lower(letters), letters).dictionary_encode()
        others, letter_ids = packed(self._encode([".", ",", *other])), self._encode_letters(letters.dictionary.to_pylist())
        ids = np.concatenate([others[0], letter_ids[0]])
        sizes = np.concatenate([others[1], letter_ids[1]])
        starts = np.cumsum(sizes) - sizes
        # Each word is one or two parts: itself or its stem, and a mark.
        is_plain = plain.to_numpy(zero_copy_only=False)
        two = is_plain & marked.to_numpy(zero_copy_only=False)
        first = np.cumsum(1 + two) - (1 + two)
        part = np.zeros(len(words) + int(two.sum()), np.int64)
        part[first[~is_plain]] = 2 + np.arange(len(other))
        part[first[is_plain]] = 2 + len(other) + letters.indices.to_numpy()
        part[first[two] + 1] = pc.ends_with(words, ",").to_numpy(zero_copy_only=False)[two]
        out = sizes[part]
        return ids[ragged(starts[part], out)], np.add.reduceat(out, first) if len(words) else out


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The white-space separated words of texts and where each text's begin."""
    # The library doesn't take these four for white space, Python and Arrow do.
    if any(c in t for t in texts for c in "\x1c\x1d\x1e\x1f"):
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        return flat_words([[t] if o else t.split() for t, o in zip(texts, odd, strict=True)])
    lists = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
    return lists.values, lists.offsets.to_numpy().astype(np.int64)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_chars: int = 6_000_000,
) -> DataFrame:
    """Each document's ids and ``end_id``, in pieces of ``capacity``; the last may be shorter.

    Returns id, ``piece``, ``start``, ``length`` and ``ids_crc32``. Null counts as an
    empty text, which is the end id alone.
    """
    kind = docs.schema[id_col].dataType
    end = np.array([end_id], "<u4")

    @tidy
    def run(batches: Batches) -> Batches:
        words = WordIds(tokenizer(path or public_tokenizers.path("word_bpe_49k.json")).encode_words)
        for batch in sliced(batches, batch_chars):
            ids, texts = batch.columns
            rows: list[tuple[int, int, int, int, int]] = []
            for at, encoded in enumerate(encode_texts([t or "" for t in texts.to_pylist()], split_words, words, batch_chars)):
                encoded = np.append(encoded, end)
                for k, a in enumerate(range(0, len(encoded), capacity)):
                    cut = encoded[a : a + capacity]
                    rows.append((at, k, a, len(cut), zlib.crc32(cut)))
            row, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc))],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    return docs.select(F.col(id_col).alias("_pk_id"), F.col(text_col).alias("_pk_text")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size, largest first, goes where least room is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # those that some bin has, ascending
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins[b].append(k)
        if room > size:
            if not by_room[room - size]:
                insort(rooms, room - size)
            by_room[room - size].append(b)
    return bins


def fill_bins(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins filled one after the other: the largest size left, then again and again the one or
    two sizes that together come nearest to the room left, of equals those with the larger one.

    Where some sizes make up a bin, this leaves less room than a rule that places one size at a time.
    """
    sizes = np.asarray(sizes, np.int64)
    members: dict[int, list[int]] = {}
    for k in np.argsort(sizes, kind="stable").tolist():
        members.setdefault(int(sizes[k]), []).append(k)
    count = np.bincount(sizes, minlength=capacity + 1)
    places = np.arange(capacity + 1)
    bins: list[list[int]] = []
    while count.any():
        there = np.flatnonzero(count)
        below = np.maximum.accumulate(np.where(count > 0, places, 0))  # the largest size up to each
        changed = False
        while not changed:  # until a size is used up
            own, room, chosen = [], capacity, [int(there[-1])]
            while chosen:
                for v in chosen:
                    own.append(members[v].pop())
                    count[v] -= 1
                    room -= v
                    if not count[v]:
                        changed, there = True, np.flatnonzero(count)
                        below = np.maximum.accumulate(np.where(count > 0, places, 0))
                first = there[: np.searchsorted(there, room, side="right")]
                if not len(first):
                    break
                second = below[room - first]
                second = np.where((second == first) & (count[first] < 2), below[np.maximum(first - 1, 0)], second)
                total = first + second
                at = len(total) - 1 - int(total[::-1].argmax())
                chosen = [int(first[at]), *([int(second[at])] if second[at] else [])]
            bins.append(own)
    return bins


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """How many bins any packing needs at least.

    For every limit k up to half a bin: sizes over half a bin share with none of their
    kind, and those from k on that are smaller go beside them or into bins of their own.
    """
    count = np.bincount(np.asarray(sizes, np.int64), minlength=capacity + 1)
    weight = count * np.arange(capacity + 1)
    n, w = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(weight)])  # of sizes below k
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2 + 1
    large = n[-1] - n[half]
    beside = n[capacity - k + 1] - n[half]  # large ones that leave k or more
    room = beside * capacity - (w[capacity - k + 1] - w[half])
    left = w[half] - w[k] - room
    return int((large + np.maximum(-(-left // capacity), 0)).max())


def empty_bins(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search: exchange or move documents between underfull bins until bins empty.

    Bins give in order of their fill, to bins that are no emptier: a document moves to
    another bin with room, or changes places with a smaller one there (one for one), or
    two change places with one smaller than both together (two for one). Each step raises
    the sum of squared fills, so the search ends: when no bin has a step left, or when
    there are no more bins than any packing needs.
    """
    bins = [list(b) for b in bins]
    sizes = np.asarray(sizes, np.int64)
    fill = np.array([sizes[b].sum() for b in bins], np.int64)
    at = np.zeros(len(sizes), np.int64)
    for k, b in enumerate(bins):
        at[b] = k
    used, least, moved = int((fill > 0).sum()), least_bins(sizes, capacity), True
    while moved and used > least:
        moved = False
        order = np.flatnonzero((fill > 0) & (fill < capacity))
        for giver in order[np.argsort(fill[order], kind="stable")].tolist():
            while fill[giver] and (step := _step(bins[giver], sizes, fill, at, giver, capacity)):
                out, taker, back = step
                for k in out:
                    bins[giver].remove(k)
                for k in back:
                    bins[taker].remove(k)
                bins[taker] += out
                bins[giver] += back
                at[out], at[back] = taker, giver
                gain = int(sizes[out].sum() - sizes[back].sum())
                fill[giver] -= gain
                fill[taker] += gain
                moved = True
            used -= not fill[giver]
            if used <= least:
                break
    return [b for b in bins if b]


def _step(own: list[int], sizes, fill, at, giver: int, capacity: int) -> tuple[list[int], int, list[int]] | None:
    """The exchange that fills a taker most: (documents out, taker, documents back), or None."""
    takes = (fill >= fill[giver]) & (fill < capacity)
    takes[giver] = False
    takers = np.flatnonzero(takes)
    if not len(takers):
        return None
    room = capacity - fill
    by_size = {int(sizes[k]): k for k in own}
    fits = np.sort(room[takers])
    for size in sorted(by_size, reverse=True):  # a move, to where least room is left
        if size <= fits[-1]:
            least = fits[np.searchsorted(fits, size)]
            return [by_size[size]], int(takers[room[takers] == least][0]), []
    # Of each size the document in the bin with most room: it can make place for up to size + room.
    members = np.flatnonzero(takes[at])
    best = np.full(capacity + 1, -1)
    np.maximum.at(best, sizes[members], room[at[members]] * len(sizes) + members)
    partner = np.full(capacity + 1, -1)  # by size that comes: the smallest size that can make place
    for size in np.flatnonzero(best >= 0)[::-1].tolist():
        partner[size + 1 : size + int(best[size]) // len(sizes) + 1] = size
    second = {int(sizes[k]): k for k in own if by_size[int(sizes[k])] != k}
    several = [*by_size.values(), *second.values()]
    single = np.array(list(by_size), np.int64)
    gains = [(int(g), [by_size[int(v)]]) for v, g in zip(single, single - partner[single], strict=True) if partner[v] >= 0]
    one = np.array([sizes[k] for k in several], np.int64)
    i, j = np.triu_indices(len(one), 1)
    both = one[i] + one[j]
    fine = np.flatnonzero(both <= capacity)
    fine = fine[partner[both[fine]] >= 0]
    if len(fine):
        k = fine[(both[fine] - partner[both[fine]]).argmax()]
        gains.append((int(both[k] - partner[both[k]]), [several[i[k]], several[j[k]]]))
    if not gains:
        return None
    _, out = max(gains, key=lambda g: g[0])
    back = int(best[partner[int(sizes[out].sum())]]) % len(sizes)
    return out, int(at[back]), [back]


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length."""
    lengths = np.asarray(lengths, np.int64)
    begun = min(best_fit(lengths, capacity), fill_bins(lengths, capacity), key=len)
    bins = empty_bins(begun, lengths, capacity)
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(bins):
        at = 0
        for k in members:
            bin_of[k], offset[k] = b, at
            at += int(lengths[k])
    return bin_of, offset


def pack(pieces: DataFrame, capacity: int = 4096, group_pieces: int = 25_000) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    Pieces of ``capacity`` are sequences of their own, numbered below 0 where they are.
    The others are dealt by their place in the table, whatever they hold, to groups of
    about ``group_pieces``; each group is packed on its own, which costs about one
    sequence a group. Repeated rows are packed as often as they come. The pieces, not
    their texts or ids, are kept in the checkpoint folder, so that places are fixed.
    """
    pieces = cut_lineage(pieces)
    place = F.monotonically_increasing_id()
    full = pieces.where(F.col("length") >= capacity)
    full = full.withColumns({"sequence_id": -1 - place, "offset": F.lit(0).cast("long")})
    part = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_pieces))
    dealt = part.withColumn("_pk_group", F.pmod(F.xxhash64(place), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("piece", "ascending")])
        bin_of, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        sequence = rows["_pk_group"].to_numpy() * (1 << 40) + bin_of
        rows = rows.drop_columns(["_pk_group"])
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*pieces.schema.fields, *added])
    return dealt.groupBy("_pk_group").applyInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise, cut and pack all documents: a row for each piece with its place.

    Null texts count as empty; repeated rows and equal ids are packed each for itself;
    long texts are cut into pieces, never shortened; an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    return pack(token_pieces(docs, path, capacity, end_id), capacity)
