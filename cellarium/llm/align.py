"""Alignment of two tokenizers over the same bytes of texts.

Texts are cut into chunks before spaces that follow something else than white space. No token of
either vocabulary reaches over such a cut, so both end there, and a chunk's tokens, groups and
links are its own, wherever it stands. A task aligns each different chunk once, in DuckDB over
Arrow tables of token intervals, and adds up chunks for texts.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache
from itertools import pairwise

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import encoder
from .common import Batches, cut_lineage, sliced, tidy
from .words import packed, ragged, space_chunks

#: Texts are aligned for about so many bytes at a time.
BATCH_BYTES = 6_000_000

#: A pair of ids in one number: id A above, id B below.
B_BITS = 20

#: All pairs of overlapping intervals, as numbers of tokens: the B token in which each A token
#: begins, and those that begin inside it. Bytes are numbered through all chunks, so no key but
#: the place is needed; the range join meets by blocks of 16 bytes, so that a long chunk is no
#: hot key.
LINKS_SQL = """
SELECT a.i, b.j FROM a ASOF JOIN b ON a.s >= b.s
UNION ALL
SELECT a.i, b.j FROM (SELECT *, unnest(range(s >> 4, ((e - 1) >> 4) + 1)) AS k FROM a) a
JOIN (SELECT *, s >> 4 AS k FROM b) b ON a.k = b.k AND b.s > a.s AND b.s < a.e
"""

#: Groups end where tokens of both end: a window sums the common ends up to each A token, so a
#: token's group is the sum before it.
ENDS_SQL = """
SELECT a.i, sum(CASE WHEN b.e IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY a.i ROWS UNBOUNDED PRECEDING)::BIGINT AS ends
FROM a LEFT JOIN b ON a.e = b.e
"""


class _Tokens:
    """The bytes of a vocabulary's tokens, and ids of chunks."""

    def __init__(self, raw: list[bytes]):
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_sizes = np.array(list(map(len, raw)), np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes

    def ids(self, chunks: list[str]) -> list[array]:
        """Ids of texts that begin with a space."""
        raise NotImplementedError

    def encode(self, chunks: list[str], lengths: np.ndarray, together: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of ``lengths`` bytes, and how many each has.

        Chunks that don't end in white space are encoded as one text for about ``together`` bytes
        and cut by the bytes of the tokens; where that text doesn't come out byte for byte, and
        for the other chunks, each is encoded alone.
        """
        column = pa.array(chunks, pa.string())
        alone = pc.not_equal(pc.utf8_rtrim_whitespace(column), column).to_numpy(zero_copy_only=False).copy()
        group = np.cumsum(lengths) // together
        while True:
            joined = np.flatnonzero(~alone)
            starts = np.flatnonzero(np.diff(group[joined], prepend=-1))
            of = [chunks[k] for k in joined.tolist()]
            found = self.ids(["".join(of[x:y]) for x, y in pairwise([*starts.tolist(), len(of)])])
            ids, counts = packed(list(map(array.tobytes, found)))
            want = np.add.reduceat(lengths[joined], starts) if len(starts) else np.zeros(0, np.int64)
            bad = _sums(self.token_sizes[ids], counts) != want
            if not bad.any():
                ends, want = np.cumsum(self.token_sizes[ids]), np.cumsum(lengths[joined])
                at = np.searchsorted(ends, want)
                bad = np.logical_or.reduceat(ends[at] != want, starts) if len(starts) else bad
                if not bad.any():
                    break
            alone[joined[np.repeat(bad, np.diff(np.append(starts, len(joined))))]] = True
        out = np.zeros(len(chunks), np.int64)
        out[joined] = np.diff(at, prepend=-1)
        alone = np.flatnonzero(alone)
        own, out[alone] = packed(list(map(array.tobytes, self.ids([chunks[k] for k in alone.tolist()]))))
        start = np.zeros(len(chunks), np.int64)
        start[joined] = np.cumsum(out[joined]) - out[joined]
        start[alone] = len(ids) + np.cumsum(out[alone]) - out[alone]
        return np.concatenate([ids, own])[ragged(start, out)], out


class ByteTokens(_Tokens):
    """A byte-level vocabulary of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, path: str):
        bpe = encoder(path)
        ends = np.concatenate([bpe.token_starts, [len(bpe.token_bytes)]]).tolist()
        whole = bpe.token_bytes.tobytes()
        super().__init__([whole[x:y] for x, y in pairwise(ends)])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True

    def ids(self, chunks: list[str], together: int = 64) -> list[array]:
        parts = (chunks[x : x + together] for x in range(0, len(chunks), together))  # encodings are large
        return [array("I", e.ids) for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]


class PieceTokens(_Tokens):
    """A sentencepiece model that keeps white space and adds a space before texts."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece of the model reaches over the start of a word")
        self.space = self.model.piece_to_id("▁")
        super().__init__([
            bytes([int(name[3:-1], 16)]) if self.model.is_byte(k) else name.replace("▁", " ").encode()
            for k, name in enumerate(names)
        ])

    def ids(self, chunks: list[str]) -> list[array]:
        # The model adds the first space; it adds none to an empty text.
        return [array("I", ids or [self.space]) for ids in self.model.encode([c[1:] for c in chunks], num_threads=1)]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _holds(tokens: _Tokens, ids: np.ndarray, counts: np.ndarray, chunks: list[str], lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes of the tokens are those of the chunk."""
    size = tokens.token_sizes[ids]
    same = _sums(size, counts) == lengths
    raw = tokens.token_bytes[ragged(tokens.token_starts[ids], size)][np.repeat(same, _sums(size, counts))]
    want = np.frombuffer("".join(c for c, s in zip(chunks, same.tolist(), strict=True) if s).encode(), np.uint8)
    at = np.flatnonzero(same)
    same[at[_sums(raw != want, lengths[at]) > 0]] = False
    return same


def _joined(strings: pa.Array, counts: np.ndarray, mark: str) -> pa.Array:
    """Each ``counts[k]`` strings joined by a mark."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), mark)


class ChunkAligner:
    """Aligned chunks: a table with ``chunk``, ``n_a`` and ``n_b`` (0 where the bytes of the tokens
    aren't the chunk's), ``pairs`` (all links), and if asked for ``n_groups`` and ``said``.

    What is remembered takes about ``most_bytes`` at most, of chunks of up to ``longest`` bytes.
    """

    def __init__(self, a: ByteTokens, b: PieceTokens, groups: bool, most_bytes: int = 40 << 20, longest: int = 64):
        self.a, self.b, self.groups, self.most_bytes, self.longest = a, b, groups, most_bytes, longest
        self.con = duckdb.connect(":memory:")
        self.con.execute("SET threads = 1; SET memory_limit = '400MB'; SET temp_directory = ''; SET enable_progress_bar = false")
        self.digits = pa.array([str(k) for k in range(max(len(a.token_sizes), len(b.token_sizes)))], pa.string())
        self.known = self.align([])

    def align(self, chunks: list[str], together: int = 1_000_000) -> pa.Table:
        """Chunks aligned, about ``together`` characters at a time."""
        sizes = np.cumsum([len(c) for c in chunks], dtype=np.int64)
        edges = [0, *(np.flatnonzero(np.diff(sizes // together)) + 1).tolist(), len(chunks)] if chunks else [0, 0]
        return pa.concat_tables([self._align(chunks[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)])

    def _align(self, chunks: list[str]) -> pa.Table:
        n = len(chunks)
        lengths = pc.binary_length(pa.array(chunks, pa.string())).to_numpy().astype(np.int64)
        (a_ids, a_counts), (b_ids, b_counts) = self.a.encode(chunks, lengths), self.b.encode(chunks, lengths)
        fine = _holds(self.a, a_ids, a_counts, chunks, lengths) & _holds(self.b, b_ids, b_counts, chunks, lengths)
        tokens = []
        for name, number, vocabulary, ids, counts in (("a", "i", self.a, a_ids, a_counts), ("b", "j", self.b, b_ids, b_counts)):
            keep = np.repeat(fine, counts)
            ids = ids[keep].astype(np.int64)
            end = np.cumsum(vocabulary.token_sizes[ids])
            start = end - vocabulary.token_sizes[ids]
            self.con.register(name, pa.table({number: np.arange(len(ids)), "s": start, "e": end}))
            tokens.append((ids, np.repeat(np.arange(n), counts)[keep]))
        (a_ids, a_chunk), (b_ids, b_chunk) = tokens
        links = self.con.sql(LINKS_SQL).to_arrow_table()
        i, j = links["i"].to_numpy(), links["j"].to_numpy()
        per_chunk = np.bincount(a_chunk[i], minlength=n)
        pairs = ((a_ids[i] << B_BITS) | b_ids[j])[np.argsort(a_chunk[i], kind="stable")]
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_chunk)]).astype(np.int32))
        out = {
            "chunk": pa.array(chunks, pa.string()),
            "n_a": pa.array(np.where(fine, a_counts, 0)),
            "n_b": pa.array(np.where(fine, b_counts, 0)),
            "pairs": pa.ListArray.from_arrays(offsets, pa.array(pairs)),
        }
        if self.groups:
            found = self.con.sql(ENDS_SQL).to_arrow_table()
            ends = np.zeros(len(a_ids) + 1, np.int64)
            ends[found["i"].to_numpy() + 1] = found["ends"].to_numpy()
            a_group, b_group = ends[:-1], np.zeros(len(b_ids), np.int64)
            b_group[j] = ends[i]  # all A tokens that a B token meets are in its group
            sizes = [np.bincount(g, minlength=ends[-1]) for g in (a_group, b_group)]
            sides = [_joined(self.digits.take(pa.array(x)), m, ",") for x, m in zip((a_ids, b_ids), sizes, strict=True)]
            said = pc.binary_join_element_wise(*sides, "|")
            n_groups = np.bincount(a_chunk[np.cumsum(sizes[0]) - 1], minlength=n)
            out |= {"n_groups": pa.array(n_groups), "said": _joined(said, n_groups, ";")}
        for name in ("a", "b"):
            self.con.unregister(name)
        return pa.table(out)

    def find(self, chunks: pa.Array) -> pa.Table:
        """The rows of different chunks, in their order."""
        at = pc.index_in(chunks, value_set=self.known["chunk"])
        new = pc.is_null(at)
        is_new = new.to_numpy(zero_copy_only=False)
        added = self.align(chunks.filter(new).to_pylist())
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[is_new] = self.known.num_rows + np.arange(added.num_rows)
        found = pa.concat_tables([self.known, added]).combine_chunks().take(pa.array(place))
        short = added.filter(pc.less_equal(pc.binary_length(added["chunk"]), self.longest))
        if self.known.nbytes + short.nbytes > self.most_bytes:
            self.known = self.known.slice(0, 0)
        if short.nbytes <= self.most_bytes:
            self.known = pa.concat_tables([self.known, short]).combine_chunks()
        return found


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


@lru_cache(maxsize=2)
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)


class _Texts:
    """A batch of texts as chunks: the rows of its different chunks, and which stand where."""

    def __init__(self, aligner: ChunkAligner, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        flat, edges = space_chunks(texts.to_pylist())
        first = np.zeros(len(flat), bool)
        first[edges[:-1]] = True
        flat = pc.if_else(pa.array(first), pc.binary_join_element_wise(" ", flat, ""), flat)
        coded = flat.dictionary_encode()
        found, index = aligner.find(coded.dictionary), coded.indices.to_numpy()
        fine = (found["n_b"].to_numpy() > 0)[index]
        fine[first] &= pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        broken = np.add.reduceat(~fine, edges[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        counts = np.where(broken, 0, np.diff(edges))
        self.found, self.counts, self.edges = found, counts, np.concatenate([[0], np.cumsum(counts)])
        self.index = index[np.repeat(~broken, np.diff(edges))]

    def of(self, values: np.ndarray) -> np.ndarray:
        """Sums of a number of the chunks for each text."""
        return _sums(values[self.index], self.counts)


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table[name].combine_chunks()
    return column.flatten().to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64)


def _added_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    different, at = np.unique(keys, return_inverse=True)
    return different, np.bincount(at, weights=n, minlength=len(different)).astype(np.int64)


def pair_counts(docs: DataFrame, a_path: str | None, b_path: str | None, text_col: str = "text", most_pairs: int = 2_000_000) -> DataFrame:
    """``pair`` and ``n``, its links in all texts. Tasks add up what they see; they hand on what
    they have whenever it is over ``most_pairs`` different pairs, and at their end."""

    @tidy
    def run(batches: Batches) -> Batches:
        aligner = _aligner(a_path, b_path, False)
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in sliced(batches, BATCH_BYTES):
            texts = _Texts(aligner, batch.columns[0])
            pairs, sizes = _lists(texts.found, "pairs")
            times = np.repeat(np.bincount(texts.index, minlength=len(sizes)), sizes)
            keys, n = _added_up(np.concatenate([keys, pairs[times > 0]]), np.concatenate([n, times[times > 0]]))
            if len(keys) > most_pairs:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
                keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    counted = docs.select(F.col(text_col).alias("_al_text")).mapInArrow(run, "pair long, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def _aligner(a_path: str | None, b_path: str | None, groups: bool) -> ChunkAligner:
    a = byte_tokens(a_path or public_tokenizers.path("byte_bpe_50k.json"))
    return ChunkAligner(a, piece_tokens(b_path or public_tokenizers.path("piece_bpe_32k.model")), groups)


def align_tokenizers(
    docs: DataFrame,
    a_path: str | None = None,
    b_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    common_pairs: int = 1 << 18,
) -> DataFrame:
    """Each text's tokens by both tokenizers, their groups and links, and what the corpus says of
    the linked pairs.

    Returns id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is, in the
    corpus, the most frequent of its B id, ties included), ``count_sum`` (the pairs' corpus counts
    over the links) and ``groups_sha256``. Both encode a space and the text; a text that is null or
    empty, or whose tokens are other bytes than that, has no tokens: zeros and ''.

    The corpus counts are partial sums a task, merged in one aggregation. The ``common_pairs``
    most frequent pairs go to all tasks (17 bytes each, so their size is bounded by that number);
    links of other pairs are joined by pair with their counts, and as none of them is among so
    many most frequent ones, none holds more than one in ``common_pairs`` of all links. Repeated
    rows and equal ids count each for itself; an empty table gives no rows; other columns are not
    read, whatever their names. Texts are aligned whole: a text without white space is one chunk
    and takes some hundred bytes of a worker's memory a token.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pairs = cut_lineage(pair_counts(docs, a_path, b_path, text_col))
    best = pairs.groupBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b")).agg(F.max("n").alias("most"))
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    # One row a B id: no more rows than the vocabulary has.
    judged = pairs.join(F.broadcast(best), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    common = judged.orderBy(F.desc("n"), "pair").limit(common_pairs).toArrow().sort_by("pair")
    pair, n, is_best = (common[c].to_numpy() for c in ("pair", "n", "best"))
    shared = docs.sparkSession.sparkContext.broadcast((pair, n, is_best))

    @tidy
    def run(batches: Batches) -> Batches:
        aligner = _aligner(a_path, b_path, True)
        pair, n, is_best = shared.value
        for batch in sliced(batches, BATCH_BYTES):
            ids, column = batch.columns
            texts = _Texts(aligner, column)
            found = texts.found
            keys, sizes = _lists(found, "pairs")
            at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
            known = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
            spread = lambda x, known=known, at=at, sizes=sizes: _sums(np.where(known, x[at] if len(x) else 0, 0), sizes)
            rare, rare_n = _rare(texts, keys[~known], _sums(~known, sizes))
            said = _joined(found["said"].combine_chunks().take(pa.array(texts.index)), texts.counts, ";").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    *[pa.array(texts.of(found[c].to_numpy())) for c in ("n_a", "n_b", "n_groups")],
                    *[pa.array(texts.of(v)) for v in (sizes, spread(is_best.astype(np.int64)), spread(n))],
                    pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said], pa.string()),
                    rare,
                    rare_n,
                ],
                [id_col, *COUNTS, "groups_sha256", "rare", "rare_n"],
            )

    schema = f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, rare array<long>, rare_n array<long>"
    aligned = docs.select(F.col(id_col).alias("_al_id"), F.col(text_col).alias("_al_text")).mapInArrow(run, schema)
    aligned = cut_lineage(aligned.withColumn("_al_row", F.monotonically_increasing_id()))
    rare = aligned.where(F.size("rare") > 0).select("_al_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
    rare = rare.select("_al_row", F.col("r.rare").alias("pair"), F.col("r.rare_n").alias("times")).join(judged, "pair")
    more = rare.groupBy("_al_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more")
    )
    whole = aligned.join(more, "_al_row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)),
    })
    return whole.select(id_col, *COUNTS, "groups_sha256")


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _rare(texts: _Texts, keys: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each text the different pairs that are not common, and how often it has them."""
    occurs = np.flatnonzero(sizes[texts.index] > 0)
    chunk = texts.index[occurs]
    flat = keys[ragged((np.cumsum(sizes) - sizes)[chunk], sizes[chunk])]
    text = np.repeat(np.searchsorted(texts.edges, occurs, side="right") - 1, sizes[chunk])
    order = np.lexsort((flat, text))
    flat, text = flat[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(flat) != 0) | (np.diff(text) != 0)])) if len(flat) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(flat)))
    offsets = pa.array(np.searchsorted(text[first], np.arange(len(texts.counts) + 1)).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (flat[first], times))
