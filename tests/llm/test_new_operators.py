"""Alignment, spelling variants and token counts against plain versions, and on edges."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
from oracle import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellarium.llm import align, spelling, token_counts, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MARKS = [
    "a", "b", " ", "  ", "\n", "\t", "'s", "é", "ß", "▁", "<s>", "<|endoftext|>", "\x85", "　", "12", "3", ".", "日本語", "😀",
    "\x1c", "\0", "x y", "don't", " \n ", "\r\n", "<0x41>", "word word",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choice(MARKS) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["word " * 3000, "x" * 20_000, "あ" * 5000]


@pytest.fixture(scope="module")
def edge(spark, texts):
    rows = [(k % 50 if k % 7 else None, t if k % 11 else None, None, "s", 1) for k, t in enumerate(texts)]
    # names that the operators add themselves
    return spark.createDataFrame(rows, SCHEMA).withColumns({"n_a": F.lit("x"), "word": F.lit("y"), "n_tokens": F.lit(1), "pair": F.lit(2)})


# Token counts


def test_whole_tokens_are_one_token_alone():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    whole = token_counts.proved_tokens(path).to_pylist()
    assert len(set(whole)) == len(whole) > 40_000
    assert all(len(e.ids) == 1 for e in library.encode_batch_fast(whole, add_special_tokens=False))


def test_counts_like_the_library(spark, edge):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (edge, docs):
        want = Counter()
        for r in table.select("doc_id", "text").collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want[r.doc_id, len((r.text or "").encode()), n, n > 1024] += 1
        assert Counter(map(tuple, token_counts.count_tokens(table).collect())) == want


def test_counts_in_slices_and_with_little_memory(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    counter = token_counts.TokenCounter(token_counts.encoder(path), token_counts.proved_tokens(path), most_bytes=500)
    for chars in (50, 1000):
        assert counter.of(texts, chars).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert counter.pieces.nbytes + counter.counts.nbytes <= 500


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA)).collect() == []


# Chunks


def test_chunks(texts):
    flat, edges = words.space_chunks(texts)
    flat = flat.to_pylist()
    for k, t in enumerate(texts):
        assert flat[edges[k] : edges[k + 1]] == (regex.split(r"(?V1)(?<=[^\s\x1c-\x1f])(?= )", t) if t else [""])


# Alignment


def plain_alignment(rows):
    """Tokens by the libraries, overlaps and groups by going through the bytes."""
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_of, b_of = align.byte_tokens(public_tokenizers.path("byte_bpe_50k.json")), align.piece_tokens(public_tokenizers.path("piece_bpe_32k.model"))
    raw = lambda of, k: of.token_bytes[of.token_starts[k] : of.token_starts[k] + of.token_sizes[k]].tobytes()
    found, count = [], Counter()
    for _, text in rows:
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        a_raw, b_raw = [raw(a_of, k) for k in a], [raw(b_of, k) for k in b]
        whole = b"".join(a_raw)
        if not text or whole != (" " + text).encode() or b"".join(b_raw) != whole:
            found.append(None)
            continue
        at_a, at_b = (np.repeat(np.arange(len(r)), [len(x) for x in r]) for r in (a_raw, b_raw))
        links = [(a[i], b[j]) for i, j in sorted(set(zip(at_a.tolist(), at_b.tolist(), strict=True)))]
        count.update(links)
        ends = sorted(set(np.cumsum([len(x) for x in a_raw]).tolist()) & set(np.cumsum([len(x) for x in b_raw]).tolist()))
        groups = []
        for x, y in zip([0, *ends[:-1]], ends, strict=True):
            groups.append("|".join(",".join(str(ids[k]) for k in dict.fromkeys(at[x:y].tolist())) for ids, at in ((a, at_a), (b, at_b))))
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = Counter()
    for (doc_id, _), f in zip(rows, found, strict=True):
        if f is None:
            out[doc_id, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            best = sum(count[p] == most[p[1]] for p in f[3])
            out[doc_id, f[0], f[1], f[2], len(f[3]), best, sum(count[p] for p in f[3]), f[4]] += 1
    return out


@pytest.mark.parametrize("common", [1 << 18, 40, 0])
def test_alignment_like_a_plain_version(spark, edge, common):
    want = plain_alignment([tuple(r) for r in edge.select("doc_id", "text").collect()])
    assert sum(n for row, n in want.items() if row[1]) > 300  # some texts have tokens
    got = align.align_tokenizers(edge, common_pairs=common)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert Counter(map(tuple, align.align_tokenizers(docs, common_pairs=3000).collect())) == want


def test_partial_counts_may_be_handed_on_early(spark, edge):
    whole, parts = (align.pair_counts(edge, None, None, most_pairs=m) for m in (2_000_000, 0))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_remembered_chunks_are_bounded():
    a, b = align.byte_tokens(public_tokenizers.path("byte_bpe_50k.json")), align.piece_tokens(public_tokenizers.path("piece_bpe_32k.model"))
    small, large = (align.ChunkAligner(a, b, True, most_bytes=m) for m in (4000, 1 << 20))
    for k in range(5):
        chunks = pa.array([f" w{k * 7 + i}" for i in range(20)])
        assert small.find(chunks).equals(large.find(chunks))
        assert small.known.nbytes <= 4000


def test_alignment_of_an_empty_table(spark):
    assert align.align_tokenizers(spark.createDataFrame([], SCHEMA)).collect() == []


# Spelling variants


def plain_variants(rows, drop=199, letters=6, least=5, times=5):
    n = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % drop == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) > len(b):
            a, b = b, a
        k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[k + (len(a) == len(b)) :] == b[k + 1 :]

    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, found in others.items():
        top = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(others[w]), n.get(form[w], 0)) for w in n)


def same_variants(got):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got.collect())


@pytest.mark.parametrize("bucket", [512, 2])
def test_variants_like_a_plain_version(spark, bucket, monkeypatch):
    rng = random.Random(9)
    stems = ["abcdef", "ABCDEFG", "éabcdé", "aaaaaa", "zßyxwvu", "abcabcab", "bananas"]

    def word(d):
        w = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "a", "b", "É", "é"])
        return "".join(w)

    rows = [(k if k % 9 else None, " ".join(word(k) for _ in range(rng.randint(0, 60))) if k % 13 else None) for k in range(300)]
    plain = near = None
    near = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda words: near(words, bucket))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "key": F.lit(2)})
    plain = plain_variants(rows)
    assert sum(bool(r[1]) for r in plain) > 30
    assert same_variants(spelling.spelling_variants(table)) == plain


def test_chains_of_forms_end_at_the_last(spark):
    ladder = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    rows = [(k, w) for w, times in zip(ladder, (5, 25, 125, 625, 3125, 15_625), strict=True) for k in range(times)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), drop_one_in=None)
    assert {(r.word, r.form, r.root) for r in got.collect()} == {
        (w, f, ladder[-1]) for w, f in zip(ladder, [*ladder[1:], None], strict=True)
    }


def test_one_edit_keeps_a_band_of_the_mask(spark):
    rng = random.Random(2)
    letters = spelling._LOWER + "".join(map(chr, range(0xC0, 0x100)))
    pairs = []
    for _ in range(400):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
        at = rng.randrange(len(w))
        pairs.append((w, w[:at] + rng.choice(["", *letters]) + w[at + rng.choice([0, 1]) :]))
    masks = spark.createDataFrame(pairs, "a string, b string").select(
        spelling.parity_mask(F.col("a")).bitwiseXOR(spelling.parity_mask(F.col("b"))).alias("x")
    )
    for r in masks.collect():
        assert bin(r.x).count("1") <= 2
        assert any((r.x >> (k * spelling.BAND_BITS)) & ((1 << spelling.BAND_BITS) - 1) == 0 for k in range(spelling.BANDS))


def test_variants_edges(spark):
    rows = [(1, None), (2, ""), (None, "ab cd"), (3, "x" * 50_000), *[(4, "repeated rows")] * 6]
    got = same_variants(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_variants(rows) and got
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
