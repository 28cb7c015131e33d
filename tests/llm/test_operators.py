"""Each operator against plain versions, and on nulls, empties, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from oracle import SF, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellarium.llm import bpe, chat, gbdt, imatch, language, ngram_join, ogg, packing, pii, quality, words
from cellarium.llm.line_dedup import line_dedup
from cellarium.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, "one two three four five six", "en", "a", 27),
    (2, "one two three four five six", "en", "a", 27),
    (2, "one two three four five six", "en", "a", 27),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (None, "a line\nb line\nc line\nd line", None, "a", 5),
    (5, "a line\nb line\nc line\nd line", "en", None, 5),
    (6, "\n\n\n\n", "en", "a", 4),
    (7, "word " * 30_000, "en", "a", 150_000),
    (8, "9" * 60_000 + " a@b.co +1 (555) 123-4567", "en", "a", 60_000),
]


@pytest.fixture(scope="module")
def edge(spark):
    # names that the operators add themselves, and one that is only like theirs
    return spark.createDataFrame(EDGE, SCHEMA).withColumns(
        {"score": F.lit("x"), "n_removed": F.lit("y"), "spans": F.lit(1), "key": F.lit(2), "signatures": F.lit("z")}
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), ORACLE_SQL[name])


# Line dedup


def plain_line_dedup(rows):
    seen, covered = {}, {}
    ordered = sorted(enumerate(rows), key=lambda r: r[1][0])
    for k, (_, text) in ordered:
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if window in seen:
                covered.setdefault(k, set()).update(range(i, i + 3))
            seen.setdefault(window, (k, i))
    return {r[0]: "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in covered.get(k, ())) for k, r in enumerate(rows)}


def test_line_dedup_like_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for k in range(120)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain_line_dedup(rows)


def test_line_dedup_edges(edge, empty):
    got = line_dedup(edge).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[None][0]["n_removed"] == 0 and by[5][0]["text"] == "" and by[5][0]["n_removed"] == 4
    assert by[3][0]["text"] is None and by[3][0]["n_lines"] == 0 and by[4][0]["text"] == ""
    assert by[6][0]["text"] == "\n".join([""] * 1) and by[2][0] == by[2][1]
    assert line_dedup(empty).count() == 0


# Quality


def test_trees_learn_and_are_walked_alike():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -1)).astype(int)
    forest = gbdt.fit(x[:3000], y[:3000], trees=40)
    assert ((forest.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9

    def walk(row):
        total = forest.base
        for k in forest.roots:
            while forest.left[k] != k:
                k = forest.left[k] if row[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
            total += forest.value[k]
        return total

    assert np.allclose([walk(r) for r in x[:50]], forest.margin(x[:50]))
    assert gbdt.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2))) == [0.5]
    assert gbdt.fit(np.zeros((3, 2)), np.ones(3)).score(np.zeros((1, 2)))[0] > 0.5


def test_quality_on_held_out_labels(spark):
    got = QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id"
    )
    rows = got.where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 0), (4, 1)], "doc_id long, quality int")
    forest = quality.train_quality(edge, labels)
    got = quality.score_quality(edge, forest).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    same = {r["text"]: set() for r in got}
    for r in got:
        same[r["text"]].add(r["score"])
    assert all(len(v) == 1 for v in same.values()) and same[None] == same[""]
    assert quality.score_quality(empty, quality.train_quality(empty, labels)).count() == 0


# Chat


def test_preferences(spark):
    turns = [
        (1, 0, 10, 0, "user", "hi"), (1, 0, 10, 1, "assistant", "yes"), (1, 0, 10, 2, "user", "more"),
        (1, 1, 11, 0, "user", "hi"), (1, 1, 11, 1, "assistant", "no"),
        (2, 0, 20, 0, "user", "a"), (2, 1, 21, 0, "user", "a"),
        (3, 0, 30, 0, None, None), (None, 0, None, 0, "user", "z"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, side int, conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.format_preferences(df).collect()}
    one = got[1]
    assert one["prompt_turns"] == 1 and one["prompt"] == "<|user|>\nhi\n<|end|>\n"
    a, b = map(int, one["chosen_mask"].split(":"))
    assert one["chosen"][a:b] == "yes\n<|end|>\n" and one["rejected"].startswith("<|assistant|>\nno")
    assert got[2]["prompt_turns"] == 1 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[3]["rejected_id"] is None and got[3]["chosen"] == "<||>\n\n<|end|>\n" and got[None]["chosen_id"] is None
    assert chat.format_preferences(df.limit(0)).count() == 0


# Personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_base(text):
    def luhn(d):
        twice = [int(c) * 2 for c in d[-2::-2]]
        return (sum(int(c) for c in d[-1::-2]) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0

    out = []
    for k, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card" and not (14 <= len(d) <= 19 and luhn(d)) or name == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out))


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train_pii(spark)


def test_base_spans_like_plain_patterns(spark, docs, pii_model):
    rng = random.Random(5)
    alphabet = list("0123456789.@+-() ab%é") + ["4111111111111111", "a@b.c", "+1 (555) 123-4567", "1.2.3.4", " "]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    for r in pii.find_pii(df, pii_model).withColumn("digest", pii.base_digest()).collect():
        want = plain_base(r["text"])
        assert r["digest"] == hashlib.sha256(want.encode()).hexdigest(), r["text"][:80]
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [len(re.findall(rf"\b{k}:", want)) for k in pii.BASE_KINDS]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_added_spans_and_redaction(spark, pii_model):
    text = "call (293) 555-9179 or token = \"24be64439e3e49cf46b2d7c90f3602a3\" x@y.org, order 1234567, é ssn 123-45-6789."
    df = spark.createDataFrame([(1, text), (2, "nothing to see"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(df, pii_model)).collect()}
    assert got[1] == "call [REDACTED] or [REDACTED] [REDACTED], order 1234567, é ssn [REDACTED]."
    assert got[2] == "nothing to see" and got[3] is None


def test_long_secrets_are_covered_to_their_end(spark, pii_model):
    rng = random.Random(11)
    key = "".join(rng.choice("0123456789abcdef") for _ in range(400))
    rows = [(1, f"see token={key} end"), (2, f"key {key} end"), (3, f"see {key}{key}{key} end")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), pii_model)
    assert {r["doc_id"]: r["spans"] for r in found.collect()} == {1: "secret:4:410", 2: "secret:4:404", 3: "secret:4:1204"}
    got = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert got == {1: "see [REDACTED] end", 2: "key [REDACTED] end", 3: "see [REDACTED] end"}


def test_mail_candidates_of_a_place_need_nothing_else(spark):
    rows = [
        (1, "write to jane.doe at example.com today"), (2, "write to jane.doe at example.com today, or @home"),
        (3, "WRITE TO JANE AT EXAMPLE DOT COM"), (4, "jane at example [dot] com"), (5, "we met at noon and left"), (6, "jane(at)x.org"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mails = F.filter(pii.candidates(F.col("text")), lambda c: c["generator"] == 0)
    got = df.select("doc_id", F.transform(mails, lambda c: F.struct(c["start"], c["end"])).alias("at")).collect()
    at = {r["doc_id"]: [tuple(c) for c in r["at"]] for r in got}
    assert at == {1: [(9, 32)], 2: [(9, 32)], 3: [(9, 32)], 4: [(0, 25)], 5: [], 6: [(0, 13)]}


def other_forms(copies=12, seed=99):
    """Texts in other forms than the examples that the trees learn from: (text, span or None)."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    x = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    caps, hexs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
    mixed = caps + caps.lower()
    name = lambda: r.choice(["paula", "john.smith", "k_meyer", "ines.lopez", "tom", "aya.sato"])
    site = lambda: r.choice(["mailbox", "uni-bonn", "acme", "post", "webmail"])
    yes = [
        lambda: ("Please send it to ", f"{name()} (at) {site()}.com", " before Friday."),
        lambda: ("You can find her under ", f"{name()}[at]{site()}[dot]de", ", she said."),
        lambda: ("Her office number is ", f"({d(3)}) {d(3)}-{d(4)}", " as of May."),
        lambda: ("Dial ", f"{d(3)}-{d(3)}-{d(4)}", " and ask for the desk."),
        lambda: ("He paid by Visa, ", f"{d(4)} {d(4)} {d(4)} {d(4)}", ", last week."),
        lambda: ("The form asked for an SSN: ", f"{d(3)}-{d(2)}-{d(4)}", "."),
        lambda: ("Transfer to IBAN ", f"IT{d(2)} {x(caps[:9], 4)} {d(4)} {d(4)} {d(4)} {d(4)}", " today."),
        lambda: ("export API_KEY=", x(hexs, 32), " && run it"),
        lambda: ("config: ", f'password = "{x(mixed, 15)}7"', " # todo"),
        lambda: ("Authorization: Bearer ", x(mixed, 60) + "7", " -H"),
        lambda: ("aws id ", f"AKIA{x(caps, 16)}", " leaked"),
        lambda: ("commit secret: ", x(hexs, 500), ", sorry"),
    ]
    no = [
        lambda: "The meeting at noon. Then we left at once, dot by dot.",
        lambda: f"Invoice {d(8)} was paid on {r.randint(1990, 2029)}-{d(2)}-{d(2)}.",
        lambda: f"See ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)} for details.",
        lambda: f"The town has {d(1)} {d(3)} {d(3)} people.",
        lambda: f"Scores: {', '.join(d(2) for _ in range(12))}.",
        lambda: f"table {' '.join(d(3) for _ in range(20))} end",
        lambda: "The secret: nothing at all, and the token of our thanks.",
        lambda: "a_very_long_function_name_with_many_parts and /usr/local/share/doc/readme",
        lambda: "Donaudampfschifffahrtsgesellschaftskapitaen is one word; pneumonoultramicroscopic too.",
        lambda: f"pi is 3.{d(60)} or so",
        lambda: "================================ heading ------------------------",
        lambda: f"Order no. {d(4)} {d(4)} {d(4)} was sent.",
    ]
    made = []
    for _ in range(copies):
        for f in yes:
            before, value, after = f()
            made.append((before + value + after, (len(before), len(before) + len(value))))
        made += [(f(), None) for f in no]
    return made


def test_added_spans_of_other_forms(spark, pii_model):
    made = other_forms()
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)], "doc_id long, text string")
    got = pii.find_pii(df, pii_model).select("doc_id", "n_added", "n_spans", "all_spans", "base_spans").collect()
    real = caught = reported = right = 0
    for r in got:
        want = made[r["doc_id"]][1]
        added = [s for s in r["all_spans"] if s not in r["base_spans"]]
        assert r["n_added"] == len(added) and r["n_spans"] == len(r["all_spans"])
        real += want is not None
        caught += want is not None and any(s["start"] <= want[0] and s["end"] >= want[1] for s in r["all_spans"])
        reported += len(added)
        right += sum(want is not None and s["start"] < want[1] and s["end"] > want[0] for s in added)
    assert caught / real >= 0.9 and right / reported >= 0.95, (caught / real, right / reported)


def test_spans_inside_others_are_left_out(spark, pii_model):
    rows = [(1, 'x password = "a1b2c3d4e5f6a7b8c9d0e1f2@mail.example.com" y'), (2, "w 8646308210557563 w"), (3, "no. 12345678901234567890123 w")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), pii_model).collect()}
    for r in got.values():
        spans = [s for s in r["all_spans"] if s not in r["base_spans"]]
        for s in spans:
            assert not any(o != s and o["start"] <= s["start"] and o["end"] >= s["end"] for o in r["all_spans"])
    assert "secret" not in got[2]["spans"] and not got[3]["n_added"]  # digits alone are no secret


def test_pii_edges(edge, empty, pii_model):
    got = pii.find_pii(edge, pii_model).collect()
    assert len(got) == len(EDGE)
    assert next(r for r in got if r["doc_id"] == 3)["spans"] == ""
    assert next(r for r in got if r["doc_id"] == 8)["spans"].endswith("phone:60008:60025")
    assert pii.redact(pii.find_pii(empty, pii_model)).count() == 0


# Fingerprints


def test_imatch_edits(spark, docs):
    got = QUERIES["op5_imatch"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    after = {a: ids[(i + 1) % len(ids)] for i, a in enumerate(ids)}
    prints = {}
    for r in got:
        t = texts[r["doc_id"]]
        k = len(t) // 2
        edited = t[: len(t) - k] + texts[after[r["doc_id"]]][:k]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(t, set()).add(r["fingerprint"])
    assert len(got) == len(texts) and all(len(p) == 1 for p in prints.values())
    assert sum(r["near_edited"] for r in got) > 3 * sum(r["near_next"] for r in got)


def test_imatch_edges(edge, empty):
    got = imatch.compare_with_edits(edge, imatch.build_lexicon(edge)).collect()
    assert len(got) == len(EDGE) and sum(r["n_chars"] == 0 for r in got) == 2
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert imatch.compare_with_edits(empty, imatch.build_lexicon(empty)).count() == 0


@pytest.mark.parametrize("words", ["own", "common"])
def test_imatch_of_a_third_of_copies(spark, words):
    rng = random.Random(9)
    common = [f"w{k}" for k in range(400)]
    base = [f"c{k}" for k in range(200)] if words == "own" else common[:40]
    rows = [(k, " ".join(rng.sample(common, 30))) for k in range(200)]
    for k in range(200, 300):  # near copies, one word changed to one of the band; or exact copies
        copy = list(base)
        if words == "own":
            copy[rng.randrange(200)] = rng.choice(common)
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = imatch.build_lexicon(df)
    got = imatch.fingerprint(df, lexicon).withColumn("kept", F.size(imatch.in_lexicon(imatch.terms(F.col("text")), lexicon.common)))
    by = {r["doc_id"]: r for r in got.collect()}

    def like(a, b):
        pairs = [(x, y) for x, y in zip(by[a]["signatures"], by[b]["signatures"], strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in pairs) / len(pairs)

    assert np.mean([like(k, k + 1) for k in range(200, 299)]) > 0.7
    assert np.mean([like(k, k + 1) for k in range(199)]) < 0.1
    if words == "common":  # copies count once: their words stay in the band
        assert by[200]["kept"] == 40


def test_imatch_keeps_a_band_over_the_size(spark):
    rng = random.Random(10)
    common = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.sample(common, 30))) for k in range(60)] + [(60, None), (61, ""), (62, "x y"), (None, "w1 w2")]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    whole = [imatch.compare_with_edits(df, imatch.build_lexicon(df, size=n)) for n in (32_768, 20)]
    assert whole[0].columns == whole[1].columns
    by = [sorted(map(tuple, w.collect()), key=repr) for w in whole]
    assert len(by[0]) == 69 and by[0] == by[1]


# Ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_round_trips():
    rng = random.Random(4)
    assert all(slow_crc(d) == ogg.checksum(d) for d in (b"", b"a", rng.randbytes(300)))
    for _ in range(40):
        sizes = [rng.choice([0, 1, 254, 255, 256, 510, 65025, 70000, rng.randint(0, 3000)]) for _ in range(rng.randint(1, 30))]
        packets = [(rng.randbytes(n), i) for i, n in enumerate(sizes)]
        streams, bad = ogg.read_streams(b"".join(ogg.stream_pages(9, packets)))
        assert not bad and streams[9].packets == [p for p, _ in packets] and not streams[9].lost and streams[9].ended
    media = ogg.load(ogg.store(bytes(range(256)) * 100))
    assert media.seconds == 25600 / 8000 and media.payload == bytes(range(256)) * 100
    broken = bytearray(ogg.store(rng.randbytes(300_000)))
    broken[100_000] ^= 1
    hurt = ogg.load(bytes(broken))
    assert hurt.bad_pages == 1 and hurt.lost and len(hurt.payload) < 300_000
    assert ogg.load(b"no ogg").payload == b""


def test_ogg_query(spark, edge, empty):
    got = ogg.media_digests(edge).collect()
    texts = sorted((r[1] or "").encode() for r in EDGE)
    assert sorted(r["n_bytes"] for r in got) == sorted(map(len, texts))
    want = sorted((hashlib.sha256(ogg.padded(t)).hexdigest(), zlib.crc32(ogg.padded(t)[-64:])) for t in texts)
    assert sorted((r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert ogg.media_digests(empty).count() == 0
    files = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(ogg.store(b"abcd" * 16)))], "id long, media binary")
    assert [(r["rate"], bytes(r["payload"])) for r in ogg.read_media(files, "id").orderBy("id").collect()] == [
        (0, b""), (0, b""), (8000, b"abcd" * 16)
    ]


# Language


def plain_viterbi(scores, penalty):
    value, back = scores[0].copy(), []
    for row in scores[1:]:
        step = value[None, :] - penalty * (1 - np.eye(len(value)))
        back.append(step.argmax(axis=1))
        value = step.max(axis=1) + row
    return value.max()


def test_language(spark, docs):
    model = language.train_language(docs)
    got = QUERIES["op7_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    rng = random.Random(6)
    words = [w for r in docs.limit(40).collect() for w in r["text"].lower().split()]
    lists = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(30)]
    paths, _, _ = model.label(lists)
    for ws, path in zip(lists, paths, strict=True):
        scores, _ = model.word_scores(ws)
        value = scores[np.arange(len(ws)), path].sum() - model.penalty * (path[1:] != path[:-1]).sum()
        assert abs(value - plain_viterbi(scores, model.penalty)) < 1e-6


def test_mixed_text_has_spans(spark, docs):
    model = language.train_language(docs)
    parts = {r["lang"]: r["text"] for r in docs.where("n_chars between 300 and 3000 and text not like '%|%'").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(1, parts["de"] + " " + parts["es"])], "doc_id long, text string")
    spans = language.identify_language(mixed, model).first()["spans"]
    assert {spans[0]["lang"], spans[-1]["lang"]} == {"de", "es"}
    assert abs(spans[0]["end"] - len(parts["de"].split())) <= 3 or len(spans) > 2


def test_language_sample_takes_one_row_of_an_id(spark):
    learned = [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1]
    plain = [(k, f"one two three {k}", "en") for k in learned] + [(k, f"eins zwei drei {k}", "de") for k in learned]
    hot = [(learned[0], f"zz yy xx ww {k}", "en") for k in range(500)]
    schema = "doc_id long, text string, lang string"
    once, often = (language.train_language(spark.createDataFrame(rows, schema)) for rows in (plain, plain + hot))
    assert np.array_equal(once.table, often.table)  # "one .." comes before "zz .."


def test_many_languages_in_small_batches(spark):
    rng = np.random.default_rng(4)
    names = [f"l{k:03d}" for k in range(300)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    words_of = {n: ["".join(rng.choice(list(letters), 7)) for _ in range(6)] for n in names}
    learned = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(k, " ".join(words_of[names[i % 300]] * 3), names[i % 300]) for i, k in enumerate(learned[:600])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_language(docs)
    assert len(model.languages) == 300
    whole, small = (language.identify_language(docs, model, batch_words=b).collect() for b in (1_500_000, 40))
    assert {tuple(r[:2]) for r in whole} == {tuple(r[:2]) for r in small} == {(k, lang) for k, _, lang in rows}
    both = spark.createDataFrame([(1, " ".join(words_of["l007"] * 4 + words_of["l270"] * 4))], "doc_id long, text string")
    spans = language.identify_language(both, model).first()["spans"]
    assert [(s["lang"], s["begin"], s["end"]) for s in spans] == [("l007", 0, 24), ("l270", 24, 48)]


def test_language_edges(edge, empty, docs):
    model = language.train_language(docs)
    got = {r["doc_id"]: r for r in language.identify_language(edge, model).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[6]["lang_pred"] == "und" and got[3]["score"] == 0
    assert got[7]["lang_pred"] in model.languages and 0 <= got[7]["score"] <= 1
    none = language.train_language(empty)
    assert {r["lang_pred"] for r in language.identify_language(edge, none).collect()} == {"und"}
    assert language.identify_language(empty, model).count() == 0


# Tokens

ODD = ["", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "it's  I'll\n\n\n  we've ", "x" * 3000, " " * 500, "The, the. THE.,", "ﬁ ﭏ שׁ İ"]


@pytest.fixture(scope="module")
def texts(docs):
    rng = random.Random(1)
    alphabet = list("abc ABC  \n\t\r'sS.,!0123é½ßñ漢字😀　\xa0́Σ\x1c\x85'll's<|>_Ⅷ​")
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return made + ODD + [r["text"] for r in docs.limit(60).collect()]


def test_bpe_like_the_library(texts):
    ours = bpe.BytePairEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for chars in (9, 300, 1_000_000):  # slices of texts, parts of several texts, all at once
        got = list(ours.encode(texts, chars=chars))
        assert [g.tolist() for g in got] == want
    assert [ours.decode(g) for g in got] == library.decode_batch(want, skip_special_tokens=False)
    # the tree for long words and the one for many short ones agree
    words = [t.encode() for t in texts if 2 <= len(t.encode()) <= 64][:300]
    assert [np.array(ours.encode_word(w), "<u4").tobytes() for w in words] == [
        ours._encode_equal([w], max(2, 1 << (len(w) - 1).bit_length()))[0] for w in words
    ]


def test_words_like_the_library(texts):
    ours = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for chars in (9, 300, 1_000_000):
        got = words.encode_texts(texts, packing.split_words, words.WordIds(ours.encode_words), chars)
        assert [g.tolist() for g in got] == want


def test_remembered_words_are_bounded_in_bytes():
    asked = []

    def encode(ws):
        asked.extend(ws.to_pylist())
        return words.packed([np.array([len(w), 7], "<u4").tobytes() for w in ws.to_pylist()])

    ids = words.WordIds(encode, most_bytes=4000, longest=8)
    rng = random.Random(3)
    for _ in range(200):
        batch = [f"w{rng.randint(0, 400)}" for _ in range(40)] + ["long " * 1000]
        got, counts = ids.find(pa.array(batch)).of(0, len(batch))
        assert got.tolist() == [v for w in batch for v in (len(w), 7)] and set(counts) == {2}
        assert ids.bytes <= 4000 + 200
    assert 200 < len(asked) < 200 * 41


def test_bpe_edges(edge, empty):
    got = bpe.encode_digests(edge).collect()
    assert len(got) == len(EDGE) and sum(r["n_tokens"] == 0 for r in got) == 2
    assert bpe.encode_digests(empty).count() == 0


def check_packing(rows, capacity=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, docs):
    rows = packing.pack_documents(docs).collect()
    n = check_packing(rows)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    for d in docs.limit(30).collect():
        ids = [*library.encode(d["text"], add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            r = pieces[d["doc_id"], k]
            cut = np.array(ids[a : a + 4096], "<u4").tobytes()
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, len(cut) // 4, zlib.crc32(cut))


def test_packing_edges(edge, empty):
    rows = packing.pack_documents(edge).collect()
    check_packing(rows)
    assert {r["doc_id"] for r in rows} == {r[0] for r in EDGE} and sum(r["length"] == 1 for r in rows) >= 3
    assert packing.pack_documents(empty).count() == 0


def best_packing(sizes, capacity):
    """The least number of bins, by trying all ways."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[k]}:
            rest = list(rooms)
            rest.remove(room)
            place(k + 1, [*rest, room - sizes[k]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_packing_against_the_exact_optimum():
    same = 0
    for seed in range(120):
        rng = random.Random(seed)
        sizes = sorted((rng.randint(1, rng.choice([40, 60, 100])) for _ in range(rng.randint(1, 9))), reverse=True)
        best, found = best_packing(sizes, 100), len(packing.empty_bins(packing.best_fit(np.array(sizes), 100), sizes, 100))
        assert packing.least_bins(sizes, 100) <= best <= found <= best + 1
        same += best == found
    assert same >= 118


def test_local_search_saves_bins():
    moved = packing.empty_bins([[0], [1], [2], [3]], np.array([6, 3, 4, 7]), 10)
    assert sorted(map(sorted, moved)) == [[0, 2], [1, 3]]
    # 8 + 4 and 7 + 5 fill two bins; only by exchanges does the third empty
    exchanged = packing.empty_bins([[0, 2], [1], [3]], np.array([8, 7, 3, 2, 0][:4]), 12)
    assert len(exchanged) == 2
    for seed in range(10):
        d = np.random.default_rng(seed).integers(1, 2000, 200)
        first = packing.best_fit(d, 4096)
        better = packing.empty_bins([[k] for k in range(200)], d, 4096)
        for bins in (first, better, packing.empty_bins(first, d, 4096)):
            assert sorted(k for b in bins for k in b) == list(range(200)) and max(d[b].sum() for b in bins) <= 4096
            assert len(bins) >= packing.least_bins(d, 4096)
        assert len(better) <= packing.least_bins(d, 4096) + 2


@pytest.mark.parametrize(("low", "high", "over"), [(900, 1800, 100), (1400, 2700, 5), (500, 1200, 25), (1, 4095, 25)])
def test_packing_of_sizes_that_share_badly(low, high, over):
    sizes = np.random.default_rng(1).integers(low, high + 1, 25_000 if low == 900 else 8000)
    filled = packing.fill_bins(sizes, 4096)
    assert sorted(k for b in filled for k in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 4096 for b in filled)
    bin_of, _ = packing.pack_lengths(sizes, 4096)
    assert np.bincount(bin_of, weights=sizes).max() <= 4096
    assert bin_of.max() + 1 <= min(packing.least_bins(sizes, 4096) + over, len(packing.best_fit(sizes, 4096)))


def test_packing_in_several_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(k, 0, 0, int(n), k) for k, n in enumerate([*rng.integers(1, 1500, 3000), *[4096] * 200, *[5] * 500])]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = packing.pack(pieces, 4096, group_pieces=500).collect()
    least = packing.least_bins(np.array([r[3] for r in rows]), 4096)
    assert sorted(r["doc_id"] for r in found) == list(range(len(rows)))
    assert least <= check_packing(found) <= least + 7  # one a group at most
    # rows that are all alike are dealt to all groups
    alike = spark.createDataFrame([(None, 0, 0, 1, 9)] * 2000, pieces.schema)
    found = packing.pack(alike, 4096, group_pieces=500).collect()
    assert len(found) == 2000 and check_packing(found) == 4


# Joins


def grams(text, n=5):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain_join(rows):
    sets = [grams(t) for _, t in rows]
    classes = {}
    for (k, _), s in zip(rows, sets, strict=True):
        classes.setdefault(s, []).append(k)
    keys = list(classes)
    links = {s: set() for s in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[a].add(b)
                links[b].add(a)
    root = {}
    for s in keys:
        if s not in root:
            seen, todo = {s}, [s]
            while todo:
                for other in links[todo.pop()] - seen:
                    seen.add(other)
                    todo.append(other)
            least = min(min(classes[x]) for x in seen)
            root |= dict.fromkeys(seen, least)
    return sorted((k, root[s], min(classes[s]), len(classes[s]), len(links[s])) for (k, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("block", [384, 4])
def test_join_like_brute_force_with_large_groups(spark, block):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for k in range(60):  # a group of near copies in which all buckets are large
        copy = list(base)
        copy[rng.randrange(120)] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    rows += [(100 + k, " ".join(rng.choice(words) for _ in range(40))) for k in range(40)]
    rows += [(200 + k, rows[k][1]) for k in range(30)] + [(300, "a b"), (301, "a  b"), (302, ""), (303, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_jaccard_join(df, block_docs=block).collect()
    assert sorted((r["doc_id"], r["class_id"], r["set_id"], r["n_copies"], r["n_links"]) for r in got) == plain_join(rows)


def test_join_edges(edge, empty):
    got = ngram_join.ngram_jaccard_join(edge).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["class_id"] == 1 and by[2]["n_copies"] == 3 and by[3]["class_id"] == by[6]["class_id"] == 3
    assert by[None]["set_id"] == 5 and by[None]["n_copies"] == 2
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.choose_bands(threshold, 0.999)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= 0.999


# Plain versions of fingerprints, statistics, splits and media features


def spark_hash(*values):
    """Spark's 64-bit hash of values in a row: (kind, value) with kind i, l or s."""
    seed = 42
    for kind, v in values:
        raw = v.encode() if kind == "s" else v.to_bytes(4 if kind == "i" else 8, "little", signed=True)
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def plain_terms(text):
    return sorted({spark_hash(("s", w)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w})


def plain_signatures(text, lexicon):
    found = plain_terms(text)
    own = [t for t in found if t in lexicon]
    own = found if len(own) * 16 < len(found) else own
    part = {t: spark_hash(("i", 1), ("l", t)) % 56 for t in own}
    sigs = [spark_hash(("i", 0), *[("l", t) for t in own]) if own else spark_hash(("i", -2), ("s", text))]
    for k in range(23):
        some = [t for t in own if part[t] == k]
        sigs.append(spark_hash(("i", k), *[v for t in some for v in (("l", k), ("l", t))]) if some else None)
    return sigs


def test_fingerprints_like_a_plain_version(spark, docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    texts = {t for _, t in rows}
    df = {}
    for t in texts:
        for term in plain_terms(t):
            df[term] = df.get(term, 0) + 1
    lexicon = {t for t, n in df.items() if -(-len(texts) // 100) <= n <= len(texts) // 4}
    shown = lambda sigs: ".".join("-" if s is None else f"{s & (1 << 64) - 1:016x}" for s in sigs)

    def like(a, b):
        seen = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in seen) / max(len(seen), 1)

    want = {}
    for k, (doc_id, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - half] + after[:half]
        own, changed, other = (plain_signatures(t, lexicon) for t in (text, edited, after))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want[doc_id] = (len(text), digest, shown(own), shown(changed), like(own, changed), like(own, other))
    got = QUERIES["op5_imatch"](spark, SF).collect()
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == want


def test_statistics_like_a_plain_version():
    classes = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r", ".,;:'\"-()?", "|", "!"]
    classes += ["#$%&*@^~<>{}[]=+_/\\`"]
    for text in ["", "Hi THERE, é|!\n\nshort line 12", "a b a b\n" * 30, "x" * 500, "日本 word", None]:
        t = text or ""
        raw, words, lines = list(t.encode()), t.split(), t.split("\n")
        at = [next((k for k, c in enumerate(classes) if chr(b) in c), 9) if b < 128 else 8 for b in raw]
        want = [at.count(k) / max(len(raw), 1) for k in range(10)]
        n = max(len(words), 1)
        want += [math.log1p(len(raw)), math.log1p(len(words)), (len(t) - t.count(" ")) / n, len(set(words)) / n**0.8]
        want += [max([len(w) for w in words] or [0]), math.log1p(len(lines)), math.log1p(len(t) / len(lines))]
        want += [len(set(lines)) / len(lines), sum(len(x) < 40 for x in lines) / len(lines), sum(w.isupper() for w in words) / n]
        assert np.allclose(quality.statistics(text), want)


def test_the_first_split_is_the_best():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 12, (200, 4)).astype(float)
        y = ((x[:, seed % 4] > 5) ^ (rng.random(200) < 0.2)).astype(float)
        forest = gbdt.fit(x, y, trees=1, depth=1, least_rows=3)
        gradient = y - (y.sum() + 1) / 202
        weight = (y.sum() + 1) / 202 * (1 - (y.sum() + 1) / 202)

        def gain(f, cut):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < 3:
                return -1.0
            return sum(gradient[side].sum() ** 2 / (weight * side.sum() + 1) for side in (left, ~left))

        best = max(gain(f, cut) for f in range(4) for cut in np.unique(x[:, f]))
        root = forest.roots[0]
        assert abs(gain(forest.feature[root], forest.threshold[root]) - best) < 1e-9


def test_media_feature_like_a_plain_version():
    payload = ogg.padded("Hällo wörld, 123".encode() * 9)
    media = ogg.load(ogg.store(payload))
    assert media.payload == payload
    n = len(payload)
    shares = [sum(b // 16 == k for b in payload) / n for k in range(16)]
    wave = [b - 128 for b in payload]
    mean = sum(wave) / n
    deviation = (sum((w - mean) ** 2 for w in wave) / n) ** 0.5
    turns = sum((a < 0) != (b < 0) for a, b in zip(wave, wave[1:], strict=False)) / (n - 1)
    assert ogg.feature(media) == ",".join(f"{v:.6f}" for v in [*shares, mean, deviation, turns, n / 8000])


def test_preferences_edges(spark):
    fields = "conv_id long, turn int, role string, text string, prompt string"
    long = "word " * 40_000
    rows = [(None, k, "user", f"lone {k}", "x") for k in range(5)]
    rows += [(0, 0, "user", long, "x"), (1, 0, "user", long, "x"), (0, 1, "assistant", "a", "x"), (1, 1, "assistant", "b", "x")]
    rows += [(2, 0, "user", "hi", "x"), (2, 0, "user", "hi", "x"), (3, 0, "user", "hi", "x"), (3, 0, "assistant", None, "x")]
    rows += [(4, None, None, None, None)]
    got = chat.format_preferences(chat.neighbour_pairs(spark.createDataFrame(rows, fields))).collect()
    lone = [r for r in got if r["pair_id"] is None]
    assert len(lone) == 5 and all(r["prompt"] == "" and r["chosen"].count("lone") == 1 for r in lone)
    by = {r["pair_id"]: r for r in got if r["pair_id"] is not None}
    assert by[0]["prompt_turns"] == 1 and long in by[0]["prompt"] and by[0]["chosen"] == "<|assistant|>\na\n<|end|>\n"
    # turns of one number are ordered by role and text: the answer comes first in conversation 3
    assert by[1]["prompt_turns"] == 0 and by[1]["chosen"].count("hi") == 2 and by[2]["rejected"] == ""
    assert chat.format_preferences(chat.neighbour_pairs(spark.createDataFrame([], fields))).count() == 0


def test_added_names_may_be_there_before(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["n_tokens", "set_id", "piece", "length", "row", "key", "bands", "lang_pred", "n_added", "_same"]
    odd = df.withColumns({n: F.lit("x") for n in names})
    for run in (bpe.encode_digests, ngram_join.ngram_jaccard_join, packing.pack_documents, ogg.media_digests):
        a, b = run(df), run(odd)
        assert a.columns == b.columns
        shown = lambda d: sorted(map(str, d.drop("sequence_id", "offset").collect()))
        assert shown(a) == shown(b)


def test_words_are_cut_where_the_script_changes():
    assert language.words_of("Hello мир漢字テスト don't") == ["hello", "мир", "漢字", "テスト", "don't"]
    assert "".join(language.words_of("漢字" * 9)) == "漢字" * 9 and len(language.words_of("漢字" * 9)) == 5
    assert language.words_of(None) == [] and language.words_of("Déjà vu") == ["déjà", "vu"]
