"""The pipeline's stages, each on what the one before it kept, against plain versions."""

from oracle import SF
from pyspark.sql import functions as F
from test_operators import EDGE, SCHEMA, grams, plain_base, plain_join, plain_line_dedup

import corpus_pipeline


def test_stages(spark, tmp_path):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    first = before
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == first.columns
        tables[name] = (before, after)
        before = after

    def texts(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    old, new = map(texts, tables["quality"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(old[k] == t for k, t in new.items())
    right = [(k in new) == bool(q) for k, q in labels.items()]
    assert sum(right) / len(right) > 0.9  # few labels in the small tables

    old, new = map(texts, tables["line_dedup"])
    want = plain_line_dedup(sorted(old.items()))
    assert new == {k: t for k, t in want.items() if t or not old[k] or t == old[k]}

    old, new = map(texts, tables["ngram_jaccard_join"])
    classes = {k: c for k, c, *_ in plain_join(sorted(old.items()))}
    assert new == {k: t for k, t in old.items() if classes[k] == k}
    assert len({grams(t) for t in new.values()}) == len(new)

    old, new = map(texts, tables["pii"])
    assert old.keys() == new.keys()
    for k, t in old.items():
        assert not plain_base(new[k]) and (plain_base(t) == "" or new[k] != t)

    pieces = tables["packing"][1]
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(new)
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.where("n <> end or n > 4096").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def test_stages_on_nulls_empties_long_texts_repeats_and_extra_columns(spark):
    edge = spark.createDataFrame(EDGE, SCHEMA).withColumns({"_row": F.lit(1), "n_removed": F.lit("x"), "spans": F.lit(2)})
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, edge, SF)
        assert stage(spark, empty, SF).count() == 0
        if name == corpus_pipeline.STAGES[-1][0]:
            assert got.groupBy("doc_id").count().count() == len({r[0] for r in EDGE})
            continue
        assert got.columns == corpus_pipeline.COLUMNS
        rows = [(r["doc_id"], r["text"]) for r in got.collect()]
        if name == "line_dedup":
            # the null id comes first and keeps its lines, the other copy of them goes
            assert len(rows) == len(EDGE) - 1 and (3, None) in rows and (4, "") in rows
            assert (None, EDGE[5][1]) in rows and not any(k == 5 for k, _ in rows)
        if name == "ngram_jaccard_join":
            # one of the copies, one of the texts without words; null ids come last
            assert sorted((k for k, _ in rows)) == [1, 3, 5, 7, 8]
        if name == "pii":
            assert len(rows) == len(EDGE) and (3, None) in rows
            assert any(k == 8 and t.endswith("[REDACTED] [REDACTED]") for k, t in rows)
