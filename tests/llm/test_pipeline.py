from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import decontaminate


def test_stages(spark, tmp_path):
    clean = lambda i: " ".join(f"the{(i * 37 + k * k) % 997} of word{(i * 11 + k * 7) % 499}" if k % 3 else "the" for k in range(60))
    rows = [(i, clean(i)) for i in range(12)]
    rows += [(20, clean(3)), (21, clean(3) + " end"), (22, "### " * 80), (23, ""), (24, None), (25, clean(40) + " one two three four five six seven eight nine ten")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "One two three four five, six seven eight nine TEN")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    at, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        kept.append({r.doc_id for r in at.collect()})
    every = set(range(12))
    assert kept == [every | {20, 21, 25}, every | {20, 21, 25}, every | {25}, every]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == every and all(r.round_trip for r in out)
    assert decontaminate.WINDOW == 10


def near_pair(i, shared):
    """Two texts of 200 different five-word shingles each, ``shared`` of them the same."""
    words = [f"w{i}x{k}" for k in range(204)]
    return " ".join(words), " ".join(words[: shared + 4] + [f"y{i}x{k}" for k in range(200 - shared)])


def kept_of(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]


def test_near_copies_by_true_similarity(spark):
    # Jaccard similarities 178 / 222 = 0.802 and 177 / 223 = 0.794: one of the former pairs stays, both of the latter.
    rows = [(10 * i + k, t) for i in range(150) for k, t in enumerate(near_pair(i, 178 if i < 75 else 177))]
    assert {i for i, _ in kept_of(spark, rows)} == {i for i, _ in rows if i < 750 and i % 10 == 0 or i >= 750}


def test_large_groups_of_copies_leave_one(spark):
    docs = spark.createDataFrame([(i, "one line of a copy\nand another", "en", "s", 1) for i in range(25)] + [(90, " \n", "en", "s", 1), (91, "own text", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.line_stage(spark, docs, "")
    assert sorted(r.doc_id for r in cut.collect() if not (r.text or "").split()) == [*range(1, 25), 90]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, cut, "").collect()) == [0, 1, 91]


def test_different_texts_of_null_or_shared_ids_stay(spark):
    text = lambda k: " ".join(f"n{k}w{i}" for i in range(30))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (7, text(2)), (8, text(3)), (8, text(4)), (8, text(4))]
    assert sorted(kept_of(spark, rows), key=str) == sorted([(None, text(0)), (None, text(1)), (7, text(2)), (8, text(3)), (8, text(4))], key=str)


def test_stages_on_odd_tables(spark, odd_docs, no_docs, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names and empty tables."""
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = odd_docs.withColumn("own_hash", F.lit("mine")).withColumn("found_id", F.lit(1)).withColumn("Component_ID", F.lit(2))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name
        got = stage(spark, clash if name in ("simhash_near_dedup", "decontamination") else odd_docs, str(tmp_path))
        rows = got.collect()
        if name == "line_dedup":  # the first of the lines that 14 documents share stays, all documents do
            assert len(rows) == odd_docs.count()
            held = [r.doc_id for r in rows for x in (r.text or "").split("\n") if x.strip().lower() == "same line"]
            assert len(set(held)) == 1
        if name in ("simhash_near_dedup", "decontamination"):
            assert got.columns == clash.columns and {r.own_hash for r in rows} == {"mine"}
        if name == "decontamination":
            assert len(rows) == odd_docs.count()
        if name == "simhash_near_dedup":  # null, empty and blank texts are one group; the repeated row stays once
            assert sorted(str(r.doc_id) for r in rows if not (r.text or "").split()) == ["1"] and sum(r.doc_id == 5 for r in rows) == 2
        if name == "sentencepiece":
            assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.decontamination_stage(spark, odd_docs, str(tmp_path)).count() == odd_docs.count()
