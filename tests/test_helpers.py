import json

from pyspark.sql import functions as F

from foliospark.functions import features, numbers, text
from foliospark.operators import answers, layout, ledger
from foliospark.sources import exports, parsers
from foliospark.streaming import incremental


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_chosen_layers(spark):
    good, bad, short = "a usable layer of text with many words in it, long enough to be one", "x" * 80 + " " + "y" * 80, "short"
    native = spark.createDataFrame([("d", 1, good), ("d", 2, bad), ("d", 3, bad), ("d", 4, bad), ("d", 5, short)], "document_id string, page int, text string")
    ocr = spark.createDataFrame([("d", 1, good + "!", 0.9), ("d", 2, good, 0.6), ("d", 3, good, 0.4), ("d", 4, bad, 0.9), ("d", 5, " ", 0.9), ("d", 6, "only here", 0.3)], "document_id string, page int, text string, ocr_confidence double")
    got = {r.page: (r.text, r.ocr_confidence) for r in parsers.chosen_layers(native, ocr).collect()}
    assert got == {1: (good, None), 2: (good, 0.6), 3: (bad, 0.0), 4: (bad, 0.9), 5: (short, 0.0), 6: ("only here", 0.3)}


def test_text_helpers(spark):
    assert [one(spark, t, parsers.is_heading) for t in ("ARTICLE 5", "1.2 Objet du contrat", "une phrase qui finit.", "x", "Dispositions Générales")] == [True, True, False, False, True]
    assert one(spark, "Quel prix ? et la durée; ok, le lieu", text.clauses) == ["Quel prix", "et la durée", "le lieu"]
    assert one(spark, "1. What is the price?\n- short\n- What is the term of it?\n* What is the term of it?\nx", text.related_questions) == ["What is the price?", "What is the term of it?"]
    assert one(spark, "Titre court", text.heading_grams) == ["htit", "hitr", "htre", "hcou", "hour", "hurt", "hrec", "heco"]
    stemmed = one(spark, "remboursements mensuels", text.lexical_index_text)
    assert stemmed.startswith("remboursements mensuels\n") and "frstemrembours" in stemmed
    assert one(spark, "ﬁn Œuvre ½ x² ÀÉ", text.normalize) == "fin oeuvre ½ x2 ae"
    assert spark.range(1).select(features.similarity(F.lit(0.0)).alias("s"), numbers.cost_units(F.lit(1_000_000), F.lit(10), 3.0, 15.0).alias("c")).first() == (1.0, 4)
    cjk = "漢字" * 60
    assert [one(spark, t, text.text_quality) for t in (cjk, "a" * 70, "ok", "x\x00" * 40)] == ["usable", "joined", "sparse", "unmapped"]
    fr, en = "le chat est dans la maison et il ne sort pas avec nous", "the cat is in the house and it does not go out with us"
    assert [one(spark, t, text.language) for t in (fr, en, "xx " * 30, "le chat")] == ["fr", "en", None, None]


def test_form_pairs_and_answers(spark):
    items = [("d", 1, 100.0, "Nom", 0.0, 10.0, 0), ("d", 1, 100.0, "Age", 50.0, 10.0, 0), ("d", 1, 100.0, "42", 51.0, 8.0, 1), ("d", 1, 100.0, "oui", 1.0, 8.0, 1), ("d", 1, 100.0, "7", 90.0, 5.0, 1)]
    df = spark.createDataFrame(items, "document_id string, page int, page_width double, text string, x double, width double, row int")
    assert {(r.label, r.value) for r in layout.form_pairs(df).collect()} == {("Nom", "oui"), ("Age", "42")}
    hits = spark.createDataFrame([(1, 1, "rights:\n1. a\n2. b\n3. c\n4. d\n5. e"), (1, 2, "rights")], "query_id long, position int, text string")
    q = spark.createDataFrame([(1, "rights")], "query_id long, text string")
    assert [(r.position, r["items"]) for r in answers.enumerations(hits, q).collect()] == [(1, 5)]
    v, r = spark.createDataFrame([(1, 3), (1, 9)], "query_id long, value int"), spark.createDataFrame([(1, 6)], "query_id long, months int")
    assert {(x.value, x.below) for x in answers.month_thresholds(v, r).collect()} == {(3, True), (9, False)}


def test_incremental_runs_and_exports(spark, tmp_path):
    docs = spark.createDataFrame([(1,), (2,)], "document_id long")
    runs = spark.createDataFrame([(1, "v1")], "document_id long, extractor_version string")
    facts = spark.createDataFrame([(1, "v1", 5)], "document_id long, extractor_version string, n long")
    more, marks = ledger.with_runs(facts, docs, lambda todo: todo.withColumn("n", F.lit(7).cast("long")), "v1", runs)
    assert {(r.document_id, r.n) for r in more.collect()} == {(1, 5), (2, 7)} and marks.count() == 2
    again, _ = ledger.with_runs(more, docs, lambda todo: todo.withColumn("n", F.lit(9).cast("long")), "v1", marks)
    assert again.count() == 2
    exports.export_json({"docs": docs}, str(tmp_path))
    assert sorted(r.document_id for r in spark.read.json(f"{tmp_path}/docs").collect()) == [1, 2]
    talk = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a")], "chat_id long, created_at long, role string, content string")
    assert exports.conversation_markdown(talk).first().markdown == "**user**\n\na\n\n**assistant**\n\nb"
    assert json.loads("[]") == []


def test_ingest_and_sessions_as_streams(spark, tmp_path):
    rows = [("a", "same", "2024-01-01 10:00:00"), ("b", "same", "2024-01-01 11:00:00"), ("c", "other", "2024-01-01 12:00:00")]
    files = spark.createDataFrame(rows, "name string, content string, at string").select("name", "content", F.to_timestamp("at").alias("ts"))
    files.write.parquet(f"{tmp_path}/f/a")
    source = spark.readStream.schema(files.schema).parquet(f"{tmp_path}/f/*")
    q = incremental.ingest_once(source).writeStream.format("memory").queryName("ingested").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ingested").count() == 2 and spark.table("ingested").select("hash").distinct().count() == 2
    events = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 12:00:00")], "user_id long, at string").select("user_id", F.to_timestamp("at").alias("ts"))
    events.write.parquet(f"{tmp_path}/e/a")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e/*")
    q = incremental.sessions(source).writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.events for r in spark.table("sessions").collect()) == [1, 2]
