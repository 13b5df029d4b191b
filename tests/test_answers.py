from pyspark.sql import functions as F

from foliospark.operators import answers, layout


def frame(spark, hits, question):
    h = spark.createDataFrame([(0, i + 1, t) for i, t in enumerate(hits)], "query_id long, position int, text string")
    return h, spark.createDataFrame([(0, question)], "query_id long, text string")


def test_builders(spark):
    hits, q = frame(spark, ["Nothing here.", "The surcharge is 12,5 % of the fee. The meeting is on 03/04/2024 at 14h30. Clause 77 applies to late notice."], "what surcharge percent applies to the fee")
    u = answers.units(hits)
    got = answers.percentage(u, q).first()
    assert got.position == 2 and "12,5 %" in got.unit
    assert "14h30" in answers.date_and_time(u, q.withColumn("text", F.lit("date and time of the meeting"))).first().unit
    assert "77" in answers.number_anchored(u, q.withColumn("text", F.lit("which notice does clause 77 concern"))).first().unit
    assert answers.number_anchored(u, q).count() == 0
    s = spark.createDataFrame([(0, "a", "surcharge fee"), (0, "b", "meeting")], "query_id long, slot string, text string")
    assert {r.slot: "surcharge" in r.unit for r in answers.slots(u, s).collect()} == {"a": True, "b": False}
    assert answers.slots(u, s.unionByName(spark.createDataFrame([(0, "c", "zebra")], s.schema))).count() == 0
    asked = q.withColumn("text", F.lit("does clause 77 apply to late notice"))
    assert answers.scenario(u, asked).first().matched == 3 and answers.scenario(u, q).count() == 0
    hits, q = frame(spark, ["Paid 5,00 EUR", "Paid 1 200,50 € then"], "why 1200,50 EUR?")
    assert answers.money_anchored(hits, q).first().position == 2


def item(text, x, y, width=30.0):
    return {"text": text, "x": float(x), "y": float(y), "width": float(width)}


def test_layout(spark):
    two = [item(f"L{i}", 10, i * 10, 80) for i in range(10)] + [item(f"R{i}", 120, i * 10, 70) for i in range(10)]
    assert [t for t, _ in layout.ordered(two, 200.0)] == [f"L{i}" for i in range(10)] + [f"R{i}" for i in range(10)]
    table = [item(h, 10 + 50 * k, 0) for k, h in enumerate(("Name", "Price", "Tax"))] + [item(v, 10 + 50 * k, 10 * r) for r in (1, 2, 3) for k, v in enumerate((f"n{r}", "5", "1"))]
    assert layout.ordered(table, 200.0)[1] == ("n1 5 1", "Name: n1 | Price: 5 | Tax: 1")
    pages = spark.createDataFrame([("d", 1, 200.0, two), ("d", 2, 200.0, [])], "document_id string, page int, page_width double, items array<struct<text:string,x:double,y:double,width:double>>")
    assert layout.lines(pages).count() == 20
    ls = spark.createDataFrame([("d", 1, float(y), t) for y, t in ((0, "a"), (10, "b"), (50, "c"), (60, "d"), (70, "e"))], "document_id string, page int, y double, text string")
    assert sorted(r.text for r in layout.priced_groups(ls).collect()) == ["a b", "c d e"]
