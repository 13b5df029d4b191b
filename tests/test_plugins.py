import pytest
from pyspark.sql import functions as F

from foliospark.functions import noise, text
from foliospark.operators import metrics, passages, plugins


def test_embedding_and_prototypes(spark):
    df = spark.createDataFrame([(1, "red apple pie"), (2, None), (3, "apple pie red")], "id int, text string")
    got = {r.id: r.embedding for r in plugins.embedded(df, plugins.hashing_embedder(16), 16).collect()}
    assert got[1] == got[3] and len(got[1]) == 16 and set(got[2]) == {0.0}
    with pytest.raises(Exception, match="dimensions"):
        plugins.embedded(df, plugins.hashing_embedder(8), 16).collect()
    labelled = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])], "id long, label string, embedding array<double>")
    q = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.7, 0.7])], "query_id long, embedding array<double>")
    assert {r.query_id: r.label for r in plugins.prototypes(q, labelled).collect()} == {0: "a", 1: None}


def test_rerank_and_rewrite(spark):
    c = spark.createDataFrame([(0, "q", i, i, "x" * i) for i in range(1, 6)], "query_id long, question string, rank int, chunk_id long, text string")
    got = plugins.reranked(c, lambda q, ps: [float("nan") if len(p) == 2 else len(p) for p in ps], pool=4, keep=4).orderBy("position").collect()
    assert [r.chunk_id for r in got] == [4, 3, 1, 2]
    q = spark.createDataFrame([("total of INV-1?",), ("who",)], "text string")
    assert [r.rewritten for r in plugins.rewritten(q, lambda t: "the sum" if "INV" in t else "who is it").collect()] == ["total of INV-1?", "who is it"]


def test_passages(spark):
    one = lambda t, p: spark.createDataFrame([(t, p)], "t string, p string").select(passages.contains_passage(F.col("t"), F.col("p")).alias("x")).first().x
    assert one("Un Été à Paris, enfin.", "ete a paris") == 1.0 and one("abc", "") == 0.0
    assert 0.5 <= one("the first long run stands here", "the first long run. zzzz yyyy xx") < 1 and one("abc", "quite another text altogether") == 0.0
    h = spark.createDataFrame([("a b c d e f needle g h other i j k l m n", ["needle", "other"])], "text string, terms array<string>")
    assert passages.snippets(h, 5).first().snippet == "…f needle g h other…"
    d = spark.createDataFrame([("x.\nx.\nx.\nx.",), ("a. b. c. d.",), (None,)], "t string").select(passages.degenerate(F.col("t")).alias("d"))
    assert [r.d for r in d.collect()] == [True, False, False]
    assert spark.createDataFrame([("Ce n'est pas mentionné.",)], "t string").select(passages.refuses(F.col("t")).alias("r")).first().r
    a = spark.createDataFrame([(1, "It is 12 euros", [["12 euros", "douze"]], ["13"]), (2, "It is 13", [["13"]], ["13"])], "answer_id int, answer string, groups array<array<string>>, forbidden array<string>")
    assert [r.right for r in passages.answer_oracle(a).collect()] == [True, False]


def test_noise_is_found_again(spark):
    df = spark.createDataFrame([("Électricité générale",)], "t string")
    r = df.select(noise.without_accents(F.col("t")).alias("a"), noise.swapped(F.col("t")).alias("s"), noise.dropped(F.col("t")).alias("d")).first()
    assert r.a == "Electricite generale" and r.s == "Élcetricité géénrale" and r.d == "Élctricité géérale"
    assert text.osa("electricite", "elcetricite", 2) == 1


def test_page_recognisers(spark):
    pages = spark.createDataFrame([("d", 1, bytearray(b"a b\nc")), ("d", 2, bytearray(b"")), ("e", 1, None)], "document_id string, page int, image binary")
    read = lambda images: [[(line, 0.9 if line else 0.1) for line in (i or b"").decode().split("\n")] for i in images]
    got = sorted((r.document_id, r.page, r.line, r.text, round(r.confidence, 3)) for r in plugins.recognised(pages, read).collect())
    assert got == [("d", 1, 0, "a b", 0.9), ("d", 1, 1, "c", 0.9), ("d", 2, 0, "", 0.1), ("e", 1, 0, "", 0.1)]
    try:
        plugins.recognised(pages, lambda images: []).collect()
        raise AssertionError
    except Exception as e:
        assert "recogniser" in str(e)


def test_harness_and_parser_adapters(spark):
    cases = spark.createDataFrame([(1, "find a", "retrieve"), (2, "sum", "aggregate"), (3, "say", "generate"), (4, None, "retrieve")], "case_id long, question string, kind string")
    made = plugins.harness(cases, retrieve=lambda q: ["a", "b"], aggregate=lambda q: 12.5, generate=lambda q: {"said": q})
    assert {(r.case_id, r.result) for r in made.collect()} == {(1, '["a", "b"]'), (2, "12.5"), (3, '{"said": "say"}'), (4, '["a", "b"]')}
    files = spark.createDataFrame([("d", bytearray(b"Total\nPrice: 12 EUR\nTax 3 EUR")), ("e", bytearray(b"x"))], "document_id string, content binary")

    def broken(content):
        raise ValueError("cannot read")

    adapters = {"lines": lambda c: c.decode().split("\n"), "one": lambda c: [c.decode().replace("\n", " ")], "broken": broken}
    parsed = plugins.parsed_by(files, adapters)
    assert {(r.adapter, r.error) for r in parsed.filter("error IS NOT NULL").collect()} == {("broken", "ValueError: cannot read")}
    expected = spark.createDataFrame([("d", 1, "Price", "12"), ("d", 2, "Tax", "3"), ("d", 3, "Total", "12"), ("e", 1, "missing", "9")], "document_id string, place int, label string, value string")
    got = {r.adapter: (r.pairs, r.bound, r.orphans, r.in_order) for r in metrics.parser_metrics(expected, parsed.filter("error IS NULL")).collect()}
    assert got == {"lines": (4, 2, 1, 1.0), "one": (4, 3, 0, 0.0)}
