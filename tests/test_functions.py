import pytest
from pyspark.sql import functions as F

from foliospark.functions import features, numbers, text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_normalize(spark):
    assert one(spark, "L’Œuvre d’Été: co-\nordonné  ", text.normalize) == "l oeuvre d ete coordonne"
    assert one(spark, "ﬁn ² Ｗ", text.normalize_full) == "fin 2 w"
    assert one(spark, "N°12, total-net d’avance", text.normalize_question) == "n°12, total net d avance"
    assert one(spark, None, text.normalize) is None


def test_accents_and_case_do_not_matter(spark):
    for a, b in (("Électricité générale", "ELECTRICITE GENERALE"), ("cœur", "coeur")):
        assert one(spark, a, text.normalize) == one(spark, b, text.normalize)


def test_grams(spark):
    assert one(spark, "ab cd", text.character_grams) == ["^ab", "ab$", "^cd", "cd$", "abc", "bcd"][:4] + ["abc", "bcd"]
    assert one(spark, "a", text.character_grams) == ["^a$"]
    assert one(spark, "une amende forfaitaire", text.query_grams)[:4] == ["ame", "men", "end", "nde"]


def test_tokens(spark):
    assert one(spark, "what is the total of THE invoice", text.significant_tokens) == ["the", "total", "the", "invoice"]
    assert one(spark, "the of", text.significant_tokens) == ["the", "of"]
    assert one(spark, "See FACT-2024-7.pdf and n/a x9", text.identifiers) == ["FACT-2024-7.PDF", "FACT-2024-7"]
    assert one(spark, "Plan de Prévention des Risques (PPR) x", text.aliases) == ["Plan de Prévention des Risques", "PPR"]


def test_osa(spark):
    assert text.osa("abcd", "abdc", 4) == 1 and text.osa("ca", "abc", 4) == 3 and text.osa("abc", "xyz", 1) == 2
    df = spark.createDataFrame([("Facture", "factrue"), ("a", "zzzzzzzzz"), (None, "a")], "a string, b string")
    assert [r.d for r in df.select(text.osa_distance(F.col("a"), F.col("b"), 2).alias("d")).collect()] == [1, 3, None]


def test_language_and_quality(spark):
    assert one(spark, "le chat est sur la table et il ne veut pas descendre de là", text.language) == "fr"
    assert one(spark, "the cat is on the table and it does not want to come down", text.language) == "en"
    assert one(spark, "too short", text.language) is None
    assert one(spark, "x" * 200, text.text_quality) == "joined"
    assert one(spark, "short", text.text_quality) == "sparse"
    assert one(spark, "good words in a row " * 5, text.text_quality) == "usable"
    assert one(spark, "good words in a row " * 5 + "\x00\x00\x00�", text.text_quality) == "unmapped"


def test_html(spark):
    assert one(spark, "<style>x</style><p>A &amp; B</p><div>C<br>D</div>", text.html_text) == "A & B\nC\nD"


@pytest.mark.parametrize(
    "raw, want",
    [("1 05.11.2025 14 949,07 69,39", ["1", "05112025", "14949.07", "69.39"]), ("15 000,00 15 000 1,9900", ["15000", "15000", "1.99"]),
     ("6,420,536 à 9h30", ["6420536", "930"]), ("0801 840 506", ["0801840506"])],
)
def test_numbers(spark, raw, want):
    assert one(spark, raw, numbers.canonical_numbers) == want


def test_money(spark):
    got = one(spark, "Total TTC : 1 234,56 €\nfrais (12,00 EUR) TVA 5 $\nTotal 15 000 GNF\nxyz 9 €", numbers.money_candidates)
    assert [(m.value_minor, m.currency, m.kind) for m in got] == [(123456, "EUR", "total_ttc"), (-1200, "EUR", "fee"), (500, "USD", "tax"), (15000, "GNF", "total")]


def test_dates(spark):
    assert one(spark, "le 3 février 2024", numbers.record_date) == "2024-02-03"
    assert one(spark, "31/02/2026 then 1 mars 2020", numbers.record_date) == "2026-02-31"
    assert one(spark, "45/02/2026 then 1 mars 2020", numbers.record_date) is None
    assert one(spark, "Reference: AB-1234x and TX-999999", numbers.record_id) == "AB-1234X"
    assert one(spark, "wait 10 days, 2 mois or 3 Years", numbers.durations) == ["10 day", "2 month", "3 year"]
    rows = one(spark, "1 05.11.2025 14 949,07 69,39\nno row", numbers.schedule_rows)
    assert [(r["rank"], r["date"], r["amounts"]) for r in rows] == [(1, "2025-11-05", [1494907, 6939])]
    cells = one(spark, "a: 1 | b : x y | c", numbers.labelled_cells)
    assert [(c.label, c.value) for c in cells] == [("a", "1"), ("b", "x y")]


def test_features(spark):
    df = spark.createDataFrame([("contract termination notice 30", "a notice of termination within 30 days of contract")], "q string, p string")
    r = df.select(features.query_coverage(F.col("q"), F.col("p")).alias("c"), features.bigram_coverage(F.col("q"), F.col("p")).alias("b")).first()
    assert (r.c, r.b) == (1.0, 0.0)
