import pytest
from pyspark.sql import functions as F

from foliospark.functions import numbers
from foliospark.operators import chunking, evidence, facts, layout, ledger, metrics, relational, retrieval, workspace
from foliospark.plans import compiler, questions
from foliospark.sources import exports, parsers
from foliospark.streaming import incremental

RECEIPTS = [
    (1, "Facture n° INV-0001\nDate: 05/03/2024\nTotal TTC: 100,00 €"),
    (2, "Facture n° INV-0002\nDate: 06/04/2024\nTotal TTC: 50,01 €\nTVA: 10,00 €"),
    (3, "Facture n° INV-0003\nDate: 07/03/2024\nTotal TTC: 20,00 USD"),
    (4, "Facture n° INV-0004\nTotal TTC: 1,00 €\nNet à payer: 2,00 €"),
]


@pytest.fixture(scope="module")
def receipts(spark):
    return spark.createDataFrame([(i, i, i, t) for i, t in RECEIPTS], "document_id long, chunk_id long, page int, text string")


def test_aggregates(receipts):
    f = facts.records(receipts)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(facts.aggregate(f, "sum", "total_ttc")) == [("EUR", 15001, 2), ("USD", 2000, 1)]
    assert rows(facts.aggregate(f, "average", "total_ttc")) == [("EUR", 7501, 2), ("USD", 2000, 1)]
    assert rows(facts.aggregate(f, "minimum")) == [("EUR", 5001, 2), ("USD", 2000, 1)]
    assert facts.aggregate(f, "count").first()["count"] == 4
    assert rows(facts.aggregate(f, "sum", "total_ttc", year=2024, month=3)) == [("EUR", 10000, 1), ("USD", 2000, 1)]
    assert [r.record_key for r in facts.chosen_facts(f, "total_ttc").filter("ambiguous").collect()] == ["4:id:INV-0004"]


@pytest.mark.parametrize(
    "question, route, operation, role, scope",
    [("Quelle est la somme TTC de toutes les factures ?", "aggregate", "sum", "total_ttc", "collection"), ("What is the average VAT of all invoices?", "aggregate", "average", "tax", "collection"),
     ("How many receipts in March 2024?", "aggregate", "count", None, "temporal"), ("Who signed the contract?", "targeted", None, None, "unspecified"),
     ("Résume le document", "synthesis", "list", None, "collection"), ("What is the total of INV-0001?", "targeted", "sum", None, "record"),
     ("what are the fees", "aggregate", "list", "fee", "unspecified"), ("add up all amounts", "aggregate", "sum", None, "collection"), ("Détaille les frais", "aggregate", "list", "fee", "unspecified"),
     ("Qui est le vendeur et quel est le prix ?", "synthesis", None, None, "unspecified"), ("Combien de temps dure la garantie ?", "targeted", None, None, "unspecified"),
     ("Quel est le montant de cette facture ?", "targeted", None, None, "record"), ("Que dit la page 3 ?", "targeted", None, None, "page"), ("Combien de factres ?", "aggregate", "count", None, "collection")],
)
def test_frames(question, route, operation, role, scope):
    frame = questions.analyze(question)
    assert (frame.route, frame.operation, frame.role, frame.scope) == (route, operation, role, scope)


def test_references_and_clarifications():
    assert [questions.reference(q) for q in ("Et pour juin ?", "Quelle est sa date ?", "Que contient-il ?", "Quel est le prix ?", "Qui signe et où ?")] == ["continuation", "anaphoric", None, None, None]
    total = questions.analyze("Quel est le total ?")
    assert total.clarification == "scope" and [questions.clarified(total, n) for n in (1, 2)] == [None, "scope"]
    assert questions.clarified(questions.analyze("Quel est le total du RAPO ?"), 5) is None
    assert questions.analyze("frais et montant reçu du transfert").clarification == "financial_role"
    assert questions.contextual("Et pour juin ?", ["a", "b"]) == "Et pour juin ?\nPrevious question: b\nPrevious question: a" and questions.contextual("Quel prix ?", ["a"]) == "Quel prix ?"
    assert questions.anchored_clauses("Quel est le prix du contrat Alpha ? quelle est la durée ?") == ["Quel est le prix du contrat Alpha", "quelle est la durée ? (Alpha)"]
    assert [questions.calibrated(*x) for x in ((0.5, 0.05, 256), (0.5, 0.01, 256), (0.4, 0.5, 256), (0.9, 0.9, 384), (0.9, None, 256))] == [True, False, False, False, True]
    assert [questions.locale(q) for q in ("What is the price?", "Quel est le prix ?", "prix")] == ["en", "fr", "fr"]


def test_time_scopes():
    assert questions.temporal("du 01/02/2024 au 05/03/2024") == questions.Temporal(start="2024-02-01", end="2024-03-05")
    assert questions.temporal("in March 2023") == questions.Temporal(year=2023, month=3) and questions.temporal("le 3/4/2024").start == "2024-04-03"
    assert questions.temporal("en 2021").year == 2021 and questions.temporal("rien") is None and questions.temporal("juin puis mai").month == 6


def test_question_to_rows(receipts):
    got = sorted(tuple(r) for r in compiler.answer("Quelle est la moyenne TTC de toutes les factures en mars 2024 ?", receipts).collect())
    assert got == [("EUR", 10000, 1), ("USD", 2000, 1)]
    hits = compiler.answer("Which invoice is INV-0003 USD?", receipts).orderBy("position").collect()
    assert hits[0].chunk_id == 3


def test_relational(spark):
    chunks = spark.createDataFrame([("d", i) for i in range(10)] + [("e", 1)], "document_id string, seq int")
    near = relational.neighbours(chunks, chunks.filter("document_id = 'd' AND seq IN (2, 3)"), 1)
    assert sorted(r.seq for r in near.collect()) == [1, 2, 3, 4]
    spans = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 10, 12), ("b", 1, 2)], "g string, start int, end int")
    assert {r.g: (r.covered, r.islands) for r in relational.interval_union(spans, ["g"]).collect()} == {"a": (10, 2), "b": (1, 1)}
    w = relational.wilson(spark.createDataFrame([(8, 10), (0, 0)], "s long, n long"), "s", "n").collect()
    assert (w[0].low, w[0].high) == (0.490162, 0.943318) and w[1].low is None


def test_bm25_orders_rare_words_first(spark):
    c = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "z"]), (3, ["x"]), (4, ["q"]), (5, ["q"])], "id long, ts array<string>")
    q = spark.createDataFrame([(0, ["z", "x", "none"])], "query_id long, ts array<string>")
    ts = F.col("ts")
    got = retrieval.bm25(retrieval.postings(c, "id", ts), retrieval.query_terms(q, ts), "id", retrieval.corpus_size(c, ts)).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1, 3] and got[0].score > 0.9


def test_refine_and_fuse(spark):
    ch = spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 2, 1, 1.0)], "query_id int, chunk_id int, rank int, weight double")
    got = retrieval.fused(ch, "chunk_id").orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(2, round(1 / 61 + 1 / 62, 8)), (1, round(1 / 61, 8))]
    c = spark.createDataFrame([(0, 1, "a", 0.02, 0.9, 1.0), (0, 2, "a", 0.03, 0.1, 1.0), (0, 3, "b", 0.9, 0.1, 0.0)], "query_id int, chunk_id int, channel string, score double, cov double, comp double")
    assert [r.chunk_id for r in retrieval.refined(c, {"cov": 0.08}, "comp").orderBy("rank").collect()] == [1, 2, 3]


def test_packing_skips_and_goes_on(spark):
    rows = [(0, 1, 1, "d", "p", "alpha " * 30, False), (0, 2, 2, "d", "p", "alpha " * 29, False), (0, 3, 3, "d", "p", "beta gamma " * 2000, False),
            (0, 4, 4, "d", "p", "delta epsilon", False), (0, 5, 5, "d", "p", "zeta", True)]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, document_id string, place string, text string, is_parent boolean")
    assert [r.chunk_id for r in evidence.packed(df).orderBy("position").collect()] == [1, 4]


def test_grounding(spark):
    df = spark.createDataFrame([(1, "It is 1 200,50 over 3 years", "1 200,5 paid"), (2, "It is 999", "1 000")], "answer_id int, answer string, evidence string")
    assert [(r.unsupported, r.grounded) for r in evidence.grounded(df).collect()] == [([], True), (["999"], False)]
    d = spark.createDataFrame([(1, 300.0, "100 and 200"), (2, 301.0, "100 and 200")], "answer_id int, value double, evidence string")
    assert [r.derived for r in evidence.derivable(d).collect()] == [True, False]
    a = spark.createDataFrame([(1, "x [1][2]", 2), (2, "y [3]", 2), (3, "z", 2)], "answer_id int, answer string, n_evidence int")
    assert [r.valid for r in evidence.valid_markers(a).collect()] == [True, False, False]
    t = spark.createDataFrame([(1, "This is a sentence that repeats. This is a sentence that repeats. Yes. Yes.")], "k int, text string")
    assert evidence.without_repeats(t, "k").first().text == "This is a sentence that repeats. Yes. Yes."


def test_near_duplicate_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [("g", i, sorted({rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))})) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, ts array<string>")
    linked = {(r.i, r.twin) for r in evidence.near_duplicates(df, "g", "i", "ts").collect()}
    of = {r.i: r.representative for r in evidence.set_members(df, "g", "i", "ts").collect()}
    got = {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or (min(of[a], of[b]), max(of[a], of[b])) in linked)}
    want = {(a, b) for _, a, x in rows for _, b, y in rows if a < b and len(set(x) & set(y)) / min(len(x), len(y)) >= 0.85}
    assert got == want


def test_metrics(spark):
    rows = [(1, ["a"], ["a", "b"], True), (2, ["a", "b"], ["c", "a"], True), (3, ["z"], [], False)]
    m = metrics.retrieval_metrics(spark.createDataFrame(rows, "query_id int, expected array<string>, retrieved array<string>, answerable boolean")).first()
    assert (m.queries, m.recall_1, m.recall_1_ceiling, m.recall_5, m.mrr_10, m.negative_precision) == (2, 0.5, 0.75, 0.75, 0.75, 1.0)


def test_ledger(spark):
    state = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, name string, note string")
    change = spark.createDataFrame([(2, None, "n"), (3, "c", None)], "id int, name string, note string")
    assert sorted(tuple(r) for r in ledger.upserted(state, change, ["id"]).collect()) == [(1, "a", "x"), (2, "b", "n"), (3, "c", None)]
    assert sorted(r.id for r in ledger.inserted_or_ignored(state, change, ["id"]).collect()) == [1, 2, 3]
    s = spark.createDataFrame([("k", "1")], "key string, value string")
    assert ledger.settings(s, "k", "2").first().value == "2" and ledger.settings(s, "k", None).count() == 0


def test_parsers_and_chunks(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr>{cell("Name")}{cell("Sum")}</w:tr><w:tr>{cell("A")}{cell("5")}</w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.md").write_text("# One\n\nfirst part\n\n## Two\n\n" + "A sentence with some words in it. " * 60)
    (tmp_path / "c.bin").write_bytes(b"\0")
    (tmp_path / "broken.docx").write_bytes(b"nope")
    (tmp_path / "copy.md").write_text((tmp_path / "b.md").read_text())
    files = parsers.read_files(spark, str(tmp_path))
    assert files.count() == 4
    blocks = parsers.blocks(files).cache()
    got = {(r.document_name, r.block_index): r for r in blocks.collect()}
    assert got["a.docx", 1].context == "Name: A | Sum: 5" and got["a.docx", 1].heading == "Head"
    assert got["c.bin", 0].error == "unsupported_format" and got["broken.docx", 0].error
    made = chunking.chunks(blocks.filter("error IS NULL").withColumns({"page": F.lit(None).cast("int"), "region": F.lit(None).cast("string")})).filter("heading = 'One > Two'").collect()
    children, parents = [r for r in made if r.para_index >= 0], [r for r in made if r.para_index < 0]
    assert len(children) >= 3 and parents and all(len(r.text) <= 650 for r in children) and all(r.n_blocks >= 2 for r in parents)


def test_versions(spark, tmp_path):
    assert exports.current(spark, str(tmp_path)) is None
    for n in (3, 5, 4, 7):  # close together: the number decides, not the clock
        exports.write_version({"a": spark.range(n)}, str(tmp_path))
        assert exports.read_version(spark, str(tmp_path), "a").count() == n
    lines = spark.createDataFrame([('data: {"choices":[{"delta":{"content":"hi"}}]}',), ("data: [DONE]",), ("data: {bro",), (": x",)], "value string")
    assert [r.delta for r in exports.event_stream_deltas(lines).collect()] == ["hi"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(1, 5, "2024-01-01 10:00:00"), (1, 7, "2024-01-01 12:00:00"), (2, 1, "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "user_id long, cost long, at string").select("user_id", "cost", F.to_timestamp("at").alias("ts")).write.parquet(f"{tmp_path}/in/a")
    source = spark.readStream.schema("user_id long, cost long, ts timestamp").parquet(f"{tmp_path}/in/*")
    q = incremental.daily_quota(source, 10).writeStream.format("memory").queryName("quota").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.user_id, r.used, r.remaining) for r in spark.table("quota").collect()) == [(1, 12, 0), (2, 1, 9)]
    changes = [("d", "ready"), ("d", "parsing"), ("e", "received")]
    spark.createDataFrame(changes, "document_id string, status string").write.parquet(f"{tmp_path}/ch/a")
    source = spark.readStream.schema("document_id string, status string").parquet(f"{tmp_path}/ch/*")
    q = incremental.lifecycle(source).writeStream.format("memory").queryName("life").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.document_id, r.status) for r in spark.table("life").collect()} == {("d", "ready"), ("e", "received")}


def test_near_duplicates_meet_by_their_rarest_tokens(spark):
    rows = spark.createDataFrame([("g", i, ["a", "all", f"z{i // 2}", f"zz{i // 2}"]) for i in range(20)], "g string, id long, t array<string>")
    got = evidence.prefixes(rows, "g", "id", 0.75).collect()
    assert {(r.id, *r.prefix) for r in got} == {(i, f"z{i // 2}", f"zz{i // 2}") for i in range(20)}
    pairs = evidence.near_duplicates(rows, "g", "id", "t", 0.75).collect()
    assert pairs == []  # equal sets are one
    members = {tuple(r) for r in evidence.set_members(rows, "g", "id", "t").collect()}
    assert members == {(i, i - i % 2) for i in range(20)}
    rng = __import__("random").Random(5)
    sets = [sorted({rng.randrange(12) for _ in range(rng.randint(1, 9))}) for _ in range(120)]
    many = spark.createDataFrame([("g", i, [str(x) for x in t]) for i, t in enumerate(sets)], "g string, id long, t array<string>")
    least = {}
    for i, t in enumerate(sets):
        least.setdefault(tuple(t), i)
    want = {(a, b) for t, a in least.items() for u, b in least.items() if a < b and len(set(t) & set(u)) >= 0.75 * min(len(t), len(u))}
    assert {(r.id, r.twin) for r in evidence.near_duplicates(many, "g", "id", "t", 0.75).collect()} == want


def test_replayed_batches_are_merged_once(spark, tmp_path):
    step = incremental.keep_current(str(tmp_path), lambda state, batch: state.unionByName(batch))
    for epoch, n in ((0, 2), (1, 3), (1, 3), (0, 2), (2, 1)):
        step(spark.range(n), epoch)
    assert exports.read_version(spark, str(tmp_path), "state").count() == 6


def test_unversioned_messages_and_nearest_rank(spark):
    m = spark.createDataFrame([(1, None, 5), (2, None, 4), (3, "g", 1), (4, "g", 2)], "id long, version_group string, created_at long")
    assert sorted(r.id for r in relational.active_versions(m).collect()) == [1, 2, 4]
    rng = __import__("random").Random(3)
    rows = [("a", float(rng.randint(0, 50))) for _ in range(301)] + [("b", 2.0)] * 7 + [("c", None)] + [("d", -1.5), ("d", 1e9)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.01, 0.5, 0.95, 1.0):
        got = {r.g: r.p for r in relational.nearest_rank(df, ["g"], "v", share, "p", blocks=8).collect()}
        values = {g: sorted(v for h, v in rows if h == g and v is not None) for g in "abd"}
        assert got == {g: v[-int(-(share * len(v)) // 1) - 1] for g, v in values.items()}


def test_wrapped_received_amounts_and_months(spark):
    df = spark.createDataFrame([("Montant reçu par le\nTaux 1 EUR\nbénéficiaire 12,50 EUR",), ("Total TTC: 10,00 EUR, TVA 2,00 EUR",), ("x 5 EUR",), (None,)], "part string")
    got = sorted((r.kind, r.value_minor) for r in numbers.money_rows(df, "part").collect())
    assert got == [("received", 100), ("tax", 200), ("total_ttc", 1000)]
    dates = spark.createDataFrame([("le 3 mars 2024 puis 4 janvier 2023",), ("4/13/2023",), ("7 may 2021",)], "t string").select(numbers.record_date(F.col("t")).alias("d"))
    assert [r.d for r in dates.collect()] == ["2023-01-04", None, "2021-05-07"]
    d = spark.createDataFrame([("deux mois et 10 jours, trois ans",)], "t string").select(numbers.durations(F.col("t")).alias("d")).first().d
    assert d == ["10 day", "2 month", "3 year"]


def test_amounts_and_dates_as_written():
    assert [numbers.canonical_amounts(x) for x in ("1 234,50 €", "12.00", "1.234,05", "none", "20 00 €")] == [["1234.5"], ["12"], ["1234.05"], [], ["2000"]]
    assert numbers.joined_amounts("soit 20 00 € HT et 1 234,50 € TTC") == "soit 2000 € HT et 1 234,50 € TTC"
    found = numbers.calendar_dates("le 03/04/2024, 3 avril 2024, April 5, 2024 et 2024-04-06; 40/40/2024")
    assert [k for _, _, k in found] == [("2024-04-03", "2024-03-04"), ("2024-04-06",), ("2024-04-03",), ("2024-04-05",)]


def test_schedule_records_need_rows_and_the_euro(spark):
    row = lambda i: f"{i} {i % 27 + 1:02d}.{i % 12 + 1:02d}.2024 {i},00 69,39 1 000,00"
    texts = [(1, 1, "en euros\n" + "\n".join(map(row, range(1, 8))), None), (1, 2, "\n".join(map(row, range(8, 15))), None),
             (2, 3, "\n".join(map(row, range(1, 15))), None), (3, 4, "€\n" + "\n".join(map(row, range(1, 5))), None), (4, 5, "€\n" + "\n".join(map(row, range(1, 15))), 0.1)]
    chunks = spark.createDataFrame(texts, "document_id long, chunk_id long, text string, ocr_confidence double")
    got = facts.schedule_records(chunks).collect()
    assert {r.document_id for r in got} == {1} and len(got) == 14 and {(r.value_minor, r.currency, r.kind) for r in got} == {(6939, "EUR", "amount")}
    rows = spark.createDataFrame([(1, "2024-02-03")], "document_id long, date string")
    context = spark.createDataFrame([(1, "Date: 03.02.2024 | Principal: 50,00 | Solde: 1 000,50 €"), (1, "Date: 04.02.2024 | Principal: 60,00")], "document_id long, line string")
    assert {(r.label, r.value_minor) for r in facts.labelled_schedule(rows, context).collect()} == {("Principal", 5000), ("Solde", 100050)}


def test_wipe_needs_its_path(spark, tmp_path):
    (tmp_path / "w").mkdir()
    try:
        workspace.wipe(spark, f"{tmp_path}/w", "yes")
        raise AssertionError
    except ValueError:
        pass
    assert workspace.wipe(spark, f"{tmp_path}/w", f"{tmp_path}/w") and not (tmp_path / "w").exists()
    spark.range(5).write.parquet(f"{tmp_path}/t")
    row = workspace.stored_bytes({"t": spark.read.parquet(f"{tmp_path}/t")}).first()
    assert row.files >= 1 and row.bytes > 0


def test_columns_within_columns():
    words = lambda x, y, t: {"text": t, "x": float(x), "y": float(y), "width": 90.0}
    items = [words(x, 10 * k, f"{c} {chr(97 + k)}") for k in range(12) for x, c in ((0, "a"), (150, "b"), (400, "c"))]
    got = [t for t, _ in layout.ordered(items, 500.0)]
    assert got == [f"{c} {chr(97 + k)}" for c in "abc" for k in range(12)]


def test_form_marks_and_markdown_router(spark):
    rows = [("d", 1, 1, "☐", 10.0, 100.0, 8.0), ("d", 1, 2, "x", 12.0, 102.0, 4.0), ("d", 1, 3, "□", 10.0, 150.0, 0.0), ("d", 1, 4, "\ue001", 10.0, 200.0, 8.0),
            ("d", 1, 5, "X", 11.0, 200.0, 3.0), ("d", 1, 6, "\ue001", 10.0, 300.0, 8.0), ("d", 1, 7, "\ue002", 10.0, 400.0, 8.0), ("d", 1, 8, "✓", 50.0, 400.0, 8.0),
            ("d", 1, 9, "Oui", 20.0, 100.0, 20.0), ("e", 1, 1, "\ue001", 10.0, 300.0, 8.0), ("d", 2, 2, "ab", 10.0, 100.0, 8.0)]
    df = spark.createDataFrame(rows, "document_id string, page int, item_id int, text string, x double, y double, width double")
    got = {(r.document_id, r.page, r.item_id): r.text for r in layout.form_marks(df).collect()}
    assert got == {("d", 1, 1): "☑", ("d", 1, 3): "☐", ("d", 1, 4): "☑", ("d", 1, 6): "☐", ("d", 1, 7): "\ue002", ("d", 1, 8): "☑", ("d", 1, 9): "Oui", ("e", 1, 1): "\ue001", ("d", 2, 2): "ab"}
    pages = ["| a | 12 € |\n| b | text |\n| c | more |\n|---|---|\n| d | x |", "| a | x |\n" * 5 + "| b | 3 |", "no table", "| 12 |"]
    made = spark.createDataFrame([(t,) for t in pages], "t string").select(layout.prefers_markdown(F.col("t")).alias("m"))
    assert [r.m for r in made.collect()] == [True, False, False, False]


def test_page_chrome(spark):
    items = spark.createDataFrame([(1, 1, 0.1, 0.05, 0.2, 0.02), (1, 2, 0.1, 0.5, 0.8, 0.3), (1, 3, 0.1, 0.95, 0.2, 0.02)], "page_id int, item_id int, x double, y double, width double, height double")
    regions = spark.createDataFrame([(1, 1, "header", 0.9, 0.0, 0.0, 1.0, 0.1), (1, 2, "footer", 0.4, 0.0, 0.9, 1.0, 1.0), (1, 3, "header", 0.9, 0.0, 0.4, 1.0, 0.9)], "page_id int, region_id int, kind string, score double, left double, top double, right double, bottom double")
    assert {r.item_id: r.chrome for r in layout.page_chrome(items, regions).collect()} == {1: "header", 2: None, 3: None}


def test_near_duplicates_in_blocks(spark):
    """Pairs of all blocks, none lost, and no pair of words in common as a row: against all pairs."""
    import random
    from itertools import combinations

    from foliospark.operators import evidence

    r = random.Random(5)
    common, sets = [f"c{i}" for i in range(30)], {}
    for k in range(120):
        base = r.sample(common, r.randint(1, 30)) + [f"r{r.randint(0, 40)}" for _ in range(r.randint(0, 4))]
        sets[k] = base if k % 3 else (sets[k - 1] if k else base)[r.randint(0, 1) :] + ["x"] * (k % 2)
    rows = spark.createDataFrame([(k, "ab"[k % 7 < 3], t) for k, t in sets.items()], "k int, g string, t array<string>")
    first = {}
    for k, t in sets.items():
        if t:
            first.setdefault(("ab"[k % 7 < 3], frozenset(t)), k)
    want = {}
    for (ga, a), (gb, b) in combinations(first, 2):
        share = len(a & b) / min(len(a), len(b))
        if ga == gb and share >= 0.85:
            want[tuple(sorted((first[ga, a], first[gb, b])))] = round(share, 6)
    made = evidence.near_duplicates(rows, "g", "k", "t", block=300)
    assert {(x.k, x.twin): x.overlap for x in made.collect()} == want and len(want) > 20
    exploded = evidence.near_duplicates(rows, "g", "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in exploded


def test_sets_of_tokens_of_their_own_arent_sent(spark, monkeypatch):
    """Sets with more tokens that no other set has than may be missing are no smaller part of a pair, and meet no block."""
    from foliospark.operators import evidence

    sent, postings = [], evidence._postings
    monkeypatch.setattr(evidence, "_postings", lambda table, *more: sent.append(table.num_rows) or postings(table, *more))
    rows = [(k, "g", [f"c{i}" for i in range(10)] + [f"own{k}.{i}" for i in range(4)]) for k in range(200)]
    rows += [(200, "g", ["x", "y", "z"]), (201, "g", ["x", "y", "z", "only"])]
    made = evidence.near_duplicates(spark.createDataFrame(rows, "k int, g string, t array<string>"), "g", "k", "t")
    assert [tuple(r) for r in made.collect()] == [(200, 201, 1.0)] and sum(sent) == 1


def test_sets_meet_as_by_brute_force():
    """Whatever the order of hashes and the size of a step; hashes that collide in a set only add."""
    import numpy as np
    import pyarrow as pa

    from foliospark.operators import evidence

    r = np.random.default_rng(3)
    sets = [list(dict.fromkeys(r.integers(-40, 40, n).tolist())) for n in r.integers(1, 50, 150)]
    sets += [[x for x in sets[k] if r.random() < 0.95] or [1] for k in range(60)]
    table = pa.table({"_set": pa.array(range(len(sets)), pa.int64()), "hashes": pa.array(sets, pa.list_(pa.int32())), "alone": pa.array([0] * len(sets), pa.int32())})
    want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if len(x) <= len(y) and len(set(x) & set(y)) >= 0.85 * len(x) - 1e-9}
    block = evidence._postings(table, 0.85)
    for most in (4, 300, 1 << 20):
        met = [(int(block[0][a]), b) for small, large in evidence._met(block, *evidence._lists(table.column(1)), most) for a, b in zip(small, large.tolist())]
        assert len(met) == len(set(met)) and set(met) == want and len(want) > 220
