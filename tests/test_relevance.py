import random

from pyspark.sql import functions as F

from foliospark.functions import relevance as R
from foliospark.functions import stems
from foliospark.functions.text import osa
from foliospark.operators import extract, gates, grounding, packing, refine, retrieval


def test_published_stems():
    english = {"consistency": "consist", "knocking": "knock", "hopping": "hop", "hoping": "hope", "relational": "relat", "happiness": "happi", "skies": "sky", "news": "news", "agreed": "agre"}
    french = {"continuellement": "continuel", "majestueusement": "majestu", "contrariété": "contrariet", "chevaux": "cheval", "remboursements": "rembours", "heureuse": "heureux"}
    assert {w: stems.english(w) for w in english} == english and {w: stems.french(w) for w in french} == french


def test_near_words_equal_all_pairs():
    rng = random.Random(1)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))) for _ in range(300)}
    text = R.held(" ".join(words))
    for w in rng.sample(sorted(words), 30):
        wanted = w[:2] + "z" + w[3:]
        assert dict(text.near(wanted, 2)) == {x: osa(wanted, x, 2) for x in words if osa(wanted, x, 2) <= 2}


def of(query, text, heading=""):
    return R.features(query, "", heading, text)


def test_features_of_cases():
    f = of("Quelle est la cotisation mensuelle ?", "La cotisation mensuelle est de 45,90 € par mois")
    assert f["numeric"] == 1 and f["label"] == 1 and f["proximity"] == 1
    assert of("montant de la prime", "prime " + "x " * 200 + "45 €")["proximity"] == 0
    assert of("Combien de temps dure la garantie ?", "La garantie dure trois mois")["numeric"] == 1
    assert of("Quelle est la date de signature ?", "signé le 3 mars 2024")["temporal"] == 1 and of("date et heure ?", "le 3 mars 2024")["temporal"] == 0
    assert of("Qui est le vendeur ?", "Le vendeur : Monsieur Jean Dupont")["party"] == 1 and of("Qui est le vendeur ?", "Le vendeur paie")["party"] == 0
    assert of("Qui est Marie ?", "Marie Curie est là")["identity"] == 1
    assert of("plus de 3 ans", "au moins 3 ans")["constraint"] == 0.7 and of("plus de 3 ans", "plus de 3 ans")["constraint"] == 1.0
    assert of("Quelle est l'adresse mail ?", "écrire à a.b@c.fr")["contact"] == 1 and of("Quelle est l'adresse mail ?", "votre adresse mail")["contact"] == 0
    assert of("Jean Dupond habite Parris", "Jean Dupont vit à Paris")["names"] == 1.0
    assert 0 < of("remboursement des frais", "les frais remboursés")["stemmed"] and of("remboursment", "remboursement")["approximate"] > 0.9
    assert of("gaz naturel", "le gaz naturel")["phrase"] == 1 and of("gaz naturel", "naturel gaz")["phrase"] == 0
    assert of("garantie vol", "x", heading="Garantie vol")["heading"] == 1
    assert of("", "")["utility"] == 0 and R.features(None, None, None, None)["exact"] == 0
    assert R.duration_mentions("sous 2 mois (deux mois) puis un an et 10 jours ouvrés") == {"2 mois": "2 mois", "1 an": "un an", "10 jour": "10 jours ouvrés"}
    assert R.durations_asked("Quel délai pour payer, quel délai pour contester ?") == 2 and R.durations_asked("Quel est le prix ?") == 0


def test_refined_order_and_leaders(spark):
    rows = [(1, "Quel est le numéro de telephone ?", 1, "d", "", "rien du tout", 0.03, "words", 1), (1, "Quel est le numéro de telephone ?", 2, "d", "", "tel 01 23 45 67 89", 0.01, "vectors", 1),
            (1, "Quel est le numéro de telephone ?", 3, "d", "", "telephone numéro", 0.02, "words", 2), (2, "prix", 4, None, None, None, 0.01, "words", 1)]
    df = spark.createDataFrame(rows, "query_id long, query string, chunk_id long, document_name string, heading string, text string, score double, channel string, rank int")
    got = {r.chunk_id: r.place for r in refine.refined(df).collect()}
    assert got == {2: 1, 3: 2, 1: 3, 4: 1}
    assert refine.refined(df.limit(0)).count() == 0


def test_neighbours_follow_their_anchor(spark):
    ranked = spark.createDataFrame([(1, "q", 10, 1, 5, 1.0, 1), (1, "q", 30, 1, 9, 0.5, 2)], "query_id long, query string, chunk_id long, document_id long, seq long, score double, rank int")
    chunks = spark.createDataFrame([(9, 1, 4, "h", "good"), (11, 1, 6, "h", "bad"), (30, 1, 9, "h", "good"), (31, 1, 10, "h", "good"), (40, 2, 5, "h", "good")], "chunk_id long, document_id long, seq long, heading string, text string")
    utility = lambda q, h, t: F.when(t == "good", 0.5).otherwise(0.0)
    got = [(r.chunk_id, r.neighbour, r.score) for r in retrieval.with_neighbours(ranked, chunks, utility).orderBy("place").collect()]
    assert got == [(10, False, 1.0), (9, True, 0.46), (30, False, 0.5), (31, True, 0.235)]
    assert [r.chunk_id for r in retrieval.with_neighbours(ranked, chunks, utility, extra=0).orderBy("place").collect()] == [10, 30]


def test_one_pass_index_equals_two(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b c"), (4, "b c")], "id long, text string")
    terms = F.filter(F.split("text", " "), lambda t: t != "")
    index, size = retrieval.index(docs, "id", terms)
    assert sorted(map(tuple, index.select("id", "term", "tf", "len").collect())) == [(1, "a", 2, 3), (1, "b", 1, 3), (4, "b", 2, 2), (4, "c", 2, 2)]
    assert size.first().n == 5


def test_nearest_and_prototypes_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int").repartition(4)
    queries = df.filter("id < 6").select(F.col("id").alias("query_id"), "embedding")
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6)
    got = {}
    for r in retrieval.nearest(df, queries, "id", 5, most_queries=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    for q, v, _ in rows[:6]:
        want = sorted(((-dot(v, w), i) for i, w, _ in rows))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    made = {r.query_id: (r.label, r.score) for r in retrieval.prototypes(df, queries, "id", "label").collect()}
    for q, v, _ in rows[:6]:
        means = sorted((-round(sum(sorted((dot(v, w) for _, w, k in rows if k == label), reverse=True)[:2]) / 2 + 1e-9, 6), label) for label in range(3))
        assert made[q] == (means[0][1], -means[0][0])


def passages(*texts, page=1):
    return [extract.Passage(i + 1, "d", page, i + 1, 1.0, t) for i, t in enumerate(texts)]


def test_answer_shapes():
    p = passages("Option vol : non ajoutée\nOption bris : oui", "Nous vous recommandons l'option vol pour votre logement.")
    assert [places for _, places in extract.comparison("Y a-t-il une contradiction entre les options ?", p)] == [(1,), (1,), (2, 1)]
    assert extract.product_check("Calcule 12 mensualités de 25,50 €", passages("La prime annuelle est de 306,00 €"))[0][0].endswith("306")
    assert len(extract.obligations("Que dois-je faire en cas de sinistre ?", passages("Vous devez avertir l'assureur.", "Obligations : signaler le sinistre."))) == 2
    assert extract.labelled_number("Quel est le numéro de contrat ?", passages("Votre contrat n° 12 345 678 est actif")) == [("contrat 12345678", (1,))]
    assert extract.missing_attribute("Quel est le nom du cohabitant ?", passages("Cohabitant : oui"))[1] == ("name: not specified", ())
    assert len(extract.consequence("What happens if I do not pay?", passages("Not paying results in suspension of", "the contract."))) == 2
    assert extract.all_limits("Quels sont tous les montants ?", passages("A vol : 1 €\nB feu : 2 €\nC eau : 3 €")) is None
    assert len(extract.form_slots("Quelle est la surface du logement ? quel est le type de chauffage ?", passages("Surface du logement : 80 m\nType de chauffage : gaz\nAlarme : oui"))) == 2
    assert len(extract.rights("Quels sont mes droits ?", passages("- droit d'accéder à vos droits\n- droit de rectifier vos droits\n- droit de supprimer mes droits"))) == 3
    assert [f.line for f in extract.label_facts(passages("Vit avec :\nun conjoint", "Avez-vous une alarme ? oui", "Chien :", "Non, aucun"))] == ["Vit avec: un conjoint", "Avez-vous une alarme ?: oui", "Chien: Non"]
    assert all(shape("", []) is None for shape in extract.SHAPES)


def test_answers_by_question(spark):
    kind = "query_id long, question string, position int, document_id string, page int, seq int, score double, text string"
    rows = [(q, "Quels sont tous les montants ?", k, "d", 1, k, 1.0, f"Ligne {2 * k} : {q},00 €\nLigne {2 * k + 1} : 3,00 €") for q in range(30) for k in (1, 2)] + [(99, None, 1, None, None, None, None, None)]
    got = extract.answers(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 120 and {r["shape"] for r in got} == {"all_limits"} and {r.query_id for r in got} == set(range(30))
    assert extract.answers(spark.createDataFrame([], kind)).count() == 0


def test_grounding_of_dates_steps_and_chains(spark):
    u = grounding.unsupported
    assert u("le 3 mars 2024", ["03/03/2024"]) == [] and u("le 4 mars 2024", ["03/03/2024"]) == ["2024"]
    assert u("18.5", ["30 12"]) == ["18.5"] and u("écart : 18,5", ["30,5 12"]) == [] and u("écart : 19,5", ["30,5 12"]) == ["19.5"]
    assert u("12,5 + 30 + 7,5 = 50", ["12,5 30 7,5"]) == [] and u("12,5 + 30 + 7,5 = 51", ["12,5 30 7,5"]) == ["51"]
    assert u(None, None) == [] and u("vingt et 20", None) == [] and u("21", []) == ["21"]
    df = spark.createDataFrame([(1, "55 €", ["55"]), (2, "56 €", ["55"]), (3, None, None)], "answer_id long, answer string, evidence array<string>")
    assert [(r.grounded, r.text) for r in grounding.verdicts(df, "no").orderBy("answer_id").collect()] == [(True, "55 €"), (False, "no"), (True, None)]
    a = spark.createDataFrame([(1, "Le vol est couvert [2]. Le feu est exclu [9].", ["vol couvert par le contrat", "autre chose", "feu exclu du contrat"])], "answer_id long, answer string, evidence array<string>")
    assert [(r.marker, r.bound) for r in grounding.rebound(a).orderBy("place").collect()] == [(2, 1), (9, 3)]
    q = spark.createDataFrame([(1, "Quel est le prix ? quelle est la surface ?", "Le prix est 3"), (2, "Prix", "Le prix")], "answer_id long, question string, answer string")
    assert [(r.clauses, r.covered, r.complete) for r in grounding.completeness(q).orderBy("answer_id").collect()] == [(2, 1, False), (1, 1, True)]
    s = spark.createDataFrame([(1, k, "the same words over again. ") for k in range(9)] + [(2, 0, "fine")], "stream_id long, seq long, delta string")
    assert {r.stream_id: (r.looped, len(r.text)) for r in grounding.stopped_streams(s).collect()} == {1: (True, 81), 2: (False, 4)}


def hit(chunk, text, document="d", page=1, seq=None, score=1.0, rank=1, parent=False, question="q", structure=""):
    return packing.Hit(question, chunk, document, document, "", page, chunk if seq is None else seq, score, rank, parent, structure, text)


def packed(question, ranked, beside=(), **more):
    at = lambda hits: [packing.replace(h, question=question) for h in hits]
    return [(name, h.chunk) for name, h in packing.pack(question, at(ranked), at(beside), **more)]


def test_packing_families_and_bounds():
    q = "Quelle est l'adresse mail du service ?"
    got = packed(q, [hit(1, "l'adresse mail du service est donnée", rank=1), hit(2, "écrire à a.b@c.fr", score=0.1, rank=2), hit(3, "parent", rank=3, parent=True)])
    assert got[0] == ("contact", 2) and {c for _, c in got} == {1, 2}
    # Repeats within a document go, in another they stay; a place has its share; the budget skips and goes on.
    same = [hit(1, "mots très pareils du texte"), hit(2, "mots très pareils du texte", seq=9, rank=2, score=0.9), hit(3, "mots très pareils du texte", document="e", rank=3)]
    assert {c for _, c in packed("mots", same)} == {1, 3}
    many = [hit(i, f"unique{i} texte{i} parole{i}.", rank=i, score=1 / i) for i in range(1, 9)]
    assert len(packed("Quelle question ?", many)) == 4 and len(packed("expliquer", many)) == 6 and len(packed("Quelle question ?", many, top=2)) == 2
    sized = [hit(1, "a" * 900 + ".", page=1), hit(2, "b" * 900 + ".", page=2, rank=2, score=0.5), hit(3, "c.", page=3, rank=3, score=0.2)]
    assert [c for _, c in packed("x", sized, budget=1200)] == [1, 3]
    # The passage after one that is cut within a sentence comes along.
    cut = [hit(1, "la garantie vol couvre les biens qui sont", seq=4, question="garantie vol")]
    beside = [hit(2, "dans le logement assuré.", seq=5, rank=None, score=0.0), hit(9, "loin d'ici", seq=40, rank=None)]
    assert sorted(c for _, c in packed("garantie vol", cut, beside)) == [1, 2]
    first = [hit(1, "01/05/2024 et 01/06/2024", page=1), hit(2, "01/03/2024 et 01/04/2024", page=2, rank=2, score=0.2)]
    assert packed("Quelle est la première échéance ?", first)[0] == ("series", 2)
    assert packed("x", []) == []


def test_packed_evidence_rows(spark):
    kind = "query_id long, question string, chunk_id long, document_id long, document_name string, heading string, page int, seq int, score double, rank int, is_parent boolean, structure string, text string"
    rows = [(q, "garantie vol", 10 * q + k, q, "doc", None, k, k, 1.0 / k, k, False, None, f"garantie vol numéro {k} {q} mot{k}") for q in range(20) for k in range(1, 4)]
    rows += [rows[0], (50, None, 500, None, None, None, None, None, None, 1, None, None, None)]
    got = packing.packed_evidence(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.query_id, r.chunk_id) for r in got) == sorted({(r[0], r[2]) for r in rows})
    assert all(sorted(r.position for r in got if r.query_id == q) == [1, 2, 3] for q in range(20))
    assert packing.packed_evidence(spark.createDataFrame([], kind)).count() == 0


def test_answer_bearing_gate(spark):
    b = lambda q, *texts: gates.bears(q, [("doc", t) for t in texts])
    assert b("Quel est le prix de la maison ?", "Le bien est vendu 200 000 €") and not b("Quel est le prix de la maison ?", "Le chat dort")
    assert not b("Que dit FR-123 ?", "rien") and b("Que dit FR-123 ?", "le dossier FR-123 dit oui")
    assert not b("Quand expire le RAPO ?", "expire le 3 mars 2024") and b("Quand expire le RAPO ?", "le RAPO expire le 3 mars 2024")
    assert not b("Quand expire le contrat ?", "il expire") and b("Combien coûte la franchise du bris ?", "franchise bris de glace 100 €")
    assert not b("Quel est le numéro de telephone du service ?", "le telephone du service sonne") and b("Quel est le numéro de telephone du service ?", "Service, numero de telephone : 01 23 45 67 89")
    assert b("Qui est le vendeur ?", "Le vendeur : Monsieur Jean Dupont") and not b("Qui est le vendeur ?", "Le vendeur signe")
    assert not b("Quel est le numéro de passeport ?", "numero : 12345") and not b("x") and not b("Quoi ?")
    assert gates.person_of_role("Qui est le directeur de l'agence ?", "Agence de Lyon\nDirecteur\nJean Dupont") == "Jean Dupont"
    assert gates.person_of_role("Qui est le directeur ?", "Banque de France") is None
    got = gates.missing_duration("Quel délai pour payer, quel délai pour contester ?", "2 mois pour payer", passages("payer sous 2 mois", "contester sous 30 jours"))
    assert got == (2, "30 jours")
    rows = [(1, "Qui est le directeur ?", 1, "d", "Directeur : Jean Dupont"), (2, "Quel est le prix de la maison ?", 1, None, None), (3, None, 1, None, "x")]
    made = gates.answerable(spark.createDataFrame(rows, "query_id long, question string, position int, name string, text string")).collect()
    assert {r.query_id: (r.bears, r.person) for r in made} == {1: (True, "Jean Dupont"), 2: (False, None), 3: (False, None)}


def test_grammar_and_invariants(spark):
    rows = [("Yes it is [1].", 1), ("A [1][2].\nB [2].", 2), ("A [3].", 2), ("A.", 2), ("I can't tell.", 2), (None, 1), ("[1].", 1)]
    df = spark.createDataFrame(rows, "t string, n int").select(grounding.follows_grammar(F.col("t"), F.col("n"), "I can't tell.").alias("f"))
    assert [r.f for r in df.collect()] == [True, True, False, False, True, False, False]
    w = grounding.with_invariants
    assert w("Is it the same?", "Yes, the difference is 5 (10 - 15).") == "No, the difference is 5 (15 - 10)."
    assert w("Est-ce égal ?", "Oui, l'écart est de 0.") == "Oui, l'écart est de 0." and w(None, None) is None
    assert w("Est-ce cohérent ?", "Le tout est cohérent. Cependant une contradiction existe.").startswith("Le tout n'est pas cohérent")
    assert w("Quel est mon prix ?", "Mon prix est 3.</answer>") == "Votre prix est 3." and w("x", "<think>hm</think>ok\nInternal evidence facts: 1") == "ok"


def test_whole_path_from_question_to_evidence(spark):
    from foliospark.plans import compiler

    texts = ["La garantie vol couvre les bijoux jusqu'à 5 000 €.", "Le contrat est signé à Lyon.", "Pour le service client, écrire à aide@exemple.fr.", "L'adresse mail du service client figure ci-après."]
    chunks = spark.createDataFrame([(i, 1, i, "Titre", t) for i, t in enumerate(texts)], "chunk_id long, document_id long, seq int, heading string, text string")
    got = compiler.answer("Quelle est l'adresse mail du service client ?", chunks).orderBy("position").collect()
    assert (got[0].chunk_id, got[0].family) == (2, "contact") and {r.chunk_id for r in got} >= {2, 3}
