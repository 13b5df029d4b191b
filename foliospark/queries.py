"""Named queries over the driver's tables: each applies operators of this library to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import features, noise, numbers, relevance, text
from foliospark.operators import evidence, extract, facts, grounding, layout, ledger, metrics, packing, refine, relational, retrieval, workspace
from foliospark.sources import parsers, storage
from foliospark.streaming import incremental


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixtures: the shapes that the operators need, derived from the driver's tables.


def invoices(spark, sf_dir) -> DataFrame:
    """One chunk of invoice text for each order: number, date, tax, total, and a second total where it is ambiguous."""
    o = table(spark, sf_dir, "orders")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    tax = F.floor(cents / 5).cast("long")
    money = lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))
    currency = F.when(F.col("o_orderkey") % 4 == 0, "USD").when(F.col("o_orderkey") % 4 == 1, "GBP").otherwise("EUR")
    again = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("\nNet à payer: "), money(cents + 100), F.lit(" "), currency)).otherwise(F.lit(""))
    body = F.concat(
        F.lit("Facture n° INV-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("\nDate: "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit("\nTVA: "), money(tax), F.lit(" "), currency, F.lit("\nTotal TTC: "), money(cents), F.lit(" "), currency, again,
    )
    return o.select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").alias("chunk_id"), body.alias("text"), cents.alias("cents"),
        tax.alias("tax"), currency.alias("currency_code"), F.lit(1).alias("page"),
    )


def lines(spark, sf_dir) -> DataFrame:
    """Line items, one for each order and line number: of several, the first in the order of the files and their rows.

    Rows that share both differ, so which one stays must not hang on partitions. SQL's DISTINCT ON keeps the same one where
    it reads in order: a table of one row group, or one thread.
    """
    li, key = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    # The place in one file is a number, so that the rows are hashed; a path and a number would have them sorted.
    at = F.col("_metadata.row_index") if len(li.inputFiles()) == 1 else F.struct("_metadata.file_path", "_metadata.row_index")
    return li.groupBy(*key).agg(*(F.min_by(c, at).alias(c) for c in li.columns if c not in key))


def schedules(spark, sf_dir) -> DataFrame:
    """One text for each order of line items as schedule rows: rank, date, quantity amount, a constant and a price."""
    li = lines(spark, sf_dir)
    money = lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))
    price, quantity = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long") % 99_999, (F.col("l_quantity") * 100).cast("long")
    line = F.concat_ws(
        " ", F.col("l_linenumber").cast("string"), F.date_format("l_shipdate", "dd.MM.yyyy"), money(quantity % 500), money(F.lit(6939).cast("long")), money(price)
    )
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("rows"))
    return rows.select(
        F.col("l_orderkey").alias("document_id"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text")
    )


def privacy_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    destination = F.when(F.col("event_type") == "view", "device").otherwise(F.col("event_type"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("chat_id"), destination.alias("destination"),
        F.floor("value").cast("long").alias("bytes_sent"), F.col("ts").alias("created_at"),
    )


def messages(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("seq"), "role", "text")


def questions(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), "text")


def corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# Audit ledger


def egress_summary(spark, sf_dir):
    return ledger.egress(privacy_events(spark, sf_dir))


def egress_week(spark, sf_dir):
    e = privacy_events(spark, sf_dir)
    newest = e.agg(F.max("created_at").alias("newest"))
    recent = e.join(F.broadcast(newest), F.col("created_at") >= F.col("newest") - F.expr("INTERVAL 7 DAYS")).drop("newest")
    return ledger.egress(recent)


def egress_cloud(spark, sf_dir):
    return ledger.cloud_egress(privacy_events(spark, sf_dir))


def egress_last_by_chat(spark, sf_dir):
    return ledger.last_egress(privacy_events(spark, sf_dir), "chat_id")


def quota_daily(spark, sf_dir):
    e = privacy_events(spark, sf_dir)
    return facts.quota(e, 3000, "chat_id", F.date_format("created_at", "yyyy-MM-dd"), F.col("bytes_sent"))


def library_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return relational.with_counts(docs, table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "uses")


def missing_runs_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    runs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.lit("v4").alias("extractor_version"))
    return ledger.missing_runs(docs, runs, "v4")


def versions_active(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    group = F.when(F.col("event_type") != "view", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    made = e.select(F.col("event_id").alias("id"), group.alias("version_group"), F.col("ts").alias("created_at"))
    return relational.active_versions(made).select("id", "version_group")


def documents_upserted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    change = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "blocked").alias("source"))
    return ledger.upserted(docs, change.dropDuplicates(["doc_id"]), ["doc_id"])


def documents_replaced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    change = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit("review").alias("source"))
    return ledger.replaced(docs, change, ["doc_id"])


def documents_deleted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return ledger.deleted({"documents": docs}, gone, "doc_id")["documents"]


# Joins and windows


def neighbors_radius1(spark, sf_dir):
    m = messages(spark, sf_dir)
    anchors = m.filter(F.col("role") == "user")
    return relational.neighbours(m, anchors, 1).select("document_id", "seq")


def nearest_anchor(spark, sf_dir):
    m = messages(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc(F.length("text")), "seq"))
    anchors = m.withColumn("rank", rank).filter("rank <= 2")
    return relational.nearest_anchor(m.select("document_id", "seq"), anchors, 2)


def _spans(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    start = (F.col("l_extendedprice").cast("long") % 1000).cast("int")
    return li.select(
        F.col("l_orderkey").alias("document_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit(None).cast("int").alias("page"),
        F.col("l_returnflag").alias("heading"), start.alias("char_start"), (start + F.col("l_quantity").cast("int") * 8).alias("char_end"), "l_linenumber",
    )


def interval_overlap_children(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return relational.overlapping(s.filter("l_linenumber = 1"), s.filter("l_linenumber > 1"))


def interval_union(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return relational.interval_union(s, ["document_id"], "char_start", "char_end")


def page_leads(spark, sf_dir):
    return relational.leads(messages(spark, sf_dir).select("document_id", "role", "seq"), ["document_id", "role"], ["seq"])


def facts_left_chunks(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber")


def egress_citations(spark, sf_dir):
    """Which documents' text left: events with citations (orders of the user) and chunks (line items), three-way, distinct."""
    e = privacy_events(spark, sf_dir).filter("destination <> 'device'")
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return (
        e.join(o, F.col("chat_id") == F.col("o_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("l_partkey", "destination").distinct()
    )


def scope_semi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return relational.semi(docs, table(spark, sf_dir, "labels").filter("quality = 1"), ["doc_id"])


def parent_promotion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    children = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("parent_chunk_id"), F.col("l_discount").alias("score"))
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_totalprice") % 1).alias("score"))
    made = relational.promoted(children, parents)
    return made.select("chunk_id", "parent_chunk_id", F.round("score", 6).alias("score"))


def page_enrichment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    hits = li.select(
        F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.col("l_discount").alias("score")
    )
    return relational.repeated_pages(hits)


def pages_full_outer(spark, sf_dir):
    """Native and OCR text of pages: the longer one wins, either may be missing."""
    m = messages(spark, sf_dir)
    side = lambda role, name: m.filter(F.col("role") == role).groupBy("document_id").agg(F.sum(F.length("text")).alias(name))
    both = side("user", "native").join(side("assistant", "ocr"), "document_id", "full")
    return both.withColumn("chosen", F.when(F.col("ocr") > F.coalesce("native", F.lit(0)), "ocr").otherwise("native"))


def document_leaders(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return relational.leads(e.select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), "event_id"])


def location_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return relational.capped(e.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc("value"), "event_id"], 4)


def interleave(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    number = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lists = li.select(F.col("l_suppkey").alias("query_id"), number.alias("list_no"), rank.alias("rank"), F.col("l_partkey").alias("chunk_id"))
    return relational.interleaved(lists)


def pair_windows(spark, sf_dir):
    """Adjacent sentences of a conversation as pairs."""
    w = Window.partitionBy("document_id").orderBy("seq")
    m = messages(spark, sf_dir)
    return m.select("document_id", "seq", F.lead("seq").over(w).alias("next_seq"), F.length(F.concat_ws(" ", "text", F.lead("text").over(w))).alias("pair_chars"))


# Text


def dedup_sha256(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def normalize_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("normalized"))


def language_detect(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.language(F.col("text")).alias("detected"))


def text_quality(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.text_quality(F.col("text")).alias("quality"))


def char_grams(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.array_join(text.character_grams(F.col("text")), " ").alias("grams"))


def identifiers(spark, sf_dir):
    return invoices(spark, sf_dir).select("document_id", F.array_join(text.identifiers(F.col("text")), ",").alias("found"))


def number_tokens(spark, sf_dir):
    return invoices(spark, sf_dir).select("document_id", F.array_join(numbers.canonical_numbers(F.col("text")), ",").alias("found"))


def html_lengths(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.sha2(text.html_text(F.col("html")), 256).alias("plain"))


def byte_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"))


def _part_tokens(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_brand", F.split(F.lower("p_name"), " ").alias("tokens"))


def overlap_near_dup(spark, sf_dir):
    """Names of a brand's parts that share half of the smaller one's words: names are too short for 0.85."""
    return evidence.near_duplicates(_part_tokens(spark, sf_dir), "p_brand", "p_partkey", "tokens", 0.5)


def overlap_members(spark, sf_dir):
    return evidence.set_members(_part_tokens(spark, sf_dir), "p_brand", "p_partkey", "tokens")


def overlap_documents(spark, sf_dir):
    """Whole documents of a source whose different words overlap by 0.85 or more, between representatives."""
    d = table(spark, sf_dir, "documents")
    return evidence.near_duplicates(d.select("doc_id", "source", F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+").alias("tokens")), "source", "doc_id", "tokens")


def repeated_lines(spark, sf_dir):
    lines = corpus(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return relational.repeated_share(lines, ["doc_id"], "line")


def token_df1(spark, sf_dir):
    """Tokens that one document's name has alone: customers' names and market segments as names of documents."""
    c = table(spark, sf_dir, "customer")
    names = c.select(F.col("c_custkey").alias("document_id"), F.concat_ws(" ", F.translate("c_name", "#", ""), "c_mktsegment").alias("name"))
    return relational.unique_tokens(names)


def referenced_documents(spark, sf_dir):
    """Documents that a question names by a token of theirs alone: one question for each order, which names its customer."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    names = c.select(F.col("c_custkey").alias("document_id"), F.concat_ws(" ", F.translate("c_name", "#", ""), "c_mktsegment", F.concat(F.lit("dossier"), F.col("c_custkey").cast("string"))).alias("name"))
    asked = o.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("Que dit le dossier"), F.col("o_custkey").cast("string"), F.lit(" du segment building ?")).alias("text"))
    return relational.referenced(asked, names)


def source_labels(spark, sf_dir):
    """Anonymous labels of a conversation's roles by first appearance."""
    m = messages(spark, sf_dir).groupBy("document_id", "role").agg(F.min("seq").alias("first"))
    w = Window.partitionBy("document_id").orderBy("first", "role")
    return m.select("document_id", "role", F.concat(F.lit("Document "), F.dense_rank().over(w).cast("string")).alias("label"))


def markdown_export(spark, sf_dir):
    m = messages(spark, sf_dir)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))), lambda r: F.concat(F.lit("**"), r["role"], F.lit("**\n\n"), r["text"])), "\n\n")
    return m.groupBy("document_id").agg(F.sha2(body, 256).alias("markdown"))


def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k string")["k"]
    return e.groupBy(k.alias("k")).agg(F.count("*").alias("events"))


# Search


def _words():
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "), lambda t: t != "")


def topk_bm25(spark, sf_dir, top: int = 10):
    index, size = retrieval.index(corpus(spark, sf_dir), "doc_id", _words())
    return retrieval.bm25(index, retrieval.query_terms(questions(spark, sf_dir), _words()), "doc_id", size, top)


def _grams():
    plain = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - 2, F.lit(1))), lambda i: F.substring(plain, i, F.lit(3)))


def topk_gram(spark, sf_dir, top: int = 10):
    """Names with their fourth letter mistyped, against all names; parts share names, so different names are compared."""
    c = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    mistyped = F.concat(F.substring("text", 1, 3), F.lit("x"), F.expr("substring(text, 5)"))
    q = c.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), mistyped.alias("text"))
    return retrieval.bm25_of_copies(c, q, "p_partkey", _grams(), top)


def topk_cosine(spark, sf_dir, top: int = 10):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(e, q, "vec_id", top)


def matryoshka(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cut = retrieval.truncated(F.col("embedding"), 16)
    return e.select("vec_id", F.round(F.get(cut, F.lit(0)), 6).alias("x0"), F.round(F.get(cut, F.lit(15)), 6).alias("x15"))


def _three_channels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("a"), F.round(F.sum("l_quantity"), 2).alias("b"), F.round(F.max("l_tax"), 4).alias("c")
    )
    out = []
    for score in "abc":
        rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc(score), "l_partkey"))
        out.append(li.select(F.col("l_suppkey").alias("query_id"), "l_partkey", rank.alias("rank")).filter("rank <= 60"))
    return out


def rrf_fusion(spark, sf_dir, top: int = 16):
    a, b, c = (retrieval.channel(x, "l_partkey") for x in _three_channels(spark, sf_dir))
    return retrieval.fused(a.unionByName(b).unionByName(c), "l_partkey", top)


def weighted_rrf(spark, sf_dir, top: int = 60):
    a, b, c = _three_channels(spark, sf_dir)
    lists = retrieval.channel(a, "l_partkey", 2.0).unionByName(retrieval.channel(b, "l_partkey")).unionByName(retrieval.channel(c, "l_partkey"))
    return retrieval.fused(lists, "l_partkey", top)


def prototype_classes(spark, sf_dir):
    """Label by the mean of the two nearest labelled vectors of each class, and its margin over the next."""
    e = table(spark, sf_dir, "embeddings")
    held = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.prototypes(e.filter("vec_id % 20 <> 0"), held, "vec_id", "label")


def hybrid_search(spark, sf_dir, top: int = 8):
    """Fusion of two channels, the best eight."""
    a, b, _ = _three_channels(spark, sf_dir)
    return retrieval.hybrid(a, b, "l_partkey", top)


def channel_ablation(spark, sf_dir, top: int = 16):
    a, b, c = _three_channels(spark, sf_dir)
    return retrieval.ablated({"a": a, "b": b, "c": c}, "l_partkey", top)


def _hits(spark, sf_dir, top: int = 3):
    """The best documents of each benchmark question, with both texts."""
    d = corpus(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("passage"))
    q = questions(spark, sf_dir).select("query_id", F.col("text").alias("query"))
    return topk_bm25(spark, sf_dir, top).join(q, "query_id").join(d, "doc_id")


def coverage_features(spark, sf_dir):
    """Word and bigram coverage of benchmark questions by the three documents that match them best, whole texts."""
    terms = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " "), lambda t: F.length(t) >= 3)
    pairs = lambda t: F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(t, i), x))
    hits = _hits(spark, sf_dir).withColumns({"q": terms(F.col("query")), "p": terms(F.col("passage"))})
    share = lambda a, b: F.round(features.share(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a))), 6)
    return hits.select(
        "query_id", "doc_id", F.round(features.weighted_share(F.col("q"), F.col("p")), 6).alias("coverage"),
        text.let(pairs(F.col("q")), lambda a: share(a, pairs(F.col("p")))).alias("bigrams"),
    )


def relevance_features(spark, sf_dir):
    """Every relevance feature of benchmark questions and the three documents that match them best."""
    made = _hits(spark, sf_dir).select("query_id", "doc_id", relevance.feature_columns(F.col("query"), F.lit(""), F.lit(""), F.col("passage")).alias("f"))
    return made.select("query_id", "doc_id", "f.*")


def refined_order(spark, sf_dir):
    """The refined order of the ten best documents of each question."""
    hits = _hits(spark, sf_dir, 10).select("query_id", "query", F.col("doc_id").alias("chunk_id"), F.lit("").alias("document_name"), F.lit("").alias("heading"),
                                           F.col("passage").alias("text"), "score", "rank", F.lit("words").alias("channel"))
    return refine.refined(hits).select("query_id", "chunk_id", "refined", "place")


def weak_matches(spark, sf_dir):
    made = rrf_fusion(spark, sf_dir)
    return retrieval.gate(made, 0.04)


# Facts


def money_facts(spark, sf_dir):
    return facts.records(invoices(spark, sf_dir)).select("document_id", "record_id", "record_date", "kind", "value_minor", "currency")


def _aggregate(operation, role="total_ttc", **scope):
    def query(spark, sf_dir):
        return facts.aggregate(facts.records(invoices(spark, sf_dir)), operation, role, **scope)

    return query


entry_invoice_total = _aggregate("sum")
money_aggregate_average = _aggregate("average")
money_aggregate_minimum = _aggregate("minimum")
money_aggregate_maximum = _aggregate("maximum")
money_aggregate_list = _aggregate("list")
money_aggregate_count = _aggregate("count")
money_aggregate_tax = _aggregate("sum", "tax")
record_temporal_filter = _aggregate("sum", "total_ttc", year=1995, month=3)


def money_ambiguous(spark, sf_dir):
    return facts.chosen_facts(facts.records(invoices(spark, sf_dir)), "total_ttc").filter("ambiguous").select("record_key")


def schedule_rows(spark, sf_dir):
    rows = facts.schedule(schedules(spark, sf_dir))
    return rows.select("document_id", "rank", "date", F.array_join("amounts", ",").alias("amounts"))


def installment_column(spark, sf_dir):
    return facts.installment_column(facts.schedule(schedules(spark, sf_dir), 3))


def typical_value(spark, sf_dir):
    li = lines(spark, sf_dir)
    return facts.typical_value(li.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", "l_linenumber", "l_returnflag")


def extreme_rows(spark, sf_dir):
    li = lines(spark, sf_dir)
    return facts.extreme_rows(li, "l_orderkey", "l_linenumber", "l_quantity")


def numeric_grounding(spark, sf_dir):
    """Answers with the right total for even orders, and one that is off for odd ones."""
    i = invoices(spark, sf_dir)
    stated = F.col("cents") + F.when(F.col("document_id") % 2 == 1, 12_345).otherwise(0)
    answer = F.concat(F.lit("The total is "), F.floor(stated / 100).cast("string"), F.lit(","), F.lpad((stated % 100).cast("string"), 2, "0"), F.lit(" "), "currency_code")
    return evidence.grounded(i.select(F.col("document_id").alias("answer_id"), answer.alias("answer"), F.col("text").alias("evidence"))).select(
        "answer_id", F.array_join("unsupported", ",").alias("unsupported"), "grounded"
    )


def decomposed_totals(spark, sf_dir):
    li = lines(spark, sf_dir)
    amounts = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("at"), F.col("l_quantity").cast("double").alias("value"))
    return evidence.decomposed_totals(amounts).select("page", "at", "value", F.size("parts").alias("n_parts"))


def period_change(spark, sf_dir):
    li = lines(spark, sf_dir)
    rows = li.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("label"),
        F.col("l_quantity").cast("double").alias("first"), (F.col("l_quantity") + F.col("l_linenumber")).cast("double").alias("second"),
    )
    return evidence.period_change(rows)


def identifier_conflicts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    claims = li.select(F.col("l_partkey").alias("identifier"), F.col("l_quantity").cast("long").alias("value"), (F.col("l_returnflag") == "A").alias("structural"))
    return evidence.context_conflicts(claims).select("identifier", F.array_join("values", ",").alias("values"))


# The workspace: conversations as chunked documents, orders and customers as chats and documents


def _chunked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(chunks, documents): turns as chunks of their conversation, every fifth a parent; not all documents are ready."""
    c = table(spark, sf_dir, "conversations")
    chunks = c.select(
        F.col("conv_id").alias("document_id"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("seq"),
        F.floor(F.col("turn") / 2).alias("page"), F.when(F.col("turn") % 5 == 4, -1).when(F.col("turn") % 5 == 3, F.col("turn")).alias("para_index"), "text",
    )
    ready = F.when(F.length(F.col("conv_id").cast("string")) % 2 == 1, "ready").otherwise("parsing")
    names = c.select("conv_id").distinct().select(F.col("conv_id").alias("document_id"), F.concat(F.lit("doc "), F.col("conv_id").cast("string")).alias("name"), ready.alias("status"))
    return chunks, names


def scoped_chunks(spark, sf_dir):
    chunks, documents = _chunked(spark, sf_dir)
    scope = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("document_id"))
    return workspace.scoped_chunks(chunks, documents, scope).select("document_id", "chunk_id", "document_name", "place")


def citable_page_firsts(spark, sf_dir):
    chunks, _ = _chunked(spark, sf_dir)
    return workspace.page_firsts(chunks).select("document_id", "page", "chunk_id")


def talk_messages(spark, sf_dir):
    """Messages that belong to the talk: event types stand for modes, null ones among them."""
    e = table(spark, sf_dir, "events")
    mode = F.when(F.col("event_type") == "view", "retrieval").when(F.col("event_type") == "click", F.lit(None).cast("string")).otherwise(F.col("event_type"))
    return e.withColumn("mode", mode).filter(workspace.answering()).select("event_id", "mode")


def settings_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.when(F.col("p_size") > 25, F.concat(F.lit("setting:"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("other:setting:"), F.col("p_partkey").cast("string")))
    return workspace.settings(p.select(key.alias("key"), F.col("p_brand").alias("value")))


def attached_documents(spark, sf_dir):
    """Customers as chats, orders as what is attached, nations as documents."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    chats = c.select(F.col("c_custkey").alias("chat_id"), F.col("c_name").alias("title"))
    documents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("document_id"), F.col("n_name").alias("name"))
    links = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("chat_id"), F.col("c_nationkey").alias("document_id"), (F.col("o_orderstatus") == "O").alias("enabled"))
    return workspace.attached(chats, links.distinct(), documents)


def library_detail(spark, sf_dir):
    """Suppliers as documents: chats of nations, egress by line items, versions by parts."""
    li = table(spark, sf_dir, "lineitem")
    documents = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"))
    of = lambda *more: li.select(F.col("l_suppkey").alias("document_id"), *more)
    egress = of(F.col("l_shipdate").alias("created_at"), F.when(F.col("l_returnflag") == "N", "device").otherwise(F.col("l_returnflag")).alias("destination"))
    made = workspace.document_detail(documents, of("l_orderkey").distinct(), egress, of("l_partkey").distinct())
    newest = F.get("sent", F.lit(0))
    return made.select("document_id", "chats", "versions", "n_sent", F.date_format(newest["created_at"], "yyyy-MM-dd").alias("last_sent"), newest["destination"].alias("destination"))


def merged_confidence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("ocr_confidence", F.when(F.col("l_linenumber") > 1, 1 - F.col("l_discount")))
    made = workspace.merged_confidence(li, ["l_orderkey"])
    return made.select("l_orderkey", F.round("ocr_confidence", 4).alias("ocr_confidence"), "blocks")


def evidence_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    made = workspace.evidence_text(F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_type")), F.col("p_name"))
    return p.select("p_partkey", made.alias("evidence"))


def method_summaries(spark, sf_dir):
    """Summaries as JSON and back."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("message_id"), F.col("o_orderstatus").alias("route"), (F.col("o_custkey") % 7).cast("int").alias("passages"), (F.col("o_orderkey") % 2 == 0).alias("cloud"))
    return workspace.decoded_methods(workspace.encoded_methods(rows))


def retrieval_payloads(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    hits = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    content = F.concat(F.lit('{"query":"order '), F.col("l_orderkey").cast("string"), F.lit('","hits":['), F.array_join(F.transform("parts", lambda x: F.concat(F.lit('{"chunkId":'), x.cast("string"), F.lit("}"))), ","), F.lit("]}"))
    rows = hits.select(F.col("l_orderkey").alias("message_id"), F.when(F.col("l_orderkey") % 3 == 0, "local").otherwise("retrieval").alias("mode"), content.alias("content"))
    made = workspace.retrieval_payload(rows)
    return made.select("message_id", "query", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"))


def universal_search(spark, sf_dir):
    """Suppliers as queries: line items as messages of chats (orders), parts as chunks."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    mode = F.when(F.col("l_returnflag") == "R", "retrieval").when(F.col("l_returnflag") == "A", "local")
    ranked = li.withColumns({"rank": F.row_number().over(w), "mode": mode})
    message = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), "l_linenumber")
    chats = ranked.select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("chat_id"), message.alias("message_id"), "mode", "rank")
    documents = ranked.select(F.col("l_suppkey").alias("query_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), "rank")
    return workspace.universal_search(chats, documents)


def repaired_views(spark, sf_dir):
    """Parts as chunks of documents named by brand; half of them name it already."""
    p = table(spark, sf_dir, "part")
    chunks = p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id"), F.col("p_name").alias("text"),
                      F.when(F.col("p_size") > 25, F.concat_ws(" ", F.upper("p_brand"), "p_name")).alias("search_text"))
    documents = p.select(F.col("p_brand").alias("document_id"), F.concat(F.lit(" "), F.col("p_brand")).alias("name")).distinct()
    return workspace.repaired_views(chunks, documents).select("chunk_id", "search_text")


def evidence_recall(spark, sf_dir):
    """Parts of an order's lines that were returned against all of them."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("document_id"), "l_returnflag")
    return metrics.evidence_recall(li, li.filter("l_returnflag <> 'N'"))


# Answers from evidence


def _forms(spark, sf_dir) -> DataFrame:
    """One passage for each order: its lines as labels and amounts."""
    li = lines(spark, sf_dir)
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    line = F.concat(F.lit("Position "), F.col("l_linenumber").cast("string"), F.lit(" : "), F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda r: r["line"]), "\n")
    return li.groupBy("l_orderkey").agg(body.alias("text")).select(
        F.col("l_orderkey").alias("query_id"), F.lit("What are all the amounts?").alias("question"), F.lit(1).alias("position"), F.col("l_orderkey").alias("document_id"),
        F.lit(1).alias("page"), F.lit(1).alias("seq"), F.lit(1.0).alias("score"), "text",
    )


def packed_evidence(spark, sf_dir):
    """The evidence of benchmark questions, of their ten best documents."""
    hits = _hits(spark, sf_dir, 10)
    rows = hits.select(
        "query_id", F.col("query").alias("question"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("document_name"),
        F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("seq"), "score", "rank", F.lit(False).alias("is_parent"),
        F.lit(None).cast("string").alias("structure"), F.col("passage").alias("text"),
    )
    return packing.packed_evidence(rows)


def markdown_router(spark, sf_dir):
    """Orders' lines as Markdown tables: returned lines end in a price, the others in words."""
    li = lines(spark, sf_dir)
    last = F.when(F.col("l_returnflag") == "R", F.concat(F.floor("l_extendedprice").cast("string"), F.lit(" EUR"))).otherwise("on request")
    row = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), last, F.lit(" |"))
    pages = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))), lambda r: r["row"]), "\n").alias("page"))
    return pages.select("l_orderkey", layout.prefers_markdown(F.col("page")).alias("as_table"))


def neighbour_lists(spark, sf_dir):
    """Turns by length as a channel's hits, with the turns before and after them whose length is even."""
    m = messages(spark, sf_dir).withColumn("chunk_id", F.col("document_id") * 1000 + F.col("seq"))
    w = Window.partitionBy("role").orderBy(F.desc(F.length("text")), "chunk_id")
    hits = m.withColumn("rank", F.row_number().over(w)).filter("rank <= 60")
    ranked = hits.select(F.col("role").alias("query_id"), F.lit("").alias("query"), "chunk_id", "document_id", "seq", (1.0 / (60 + F.col("rank"))).alias("score"), "rank")
    utility = lambda q, h, t: F.when(F.length(t) % 2 == 0, 0.5).otherwise(0.0)
    return retrieval.with_neighbours(ranked, m.select("chunk_id", "document_id", "seq", F.lit("").alias("heading"), "text"), utility)


def label_value_facts(spark, sf_dir):
    return extract.facts(_forms(spark, sf_dir)).select("query_id", "label", "value")


def extractive_answers(spark, sf_dir):
    made = extract.answers(_forms(spark, sf_dir))
    return made.select("query_id", "shape", "line", "text", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


def grounding_verdicts(spark, sf_dir):
    """Answers that show a subtraction, right for even orders and off for odd ones, and write the date another way."""
    o = table(spark, sf_dir, "orders")
    total = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long") % 29_999 + 70_000
    o = o.select(F.col("o_orderkey").alias("answer_id"), "o_orderdate", total.alias("total")).withColumn("tax", F.floor(F.col("total") / 5).cast("long"))
    money = lambda c, point: F.concat(F.floor(c / 100).cast("string"), F.lit(point), F.lpad((c % 100).cast("string"), 2, "0"))
    net = F.col("total") - F.col("tax") + F.when(F.col("answer_id") % 2 == 1, 37).otherwise(0)
    answer = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": "), money(F.col("total"), "."), F.lit(" - "), money(F.col("tax"), "."), F.lit(" = "), money(net, "."))
    passage = F.concat(F.lit("Date: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nTVA: "), money(F.col("tax"), ","), F.lit(" EUR\nTotal TTC: "), money(F.col("total"), ","), F.lit(" EUR"))
    made = grounding.verdicts(o.select("answer_id", answer.alias("answer"), F.array(passage).alias("evidence")), "I can't tell.")
    return made.select("answer_id", "grounded", F.size("unsupported").alias("n_unsupported"), (F.col("text") == "I can't tell.").alias("refused"))


def schedule_records(spark, sf_dir):
    """Instalments of orders' schedules; every text names the euro, and schedules of 12 rows or more are joined by customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey")
    texts = schedules(spark, sf_dir).withColumnRenamed("document_id", "order_id").join(o, "order_id")
    made = facts.schedule_records(texts.select(F.col("o_custkey").alias("document_id"), F.col("order_id").alias("chunk_id"), F.concat(F.lit("en euros\n"), "text").alias("text")))
    return made.groupBy("document_id").agg(F.count("*").alias("instalments"), F.min("value_minor").alias("least"), F.max("value_minor").alias("most"), F.min("record_date").alias("first_date"))


# Text, evidence and evaluation helpers over whole tables


def mistyped_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", noise.swapped(F.col("p_name")).alias("swapped"), noise.dropped(F.col("p_name")).alias("dropped"), noise.without_accents(F.col("p_type")).alias("plain"))


def identifier_agreement(spark, sf_dir):
    """Invoices asked for by their own number, by another one, and by none; every fifth text has no number."""
    i = invoices(spark, sf_dir)
    number = lambda k: F.concat(F.lit("INV-"), F.lpad(k.cast("string"), 8, "0"))
    k = F.col("document_id")
    query = F.when(k % 3 == 0, F.concat(F.lit("total of "), number(k))).when(k % 3 == 1, F.concat(F.lit("total of "), number(k + 1))).otherwise("total")
    passage = F.when(k % 5 == 0, "no number at all").otherwise(F.col("text"))
    return i.select("document_id", text.identifier_compatibility(query, passage).alias("compatibility"))


def ocr_triage(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", parsers.needs_ocr(F.col("p_size") / 50.0, (F.col("p_partkey") % 20) / 100.0).alias("needs_ocr"))


def file_formats(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ending = F.when(F.col("p_size") % 5 == 0, ".PDF").when(F.col("p_size") % 5 == 1, ".md").when(F.col("p_size") % 5 == 2, ".docx").when(F.col("p_size") % 5 == 3, ".txt").otherwise(".bin")
    return p.select("p_partkey", parsers.format_of(F.concat("p_name", ending), F.lit(None).cast("string")).alias("format"))


def context_fit(spark, sf_dir):
    """Turns that fit a context of 3,900 tokens, conversation by conversation."""
    m = messages(spark, sf_dir).select(F.col("document_id").alias("query_id"), F.col("seq").alias("position"), F.coalesce("text", F.lit("")).alias("text"))
    return evidence.fit_context(m).select("query_id", "position", "so_far")


def derived_values(spark, sf_dir):
    """Sums of two numbers of the evidence, half a unit off for odd lines."""
    li = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    a, b = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long") + 100
    value = (a + b).cast("double") + F.when(F.col("l_linenumber") % 2 == 1, 0.37).otherwise(0.0)
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("answer_id"), F.concat_ws(" and ", a.cast("string"), b.cast("string")).alias("evidence"), value.alias("value"))
    return evidence.derivable(rows).select("answer_id", "derived")


def citation_markers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    answer = F.when(F.col("o_orderkey") % 3 == 0, "no marker").otherwise(F.concat(F.lit("so [1] and [") , (F.col("o_custkey") % 5).cast("string"), F.lit("]")))
    made = evidence.valid_markers(o.select(F.col("o_orderkey").alias("answer_id"), answer.alias("answer"), F.lit(3).alias("n_evidence")))
    return made.select("answer_id", F.array_join(F.transform("markers", lambda m: m.cast("string")), ",").alias("markers"), "valid")


def answer_grammar(spark, sf_dir):
    """Refusals, answers with a marker, without one, and with one that there is no excerpt for."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 5
    answer = F.when(F.col("o_orderkey") % 4 == 0, "I can't tell.").when(F.col("o_orderkey") % 4 == 1, "no marker.").otherwise(F.concat(F.lit("so it is ["), k.cast("string"), F.lit("].")))
    return o.select(F.col("o_orderkey").alias("answer_id"), grounding.follows_grammar(answer, F.lit(3), "I can't tell.").alias("follows"))


def copied_passages(spark, sf_dir):
    """Whether one of a benchmark question's three best documents holds 18 words of it in a row."""
    pairs = _hits(spark, sf_dir).select(F.concat_ws("-", "query_id", "doc_id").alias("answer_id"), F.col("query").alias("answer"), F.col("passage").alias("evidence"))
    return evidence.copied(pairs)


def amount_terms(spark, sf_dir):
    """Amounts of a line and their closest terms: supplier and part stand at places of their own."""
    li = lines(spark, sf_dir)
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    priced = li.select(line.alias("line_id"), F.array(F.struct((F.col("l_suppkey") % 40).cast("int").alias("at"), F.col("l_quantity").cast("long").alias("value_minor"))).alias("amounts"))
    terms = li.select(line.alias("line_id"), F.lit("a").alias("term"), F.lit(10).alias("at")).unionByName(li.select(line.alias("line_id"), F.lit("b").alias("term"), F.lit(30).alias("at")))
    return facts.bound_amounts(priced, terms)


def aggregate_accuracy(spark, sf_dir):
    """Invoice totals as extracted against the orders they were made from; ambiguous invoices don't match."""
    i = invoices(spark, sf_dir)
    found = facts.chosen_facts(facts.records(i), "total_ttc").filter("value_minor IS NOT NULL")
    key = F.concat(F.col("document_id").cast("string"), F.lit(":id:INV-"), F.lpad(F.col("document_id").cast("string"), 8, "0"))
    wanted = i.select(key.alias("record_key"), F.col("cents").alias("value_minor"))
    return metrics.aggregate_match(wanted, found.select("record_key", "value_minor"), ["record_key"], "value_minor")


# Streams, run to their end


def _ran(stream: DataFrame, mode: str) -> DataFrame:
    """The result of a stream over all files that are there, written by each batch: all of it, or what it changed."""
    spark, path = stream.sparkSession, storage.scratch(stream.sparkSession, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    spark.createDataFrame([], stream.schema).write.parquet(path)
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", storage.scratch(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return e.select("user_id", F.floor("value").cast("long").alias("cost"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")


def stream_quota(spark, sf_dir):
    made = _ran(incremental.daily_quota(_event_stream(spark, sf_dir), 3000), "complete")
    return made.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "used", "remaining")


def stream_egress(spark, sf_dir):
    e = _event_stream(spark, sf_dir).select(F.col("event_type").alias("destination"), F.col("cost").alias("bytes_sent"), "ts")
    made = _ran(incremental.rolling_egress(e), "complete")
    return made.select(F.date_format("window.start", "yyyy-MM-dd").alias("first_day"), "destination", "requests", "bytes")


def stream_lifecycle(spark, sf_dir):
    """The furthest status of each user as a document: kinds of events stand for statuses."""
    e = _event_stream(spark, sf_dir)
    status = F.when(F.col("event_type") == "view", "received").when(F.col("event_type") == "click", "parsing").when(F.col("event_type") == "purchase", "embedding").otherwise("chunking")
    made = _ran(incremental.lifecycle(e.select(F.col("user_id").cast("string").alias("document_id"), status.alias("status"))), "update")
    order = F.array(*[F.lit(x) for x in ("received", "parsing", "chunking", "embedding", "ready", "error")])
    furthest = made.groupBy("document_id").agg(F.max(F.array_position(order, F.col("status"))).alias("n"))
    return furthest.select("document_id", F.get(order, (F.col("n") - 1).cast("int")).alias("status"))


# Evaluation


def retrieval_metrics(spark, sf_dir):
    """Nearest vectors judged by label; queries of label 0 count as unanswerable."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", (F.col("label") > 0).alias("answerable"))
    judged = topk_cosine(spark, sf_dir).select("query_id", "vec_id", "rank").join(e, "vec_id").select("query_id", "rank", F.col("label").alias("found"))
    wanted = e.groupBy("label").agg(F.count("*").alias("n_expected"))
    return metrics.judged_metrics(queries.join(wanted, "label"), judged.join(queries.select("query_id", "label"), "query_id").select("query_id", "rank", (F.col("found") == F.col("label")).alias("right")))


def wilson(spark, sf_dir):
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    made = l.groupBy("lang").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    return relational.wilson(made, "good", "n")


def hash_split(spark, sf_dir):
    return metrics.held_out(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def first_ranks(spark, sf_dir):
    near = topk_cosine(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    judged = near.filter("vec_id <> query_id").join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    ranks = judged.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("rank") - 1)).alias("first_rank"))
    return metrics.first_ranks(ranks)


def percentile_95(spark, sf_dir):
    return relational.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95, "p95")


# Time windows over event time (an extension)


def events_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events"))
    return made.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "events")


def events_session(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    gap = at - F.lag(at).over(w)
    marked = e.withColumn("starts", F.coalesce((gap > 1800).cast("int"), F.lit(1)))
    sessions = marked.withColumn("session", F.sum("starts").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("events"))
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


QUERIES = {
    f.__name__ if f.__name__ != "query" else name: f
    for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_") and name not in (
        "table", "invoices", "schedules", "privacy_events", "messages", "questions", "corpus"
    )
}
