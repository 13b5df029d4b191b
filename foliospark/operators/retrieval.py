"""Search channels over one corpus: words (BM25), character grams (BM25), vectors (exact cosine); their fusion.

Queries are rows. The statistics of a corpus are sums over postings; a query's words join postings by word, so the
work follows the matches, never queries times corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from foliospark.sources.storage import stored

RRF_K = 60


def postings(corpus: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf, len): one row for each different term of a row."""
    # The array is a column before it is exploded; else its size would be worked out from the text for every term.
    made = corpus.select(key, terms.alias("_terms"))
    exploded = made.select(key, F.size("_terms").alias("len"), F.explode("_terms").alias("term"))
    return exploded.groupBy(key, "term", "len").agg(F.count("*").alias("tf"))


def index(corpus: DataFrame, key: str, terms: Column) -> tuple[DataFrame, DataFrame]:
    """Postings and the corpus' size, of one pass over the texts: a row without terms has one of its own (term null).

    The postings are written to the session's shared folder, as they are read twice.
    """
    made = corpus.select(key, terms.alias("_terms"))
    each = made.select(key, F.size("_terms").alias("len"), F.explode_outer("_terms").alias("term"))
    counted = stored(each.groupBy(key, "term", "len").agg(F.count("*").alias("tf")), "postings")
    rows = counted.groupBy(key, "len").agg(F.sum("tf").alias("tf"))
    # A row that is repeated has its terms as often; its size is that of one.
    times = F.when(F.col("len") > 0, F.col("tf") / F.col("len")).otherwise(F.col("tf"))
    size = rows.agg(F.sum(times).cast("long").alias("n"), (F.sum(times * F.greatest("len", F.lit(0))) / F.sum(times)).alias("avg_len"))
    return counted.filter("term IS NOT NULL"), size


def bm25(index: DataFrame, queries: DataFrame, key: str, corpus_size: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, key, score, rank) of the OR of a query's terms; larger is better, ties by key.

    index: postings; queries: (query_id, term), different; corpus_size: one row of (n, avg_len). The inverse document
    frequency is ln((n - df + .5) / (df + .5)), 1e-6 where that isn't positive; k1 1.2 and b .75.
    """
    # Document frequencies of the queries' terms alone; the rest of the index is never grouped.
    wanted = index.join(queries.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    hits = wanted.join(df, "term").join(queries.select("query_id", "term"), "term").crossJoin(F.broadcast(corpus_size.limit(1)))
    return ranked(hits.groupBy("query_id", key).agg(_score().alias("score")), key, top)


def _score() -> Column:
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(F.lit(1e-6))
    gain = F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    return F.round(F.sum(idf * gain), 6)


def bm25_of_copies(corpus: DataFrame, queries: DataFrame, key: str, terms: Column, top: int) -> DataFrame:
    """``bm25`` of rows of (key, text) for rows of (query_id, text), where many texts are copies; exact, ties by key.

    Documents of the same texts have the same score and differ in their keys alone. So the different texts are indexed, with the
    number of their documents, different queries meet them, and of each text the ``top`` first keys are enough. What is shuffled
    follows the different texts that match, and the results. ``terms`` are made of the column ``text``.
    """
    # Rows that share a key are one document: its texts, each with the number of its rows.
    rows = corpus.groupBy(key, "text").agg(F.count("*").alias("times"))
    docs = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("text", "times"))).alias("texts"))
    last = F.asc_nulls_last(key)
    least = docs.withColumn("nth", F.row_number().over(Window.partitionBy("texts").orderBy(last))).filter(F.col("nth") <= top)
    # The first key stands for its text; a null key is a document too, the last one.
    firsts = least.groupBy("texts").agg(F.array_sort(F.collect_list(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key")))).alias("keys"))
    counted = docs.groupBy("texts").agg(F.count("*").alias("docs"))
    kinds = stored(counted.join(firsts, "texts").select("texts", "docs", "keys", F.get("keys", F.lit(0)).alias("kind")), "kinds")
    each = kinds.select("kind", "docs", F.explode("texts").alias("t")).select("kind", "docs", "t.times", F.col("t.text").alias("text"))
    made = each.select("kind", "docs", "times", terms.alias("_terms")).withColumn("len", F.size("_terms"))
    weight = F.col("docs") * F.col("times")
    size = made.agg(F.sum(weight).alias("n"), (F.sum(weight * F.greatest("len", F.lit(0))) / F.sum(weight)).alias("avg_len"))
    postings = made.select("kind", "docs", "times", "len", F.explode("_terms").alias("term")).groupBy("kind", "docs", "term", "len").agg(F.sum("times").alias("tf"))
    # Queries of the same texts, too, have the same results; the first one asks.
    asked = queries.groupBy("query_id").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    first = asked.groupBy("texts").agg(F.min(F.struct(F.col("query_id").isNull().alias("none"), "query_id")).alias("query"))
    words = first.select("query", F.explode("texts").alias("text")).select("query", F.explode(terms).alias("term")).distinct()
    df = postings.groupBy("term").agg(F.sum("docs").alias("df"))
    hits = postings.join(words, "term").join(df, "term").crossJoin(F.broadcast(size))
    scored = hits.groupBy("query", "kind").agg(_score().alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "kind")
    best = scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top)
    every = best.join(kinds.select("kind", "keys"), "kind").select("query", "score", F.explode("keys").alias("kind"))
    ranks = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    lists = ranks.groupBy("query").agg(F.collect_list(F.struct("kind.key", "score", "rank")).alias("found"))
    return asked.join(first.join(lists, "query"), "texts").select("query_id", F.explode("found").alias("f")).select("query_id", F.col("f.key").alias(key), "f.score", "f.rank")


def corpus_size(corpus: DataFrame, terms: Column) -> DataFrame:
    return corpus.agg(F.count("*").alias("n"), F.avg(F.size(terms)).alias("avg_len"))


def ranked(scored: DataFrame, key: str, top: int | None = None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("rank") <= top)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def truncated(vector: Column, size: int) -> Column:
    """The first ``size`` numbers, of length 1 again."""
    head = F.slice(vector, 1, size)
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(head, lambda x: x.cast("double") / norm)).otherwise(F.transform(head, lambda x: x.cast("double")))


def nearest(corpus: DataFrame, queries: DataFrame, key: str, top: int, most_queries: int = 10_000, also: str | None = None, each: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the ``top`` rows by dot product of unit vectors; exact, ties by key.

    Every stated query meets every row, so the queries are counted and sent to the corpus in blocks of ``most_queries``.
    A task multiplies a batch of rows with the block of queries and keeps each query's best so far, so what is shuffled
    and sorted is ``top`` rows for each query and task. ``also``: a column to keep, and with ``each``, the best ``each`` of
    every value of it instead of the best of all.
    """
    blocks = max(1, -(-queries.count() // most_queries))
    kept = each or top
    names = ["query_id", key, *([also] if also else [])]
    schema = T.StructType([queries.schema["query_id"], *(corpus.schema[c] for c in names[1:]), T.StructField("score", T.DoubleType())])
    rows = corpus.select(*names[1:], "embedding")
    out = None
    for k in range(blocks):
        block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        # At most ``most_queries`` vectors.
        sent = corpus.sparkSession.sparkContext.broadcast([(r.query_id, list(r.embedding)) for r in block.select("query_id", "embedding").collect()])
        made = rows.mapInArrow(_best_rows(sent, key, also if each else None, also, kept, to_arrow_schema(schema)), schema)
        out = made if out is None else out.unionByName(made)
    group = ["query_id", also] if each else ["query_id"]
    w = Window.partitionBy(*group).orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kept)


def _best_rows(sent, key: str, by: str | None, also: str | None, kept: int, schema):
    """Best rows of each query (and value of ``by``) among a task's rows, batch by batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids = [i for i, _ in sent.value]
        matrix = np.array([v for _, v in sent.value], dtype=np.float64)
        best: dict = {}

        def offer(slot, scores, keys, values):
            old = best.get(slot)
            if old is not None:
                scores, keys, values = np.r_[old[0], scores], [*old[1], *keys], [*old[2], *values]
            # By score, ties by key.
            order = sorted(range(len(keys)), key=lambda i: (-scores[i], keys[i]))[:kept]
            best[slot] = (scores[order], [keys[i] for i in order], [values[i] for i in order])

        for batch in batches:
            if not batch.num_rows or not ids:
                continue
            vectors = np.array(batch.column("embedding").to_pylist(), dtype=np.float64)
            keys = batch.column(key).to_pylist()
            values = batch.column(also).to_pylist() if also else [None] * len(keys)
            groups: dict = {}
            for i, v in enumerate(values):
                groups.setdefault(v if by else None, []).append(i)
            scores = np.round(matrix @ vectors.T, 6) + 0.0
            for v, at in groups.items():
                part = scores[:, at]
                least = np.partition(part, -min(kept, len(at)), axis=1)[:, -min(kept, len(at))]
                for q in range(len(ids)):
                    near = np.flatnonzero(part[q] >= least[q])  # with all ties of the last
                    offer((q, v), part[q][near], [keys[at[i]] for i in near], [values[at[i]] for i in near])
        for (q, _), (scores, keys, values) in best.items():
            columns = {"query_id": [ids[q]] * len(keys), key: keys, "score": scores.tolist()} | ({also: values} if also else {})
            yield pa.RecordBatch.from_pydict({c: columns[c] for c in schema.names}, schema=schema)

    return run


def prototypes(corpus: DataFrame, queries: DataFrame, key: str, label: str, each: int = 2) -> DataFrame:
    """(query_id, label, score, margin): the label by the mean of its ``each`` nearest vectors, and its lead over the next.

    Each task keeps the best of each label while it scores; no pair becomes a row.
    """
    near = nearest(corpus, queries, key, each, also=label, each=each)
    mean = near.groupBy("query_id", label).agg(F.round(F.avg("score") + 1e-9, 6).alias("score"))
    r = Window.partitionBy("query_id").orderBy(F.desc("score"), label)
    made = mean.withColumns({"n": F.row_number().over(r), "next": F.lead("score").over(r)}).filter("n = 1")
    return made.select("query_id", label, "score", F.round(F.col("score") - F.col("next"), 6).alias("margin"))


def hybrid(vectors: DataFrame, words: DataFrame, key: str, top: int = 8) -> DataFrame:
    """Reciprocal rank fusion of two channels of (query_id, key, rank), the best ``top``."""
    return fused(channel(vectors, key).unionByName(channel(words, key)), key, top)


def ablated(channels: dict[str, DataFrame], key: str, top: int = 16) -> DataFrame:
    """Fusion with all channels and with each left out: (without, query_id, key, score, rank); ``without`` is empty for all."""
    out = None
    for left_out in ("", *channels):
        parts = [channel(df, key) for name, df in channels.items() if name != left_out]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        made = fused(every, key, top).withColumn("without", F.lit(left_out))
        out = made if out is None else out.unionByName(made)
    return out


def with_neighbours(
    ranked_rows: DataFrame, chunks: DataFrame, utility, anchors: int = 48, most: int = 60, extra: int = 24
) -> DataFrame:
    """A channel's list with neighbours: (query_id, chunk_id, score, place, neighbour).

    The chunks before and after each of the first ``anchors`` hits follow it, if ``utility(query, heading, text)`` says
    they bear on the question: with 0.45 of the anchor's score and 0.02 of the utility. A chunk stands at its first
    place; ``most`` hits stay, and ``extra`` neighbours on top of them, so hits aren't pushed out.

    ranked_rows: query_id, query, chunk_id, document_id, seq, score, rank; chunks: chunk_id, document_id, seq, heading, text.
    """
    hits = ranked_rows.filter(F.col("rank") <= most).select("query_id", "chunk_id", "score", "rank", F.lit(-1.0).alias("order"), F.lit(False).alias("neighbour"))
    near = chunks.select(F.col("document_id").alias("d"), F.col("seq").alias("s"), F.col("chunk_id").alias("c"), "heading", "text")
    around = ranked_rows.filter((F.col("rank") <= anchors) & F.col("seq").isNotNull()).join(
        near, (F.col("document_id") == F.col("d")) & F.col("s").isin(F.col("seq") - 1, F.col("seq") + 1)
    )
    scored = around.withColumn("utility", utility(F.col("query"), F.col("heading"), F.col("text"))).filter("utility > 0")
    found = scored.select(
        "query_id", F.col("c").alias("chunk_id"), (F.col("score") * 0.45 + F.col("utility") * 0.02).alias("score"), "rank",
        (1 - F.col("utility")).alias("order"), F.lit(True).alias("neighbour"),
    )
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank", "order", "chunk_id")
    alone = hits.unionByName(found).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    among = Window.partitionBy("query_id", "neighbour").orderBy("rank", "order", "chunk_id")
    kept = alone.withColumn("_k", F.row_number().over(among)).filter(~F.col("neighbour") | (F.col("_k") <= extra)).drop("_k")
    place = Window.partitionBy("query_id").orderBy("rank", "order", "chunk_id")
    return kept.select("query_id", "chunk_id", F.round("score", 8).alias("score"), F.row_number().over(place).alias("place"), "neighbour")


def fused(channels: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, key, rank, weight): sum of weight / (60 + rank)."""
    score = F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 8)
    return ranked(channels.groupBy("query_id", key).agg(score.alias("score"), F.count("*").alias("channels")), key, top)


def channel(df: DataFrame, key: str, weight: float = 1.0) -> DataFrame:
    return df.select("query_id", key, "rank", F.lit(weight).alias("weight"))


def query_terms(queries: DataFrame, terms: Column) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms)).alias("term"))


def refined(candidates: DataFrame, weights: dict[str, float], compatibility: str, channel_bonus: float = 0.16, floor: float = 0.35) -> DataFrame:
    """Linear feature model over fused candidates: (score + sum of weight * feature) * compatibility.

    candidates: query_id, chunk_id, channel, score, the features and ``compatibility``. The best of each channel by its
    largest feature, if that is ``floor`` or more, gains ``channel_bonus`` times it. Ranked, ties by chunk.
    """
    utility = F.greatest(*[F.col(f) for f in weights]) if len(weights) > 1 else F.col(next(iter(weights)))
    linear = F.col("score")
    for f, w in weights.items():
        linear = linear + F.col(f) * w
    made = candidates.withColumn("refined", linear * F.col(compatibility)).withColumn("utility", utility)
    lead = Window.partitionBy("query_id", "channel").orderBy(F.desc("utility"), "chunk_id")
    first = (F.row_number().over(lead) == 1) & (F.col("utility") >= floor)
    made = made.withColumn("refined", F.round(F.col("refined") + F.when(first, channel_bonus * F.col("utility")).otherwise(0.0), 8))
    order = Window.partitionBy("query_id").orderBy(F.desc("refined"), "chunk_id")
    return made.withColumn("rank", F.row_number().over(order))


def gate(candidates: DataFrame, weakest: float = 0.018) -> DataFrame:
    """(query_id, best, weak): whether a query's best score is too low to answer from."""
    best = candidates.groupBy("query_id").agg(F.max("score").alias("best"))
    return best.withColumn("weak", F.col("best") < weakest)
