import random
import zlib

import numpy as np
import pytest

from foliospark.llm import sentencepieces, token_counts, token_store
from foliospark.llm.queries import tokenizer_file
from foliospark.llm.sentencepieces import Lattice, Transfer, best_states

PIECES = tokenizer_file("piece_bpe_32k.model")


def test_huffman_round_trip_and_limit():
    rng = np.random.default_rng(0)
    counts = np.zeros(3000, np.int64)
    counts[rng.permutation(3000)[:1500]] = (1.5 ** rng.integers(0, 60, 1500)).astype(np.int64) + 1
    for bits in (11, 12, 20):
        lengths = token_store.code_lengths(counts, bits)
        used = lengths[counts > 0].astype(float)
        assert used.max() <= bits and (lengths[counts == 0] == 0).all() and (2.0**-used).sum() <= 1
        ids = rng.choice(np.flatnonzero(counts), 20_011).astype(np.uint32)
        raw = token_store.pack([(4, 11), (None, 20_000)], ids, lengths, token_store.canonical_codes(lengths), 100)
        docs, back = token_store.unpack(raw, token_store.decode_table(lengths))
        assert docs == [(4, 11), (None, 20_000)] and (back == ids).all()
    with pytest.raises(ValueError):
        token_store.code_lengths(counts, 10)
    one = token_store.code_lengths(np.array([0, 0, 5]))
    assert token_store.unpack(token_store.pack([(1, 3)], np.array([2, 2, 2]), one, token_store.canonical_codes(one)), token_store.decode_table(one))[1].tolist() == [2, 2, 2]


def test_code_lengths_are_optimal_without_a_limit():
    import heapq

    counts = [5, 1, 9, 2, 2, 30, 7]
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((token_store.code_lengths(np.array(counts)) * np.array(counts)).sum()) == total


def test_store_equals_library(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    t.encode_special_tokens = True
    got = token_store.read_store(spark, token_store.write_store(odd_docs, tokenizer_file("word_bpe_49k.json"))).orderBy("start").collect()
    assert len(got) == odd_docs.count()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd_docs.collect()))
    assert sorted(((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got)) == want
    at = 0
    for r, before in zip(got, [None, *got]):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        assert before is None or (before.doc_id is None or (r.doc_id is not None and before.doc_id <= r.doc_id))
        at += r.n_tokens
    assert token_store.read_store(spark, token_store.write_store(no_docs, tokenizer_file("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("key, value", [("spark.sql.files.maxRecordsPerFile", "3"), ("spark.sql.files.maxPartitionBytes", "2000")])
def test_store_is_in_order_however_files_are_cut(spark, key, value):
    rows = [(i % 7 * 30 - i, f"some words {i} of a document " * (i % 5)) for i in range(200)] + [(3, "the same row")] * 40 + [(None, f"no id {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        got = token_store.read_store(spark, token_store.write_store(docs, tokenizer_file("word_bpe_49k.json"))).orderBy("start").collect()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    assert sorted(r.doc_id or -999 for r in got) == sorted(i or -999 for i, _ in rows)
    ids = [-1000 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_words_and_runs_equal_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    t.encode_special_tokens = True
    rng, encoder = random.Random(6), token_store.Encoder(tokenizer_file("word_bpe_49k.json"), 2)
    bits = ["The", "don't", "'s", "it's", "##", "1", "23", "_", "a_b", "É", "ß", "²", "été", " ", "  ", "\n", "\t", "tion", "x", ",", ".", "<|endoftext|>", "中", "\x1c", "İ", "\u2028", "\xa0"]
    for most in (100, 24):  # with and without characters that go to the library whole
        texts = ["".join(rng.choice(bits[:most]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
        assert got == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def chunks(lattice, text, size):
    n, pad = -(-len(text) // size), lattice.longest
    return [
        (text[max(0, k * size - pad) : (k + 1) * size + pad], k * size - max(0, k * size - pad), min(len(text), (k + 1) * size) - max(0, k * size - pad), k == 0, k == n - 1)
        for k in range(n)
    ]


def scanned(lattice, text, size):
    parts = chunks(lattice, text, size)
    transfers = [Transfer.unpacked(*Transfer.of(lattice.factors(*c)).packed()) for c in parts]
    states = best_states(transfers)
    if len(transfers) > 2:  # the same by a tree of products
        cut = len(transfers) // 2
        halves = []
        for part in (transfers[:cut], transfers[cut:]):
            whole = part[0]
            for t in part[1:]:
                whole = whole.then(t)
            halves.append(whole)
        middle, end = best_states(halves)
        tree = best_states(transfers[:cut], 0, middle) + best_states(transfers[cut:], middle, end)
        assert tree == states or not lattice.bpe
    return b"".join(lattice.trace(*c, a, b) for c, a, b in zip(parts, [0, *states[:-1]], states))


def test_bpe_equals_library_whole_and_in_chunks():
    import sentencepiece

    library, lattice, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), Lattice.load(PIECES), random.Random(3)
    bits = ["the ", "of", " ", "  ", "\n", "é", "中", "a", "in", "tion", "▁", "xq", "1", "😀", "    ", "aaaa", "\t", "."]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        want = library.encode(text)
        assert np.frombuffer(lattice.encode(text), "<u4").tolist() == want
        whole = lattice.normalised(text)
        if len(whole) > 16:
            assert np.frombuffer(scanned(lattice, whole, rng.choice([16, 17, 29])), "<u4").tolist() == want
        if "▁" not in text:
            assert lattice.decode(lattice.encode(text)) == text


def test_unigram_scan_equals_brute_force():
    rng = random.Random(4)
    pieces = {p: (i, -rng.random() * 5) for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb"])}
    lattice = Lattice(pieces, list(range(100, 356)), bpe=False, prefix=False)

    def best(text):
        score = [0.0] + [float("-inf")] * len(text)
        for e in range(1, len(text) + 1):
            score[e] = max(score[s] + pieces[text[s:e]][1] for s in range(max(0, e - 3), e) if text[s:e] in pieces)
        return score[-1]

    value = lambda ids: sum({i: s for i, s in pieces.values()}[k] for k in np.frombuffer(ids, "<u4").tolist())
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(4, 40)))
        assert abs(value(lattice.encode(text)) - best(text)) < 1e-9
        assert abs(value(scanned(lattice, text, rng.choice([3, 4, 7]))) - best(text)) < 1e-9


def test_encode_rows(odd_docs, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(zlib.crc32(np.array(library.encode(r.text or ""), dtype="<u4").tobytes()) for r in odd_docs.collect())
    for size in (64, 16_384):
        got = sentencepieces.digest(odd_docs, PIECES, size).collect()
        assert sorted(r.ids_crc32 for r in got) == want and all(r.round_trip for r in got)
    assert sentencepieces.digest(no_docs, PIECES).count() == 0


def test_scan_of_several_levels(spark, monkeypatch):
    """Chunks of 20 characters and 3 matrices a step: five levels and more, with copies and a text without meeting places."""
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(9)
    texts = ["".join(rng.choice(["the ", "of", "a", "    ", "é", "tion", "\n"]) for _ in range(n)) for n in (30, 700, 2500)] + ["a" * 3000, " " * 900]
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 3 + [(None, texts[2])], "doc_id long, text string")
    long = sentencepieces.keyed(docs)
    got = {r.text_hash: r.ids for r in sentencepieces._giants(long, PIECES, 20, 1000, fan=3).collect()}
    want = {r.text_hash: np.array(library.encode(r.text), "<u4").tobytes() for r in long.collect()}
    assert {k: bytes(v) for k, v in got.items()} == want
    assert sentencepieces._giants(long, PIECES, 20, 1000, fan=3).count() == 6


def test_token_histogram(spark, odd_docs, no_docs):
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    n = [r.n_tokens for r in token_counts.token_lengths(odd_docs, ranks).collect()]
    assert sorted(n) == sorted(len(library.encode(r.text or "", disallowed_special=())) for r in odd_docs.collect())
    sums = token_counts.suffix_sums(token_counts.token_lengths(odd_docs, ranks), block=8)
    for r in sums.collect():
        above = [x for x in n if x >= r.n_tokens]
        assert (r.n_docs, r.docs_from, r.tokens_from, r.docs_before) == (n.count(r.n_tokens), len(above), sum(above), len(n) - len(above))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
    assert token_counts.totals(sums).first() == (len(n), sum(n))
    assert {r.context: r.n_tokens for r in token_counts.truncated(sums, [0, 5, 9_999_999]).collect()} == {0: 0, 5: sum(min(x, 5) for x in n), 9_999_999: sum(n)}
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(x for x in n if sum(y <= x for y in n) >= r.fraction * len(n))
    assert token_counts.suffix_sums(token_counts.token_lengths(no_docs, ranks)).count() == 0
