import base64
import hashlib
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlake.llm import bpe, mixing, tokenio, toxicity, urlfilter, wordpiece
from cohortlake.llm.queries import URL_RULES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", "a", " a", "a ", "  two  spaces \n\n x", "tab\t x\t", "don't I'll 's", "ünïcödé ßtraße 漢字 ½ ١٢", "<|endoftext|> x", " " * 300 + "x", "\n" * 200, "word " * 200, "ab" * 400, "x y \x1c z", "👩‍👩‍👧 ok", "one two " * 20 + "x" * 300 + " three four" * 20 + "\n" * 90 + "5" * 200 + "six seven\n" * 9 + "y" * 150]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(None, "null id", "c", 0), (7, TEXTS[7], "clash", 7), (99, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n long")


def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (64, 16), (20, 19), (7, 2)])
def test_bpe_equals_the_library(docs, library, chunk, overlap):
    found = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap, with_decoded=True).collect()
    wanted = [(r.doc_id, np.asarray(library.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect()]
    assert sorted(map(repr, [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found])) == sorted(map(repr, wanted))


def test_bpe_decodes(docs):
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert {bytes(r.decoded) for r in bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()} == {(r.text or "").encode() for r in docs.collect()}
    assert bpe.encode(empty(docs), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_takes_runs_that_overflow_the_library(spark):
    long = spark.createDataFrame([(1, " " * 200_000), (2, "a" * 200_000)], "doc_id long, text string")
    back = bpe.encode(long, RANKS, public_tokenizers.PATTERN, with_decoded=True).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {1: " " * 200_000, 2: "a" * 200_000}


@pytest.mark.parametrize("high", [1, 2, 100, 50_000, 2**40, 2**63])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5_000])
def test_simple8b_round_trip(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64)
    ids[: n // 3] = 0
    words, starts, places, escapes = tokenio.pack(ids)
    assert (tokenio.unpack(words, places, escapes) == ids).all() and len(starts) == -(-n // tokenio.BLOCK)
    for k, start in enumerate(starts):  # any block can be read on its own
        end = starts[k + 1] if k + 1 < len(starts) else len(words)
        block = ids[k * tokenio.BLOCK:(k + 1) * tokenio.BLOCK].copy()
        block[block >> np.uint64(60) > 0] = 0
        assert (tokenio.unpack(words[start:end]) == block).all()


@pytest.mark.parametrize("special_as_text", [False, True])
def test_token_files(spark, docs, tmp_path, monkeypatch, special_as_text):
    monkeypatch.setattr(tokenio, "PACKET_IDS", 150)  # several packets a shard
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(tokenizer)
    library.encode_special_tokens = special_as_text
    more = ["it.\nThen, <|endoftext|>x\n<|endoftext|>", "un.\n\nzwei &&& x's\ty's 'll", "é\nÉé,\n漢字.", "a\n\nb\n c \nd"]
    docs = docs.unionByName(spark.createDataFrame([(200 + i, t, None, None) for i, t in enumerate(more)], docs.schema))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards
    tokenio.write_ids(docs, str(tmp_path / "ids"), tokenizer, special_as_text=special_as_text)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = tokenio.read_ids(spark, str(tmp_path / "ids")).collect()
    assert len({r.shard for r in found}) > 1 and max(r.packet for r in found) > 0
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    start, wanted = 0, {}
    for (key, text), r in zip(rows, sorted(found, key=lambda r: (r.start)), strict=True):
        ids = np.asarray([*library.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert ((-1 if r.doc_id is None else r.doc_id), r.start, bytes(r.ids)) == (key, start, ids)
        wanted.setdefault(r.doc_id, []).append(ids)
        start += len(ids) // 4
    some = tokenio.read_ids(spark, str(tmp_path / "ids"), only=[7, 11, 203, 12345]).collect()
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in some) == sorted((r.doc_id, r.start, bytes(r.ids)) for r in found if r.doc_id in (7, 11, 203))
    tokenio.write_ids(empty(docs), str(tmp_path / "none"), tokenizer)
    assert tokenio.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_blocks_are_read_on_their_own():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 3_000, dtype=np.uint64)
    ids[::400] = 2**63
    packed = tokenio.pack(ids)
    for begin, end in ((0, 3_000), (0, 1), (255, 257), (512, 768), (2_999, 3_000), (700, 2_222), (5, 5)):
        assert (tokenio.unpack_part(*packed, 3_000, begin, end) == ids[begin:end]).all()


def greedy(word, begin, inside):
    n = at = 0
    if not any(word.startswith(p) for p in begin):
        return 0
    while at < len(word) or n == 0:
        best = max((len(p) for p in (inside if n else begin) if word.startswith(p, at)), default=None)
        if best is None or (n and not best):
            return 0
        at, n = at + best, n + 1
    return n


def test_longest_match_equals_greedy():
    random.seed(1)
    for _ in range(60):
        piece = lambda: "".join(random.choice("abc") for _ in range(random.randrange(1, 5)))
        begin, inside = {piece() for _ in range(6)} | ({""} if random.random() < 0.3 else set()), {piece() for _ in range(6)}
        match = wordpiece.LongestMatch(begin, inside)
        for _ in range(60):
            word = "".join(random.choice("abc") for _ in range(random.randrange(1, 12)))
            assert match.count(word) == greedy(word, begin, inside), (word, begin, inside)


def test_token_counts(docs):
    begin, inside = ["two", "a", "wor", "x"], ["d", "s", "paces"]
    found = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in wordpiece.count_tokens(docs, begin, inside).collect()}
    assert found[0] == (0, 0, 0) and found[99] == (0, 0, 0) and found[11] == (200, 400, 0) and found[4] == (3, 3, 1)
    assert wordpiece.count_tokens(empty(docs), begin, inside).count() == 0


def test_toxicity_learns_words_from_document_labels(spark):
    random.seed(2)
    calm = ["".join(random.choice("klmnop") for _ in range(5)) for _ in range(200)]
    sentence = lambda extra=(): " ".join([*random.choices(calm, k=8), *extra]).capitalize() + "."
    rows = [(i, " ".join([sentence() for _ in range(6)] + ([sentence(["vile"])] if i % 3 == 0 else []) + [sentence() for _ in range(3)]), int(i % 3 == 0)) for i in range(300)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(data.select("doc_id", "text"), data.filter("doc_id < 200").select("doc_id", "toxic"))
    extra = spark.createDataFrame([(1000, ""), (1001, None), (None, "A vile thing. Fine.")], "doc_id long, text string")
    scored = toxicity.score(data.select("doc_id", "text").unionAll(extra), model).collect()
    held = [r for r in scored if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in held) >= 97
    texts = {r[0]: r[1] for r in rows}
    assert all("vile" in texts[r.doc_id][s.begin:s.end] for r in held for s in r.sentences)
    assert [r.score for r in scored if r.doc_id in (1000, 1001)] == [0.0, 0.0] and [s for r in scored if r.doc_id is None for s in r.sentences]
    none = toxicity.fit(data.select("doc_id", "text"), data.limit(0).select("doc_id", "toxic"))
    assert not none.weights.any() and toxicity.score(data.limit(0), none).count() == 0
    of_one = toxicity.fit(data.select("doc_id", "text"), data.filter("toxic = 1").select("doc_id", "toxic"))
    assert {r.score for r in toxicity.score(data, of_one).collect()} == {0.0}


def test_toxicity_does_not_grow_with_length(spark):
    random.seed(6)
    calm = ["".join(random.choice("klmnop") for _ in range(5)) for _ in range(200)]
    sentence = lambda extra=(): " ".join([*random.choices(calm, k=8), *extra]) + "."
    rows = [(i, " ".join([sentence() for _ in range(8)] + ([sentence(["vile"])] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(300)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    long = "Quite plain. " * 20_000
    found = toxicity.score(spark.createDataFrame([(1, long), (2, long + "A vile thing."), (3, "A vile thing.")], "doc_id long, text string"), model).collect()
    scores = {r.doc_id: r.score for r in found}
    assert scores[1] == 0.0 and scores[2] == pytest.approx(scores[3], abs=1e-3) and scores[3] >= 0.5


def bags_of(rng, n_docs, n_features):
    """Bags with the sentences' features in a list beside them."""
    docs = [[sorted(set(rng.integers(0, n_features, rng.integers(1, 4)).tolist())) for _ in range(rng.integers(0, 5))] for _ in range(n_docs)]
    sentences = [(d, s) for d, doc in enumerate(docs) for s in doc]
    at = np.array([f for _, s in sentences for f in s], dtype=np.int64)
    bags = toxicity.Bags(rng.integers(0, 2, n_docs).astype(float), rng.integers(0, 4, n_docs).astype(float), np.array([d for d, _ in sentences], dtype=np.int64),
                         np.array([i for i, (_, s) in enumerate(sentences) for _ in s], dtype=np.int64), at)
    return bags, docs


def plain_loss(bags, docs, w, bias, decay):
    total, p = 0.0, lambda z: 1 / (1 + math.exp(-z))
    for y, plain, doc in zip(bags.y, bags.plain, docs, strict=True):
        off = (1 - p(bias)) ** plain * math.prod(1 - p(bias + sum(w[f] for f in s)) for s in doc)
        total -= math.log(max(1e-6, 1 - off)) if y else math.log(off)
    return total / len(docs) + decay * sum(x * x for x in w) / (2 * len(docs))


def test_toxicity_gradient_is_the_loss_s():
    """Against the loss written out sentence by sentence, and its differences."""
    rng = np.random.default_rng(4)
    for _ in range(5):
        bags, docs = bags_of(rng, 30, 8)
        w, bias, step = rng.normal(size=8), -1.0 + rng.normal() / 4, 1e-5
        loss, grad, bias_grad = toxicity.loss_and_gradient(bags, w, bias, 0.1)
        assert loss == pytest.approx(plain_loss(bags, docs, w, bias, 0.1))
        for i in range(8):
            moved = [w + step * s * (np.arange(8) == i) for s in (1, -1)]
            slope = (plain_loss(bags, docs, moved[0], bias, 0.1) - plain_loss(bags, docs, moved[1], bias, 0.1)) / (2 * step)
            assert grad[i] == pytest.approx(slope, rel=1e-4, abs=1e-6)
        assert bias_grad == pytest.approx((plain_loss(bags, docs, w, bias + step, 0.1) - plain_loss(bags, docs, w, bias - step, 0.1)) / (2 * step), rel=1e-4, abs=1e-6)


def test_toxicity_loss_falls():
    bags, _ = bags_of(np.random.default_rng(5), 80, 12)
    losses = []
    for rounds in (1, 20, 150):
        w, bias = toxicity.descend(bags, np.zeros(12), rounds=rounds, rate=0.1, decay=0.1)
        losses.append(toxicity.loss_and_gradient(bags, w, bias, 0.1)[0])
    assert losses[0] > losses[1] > losses[2]


def test_clean_evidence_is_of_documents_a_model_has_not_seen():
    bags, docs = bags_of(np.random.default_rng(6), 60, 6)
    options, w, all_of = {"rounds": 30, "rate": 0.1, "decay": 0.1}, np.zeros(6), []
    for k in range(toxicity.FOLDS):
        chosen = np.arange(60) % toxicity.FOLDS != k
        others = bags.only(chosen)
        assert len(others.y) == chosen.sum() and others.at.tolist() == [f for d in np.flatnonzero(chosen) for s in docs[d] for f in s]
        weights, bias = toxicity.descend(others, w, **options)
        for d in np.flatnonzero(~chosen & (bags.y == 0)):
            all_of += [max(0.0, math.log1p(math.exp(bias + sum(weights[f] for f in s))) - math.log1p(math.exp(bias))) for s in docs[d]] + [0.0] * int(bags.plain[d])
    assert toxicity.clean_evidence(bags, w, **options) == pytest.approx((np.mean(all_of), np.std(all_of)))


def test_urls(spark):
    rows = [(1, "http://A.Example.org/es/x"), (2, "https://example.org/en/1?q"), (3, "https://notexample.org/es/"), (4, "http://x.com/fr/#a"), (5, "http://x.com/de"), (6, "http://www.listed.net/p.html?x#y"),
            (7, "http://listed.net/p/"), (8, None), (9, "no scheme/org/"), (10, "http://other.net/"), (None, "http://x.com/de/1"), (7, "http://listed.net/p/"), (11, "http://example.org"), (12, "http://üÄ.net/p")]
    pages = spark.createDataFrame([(i, u, "host") for i, u in rows], "page_id long, url string, host string")
    listed = spark.createDataFrame([("listed.net/p",), (None,), ("listed.net/p",)], "u string")
    found = [((r.page_id or 0), r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, listed, URL_RULES).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/1", "example.org/en/1", "block"), (3, "notexample.org", "/es/", "org/", "allow"), (4, "x.com", "/fr/", "com/fr/", "allow"),
        (5, "x.com", "/de", None, "allow"), (6, "www.listed.net", "/p.html", None, "block"), (7, "listed.net", "/p/", None, "block"), (7, "listed.net", "/p/", None, "block"), (8, "", "", None, "allow"),
        (9, "", "", None, "allow"), (10, "other.net", "/", None, "allow"), (0, "x.com", "/de/1", "com/de/", "block"), (11, "example.org", "", None, "allow"), (12, "üÄ.net", "/p", None, "allow")]))
    assert urlfilter.judge(pages.limit(0), listed, URL_RULES).count() == 0
    host, path = urlfilter.split_url(F.col("link"))  # a column of any name
    assert [tuple(r) for r in spark.createDataFrame([("http://A.b/c?d",)], "link string").select(host, path).collect()] == [("a.b", "/c")]
    assert {r.verdict for r in urlfilter.judge(pages.filter("page_id IN (6, 7)"), listed.limit(0), URL_RULES).collect()} == {"allow"}


def test_mixing(spark):
    tokens = {"big": 1000, "small": 100, None: 50, "nothing": 0}
    at = mixing.solve(tokens, least_entropy=0.9 * math.log(3))
    assert 0 < at.exponent < 1 and mixing.entropy(at.weights) == pytest.approx(0.9 * math.log(3), abs=1e-6)
    limited = mixing.solve(tokens, most_epochs=2.0)
    assert max(limited.epochs.values()) == pytest.approx(2.0, abs=1e-6) and limited.epochs["big"] == pytest.approx(1.0)
    rows = [(i, "big" if i % 4 else None, "w " * (1 + i % 7), i) for i in range(2_000)] + [(5000, "big", None, 1), (None, "big", "one", 1), (7, "big", "w " * 1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, block long")
    mixed = mixing.mix(docs, least_entropy_share=0.99, budget_share=1.0).collect()
    assert len(mixed) == len(rows)
    total = sum(r.n_tokens for r in mixed)
    taken = {s: sum(r.n_tokens * r.copies for r in mixed if r.source == s) for s in ("big", None)}
    weights = mixing.solve({s: sum(r.n_tokens for r in mixed if r.source == s) for s in taken}, least_entropy=0.99 * math.log(2), budget=total).weights
    assert all(abs(taken[s] - weights[s] * total) <= 8 for s in taken)
    whole = mixing.mix(docs.drop("block"), most_epochs=1.5)
    assert mixing.realise(whole).columns == ["doc_id", "source", "text"]
    assert mixing.realise(whole).count() == sum(r.copies for r in whole.collect()) >= len(rows) and min(r.copies for r in whole.collect()) >= 1
    assert mixing.mix(docs.limit(0), most_epochs=1.5).count() == 0


def test_mixing_takes_sources_without_tokens(spark):
    rows = [(i, "full", "w " * 5) for i in range(40)] + [(100, "empty", ""), (101, "empty", None), (102, None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = {r.doc_id for r in mixing.realise(mixing.mix(docs, most_epochs=1.2)).collect()}
    assert taken == {r[0] for r in rows}
    assert mixing.realise(mixing.mix(docs.filter("doc_id >= 100"), most_epochs=1.2)).count() == 3


def test_held_out_rule(spark):
    from cohortlake.llm.queries import held_out

    rows = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
