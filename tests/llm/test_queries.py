"""Every contract column of the registered queries against brute force or DuckDB, on small tables."""

import base64
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlake.llm import queries, toxicity

ROWS = 60


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh é", k=rng.randrange(2, 9))).strip() or "x" for _ in range(400)]
    fresh = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + rng.choice([".", "!\n", " \n\n", "", ", "])
    passage = fresh(120)
    texts = [fresh(rng.randrange(5, 90)) + (passage if i % 7 == 0 else "") + (fresh(60) if i % 3 else "") for i in range(ROWS)]
    texts += [texts[3], texts[4] + " one more word.", passage, "", None, "<|endoftext|> x", "漢字 " * 150, "a" * 900, " \t\n ", "one two", fresh(15_000), "long" * 30_000]
    docs = [(i * 3, t, "en", rng.choice(["a", "b", None, "c"]), len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i * 3, 1, int(i % 7 == 0)) for i in range(ROWS)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    base = np.random.default_rng(1).normal(size=(150, 16))
    vectors = [*base.tolist(), *(base[:20] * 1.5 + 0.01).tolist(), None, [0.0] * 16, [1e-200] * 16, [1e200] + [0.0] * 15, [float("nan")] * 16, base[0].tolist(), base[0].tolist()]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    pages = [(i, f"http://{rng.choice(['a.org', 'example.org', 'www.x.com', 'y.net'])}/{rng.choice(['en/1', 'es/', 'fr/', 'de/', ''])}{i}", "h" * rng.choice([10, 2_000])) for i in range(50)] + [(None, None, None), (3, "none", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def little(ids):
    return np.asarray(ids, "<u4").tobytes()


def test_op1(spark, folder, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, folder).collect()}
    ids = {k: library.encode_ordinary(t) for k, t in texts.items()}
    assert found == {k: (len(ids[k]), hashlib.sha256(little(ids[k])).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, t in texts.items()}


def test_op6(spark, folder, texts):
    raw = {k: t.encode() for k, t in texts.items()}
    starts = {}
    for k, t in raw.items():
        for i in range(len(t) - 399):
            starts.setdefault(t[i:i + 400], []).append((k, i))
    gone = {k: bytearray(len(t)) for k, t in raw.items()}
    for places in starts.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i:i + 400] = b"\1" * 400
    wanted = {}
    for k, t in raw.items():
        kept = bytes(b for b, g in zip(t, gone[k]) if not g)
        runs = sum(1 for i, g in enumerate(gone[k]) if g and (i == 0 or not gone[k][i - 1]))
        wanted[k] = (len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_repeats(spark, folder).collect()}
    assert found == wanted and sum(w[1] for w in wanted.values()) > 0


def test_op8(spark, folder, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, wanted = 0, {}
    for k in sorted(texts):
        ids = [*library.encode(texts[k], add_special_tokens=False).ids, 0]
        wanted[k], start = (start, len(ids), zlib.crc32(little(ids))), start + len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_files(spark, folder).collect()} == wanted


def test_op3_scores_are_the_noisy_or_of_sentences(spark, folder, texts):
    rng = random.Random(1)
    weights = np.zeros(toxicity.BUCKETS)
    for word in {w for t in texts.values() for w in toxicity.WORD.findall(t.lower())}:
        if rng.random() < 0.2:
            weights[toxicity.bucket(word + ">")] = rng.uniform(-2, 4)
    bias, mean, deviation = -4.0, 0.001, 0.02
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.Model(weights, bias, mean, deviation)).collect()}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for k, t in texts.items():
        evidence, sentences = 0.0, toxicity.SENTENCE.findall(t.lower())
        for s in sentences:
            features = set().union(*(toxicity.features_of(w) for w in toxicity.WORD.findall(s)))
            z = max(-30.0, min(30.0, bias + sum(float(np.float32(weights[f])) for f in features)))
            evidence += max(0.0, math.log(1 - sigmoid(bias)) + math.log1p(math.exp(z)))
        evidence -= mean * len(sentences) + toxicity.DEVIATIONS * deviation * math.sqrt(len(sentences))
        assert found[k] == pytest.approx(1 - math.exp(-max(0.0, evidence)), abs=1e-6)
    rows = queries.op3_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows) and len(rows) == len(texts)


@pytest.mark.parametrize("name", ["op2_mixing", "op4_vector_near_dedup", "op5_url_filter", "op9_near_dedup", "op10_wordpiece_counts"])
def test_queries_equal_their_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    wanted = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    found = queries.QUERIES[name](spark, folder)
    assert set(found.columns) == set(columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_op7(spark, folder):
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding is not None}
    vectors = {k: v for k, v in vectors.items() if np.isfinite(v).all() and v.any()}
    found = {}
    for r in queries.op7_nearest_neighbours(spark, folder).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == {k for k in vectors if k % 20 == 0}
    hits = 0
    for q, ranked in found.items():
        assert sorted(ranked) == list(range(1, 21))
        best = sorted((k for k in vectors if k != q), key=lambda k: (-(vectors[k] @ vectors[q]), k))[:20]
        hits += len(set(best) & {k for k, _ in ranked.values()})
        assert all(score == pytest.approx(float(vectors[k] @ vectors[q]), rel=1e-12) for k, score in ranked.values())
    assert hits >= 0.9 * 20 * len(found)


def test_op7_by_windows(spark, tmp_path):
    """So many vectors that windows are widened, and not all rows are verified."""
    rng = np.random.default_rng(7)
    vectors = dict(enumerate(rng.normal(size=(1500, 12)) * rng.uniform(0.5, 1.5, (1500, 1))))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {}
    for r in queries.op7_nearest_neighbours(spark, str(tmp_path)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == {k for k in vectors if k % 20 == 0} and all(len(f) == 20 for f in found.values())
    best = {q: set(sorted((k for k in vectors if k != q), key=lambda k: (-(vectors[k] @ vectors[q]), k))[:20]) for q in found}
    assert sum(len(best[q] & found[q]) for q in found) >= 0.9 * 20 * len(found)


CLASHING = ["id", "key", "k", "t", "row", "n", "w", "a", "b", "l", "r", "f", "at", "score", "bucket", "block", "component", "words", "phrase", "spans", "near", "copies", "rank", "part", "hash", "shard", "ids", "n_tokens",
            "sentences", "canonical", "host", "path", "rule", "verdict", "code", "entity", "term", "kept", "starts", "place", "turn", "size", "center", "neighbour", "query_id"]


@pytest.fixture(scope="module")
def crowded(spark, folder, tmp_path_factory):
    """The same tables with many more columns, of names that operators could use."""
    path = str(tmp_path_factory.mktemp("crowded"))
    for table in ("documents", "embeddings", "pages", "labels"):
        df = spark.read.parquet(f"{folder}/{table}.parquet")
        df.select("*", *(F.lit("clash").alias(c) for c in CLASHING if c not in df.columns)).write.parquet(f"{path}/{table}.parquet")
    return path


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_further_columns_change_nothing(spark, folder, crowded, name):
    rows = [sorted(map(repr, queries.QUERIES[name](spark, path).collect())) for path in (folder, crowded)]
    assert rows[0] == rows[1] and rows[0]


def test_queries_of_empty_tables(spark, folder, tmp_path):
    for table in ("documents", "embeddings", "pages", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    for query in queries.QUERIES.values():
        assert query(spark, str(tmp_path)).collect() == []
