import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import collision, graph, itq, minhash, repeats
from cohortlake.llm.stage import Scratch


def components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    random.seed(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(random.randrange(200, 300), random.randrange(200, 300)) for _ in range(60)]
    df = spark.createDataFrame([*links, (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in graph.components(df, Scratch(spark, "t"), "g").collect()}
    wanted = components({n for link in links for n in link}, links)
    assert found == {n: c for n, c in wanted.items() if any(n in link and link[0] != link[1] for link in links)}
    assert graph.components(df.limit(0), Scratch(spark, "t"), "g").count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 8)  # large buckets too
    monkeypatch.setattr(minhash, "BLOCK", 4)
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = random.choices(words, k=random.choice([8, 60, 200]))
        for _ in range(14):
            copy = [w if random.random() > random.choice([0, 0.005, 0.02]) else random.choice(words) for w in base]
            rows.append(" ".join(copy))
    rows += ["", None, "one", "ONE\t", "one two three", "One  two\nthree", "É é", rows[0], rows[0].upper(), " \x0b ", "x\x1cy"]
    data = [(i, t, "clash") for i, t in enumerate(rows)] + [(None, rows[0], "c"), (None, "alone here", "c"), (3, rows[3], "clash")]
    docs = spark.createDataFrame(data, "doc_id long, text string, kept string")
    sets = {i: shingle_set(t) for i, t in enumerate(rows)}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    wanted = components(sets, links)
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(data)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), wanted[r.doc_id], wanted[r.doc_id] == r.doc_id)
    assert {(r.component_id, r.kept) for r in found if r.doc_id is None} == {(wanted[0], False), (None, False)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def spans_of(texts, length):
    starts = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            starts.setdefault(t[i:i + length], []).append((k, i))
    marked = [set() for _ in texts]
    for places in starts.values():
        if len(places) > 1:
            for k, i in places:
                marked[k].update(range(i, i + length))
    return marked


@pytest.mark.parametrize("length, gram", [(20, 10), (30, 12), (12, 12), (60, 20), (60, 30)])
def test_repeats_equal_brute_force(spark, length, gram):
    random.seed(length)
    texts = ["".join(random.choice(["ab", "c", "dd", "é ", "fg"]) for _ in range(random.randrange(60))) for _ in range(50)]
    texts += [texts[3], texts[5] * 3, "a" * 100, "", "x" + "a" * 50, "ab" * 40, None, texts[3]]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = repeats.cut_spans(repeats.mark_repeats(docs.withColumn("at", F.monotonically_increasing_id()), length=length, gram=gram, carry=["spans"]).toDF("doc_id", "text", "spans", "carried")).collect()
    raw = [(t or "").encode() for t in texts]
    wanted = sorted(zip(raw, (bytes(b for i, b in enumerate(t) if i not in m) for t, m in zip(raw, spans_of(raw, length)))))
    assert sorted((bytes(r.text), bytes(r.kept)) for r in found) == wanted and {r.carried for r in found} == {"clash"}
    assert repeats.mark_repeats(docs.limit(0), length=length, gram=gram).count() == 0


def test_repeats_across_buffers(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PLACE_BITS", 9)
    monkeypatch.setattr(repeats, "BUFFER", 512)
    pieces = repeats.Pieces(40, 20)
    text = bytes(random.Random(1).choices(b"abcd", k=3_000))
    found = pieces.of([text, b"short", text[100:900]])
    covered = sorted(i for n, a, b in zip(found["text"], found["first"], found["last"]) if n == 0 for i in range(a, b + 1))
    assert covered == list(range(3_000 - 39))
    # windows hash alike wherever their body begins and whichever buffer they are in
    whole, part = pieces.bodies(text[:480], np.array([0]), np.array([440])), pieces.bodies(text[100:480], np.array([0]), np.array([340]))
    filler = [text[500 + 90 * i:580 + 90 * i] for i in range(9)]
    ask = lambda bodies, last, place: pieces.windows(bodies, *(np.array([x] + [0] * 9) for x in (0, 0, last, place)))
    row, start, hashes = ask([*whole[1], *filler], 440, 5)
    _, again, same = ask([*part[1], *filler], 340, -95)
    assert (hashes[100:441] == same[:341]).all() and (start[:441] == range(441)).all() and len(again) == 341 + 9 and (row[:441] == 0).all()


@pytest.mark.parametrize("read, length, gram", [(repeats.in_bytes, 100, 52), (repeats.in_words, 51, 26)])
def test_cells_of_repeats(read, length, gram):
    rng = random.Random(2)
    text = bytes(rng.choices(b"abcd", k=400)) if read is repeats.in_bytes else " ".join(rng.choices(["a", "bb", "ccc"], k=400)).encode()
    pieces, symbols = repeats.Pieces(length, gram, read), read(text)
    found = pieces.of([text])
    assert pieces.cell > 1
    at, bodies = pieces.bodies(text, found["first"], found["last"])
    cells = pieces.cells(bodies, np.array(at), found["first"], found["last"], found["place"])
    seen = {}
    for piece, cell, inner, outer, whole in zip(*(cells[c].tolist() for c in ("piece", "cell", "inner", "outer", "whole")), strict=True):
        place, near, far = int(found["place"][piece]), cell * pieces.cell, min(cell * pieces.cell + pieces.cell - 1, length - gram)
        assert whole == (place - far >= 0 and place - near + length <= len(symbols))
        strings = [(cell, tuple(symbols[place - near:place - far + length]))] + [(cell, tuple(symbols[place - far:place - near + length]))] * whole
        for string, value in zip(strings, (inner, outer)):  # a cell of one window has it in common and covers it
            assert seen.setdefault(string, value) == value
    assert len(set(seen.values())) == len(seen)


def test_whole_characters(spark):
    marked = spark.createDataFrame([(1, bytearray("aéb漢c".encode()), [(2, 3), (5, 6)])], "doc_id long, text binary, spans array<struct<begin:int,end:int>>")
    assert bytes(repeats.cut_spans(marked, whole_characters=True).first().kept).decode() == "abc"


def vectors_frame(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 16))
    near = [base[i % 8] + 0.05 * rng.normal(size=16) for i in range(60)]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near, base[1], 2 * base[1], base[2], -base[3]])]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [1.0, None] + [0.0] * 14), (n + 3, [float("nan")] * 16), (n + 4, [float("inf")] + [0.0] * 15), (n + 5, [1.0]), (n + 6, [])]
    return rows, spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<double>, label int, n_links string")


def usable(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_vector_links(spark):
    rows, df = vectors_frame(spark)
    found = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if usable(v)}
    links = [(a, b) for a, b in combinations(good, 2) if good[a] @ good[b] >= 0.95]
    wanted = components([i for i, _ in rows], links)
    total = sum(r.n_links for r in found.values())
    assert 0.9 * 2 * len(links) <= total <= 2 * len(links) and len(found) == len(rows)
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i, v in rows if not usable(v))
    assert sum(found[i].component_id == wanted[i] for i in wanted) >= 0.95 * len(wanted)
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_any_size(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate([(v, s) for s in (1.0, 1e-200, 1e200, 1e-310) for v in base])]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = itq.near_duplicates(df).collect()
    # each direction four times at least, whatever its length; rounding of the smallest may cost a link
    assert len(found) == len(rows) and {r.component_id for r in found} == set(range(40)) and all(3 <= r.n_links <= 6 for r in found)
    assert {(r.component_id, r.kept) for r in found if r.vec_id is None} == {(0, False)}
    nearest = collision.search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert len(nearest) == 5 * 8 and not any(np.isnan(r.score) for r in nearest)
    same = spark.createDataFrame([(i, [1.0 + i % 2] * 16) for i in range(60)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in collision.search(same, F.col("vec_id") == 0, k=3).orderBy("rank").collect()] == [1, 3, 5]
    assert {(r.component_id, r.n_links) for r in itq.near_duplicates(same).collect()} == {(0, 59)}


def test_recall_of_links_among_many_vectors():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(20_000, 64))
    away = rng.normal(size=(2_000, 64))
    one = v[:2_000] / np.linalg.norm(v[:2_000], axis=1, keepdims=True)
    away -= (away * one).sum(axis=1, keepdims=True) * one
    cosine = rng.uniform(0.95, 0.96, size=(2_000, 1))
    other = cosine * one + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    mean, rotation = itq.learn(v, 64, 5)
    width, tables, flips, distance = itq.plan(itq.differing(v, mean, rotation, 0.95), 64, 10_000_000)
    differ = ((one - mean) @ rotation >= 0) != ((other - mean) @ rotation >= 0)
    begins = [t // (64 // width) * 64 + t % (64 // width) * width for t in range(tables)]
    hit = np.min([differ[:, b:b + width].sum(axis=1) for b in begins], axis=0) <= flips
    assert (hit & (differ[:, :-(-tables // (64 // width)) * 64].sum(axis=1) <= distance)).mean() >= 0.97


def test_nearest(spark):
    rows, df = vectors_frame(spark)
    good = {i: np.array(v) for i, v in rows if usable(v)}
    found = {}
    for r in collision.search(df, F.col("vec_id") % 20 == 0, k=10).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in good if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(s - good[q] @ good[i]) < 1e-9 for _, i, s in got) and q not in [i for _, i, _ in got]
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        best = sorted((i for i in good if i != q), key=lambda i: (-(good[q] @ good[i]), i))[:10]
        hits += len(set(best) & {i for _, i, _ in got})
    assert hits >= 0.9 * 10 * len(found)
    assert collision.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_exact(spark):
    """With a share of 1, the result is that of brute force, whatever the lengths, and over several shards."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(9000, 8)) * rng.lognormal(sigma=0.7, size=(9000, 1))
    vectors[1::1000] = vectors[0]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {}
    for r in collision.search(df, F.col("vec_id") % 100 == 0, k=10, share=1).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.arange(len(vectors))
    assert set(found) == set(range(0, 9000, 100))
    for q, rows in found.items():
        scores = (vectors * vectors[q]).sum(axis=1)
        order = np.lexsort((ids, -scores))
        wanted = [i for i in order if i != q][:10]
        assert [i for i, _ in rows] == wanted and np.allclose([x for _, x in rows], scores[wanted], rtol=1e-12)
    with pytest.raises(ValueError, match="share"):
        collision.search(df, F.col("vec_id") == 0, share=0)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    random.seed(9)
    words = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = lambda n: " ".join(random.choices(words, k=n)) + "."
    passage = text(80)
    rows = [(i, text(60) + (" Vile stuff." if i % 5 == 0 else "")) for i in range(100)]
    rows += [(200, rows[1][1]), (201, rows[2][1].replace(rows[2][1].split()[30], "zz", 1)), (300, text(30) + passage + text(30)), (301, text(40) + passage + text(20)), (None, "no id here"), (400, ""), (401, None)]
    docs = spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        current = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "bpe" or current.columns == docs.columns
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in seen.items()}
    assert not any(i is not None and i < 100 and i % 5 == 0 for i in ids["toxicity"]) and len(ids["toxicity"]) == len(rows) - 20
    assert 200 not in ids["near_dedup"] and None in ids["near_dedup"] and len(ids["near_dedup"]) in (len(rows) - 21, len(rows) - 22)
    texts = {r.doc_id: r for r in seen["repeats"].collect()}
    assert len(texts) == len(ids["near_dedup"]) and passage[50:-50] not in texts[300].text + texts[301].text and texts[300].n_chars == len(texts[300].text)
    assert texts[3].text == rows[3][1]
    assert set(ids["mixing"]) == set(ids["near_dedup"]) and len(ids["bpe"]) == len(ids["mixing"])
    assert {r.n_tokens for r in seen["bpe"].filter("doc_id IN (400, 401)").collect()} == {0}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids["bpe"])


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    names = ["kept", "spans", "score", "sentences", "copies", "block", "n_tokens", "key", "part", "id", "starts", "a.b"]
    passage = fresh(70)
    rows = [(i, f"{fresh(20)}. {passage if i < 3 else fresh(40)}" + (" Vile stuff." if i % 5 == 0 else ""), "en", f"s{i % 2}", *(f"{n} {i}" for n in names)) for i in range(40)]
    columns = ["doc_id", "text", "lang", "source", *names]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in columns))  # no n_chars
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
    found = docs.collect()
    assert len(found) >= 20 and all(r[columns.index(n)] == f"{n} {r.doc_id}" for r in found for n in names)
    assert corpus_pipeline.encode(spark, docs, "").count() == len(found)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_drops_near_copies_of_80_percent(spark):
    import corpus_pipeline

    # one word changed inside 50: 46 shingles, of which 41 are shared; 41/51 = 0.804
    base = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:20], "x", *base[21:]])), (3, " ".join(f"v{i}" for i in range(50)))]
    assert 0.8 <= len(shingle_set(rows[0][1]) & shingle_set(rows[1][1])) / len(shingle_set(rows[0][1]) | shingle_set(rows[1][1])) < 0.85
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
    for percent in (50, 80, 85, 95):
        in_band = minhash.band_rows(percent)
        assert (1 - (percent / 100) ** in_band) ** (minhash.BINS // in_band) <= 3e-7
    assert minhash.band_rows(85) == 6


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    fresh = lambda n: " ".join(word() for _ in range(n))
    ordinary, short, fifty = fresh(51), " ".join(rng.choice("abcdefgh") for _ in range(51)), fresh(50)
    texts = [f"{fresh(30)} {p} {fresh(20)}" for p in (ordinary, short, fifty) for _ in range(2)] + [fresh(9) + " " + ordinary.replace(" ", "\n "), short, "é " * 50, "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    whole = [(t or "").split() for t in texts]
    seen = {}
    for i, t in enumerate(whole):
        for at in range(len(t) - 50):
            seen.setdefault(tuple(t[at:at + 51]), []).append((i, at))
    cut = {(i, at + k) for places in seen.values() if len(places) > 1 for i, at in places for k in range(51)}
    assert {i: t.split() for i, t in found.items()} == {i: [w for k, w in enumerate(t) if (i, k) not in cut] for i, t in enumerate(whole)}
    assert found[4] == texts[4] and len(found[0].split()) == 50 and found[7] == ""


@pytest.mark.parametrize("words", [3, 6])
def test_repeated_words_equal_brute_force(spark, words):
    rng = random.Random(words)
    texts = [" ".join(rng.choices(["a", "bb", "é", "ccc", "d"], k=rng.randrange(40))) for _ in range(30)] + ["a " * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = repeats.cut_spans(repeats.mark_repeats(docs, words=words)).collect()
    marked = spans_of([tuple(t.split()) for t in texts], words)
    assert {r.doc_id: bytes(r.kept).decode().split() for r in found} == {i: [w for k, w in enumerate(t.split()) if k not in marked[i]] for i, t in enumerate(texts)}


@pytest.mark.parametrize("norms", ["equal", "one of 3", "one of 10", "log-normal", "even"])
def test_nearest_with_uneven_norms(norms):
    rng = np.random.default_rng(3)
    n, k = 16_384, 20
    vectors = rng.normal(size=(n, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if norms.startswith("one"):
        vectors[7] *= float(norms.split()[-1])
    elif norms != "equal":
        vectors *= (rng.lognormal(size=n) if norms == "log-normal" else rng.uniform(0.2, 2, size=n))[:, None]
    asked, ids = np.arange(0, n, n // 40), np.arange(n)
    found = collision.nearest_of_shard(vectors, ids, ids, vectors[asked], asked, k)
    hits = 0
    for q, (rows, scores) in zip(asked, found, strict=True):
        exact = vectors @ vectors[q]
        exact[q] = -np.inf
        assert q not in rows and np.allclose(exact[rows], scores) and len(rows) == k
        hits += len(set(np.argsort(-exact)[:k]) & set(rows))
    assert hits >= 0.9 * k * len(asked)


@pytest.mark.parametrize("shift", [0, 1, 2])
def test_vector_links_of_shifted_vectors(spark, shift):
    rng = np.random.default_rng(shift)
    v = rng.normal(size=(1_500, 64)) / 8
    v[:, 0] += shift
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    away = rng.normal(size=(500, 64))
    away -= (away * v[:500]).sum(axis=1, keepdims=True) * v[:500]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.97, size=(500, 1))
    v = np.concatenate([v, cosine * v[:500] + np.sqrt(1 - cosine**2) * away])
    links = np.count_nonzero(np.triu(v @ v.T >= 0.95, 1))
    found = itq.near_duplicates(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")).collect()
    assert 0.97 * links <= sum(r.n_links for r in found) / 2 <= links
