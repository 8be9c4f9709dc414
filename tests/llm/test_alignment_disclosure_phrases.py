"""Token alignment, disclosing words and collocations against brute force, and odd input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortlake.llm import align, disclosure, phrases, queries

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "a  b", "  x ", "\nThe a\n b", "x▁y z", "<|endoftext|> <s>", "漢字 𠮷.  x　y", "a" * 900, " \t\n ", "it's. 've x,y;z 1.2.3 a\r\nb\x1c \x85c", "ﬁ é é", "...,,. a. b", " .a", "\n\n.a\n.b \n c", "\x00a \x00", "long" * 5_000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghé", k=rng.randrange(2, 9))) for _ in range(300)]
    fresh = [" ".join(rng.choices(words, k=rng.randrange(1, 80))).capitalize() + rng.choice([".", "!\nAnd", "  x", ", y", ""]) for _ in range(60)]
    return dict(enumerate([*fresh, *fresh[:9], fresh[0], *ODD, *ODD]))


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in texts.items()], "doc_id long, text string, key string, copies int").repartition(3)


def alignment(texts):
    first, second = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    letters, linked = align.byte_of_letter(), {}
    for k, text in texts.items():
        if not text:
            continue
        a, b, raw = first.encode(" " + text, add_special_tokens=False), second.encode(text), (" " + text).encode()
        pieces = [second.id_to_piece(i) for i in b]
        sizes = [[len(bytes(letters[c] for c in x)) for x in a.tokens], [1 if re.fullmatch("<0x..>", p) else len(p.replace("▁", " ").encode()) for p in pieces]]
        if b"".join(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces) != raw:
            continue
        owner = [[i for i, n in enumerate(size) for _ in range(n)] for size in sizes]  # of each byte
        pairs = list(dict.fromkeys(zip(*owner)))
        cut = [i for i in range(len(raw)) if i + 1 == len(raw) or (owner[0][i] != owner[0][i + 1] and owner[1][i] != owner[1][i + 1])]
        groups, begin = [], 0
        for end in cut:
            groups.append("|".join(",".join(str(ids[j]) for j in dict.fromkeys(own[begin:end + 1])) for ids, own in ((a.ids, owner[0]), (b, owner[1]))))
            begin = end + 1
        linked[k] = len(a.ids), len(b), groups, [(a.ids[i], b[j]) for i, j in pairs]
    counts = Counter(p for x in linked.values() for p in set(x[3]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    rows = {k: (0, 0, 0, 0, 0, 0, "") for k in texts}
    for k, (n_a, n_b, groups, pairs) in linked.items():
        rows[k] = n_a, n_b, len(groups), len(pairs), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()
    return rows


@pytest.mark.parametrize("broadcast_pairs", [align.BROADCAST_PAIRS, 0])
def test_alignment_equals_bytes_one_by_one(spark, texts, broadcast_pairs):
    found = {r.doc_id: tuple(r)[1:8] for r in align.measure(docs(spark, texts), FIRST, SECOND, broadcast_pairs=broadcast_pairs).collect()}
    assert found == alignment(texts)


def test_alignment_with_a_small_cache_and_small_groups(texts, monkeypatch):
    with open(FIRST, "rb") as a, open(SECOND, "rb") as b:
        whole = align.Segments(a.read(), b.read(), True, None)
    some = [t for t in texts.values() if t]
    wanted = whole.measures(some)
    monkeypatch.setattr(align, "CACHE_SEGMENTS", 10)
    for i, text in enumerate(some):  # each after what is remembered was cleared
        sums, digests = whole.measures([text])
        assert sums[0].tolist() == wanted[0][i].tolist() and digests[0] == wanted[1][i]


def test_a_vocabulary_without_sure_cuts_is_asked_for_whole_texts():
    with open(FIRST, "rb") as a, open(SECOND, "rb") as b:
        aligner = align.Aligner(a.read(), b.read())
    cut, whole = aligner._cuts([]), aligner._cuts(["a▁b"])
    text = " one two, three\nfour"
    assert cut.findall(text) == [" one", " two", ",", " three", "\nfour"] and whole.findall(text) == [text]
    assert "".join(cut.findall("  a \n b,c  ")) == "  a \n b,c  "
    assert align.Aligner._cuts(aligner, ["a,"]).findall(text) == [" one", " two,", " three", "\nfour"]


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.measure(empty, FIRST, SECOND).collect() == []
    none = spark.createDataFrame([(None, None), (None, ""), (1, None)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in align.measure(none, FIRST, SECOND).collect()} == {(0, 0, 0, 0, 0, 0, "", 0)}


# --- personal data


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 14 <= len(digits) <= 19 and doubled % 10 == 0 or kind == "phone" and 10 <= len(digits) <= 15:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_forms_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a.b", "@", "x", ".", "-", "+1", "4111 1111-1111 1111", "255.1.1.", "300", "12", " ", "(", ")", "é", "0" * 3, "@c.d", "1.2.3.4", "9" * 20, "+", "_", "4539578763621486"]
    for _ in range(4_000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert [x[:3] for x in disclosure.personal_data(text)] == base_spans(text), text


def test_long_runs_take_no_longer():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" + " " * 300_000, "1." * 150_000, "a@b" * 100_000, "9 " * 150_000):
        assert all(x[1] == 1 for x in disclosure.personal_data(text))


def people(rng):
    """Documents in which words go with a mail address; nobody else has them."""
    rows = []
    for i in range(60):
        who = "abcdef"[i % 6]
        filler = " ".join(rng.choices(["alpha", "bravo", "charlie", "delta", "echo", "golf"], k=12))
        rows.append(f"{filler} Nickname{who} wrote to person{who}@mail.example.com about codeword{who} {filler}" if i % 2 else f"{filler} nothing here {filler}")
    return rows + [rows[1]] * 3 + ["Nicknameb alone", None, "", "é 4111 1111 1111 1111 card"]


def brute_disclosure(texts, least, share, reach):
    words = [{w for m in re.finditer(r"[^\W\d_]{3,}", t or "") for w in [m.group().lower()]} for t in texts]
    terms = [w | {x[:disclosure.STEM] + "*" for x in w if len(x) > disclosure.STEM} for w in words]
    near = []
    for t in texts:
        spans, own = disclosure.personal_data(t or ""), set()
        free = [m for m in re.finditer(r"[^\W\d_]{3,}", t or "") if not any(s < m.end() and m.start() < e for s, _, e, _ in spans)]
        for s, k, e, value in spans:
            before, behind = [m for m in free if m.start() < s][-reach:], [m for m in free if m.start() >= e][:reach]
            own |= {(f"{disclosure.KINDS[k]}:{value}", m.group().lower(), m.start(), m.end()) for m in before + behind}
        near.append(own)
    n, of_entity, of_both = len(texts), Counter(), Counter()
    for own in near:
        of_entity.update({x[0] for x in own})
        both = {x[:2] for x in own}
        of_both.update(both | {(e, w[:disclosure.STEM] + "*") for e, w in both if len(w) > disclosure.STEM})
    of_term = Counter(x for t in terms for x in t)
    tells = {(e, w) for (e, w), k in of_both.items() if k >= least and of_entity[e] < n and math.log(k * n / (of_entity[e] * of_term[w])) >= share * math.log(n / of_entity[e])}
    return [{(s, e) for c, w, s, e in own if (c, w) in tells} for own in near]


@pytest.mark.parametrize("share", [0.9, 0.4])
def test_disclosing_words_equal_brute_force(spark, share):
    texts = people(random.Random(8))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    found = {r.doc_id: r for r in disclosure.sanitise(df, share=share, reach=3, with_text=True).collect()}
    assert len(found) == len(texts)
    wanted = brute_disclosure(texts, 3, share, 3)
    for i, text in enumerate(texts):
        assert [(x.start, x.kind, x.end) for x in found[i].spans if x.kind < 4] == base_spans(text or "")
        assert {(x.start, x.end) for x in found[i].spans if x.kind == 4} == wanted[i]
        assert text is None and found[i].sanitised is None or "@" not in found[i].sanitised
    assert any(wanted) and "codewordb" not in found[1].sanitised and "<email>" in found[1].sanitised and found[len(texts) - 4].sanitised == "Nicknameb alone"
    assert found[0].spans == [] and found[0].sanitised == texts[0]


def test_words_are_generalised_where_that_tells_nothing(spark):
    texts = [f"planet{i} planned plant {'zebrafish' if i < 4 else 'zebra'} a@b.com" if i < 4 else f"plan{'abcdef'[i % 6]}bc and more zebras" for i in range(40)]
    found = {r.doc_id: r for r in disclosure.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_text=True).collect()}
    assert found[0].sanitised.endswith("zebr* <email>")


def test_disclosure_of_odd_tables(spark):
    assert disclosure.sanitise(spark.createDataFrame([], "doc_id long, text string"), with_text=True).collect() == []
    everywhere = spark.createDataFrame([(None, "word a@b.com word")] * 5, "doc_id string, text string")
    assert {tuple(x.kind for x in r.spans) for r in disclosure.sanitise(everywhere).collect()} == {(0,)}
    assert disclosure.replaced("abcdefgh", [{"start": 1, "end": 4, "put": "X"}, {"start": 2, "end": 6, "put": "Y"}]) == "aXgh"


# --- phrases


def brute_collocations(rows, longest, least, inside, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows = defaultdict(list)
    for (lang, p), a in candidates.items():
        held = max((b for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))), default=0)
        if not held or 100 * held < inside * a:
            score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, own in rows.items() for i, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1))


@pytest.mark.parametrize(("longest", "top"), [(2, 2000), (3, 7), (3, 2000), (4, 2000)])
def test_collocations_equal_brute_force(spark, longest, top):
    rng = random.Random(2)
    words = ["ab", "É", "Cd", "ef", "gh.", "ij,", "k\nl", "mno", "漢", "\t", "x" * 200]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(words, weights=range(11, 0, -1), k=rng.randrange(0, 60)))) for _ in range(120)] + [("en", None), ("fr", ""), ("de", "ab ab ab ab"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "lang string, text string, rank int, f string").repartition(3)
    found = phrases.collocations(df, longest=longest, least=10, inside_percent=50, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for _, t in found.dtypes} == {"string", "bigint"}
    wanted = brute_collocations(rows, longest, 10, 50, top)
    assert sorted(map(tuple, found.collect())) == wanted and len(wanted) > 10


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [(a, a + rng.randrange(9), a + rng.randrange(10**6)) for a in (rng.randrange(10, 10**15) for _ in range(200))]
    found = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases._score(*(phrases.F.col(c) for c in "alr"))).collect()
    assert all(s == 10**6 * a * a // (left * right) for a, left, right, s in found)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_digests_of_op12(spark, tmp_path):
    text = "call +1 (386) 555-3733 or 10.0.0.1, x.y@z.org 4111111111111111"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op12_disclosure(spark, str(tmp_path)).collect()}
    listed = ",".join(f"{list(FORMS)[k]}:{s}:{e}" for s, k, e in base_spans(text))
    assert tuple(found[1]) == (1, 1, 1, 1, 1, hashlib.sha256(listed.encode()).hexdigest(), listed)
    assert tuple(found[2]) == (2, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def test_counts_of_op12_by_kind(spark, tmp_path):
    rng = random.Random(6)
    parts = ["a.b@c.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (386) 555-3733", "é", "300.1.1.1", "x@y", "word"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(0, 12))) for _ in range(60)] + ["a@b.co c@d.co e@f.co", "10.0.0.1", "+1 386 555 3733", "é 4111111111111111", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op12_disclosure(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        spans = base_spans(text or "")
        listed = ",".join(f"{list(FORMS)[k]}:{s}:{e}" for s, k, e in spans)
        assert tuple(found[i])[:6] == (i, *(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest())
