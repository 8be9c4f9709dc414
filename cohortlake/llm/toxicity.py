"""Toxicity by multiple-instance learning: documents carry labels, sentences carry the cause.

A sentence's probability is a logistic model of its distinct hashed words and word beginnings; a
document's is the noisy-or of its sentences, ``1 - prod(1 - p)``. What a sentence without any telling
feature would have, the bias alone, is taken out of each p when documents are scored, and so is what as many
sentences of clean documents add up to, with DEVIATIONS standard deviations: otherwise a long enough text would be
toxic whatever it says. Both are measured on training documents that a model didn't see. The weights are fitted to the
document labels alone, on a bounded sample of labelled rows, and then point out the sentences that
made a document toxic. Features enter the fit if toxic documents have them more often than chance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.stage import Scratch, prepare, tidied

BUCKETS = 1 << 18
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
#: Of the sum over as many clean sentences, what is allowed above its mean.
DEVIATIONS = 2.0
#: Parts of the sample, each of which is measured by a model of the others.
FOLDS = 3
#: Entries of the per-worker cache of words' weights; it is emptied when full.
CACHE_ENTRIES = 200_000


def bucket(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def features_of(word: str) -> set[int]:
    """Buckets of a lower-cased word: the whole word, and its first 3, 4 and 5 letters."""
    return {bucket(word + ">"), *(bucket(word[:n]) for n in (3, 4, 5))}


def training_ids(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic", max_per_class: int = 4_000) -> DataFrame:
    """At most max_per_class labelled ids of each class, (id, label), in the order of a hash of the id.

    Ids and labels that are null are left out; an id labelled twice is toxic if any of its labels is.
    """
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    of = [one.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class) for y in (0, 1)]
    return of[0].unionAll(of[1])


@dataclass(frozen=True)
class Model:
    """Weights by bucket and the bias; of a clean sentence's evidence, ``-log(1 - p)``, the mean and the standard deviation."""

    weights: np.ndarray
    bias: float
    clean_mean: float = 0.0
    clean_deviation: float = 0.0

    def allowance(self, n_sentences: int) -> float:
        return self.clean_mean * n_sentences + DEVIATIONS * self.clean_deviation * math.sqrt(n_sentences)


@dataclass(frozen=True)
class Bags:
    """Documents as bags of sentences: labels, how many sentences lack any feature chosen, and of the others the document and the features."""

    y: np.ndarray
    plain: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    at: np.ndarray

    def only(self, chosen: np.ndarray) -> Bags:
        """The documents chosen."""
        number = np.cumsum(chosen) - 1
        sentences = chosen[self.doc]
        place, features = np.cumsum(sentences) - 1, sentences[self.sentence]
        return Bags(self.y[chosen], self.plain[chosen], number[self.doc[sentences]], place[self.sentence[features]], self.at[features])

    def evidence(self, w: np.ndarray, bias: float) -> np.ndarray:
        """-log(1 - p) of each sentence that has a feature, without what the bias alone gives, 0 at least."""
        z = np.bincount(self.sentence, w[self.at], len(self.doc)) + bias
        return np.maximum(0, np.logaddexp(0, z) - np.logaddexp(0, bias))


def loss_and_gradient(bags: Bags, w: np.ndarray, bias: float, decay: float) -> tuple[float, np.ndarray, float]:
    """The mean log loss of the documents' noisy-or with a penalty on w, and its gradients by w and by the bias."""
    z = np.clip(np.bincount(bags.sentence, w[bags.at], len(bags.doc)) + bias, -30, 30)
    p, p_plain = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-max(-30.0, min(30.0, bias))))  # the latter of a sentence without a feature
    kept = np.bincount(bags.doc, np.log1p(-p), len(bags.y)) + bags.plain * math.log1p(-p_plain)
    off = np.exp(kept)  # the chance that no sentence is toxic
    some = np.maximum(1 - off, 1e-6)
    loss = np.where(bags.y == 1, -np.log(some), -kept).mean() + decay * (w**2).sum() / (2 * len(bags.y))
    pull_doc = np.where(bags.y == 1, -off / some, 1.0) / len(bags.y)
    pull = pull_doc[bags.doc] * p
    return loss, np.bincount(bags.at, pull[bags.sentence], len(w)) + decay * w / len(bags.y), pull.sum() + (pull_doc * bags.plain).sum() * p_plain


def descend(bags: Bags, w: np.ndarray, *, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias after rounds of Adam on all bags, from w on."""
    bias = -math.log(max(2.0, 4 * (bags.plain.sum() + len(bags.doc)) / len(bags.y))) - 1
    mean, square, bias_mean, bias_square = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for k in range(1, rounds + 1):
        _, grad, bias_grad = loss_and_gradient(bags, w, bias, decay)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        bias_mean, bias_square = 0.9 * bias_mean + 0.1 * bias_grad, 0.99 * bias_square + 0.01 * bias_grad**2
        w = w - rate * mean / (1 - 0.9**k) / (np.sqrt(square / (1 - 0.99**k)) + 1e-7)
        bias -= rate * bias_mean / (1 - 0.9**k) / (math.sqrt(bias_square / (1 - 0.99**k)) + 1e-7)
    return w, bias


def clean_evidence(bags: Bags, w: np.ndarray, **options: float) -> tuple[float, float]:
    """Mean and standard deviation of a clean document's sentences' evidence, each document's by a model of the other folds."""
    fold, total, square, n = np.arange(len(bags.y)) % FOLDS, 0.0, 0.0, 0.0
    for k in range(FOLDS):
        others, own = bags.only(fold != k), bags.only((fold == k) & (bags.y == 0))
        if not len(own.y) or len(set(others.y.tolist())) < 2:
            continue
        evidence = own.evidence(*descend(others, w, **options))
        total, square, n = total + evidence.sum(), square + (evidence**2).sum(), n + len(evidence) + own.plain.sum()
    mean = total / n if n else 0.0
    return mean, math.sqrt(max(0.0, square / n - mean**2)) if n else 0.0


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_per_class: int = 4_000, least_z: float = 3.0, rounds: int = 150, rate: float = 0.1, decay: float = 0.1) -> Model:
    """A model of the labelled documents. Without a labelled document of either class, no text scores over 0.

    Of the sample (at most 2 * max_per_class documents, whole texts), the driver gathers the features
    chosen, and the sentences that have one of them.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen = F.broadcast(training_ids(labels, id_col=id_col, label_col=label_col, max_per_class=max_per_class))  # 2 * max_per_class rows at most
    sample = scratch.keep(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "text", "label"), "sample")

    def has(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cached, sums = lru_cache(100_000)(features_of), np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch["text"].fillna(""), batch["label"], strict=True):
                found = set().union(*map(cached, WORD.findall(text.lower())))
                sums[int(label > 0), list(found)] += 1
        used = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"feature": used, "clean": sums[0, used], "toxic": sums[1, used]})

    # documents of each class that have a feature; log odds over their standard error
    sizes = {bool(r["label"]): r["count"] for r in sample.groupBy(F.col("label") > 0).count().toDF("label", "count").collect()}
    n_clean, n_toxic = sizes.get(False, 0), sizes.get(True, 0)
    weights = np.zeros(BUCKETS)
    if not n_clean or not n_toxic:
        return Model(weights, 0.0)
    counts = sample.mapInPandas(has, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    telling = counts.select("feature", odds.alias("odds")).filter(F.col("odds") > least_z * error).orderBy("feature").toPandas()  # BUCKETS rows at most
    used, w = telling["feature"].to_numpy(dtype=np.int64), telling["odds"].to_numpy(dtype=float) / 2
    place = {f: i for i, f in enumerate(used.tolist())}

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cached = lru_cache(100_000)(lambda word: [place[f] for f in features_of(word) if f in place])
        for batch in batches:
            each = [[sorted({f for word in WORD.findall(s) for f in cached(word)}) for s in SENTENCE.findall(t.lower())] for t in batch["text"].fillna("")]
            yield pd.DataFrame({"label": batch["label"], "turn": [crc32(str(i).encode()) for i in batch["id"]], "plain": [sum(not s for s in doc) for doc in each],
                                "sizes": [[len(s) for s in doc if s] for doc in each], "features": [[f for s in doc for f in s] for doc in each]})

    data = sample.mapInPandas(sentences, "label int, turn long, plain int, sizes array<int>, features array<int>").orderBy("turn", "label", "plain", "sizes", "features").toPandas()
    lengths = np.concatenate([*data["sizes"].map(np.asarray), np.empty(0)]).astype(np.int64)
    bags = Bags((data["label"].to_numpy() > 0).astype(float), data["plain"].to_numpy(dtype=float), np.repeat(np.arange(len(data)), data["sizes"].map(len)),
                np.repeat(np.arange(len(lengths)), lengths), np.concatenate([*data["features"].map(np.asarray), np.empty(0)]).astype(np.int64))
    options = {"rounds": rounds, "rate": rate, "decay": decay}
    weights[used], bias = descend(bags, w, **options)
    return Model(weights, float(bias), *clean_evidence(bags, w, **options))


def score(docs: DataFrame, fitted: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: Sequence[str] = ()) -> DataFrame:
    """(id, score, sentences) for each row of docs: the noisy-or, and the sentences at or over the threshold.

    A sentence is (begin, end, probability) in characters of the text, the probability being what its
    features add to the bias: 0 without any, or where they speak against it. What as many clean sentences would add up
    to is taken off a text's evidence. Null and empty texts score 0.
    Null keys and repeated rows give a row each. The columns in ``carry`` follow; others are ignored.
    """
    prepare(docs.sparkSession)
    model, bias = docs.sparkSession.sparkContext.broadcast(fitted.weights.astype(np.float32)), fitted.bias  # BUCKETS floats
    allowance = Model(np.empty(0), bias, fitted.clean_mean, fitted.clean_deviation).allowance
    id_type = docs.schema[id_col].dataType.simpleString()
    found = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    # the text, if it is carried, is sent once
    places = [1 if c == text_col else 2 + i - (text_col in carry[:i]) for i, c in enumerate(carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = model.value

        class Weights(dict):
            def __missing__(self, word: str) -> tuple[tuple[int, float], ...]:
                value = tuple((f, float(of_bucket[f])) for f in features_of(word) if of_bucket[f])
                if len(self) >= CACHE_ENTRIES:
                    self.clear()
                self[word] = value
                return value

        weights_of = Weights().__getitem__
        plain = math.log1p(math.exp(max(-30.0, min(30.0, bias))))

        def probability(sentence: str) -> float:
            found = {pair for pairs in filter(None, map(weights_of, WORD.findall(sentence))) for pair in pairs}
            if not found:
                return 0.0
            z = bias + sum(value for _, value in sorted(found))
            # 1 - (1 - p) / (1 - p of the bias alone)
            return max(0.0, -math.expm1(plain - math.log1p(math.exp(max(-30.0, min(30.0, z))))))

        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                lower = (text or "").lower()
                each = [probability(s) for s in SENTENCE.findall(lower)]
                evidence = -sum(math.log1p(-p) for p in each if p)
                scores.append(-math.expm1(min(0.0, allowance(len(each)) - evidence)) + 0.0)
                hits = []
                if each and max(each) >= threshold:
                    # lower-casing can lengthen a text, so its places are looked up in the text itself
                    hits = [{"begin": m.start(), "end": m.end(), "probability": p} for m in SENTENCE.finditer(text) if (p := probability(m.group().lower())) >= threshold]
                spans.append(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, found), *(batch.column(i) for i in places)],
                                             names=["id", "score", "sentences", *(f"carried{i}" for i in range(len(carry)))])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carried{i}") for i, c in enumerate(carry) if c != text_col))
    carried = "".join(f", carried{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    scored = rows.mapInArrow(tidied(run), f"id {id_type}, score double, sentences array<struct<begin:int,end:int,probability:double>>{carried}")
    return scored.toDF(id_col, "score", "sentences", *carry)
