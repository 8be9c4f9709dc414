"""Phrase collocations by top-order marginalisation.

Only windows of the longest order are counted: each word with those after it in its piece, padded at the piece's end.
A shorter phrase occurs as often as the windows that it begins, so ROLLUP over the words' columns gives the counts of
all orders at once, without an n-gram explosion for each.

Most windows occur once or twice, and a row for each would be many times as long as the text. So windows travel
together: those of a group of texts, counted, in one compressed row for each bucket, where a bucket has all windows of
its first two words. It adds them up and takes off the last words of those too rare to be a candidate; ROLLUP then sums
few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.stage import Scratch, give_back, tidied

#: Bytes of the texts whose windows are counted together.
GROUP_BYTES = 8 << 20
#: Parts in which a language's candidates are ranked before their best ones meet.
PARTS = 64
#: What a score is multiplied by before it is floored (fixed value).
SCALE = 1_000_000
# fixed values: what ends a piece; a point stands for all of them, and no word has one
PIECE_END = b".,;:!?\x0a\x0b\x0c\x0d"
PLAIN = bytes.maketrans(ascii_uppercase.encode() + PIECE_END, ascii_lowercase.encode() + b"." * len(PIECE_END))
#: Two odd numbers by which words' hashes are told apart by their places.
TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
CODEC = "zstd"


class Numbered(dict):
    """Words by numbers from 1 on; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def windows(texts: list[bytes], longest: int) -> tuple[list[bytes], list[np.ndarray]]:
    """The words, and for each of them in its piece a column for it and for each word after it; 0 where the piece has ended."""
    index = Numbered({b".": 0})
    words = b".".join(texts).translate(PLAIN).replace(b".", b" . ").split()
    columns = [np.fromiter(map(index.__getitem__, words), np.int64, len(words))]
    for k in range(1, longest):
        led = np.zeros(len(words), np.int64)
        led[:-k or None] = columns[0][k:]
        columns.append(np.where(columns[-1] > 0, led, 0))
    real = columns[0] > 0
    return list(index), [c[real] for c in columns]


def summed(columns: list[np.ndarray], *counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each row of the columns once, in their order, with the sums of its counts."""
    n = len(columns[0])
    base = 1 + max((int(c.max()) for c in columns if n), default=0)
    if base ** len(columns) < 1 << 63:
        key = columns[0]
        for c in columns[1:]:
            key = key * base + c
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
    else:
        order = np.lexsort(columns[::-1])
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([np.diff(c[order]) != 0 for c in columns])
    begins = np.flatnonzero(new)
    return [c[order[begins]] for c in columns], [np.add.reduceat(c[order], begins) if n else c for c in counts]


def bucket_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers of which each is dealt to another of n shuffle partitions, so that each holds one bucket."""
    dealt = spark.range(40 * n + 1_000).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("to")).agg(F.min("id").cast("int").alias("key"))
    keys = [r["key"] for r in dealt.orderBy("to").collect()]  # n rows
    if len(keys) != n:
        raise RuntimeError("some partition is dealt no number")
    return keys


def _bucket(lang: str, words: list[bytes], columns: list[np.ndarray], n_buckets: int) -> np.ndarray:
    """A bucket for each row by the language and the first two words."""
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = np.full(len(columns[0]), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for c, turn in zip(columns[:2], TURNS):
        mixed = (mixed ^ of_word[c]) * turn
        mixed ^= mixed >> np.uint64(31)
    return (mixed % np.uint64(n_buckets)).astype(np.int64)


PACKED = "bucket int, lang string, n_words int, words_size int, words binary, rows binary"


def _packed(lang: str, texts: list[bytes], longest: int, keys: list[int]) -> Iterator[tuple]:
    words, columns = windows(texts, longest)
    columns, (counts,) = summed(columns, np.ones(len(columns[0]), np.int64))
    bucket = _bucket(lang, words, columns, len(keys))
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        rows = order[i:j]
        used, at = np.unique(np.concatenate([[0], *(c[rows] for c in columns)]), return_inverse=True)
        text = b".".join([words[k] for k in used.tolist()[1:]])
        table = np.concatenate([at[1:], counts[rows]]).astype("<i4")  # a column after the other; rows are in their columns' order
        yield keys[bucket[rows[0]]], lang, j - i, len(text), pa.compress(text, CODEC, asbytes=True), pa.compress(table.tobytes(), CODEC, asbytes=True)


def pack(df: DataFrame, longest: int, keys: list[int], *, lang_col: str, text_col: str) -> DataFrame:
    """The counted windows of each group of texts of one language, a row for each bucket; keys are the buckets' names."""
    names, types = zip(*(c.split(" ") for c in PACKED.split(", ")), strict=True)
    arrow = [{"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t] for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                rows = list(_packed(lang, texts, longest, keys))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)], names=list(names))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= GROUP_BYTES:
                    yield from counted()
                    held, size = {}, 0
        yield from counted()

    rows = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")
    return rows.mapInArrow(tidied(run), PACKED)


def unpack(words_size: int, n_words: int, words: bytes, rows: bytes, longest: int) -> tuple[list[bytes], list[np.ndarray]]:
    """The words from number 1 on, and the columns with the counts behind them."""
    raw = np.frombuffer(pa.decompress(rows, decompressed_size=4 * (longest + 1) * n_words, codec=CODEC, asbytes=True), "<i4").astype(np.int64)
    return pa.decompress(words, decompressed_size=words_size, codec=CODEC, asbytes=True).split(b"."), list(raw.reshape(longest + 1, n_words))


def thinned(columns: list[np.ndarray], n: np.ndarray, least: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, counts) by the number of words left: a window without the last words that make it, or its first two, too rare.

    The columns hold all windows of their first two words. What is taken off a window stays in the sums of its prefixes.
    """
    left = total = n
    for k in range(len(columns), 1, -1):
        keeps = (total >= least) & (left > 0) & (columns[-1] > 0)
        yield [c[keeps] for c in columns], left[keeps]
        columns, (left, total) = summed(columns[:-1], np.where(keeps, 0, left), total)
    yield [c[left > 0] for c in columns], left[left > 0]


def count_bucket(table: pa.Table, longest: int, least: int) -> pa.Table:
    """The windows of one bucket, added up and thinned, as rows of words."""
    names = ["lang", *(f"w{k}" for k in range(1, longest + 1)), "n"]
    found = []
    for lang in table.column("lang").unique().to_pylist():
        own = table.filter(pa.compute.equal(table.column("lang"), lang)).to_pylist()
        index, parts = Numbered({b".": 0}), []
        for r in own:
            words, columns = unpack(r["words_size"], r["n_words"], r["words"], r["rows"], longest)
            number = np.fromiter(map(index.__getitem__, [b".", *words]), np.int64, len(words) + 1)
            parts.append([*(number[c] for c in columns[:-1]), columns[-1]])
        columns, (n,) = summed([np.concatenate(c) for c in zip(*(p[:-1] for p in parts))], np.concatenate([p[-1] for p in parts]))
        words = pa.array([None, *list(index)[1:]], pa.binary()).cast(pa.string())
        for kept, counts in thinned(columns, n, least):
            strings = [words.take(pa.array(c)) for c in kept] + [pa.nulls(len(counts), pa.string())] * (longest - len(kept))
            found.append(pa.table([pa.array([lang] * len(counts), pa.string()), *strings, pa.array(counts)], names=names))
    give_back()
    return pa.concat_tables(found)


def phrase_counts(df: DataFrame, longest: int, least: int, *, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, phrase, f) of all phrases that occur least times or more, and for words = 0 how many words a language has."""
    columns = [f"w{k}" for k in range(1, longest + 1)]
    keys = bucket_keys(df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = pack(df, longest, keys, lang_col=lang_col, text_col=text_col)
    schema = "lang string, " + ", ".join(f"{c} string" for c in columns) + ", n long"
    counted = packed.groupBy("bucket").applyInArrow(lambda table: count_bucket(table, longest, least), schema)
    summed_up = counted.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("set"))
    order = F.lit(None)
    for k in range(longest + 1):  # of k words: those behind are rolled up, and the last of them is no padding
        complete = (F.col("set") == (1 << (longest - k)) - 1) & (F.col("f") >= (least if k else 0))
        order = F.when(complete & F.col(columns[k - 1]).isNotNull() if k else complete, k).otherwise(order)
    return summed_up.withColumn("words", order).filter("words IS NOT NULL").select("lang", "words", F.concat_ws(" ", *columns).alias("phrase"), "f")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE a a / (left right)) in whole numbers of up to 38 digits: exact for counts below 10^16."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a * a, left * right)


def collocations(df: DataFrame, *, longest: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's top phrases of 2 to longest words that occur least times or more.

    A phrase scores by the cut of it that explains it best, the one of the lowest score; one that a longer candidate
    holds, and that occurs in such in inside_percent of its occurrences or more, is left out. Null texts count as
    empty and null languages as ``und``; each row of df counts, repeated ones too; other columns are ignored; an
    empty table gives no rows. A language with fewer than top phrases gives all.
    """
    counts = Scratch(df.sparkSession, "phrases").keep(phrase_counts(df, longest, least, lang_col=lang_col, text_col=text_col), "counts")
    parts = counts.filter("words > 0").select("lang", "phrase", "f")
    candidates = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    split = F.split("phrase", " ")  # words have no spaces
    cut = cut.withColumns({"first": F.array_join(F.slice(split, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(split, F.col("k") + 1, F.col("words")), " ")})
    cut = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cut.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(split, i, m), " "))))
    holding = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    holding = holding.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(holding, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
