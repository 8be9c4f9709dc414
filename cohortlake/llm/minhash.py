"""Near-duplicate documents by one-permutation MinHash.

One hash of each shingle gives both its bin (the high bits) and its rank in the bin; an empty bin
copies the first filled bin of a fixed random order of bins, which is its own (optimal
densification). Bands of bins are the bucket keys. In a large bucket the members are compared with
one centre, a star, so that m members cost m - 1 comparisons; small buckets are compared whole.
Members that a star leaves in different components are compared with each other afterwards. A pair
is screened by two bits of each bin first; links are confirmed on the full shingle sets.

The bins of a band follow from the threshold: a pair at it shares no bucket with a chance of 3e-7 (32
bands of 6 for 0.85, 38 of 5 for 0.8), and the screen (5.5 standard deviations under the threshold)
loses it with about the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortlake.llm.graph import apart, components
from cohortlake.llm.stage import Scratch, tidied

BINS = 192
#: Chance that a pair at the threshold shares no bucket.
MISSED = 3e-7
#: Two bits of each bin, as longs.
LONGS = 2 * BINS // 64
#: Buckets up to this size are compared whole.
SMALL = 3
#: Documents of a block, where clusters are compared in blocks.
BLOCK = 512
SCREEN = 5.5
CACHE_ENTRIES = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a text of fewer words is one shingle.

    A-Z are lower-cased; words are runs without the six ASCII white space characters.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    at = len(words) - n + 1
    out = np.full(at, n, np.uint64)
    for i in range(n):
        out = out * _ODD + h[i:i + at]
    return np.unique(_mix(out))


def band_rows(percent: int) -> int:
    """The most bins of a band with which a pair at the threshold shares no bucket with a chance of MISSED at most."""
    return max([r for r in range(1, BINS + 1) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED], default=1)


class Sketcher:
    """Band keys of shingle sets, and two bits of each bin; bins left over by the bands only give bits."""

    def __init__(self, rows: int, seed: int = 1):
        self.rows, self.bands = rows, BINS // rows
        rng = np.random.default_rng(seed)
        self.orders = np.argsort(rng.random((BINS, BINS)), axis=1).astype(np.int16)
        self.band = _mix(np.arange(1, self.bands + 1, dtype=np.uint64) * _ODD)

    def of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = ((found >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)  # ascending, as the hashes are
        first = np.searchsorted(bins, np.arange(BINS, dtype=np.uint64))
        filled = (first < len(bins)) & (bins[np.minimum(first, len(bins) - 1)] == np.arange(BINS))
        values = found[np.minimum(first, len(bins) - 1)]
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.orders[empty]
            values[empty] = values[order[np.arange(len(empty)), np.argmax(filled[order], axis=1)]]
        key = self.band.copy()
        for column in values[:self.bands * self.rows].reshape(self.bands, self.rows).T:
            key = _mix(key * _ODD + column)
        bits = np.concatenate([values & np.uint64(1), values >> np.uint64(1) & np.uint64(1)]).astype(np.uint8)
        return key.view(np.int64), np.packbits(bits).view("<i8")


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """(id, n, k1, k2, bands, bits): the size of each row's shingle set, a 128-bit key of the set, its bucket keys and screening bits (none for an empty set)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    in_band = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketcher = _WordHashes(), Sketcher(in_band)
        none = np.empty(0, np.int64)

        def lists(arrays: list[np.ndarray]) -> pa.Array:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, none])))

        for batch in batches:
            found = [shingles(text or b"", width, hashes) for text in batch.column(1).to_pylist()]
            k = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in found), "<i8").reshape(-1, 2)
            sketches = [sketcher.of(x) if len(x) else (none, none) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), lists([b for b, _ in sketches]), lists([b for _, b in sketches])],
                names=["id", "n", "k1", "k2", "bands", "bits"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(tidied(run), f"id {id_type}, n long, k1 long, k2 long, bands array<long>, bits array<long>")


def full_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, shingles): the sorted hashes as binary, little-endian unsigned 64-bit."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            found = [shingles(t or b"", width, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(tidied(run), f"id {id_type}, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union holds on the full sets."""
    one = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    other = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    both = pairs.join(one, "b").join(other, "a").select("a", "b", "of_a", "of_b")
    types = [to_arrow_type(f.dataType) for f in pairs.select("a", "b").schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(chosen).cast(types[i]) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(tidied(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select("a", "b").schema.fields))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Rows with equal sets form a class, whose smallest id stands for all. An empty set is linked with
    nothing. A null id stands for nothing: such a row takes its class's component (null if the class has
    no other id) and isn't kept. Repeated rows get equal results; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.keep(sketch(docs, id_col=id_col, text_col=text_col, width=width, percent=percent), "rows")
    classes = rows.filter("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "bands", "bits")).alias("m"))
    classes = scratch.keep(classes.select("k1", "k2", "m.*"), "classes")

    placed = classes.select("id", F.explode("bands").alias("key"))
    centres = placed.groupBy("key", apart("key")).agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("id"), "id")).alias("centre")).filter("m > 1")
    members = placed.join(centres.select("key", "m", F.col("centre.id").alias("centre")), "key")
    bits = classes.select("id", "n", *(F.col("bits")[i].alias(f"s{i}") for i in range(LONGS)))
    members = scratch.keep(members.join(bits, "id"), "members")

    def pairs_of(some: DataFrame, others: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        """Pairs of a bucket that may reach the threshold: sets of like sizes whose bits differ little."""
        columns = ["id", "n", *(f"s{i}" for i in range(LONGS)), *extra]
        x = some.select("key", "m", *(F.col(c).alias(f"{c}_a") for c in columns))
        y = others.select("key", *(F.col(c).alias(f"{c}_b") for c in columns))
        fewer, more = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        differ = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(LONGS)), F.lit(0))
        return x.join(y, "key").filter((100 * fewer >= percent * more) & (1 - differ / BINS >= percent / 100 - _off(F.least(fewer, F.lit(BINS)), percent)))

    small = F.col("m") <= SMALL
    first = pairs_of(members.filter(small | (F.col("id") == F.col("centre"))), members).filter(F.when(small, F.col("id_a") < F.col("id_b")).otherwise(F.col("id_a") != F.col("id_b")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # whole texts are shuffled once, for those in any bucket; how many that are has no bound, so they are never broadcast
    in_buckets = texts.join(members.select("id").distinct().hint("merge"), "id", "left_semi")
    sets = scratch.keep(full_sets(in_buckets, id_col="id", width=width).dropDuplicates(["id"]), "sets")
    pairs = first.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    links = scratch.keep(confirm(pairs, sets, percent), "links0")
    found = scratch.keep(components(links, scratch, "graph0-"), "components0")

    # large buckets whose star left several components: the documents they connect are compared in blocks
    large = members.filter(~small)
    if not large.isEmpty():
        labelled = large.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_keys = labelled.groupBy("key", apart("key")).agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
        unsettled = scratch.keep(labelled.join(open_keys, "key", "left_semi").drop("key", "m").distinct(), "open")
        if not unsettled.isEmpty():
            more = scratch.keep(_across(scratch, unsettled, sets, percent), "links1")
            if not more.isEmpty():
                found = scratch.keep(components(links.unionAll(more), scratch, "graph1-"), "components1")
    scratch.drop("members", "open", "sets")

    stands = classes.select("k1", "k2", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    stands = scratch.keep(stands, "stands")
    out = rows.select("id", "n", "k1", "k2").join(stands, ["k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _off(n, percent: int):
    """How far below the threshold the similarity estimated from bits can be for a pair at it; n: the smaller set's size."""
    j = percent / 100
    return SCREEN * ((j * (1 - j)) / n + (1 - j) / 2 / BINS) ** 0.5


def _across(scratch: Scratch, unsettled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of documents that buckets connect.

    Each cluster of connected documents is cut into blocks of about BLOCK; a task compares two blocks, so
    no group grows with its cluster, and only links leave it.
    """
    clusters = scratch.keep(components(unsettled.select(F.col("centre").alias("a"), F.col("id").alias("b")), scratch, "cluster-"), "clusters")
    docs = unsettled.drop("centre").distinct().join(clusters.withColumnRenamed("node", "id").withColumnRenamed("component", "cluster"), "id")
    sizes = clusters.groupBy("component", apart("component")).count().select(F.col("component").alias("cluster"), F.ceil(F.col("count") / BLOCK).alias("blocks"))
    docs = docs.join(sizes, "cluster").join(sets, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = docs.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    id_type = docs.schema["id"].dataType.simpleString()
    off = _off

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        one, two = part[part["block"] == part["x"]].index, part[part["block"] == part["y"]].index
        bits = part[[f"s{i}" for i in range(LONGS)]].to_numpy().view(np.uint64)
        n, components, ids = part["n"].to_numpy(), part["component"].to_numpy(), part["id"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in part["shingles"]]
        joined = {}  # components linked in this task

        def root(c):
            while c in joined:
                c = joined[c]
            return c

        a, b = [], []
        for i in one:
            others = two[two > i] if len(one) == len(two) and (one == two).all() else two
            others = np.asarray(others)
            fewer, more = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
            differ = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1)
            likely = (components[others] != components[i]) & (100 * fewer >= percent * more) & (1 - differ / BINS >= percent / 100 - off(np.minimum(fewer, BINS), percent))
            for k in others[likely]:
                if root(components[i]) != root(components[k]):
                    both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[k] - both):
                        joined[root(components[i])] = root(components[k])
                        a.append(ids[i])
                        b.append(ids[k])
        return pd.DataFrame({"a": pd.Series(a, dtype=ids.dtype), "b": pd.Series(b, dtype=ids.dtype)})

    columns = ["id", "n", "component", "block", "x", "y", "shingles", *(f"s{i}" for i in range(LONGS))]
    return placed.select("cluster", *columns).groupBy("cluster", "x", "y").applyInPandas(compare, f"a {id_type}, b {id_type}")
