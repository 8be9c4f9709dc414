"""Nearest neighbours by inner product with collision-counting hashing.

Inner products are turned into distances: candidates get one more component that gives all of them
the same length, queries get zero there. Each hash is a single random projection, kept as a sorted
array. The candidates are cut by their own lengths into ranges, each padded to the longest of its own:
were short ones padded to the longest of all, the padding would outweigh what they differ by. Ranges
too short to hold one of a query's best are passed over. A query opens a window around its own projection in every array; widening the windows step by
step (virtual rehashing) stands for coarser and coarser buckets. A candidate that lies in enough of
the windows has collided often enough to be verified with the original vectors.

The candidates are cut into shards and the queries into blocks; each pair of them is one task's work,
and the best of each shard are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.stage import Scratch
from cohortlake.llm.vectors import dimensions, scaled, usable

PROJECTIONS = 64
#: Share of the projections that must collide.
COLLIDES = 0.8
#: Share of a range's vectors verified before the windows stop widening, where the caller names none.
SHARE = 0.08
#: Factor by which windows widen.
WIDENS = 1.05
#: Lengths of one range differ by this factor at most, unless it holds so few vectors that all are verified.
RANGE = 1.1
#: Bytes of a shard's vectors, and of a block's; shards are smaller, but of SMALL_SHARD rows at least, where that employs more cores.
PART_BYTES, SMALL_SHARD = 16 << 20, 4_096
#: Steps of widening after which all rows are verified instead.
MOST_STEPS = 400


class ProjectionIndex:
    """Sorted projections of one shard's vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, seed: int = 1):
        rest = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))
        lines = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, PROJECTIONS))
        lines = np.linalg.qr(lines)[0] if lines.shape[0] >= PROJECTIONS else lines / np.linalg.norm(lines, axis=0)
        self.lines = lines[:-1]
        projected = vectors @ lines[:-1] + rest[:, None] * lines[-1]
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32, order="C")
        self.sorted = np.take_along_axis(projected, self.order.T, axis=0).T.copy()

    def candidates(self, queries: np.ndarray, k: int, share: float) -> Iterator[np.ndarray]:
        """For each query, the rows that collide with it in COLLIDES of the windows, once these hold that share of all rows."""
        n = self.order.shape[1]
        wanted = min(n, max(10 * k, int(np.ceil(share * n))))
        if wanted == n:
            yield from (np.arange(n) for _ in queries)
            return
        least = int(np.ceil(COLLIDES * PROJECTIONS))
        first_radius = radius = 0.1 * float(np.median(self.sorted[:, -1] - self.sorted[:, 0]))
        found: np.ndarray = np.empty(0, np.int64)
        for centre in queries @ self.lines:
            # a query begins with the windows that the last one needed, narrower if they held too much
            if len(found) > 1.3 * wanted:
                radius /= WIDENS
            for _ in range(MOST_STEPS):
                # wide windows hold most rows: it is those outside that are counted
                outside = []
                for row, order, c in zip(self.sorted, self.order, centre, strict=True):
                    low, high = row.searchsorted((c - radius, c + radius))
                    outside += [order[:low], order[high:]]
                missing = np.concatenate(outside)
                found = np.flatnonzero(np.bincount(missing, minlength=n) <= PROJECTIONS - least)
                if len(found) >= wanted or not len(missing):
                    break
                radius *= WIDENS
            else:
                radius, found = first_radius, np.arange(n)
            yield found


def verified(vectors: np.ndarray, query: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of the rows by exact product and then id. A product that is no number, of infinities of both signs, counts as the least."""
    scores = np.nan_to_num(vectors[rows] @ query, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    if len(rows) > k:  # all that tie with the k-th stay until ids decide
        worst = np.partition(scores, len(rows) - k)[len(rows) - k]
        near = scores >= (worst - 1e-12 * max(1.0, abs(worst)) if np.isfinite(worst) else worst)
        rows = rows[near]
    scores = np.nan_to_num((vectors[rows] * query).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    best = np.lexsort((ids[rows], -scores))[:k]
    return rows[best], scores[best]


def nearest_of_shard(vectors: np.ndarray, ids: np.ndarray, numbers: np.ndarray, queries: np.ndarray, query_numbers: np.ndarray, k: int, share: float = SHARE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, the rows and products of the best k found, its own row (the one of its number) aside."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        # lengths and hashes are taken of scaled vectors, whose squares neither vanish nor overflow; products of the original ones
        largest, asked = np.abs(vectors).max(axis=1), scaled(queries)
        size = largest.max()
        lengths = largest / size * np.sqrt((scaled(vectors) ** 2).sum(axis=1))
        own_lengths = np.sqrt((asked**2).sum(axis=1))
        query_lengths = own_lengths * np.abs(queries).max(axis=1)
        order = np.argsort(-lengths, kind="stable")
        descending = lengths[order]
        own = {number: row for row, number in enumerate(numbers.tolist())}
        found = [(np.empty(0, np.int64), np.empty(0)) for _ in queries]
        at = 0
        while at < len(order):
            end = int(np.searchsorted(-descending, -descending[at] / RANGE, side="right"))
            end = min(len(order), max(end, at + 10 * (k + 1)))
            # a range that can't hold a product as large as the k-th best has nothing for this query, nor have those after it
            asks = np.array([i for i, (_, scores) in enumerate(found) if len(scores) < k or query_lengths[i] * descending[at] * size * (1 + 1e-9) >= scores[-1]], dtype=np.int64)
            if not len(asks):
                break
            rows = np.sort(order[at:end])
            hashed = vectors[rows] / largest[rows].max()
            longest = float(np.sqrt((hashed**2).sum(axis=1)).max())
            index = ProjectionIndex(hashed, longest)
            # a query's own length doesn't change the order of its products: windows are centred as if it were as long as the range
            centred = asked[asks] * (longest / own_lengths[asks])[:, None]
            for i, likely in zip(asks, index.candidates(centred, k + 1, share), strict=True):
                likely = rows[likely]
                likely = likely[likely != own.get(int(query_numbers[i]), -1)]
                best, scores = verified(vectors, queries[i], likely, ids, k)
                best, scores = np.concatenate([found[i][0], best]), np.concatenate([found[i][1], scores])
                first = np.lexsort((ids[best], -scores))[:k]
                found[i] = best[first], scores[first]
            at = end
    return found


def search(vectors: DataFrame, is_query, *, k: int = 20, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row that is_query holds for, its own row aside.

    Ties go to the smaller id. Vectors that are null, zero, of another length than most, or hold null or
    non-finite components, and rows with a null id, take no part. Rows that repeat an id are rows of their
    own as candidates (the result can name an id twice), and one query each.

    share: of a range's vectors, how many are verified before the windows stop widening. It sets the recall; with
    1 all are verified that the lengths don't rule out, and the result is exact.
    """
    if not 0 < share <= 1:
        raise ValueError("share is over 0 and at most 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "collision")
    dims = dimensions(vectors, vector_col)
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col), dims))
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    n, asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    part_rows = max(1, PART_BYTES // (8 * max(1, dims)))
    shards, blocks = max(1, -(-n // part_rows), min(spark.sparkContext.defaultParallelism, -(-n // SMALL_SHARD))), max(1, -(-asks // part_rows))

    row_hash = F.xxhash64("row")
    # every block of queries meets every shard: each side is sent once for each part of the other
    candidates = rows.select(F.lit(False).alias("asks"), "row", "id", "v", F.pmod(row_hash, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    queries = rows.filter("asks").select(F.lit(True).alias("asks"), "row", "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(row_hash, F.lit(blocks)).alias("block"))
    id_type = rows.schema["id"].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        shard, ask = part[~part["asks"]], part[part["asks"]]
        if not len(shard) or not len(ask):
            return pd.DataFrame({"query": [], "query_row": [], "vec_id": [], "score": []})
        shard = shard.sort_values("row")
        vectors, ids, numbers = np.stack([*shard["v"]]), shard["id"].to_numpy(), shard["row"].to_numpy()
        found = []
        of_shard = nearest_of_shard(vectors, ids, numbers, np.stack([*ask["v"]]), ask["row"].to_numpy(), k, share)
        for number, query, (best, scores) in zip(ask["row"], ask["id"], of_shard, strict=True):
            found.append(pd.DataFrame({"query": query, "query_row": number, "vec_id": ids[best], "score": scores}))
        return pd.concat(found)

    best = candidates.unionAll(queries).groupBy("shard", "block").applyInPandas(one, f"query {id_type}, query_row long, vec_id {id_type}, score double")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
