"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal directions, learned on a bounded sample, turns each vector into a binary
code of balanced bits; further rotations, learned from other beginnings, lengthen the code. It is cut into
substrings, one table for each; two codes that differ little agree, up to a few bits, in some substring.
Pairs found so are screened by Hamming distance and reranked with the original vectors. How far codes of
a pair differ depends on the data (the mean is taken off before), so it is measured on pairs made at the
threshold. With more vectors substrings get longer and tables more (about n ** 0.15 at a cosine of 0.95),
so that tables stay sparse and few bits have to be flipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.graph import apart, components
from cohortlake.llm.stage import Scratch
from cohortlake.llm.vectors import dimensions, matrix, scaled, unit, usable

#: Vectors that the rotation is learned on, and its iterations.
SAMPLE, ITERATIONS = 20_000, 30
#: Share of pairs just at the threshold that are found, measured on partners of the sample's vectors.
RECALL = 0.99
#: Rotations at most, each of up to 64 bits.
ROTATIONS = 16


def learn(sample: np.ndarray, bits: int, rotations: int = 1, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and rotations (dims x bits * rotations): principal directions, turned so that signs lose least."""
    rows = unit(sample)
    mean = rows.mean(axis=0)
    _, vectors = np.linalg.eigh((rows - mean).T @ (rows - mean))
    directions = vectors[:, ::-1][:, :bits]
    projected, rng, found = (rows - mean) @ directions, np.random.default_rng(seed), []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
            turn = (u @ v).T
        found.append(directions @ turn)
    return mean, np.concatenate(found, axis=1)


def differing(sample: np.ndarray, mean: np.ndarray, rotation: np.ndarray, threshold: float, seed: int = 1) -> list[np.ndarray]:
    """Which bits differ (pairs x bits) between sample vectors and partners made at the threshold.

    The partners lie in the directions in which the sample's vectors differ, and in any direction.
    """
    rng = np.random.default_rng(seed)
    rows = unit(sample)
    rows = rows[np.arange(SAMPLE) % len(rows)]
    found = []
    for away in (rows[rng.permutation(len(rows))] - rows, rng.normal(size=rows.shape)):
        away = away - (away * rows).sum(axis=1, keepdims=True) * rows
        size = np.linalg.norm(away, axis=1, keepdims=True)
        usable = size[:, 0] > 1e-9
        if usable.any():
            one = rows[usable]
            other = threshold * one + math.sqrt(max(0.0, 1 - threshold**2)) * away[usable] / size[usable]
            found.append(((one - mean) @ rotation >= 0) != ((other - mean) @ rotation >= 0))
    return found or [np.zeros((1, rotation.shape[1]), dtype=bool)]


def plan(differ: list[np.ndarray], bits: int, n: int) -> tuple[int, int, int, int]:
    """Width of a substring, number of tables, flips tried in each, and the largest Hamming distance in the rotations used: the least
    work that finds RECALL of the differing pairs. Differ has ``bits`` columns for each rotation; a substring is never cut across two."""
    sums = [np.pad(np.cumsum(d, axis=1), ((0, 0), (1, 0))) for d in differ]
    rotations, best = differ[0].shape[1] // bits, None
    for width in range(min(bits, 4), min(bits, 40) + 1):
        begins = np.array([r * bits + i * width for r in range(rotations) for i in range(bits // width)])
        # the fewest differing bits in any of the first tables
        least = [np.minimum.accumulate(s[:, begins + width] - s[:, begins], axis=1) for s in sums]
        for flips in range(3):
            enough = [(m <= flips).mean(axis=0) >= RECALL for m in least]
            if all(e.any() for e in enough):
                tables = 1 + max(int(np.argmax(e)) for e in enough)
                probes = sum(math.comb(width, i) for i in range(flips + 1))
                work = tables * n * (1 + probes * (1 + n / 2**width))
                if best is None or work < best[0]:
                    best = work, width, tables, flips
    if best is None:  # no substring is likely enough to agree: one table of the first bits, all flips
        flips = next(f for f in range(bits + 1) if all((s[:, bits] <= f).mean() >= RECALL for s in sums))
        best = 0, bits, 1, flips
    _, width, tables, flips = best
    used = -(-tables // (bits // width)) * bits
    distance = next(h for h in range(used + 1) if all((s[:, used] <= h).mean() >= 0.9995 for s in sums))
    return width, tables, flips, distance


def _flip_masks(width: int, flips: int) -> list[int]:
    masks = {0}
    for _ in range(flips):
        masks |= {m ^ (1 << i) for m in masks for i in range(width)}
    return sorted(masks)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    Links are pairs found of cosine >= threshold, in double precision; none is below. Equal vectors form
    a class and are linked with each other. A vector that is null, zero, of another length than most, or
    holds null or non-finite components is linked with nothing. A null id stands for nothing, though its
    row counts as a link of others. Repeated rows count each; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "itq")
    dims = dimensions(vectors, vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v"), dims), F.col("v")))
    # -0.0 and 0.0 are one number
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("k1"), F.xxhash64(F.lit("second"), "v").alias("k2"))
    classes = rows.filter("v IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = scratch.keep(classes.withColumn("node", F.xxhash64("k1", "k2")), "classes")
    n = classes.count()
    sample = classes.orderBy("node").limit(SAMPLE).select("v").toPandas()["v"]  # at most SAMPLE vectors, however many there are
    bits = min(dims, 64)
    if n:
        sample = np.stack([*sample])
        mean, rotation = learn(sample, bits, min(ROTATIONS, math.ceil(n**0.15)))
        how = plan(differing(sample, mean, rotation, threshold), bits, n)
        links = _links(scratch, classes, mean, rotation, bits, how, dims, threshold)
        found = components(links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), scratch, "components")
        both = links.select(F.col("a").alias("node"), F.col("copies_b").alias("n")).unionAll(links.select("b", "copies_a"))
        counts = both.groupBy("node").agg(F.sum("n").alias("linked"))
        stands = classes.join(counts, "node", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        stands = stands.select("k1", "k2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    else:
        stands = classes.select("k1", "k2", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component"))
    stands = scratch.keep(stands, "stands")
    lone = rows.filter("k1 IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = rows.filter("k1 IS NOT NULL").select("id", "k1", "k2").join(stands, ["k1", "k2"]).select("id", "n_links", "component").unionAll(lone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def _links(scratch: Scratch, classes: DataFrame, mean: np.ndarray, rotation: np.ndarray, bits: int, how: tuple[int, int, int, int], dims: int, threshold: float) -> DataFrame:
    width, tables, flips, distance = how
    each = bits // width
    codes = -(-tables // each)
    rotation = rotation[:, :codes * bits]
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    names = [f"code{i}" for i in range(codes)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = (unit(matrix(batch.column(1), dims)) - mean) @ rotation >= 0
            found = (signs.reshape(len(signs), codes, bits) * weights).sum(axis=2, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(codes))], names=["node", *names])

    coded = scratch.keep(classes.select("node", "v").mapInArrow(code, "node long, " + ", ".join(f"{c} long" for c in names)), "codes")
    mask = (1 << width) - 1 if width < 64 else -1

    def part(of: Column | str, t: int) -> Column:
        """Substring t of a code."""
        return F.shiftrightunsigned(of, t % each * width).bitwiseAND(mask)

    listed = coded.select("node", *names, F.posexplode(F.array(*[part(names[t // each], t) for t in range(tables)])).alias("t", "part"))
    masks = F.array(*[F.lit(m).cast("long") for m in _flip_masks(width, flips)])
    probes = listed.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in names), "t", F.explode(masks).alias("mask"), "part") if flips else listed.select(
        F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in names), "t", F.lit(0).cast("long").alias("mask"), "part")
    probes = probes.withColumn("part", F.col("part").bitwiseXOR(F.col("mask"))).drop("mask")
    pairs = probes.join(listed.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in names), "t", "part"), ["t", "part"]).filter("a < b")
    apart_by = [F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in names]
    # a pair is taken from the first table that finds it
    first = F.lit(-1)
    for t in reversed(range(tables)):
        first = F.when(F.bit_count(part(apart_by[t // each], t)) <= flips, t).otherwise(first)
    total = sum((F.bit_count(x) for x in apart_by), F.lit(0))
    pairs = pairs.filter((total <= distance) & (F.col("t") == first)).select("a", "b")

    def side(x: str) -> DataFrame:
        return classes.select(F.col("node").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("copies").alias(f"copies_{x}"), F.col("v").alias(f"v_{x}"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = scaled(matrix(batch.column(6), dims)), scaled(matrix(batch.column(7), dims))
            cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            chosen = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(chosen) for i in range(6)], names=batch.schema.names[:6])

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "rep_a", "rep_b", "copies_a", "copies_b", "v_a", "v_b")
    id_type = classes.schema["rep"].dataType.simpleString()
    found = both.mapInArrow(rerank, f"a long, b long, rep_a {id_type}, rep_b {id_type}, copies_a long, copies_b long")
    return scratch.keep(found, "links")
