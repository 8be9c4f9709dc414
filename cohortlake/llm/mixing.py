"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent between 0 (all sources
alike) and 1 (shares as they are), normalised. The exponent is bisected until the weights' entropy,
or the epochs of the source repeated most, meet a target. A token budget then gives each source its
epochs. They are realised as permutations of blocks of documents: every document is taken once for
each whole epoch, and in the last, partial epoch blocks are taken in a keyed random order, the block
at the edge document by document, until the source's budget is used up. Where that happens, the edge, is
all that has to be known of a source: rows are then decided one by one, without moving.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.stage import Scratch

#: A source has a block for so many tokens or documents, whichever are more.
BLOCK_TOKENS, BLOCK_ROWS = 1 << 16, 1 << 12
#: Bits of a keyed hash, and of its beginning, by which blocks are summed before single ones are ordered.
HASH_BITS, GROUP_BITS = 60, 12


@dataclass(frozen=True)
class Mixture:
    exponent: float
    weights: dict[str | None, float]
    epochs: dict[str | None, float]


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def powered(tokens: dict[str | None, int], exponent: float) -> dict[str | None, float]:
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent for s, n in tokens.items() if n > 0}
    scale = math.fsum(raised.values())
    return {s: raised[s] / scale if s in raised else 0.0 for s in tokens}


def entropy(weights: dict[str | None, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def epochs_of(tokens: dict[str | None, int], weights: dict[str | None, float], budget: int | None) -> dict[str | None, float]:
    """Epochs of each source for a budget of tokens; without one, the least budget that takes every source once."""
    used = {s: n for s, n in tokens.items() if n > 0}
    whole = max((n / weights[s] for s, n in used.items()), default=0.0) if budget is None else budget
    return {s: whole * weights[s] / n if n > 0 else 0.0 for s, n in tokens.items()}


def solve(tokens: dict[str | None, int], *, least_entropy: float | None = None, most_epochs: float | None = None, budget: int | None = None, steps: int = 60) -> Mixture:
    """The largest exponent of entropy >= least_entropy (nats), or the smallest that repeats no source over most_epochs.

    Both fall or rise steadily with the exponent. A target that no exponent between 0 and 1 meets gives
    the end nearest to it. Exactly one target is to be given.
    """
    if (least_entropy is None) == (most_epochs is None):
        raise ValueError("give either least_entropy or most_epochs")

    def meets(exponent: float) -> bool:
        weights = powered(tokens, exponent)
        if least_entropy is not None:
            return entropy(weights) >= least_entropy
        return max(epochs_of(tokens, weights, budget).values(), default=0.0) <= most_epochs

    # entropy is met at low exponents, the repetition limit at high ones
    low, high, falls = 0.0, 1.0, least_entropy is not None
    if not sum(tokens.values()):
        return Mixture(1.0, dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 0.0))
    if meets(1.0 if falls else 0.0):
        exponent = 1.0 if falls else 0.0
    elif not meets(0.0 if falls else 1.0):
        exponent = 0.0 if falls else 1.0
    else:
        for _ in range(steps):
            middle = (low + high) / 2
            if meets(middle) == falls:
                low = middle
            else:
                high = middle
        exponent = low if falls else high
    weights = powered(tokens, exponent)
    return Mixture(exponent, weights, epochs_of(tokens, weights, budget))


def mix(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", least_entropy_share: float | None = None,
        most_epochs: float | None = None, budget: int | None = None, budget_share: float | None = None, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """Every row of docs, all its columns as they are, with ``n_tokens``, ``block`` and ``copies`` (how often the mixture takes it).

    least_entropy_share is the target entropy as a share of the highest possible, log of the number of
    sources. budget_share is the budget as a share of all tokens. Null is a source of its own. Rows of no
    tokens cost nothing and are taken for each epoch begun; with most_epochs and no budget, sources of no
    tokens at all are taken once. A column of docs with one of the added names
    is replaced. Equal rows count each; those with equal id and text get equal copies. What is known of a
    source, a few numbers, is held by the driver and broadcast.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    own = [c for c in docs.columns if c not in ("n_tokens", "block", "copies")]
    counts = word_count(F.col(text_col)) if tokens is None else tokens
    key = keyed_hash(F.lit(str(seed)), F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    slim = scratch.keep(docs.select(F.col(source_col).alias("source"), key.alias("key"), counts.cast("long").alias("n")), "slim")

    found = slim.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()  # a row for each source
    totals = {r["source"]: r["n"] for r in found}
    if budget_share is not None:
        budget = round(budget_share * sum(totals.values()))
    target = least_entropy_share * math.log(len(totals)) if least_entropy_share is not None and totals else least_entropy_share
    mixture = solve(totals, least_entropy=target, most_epochs=most_epochs, budget=budget)
    # without a budget everything is taken once at least, and what has no tokens costs nothing
    takes_all = most_epochs is not None and budget is None
    plan = []
    for r in found:
        epochs = 1.0 if takes_all and not r["n"] else mixture.epochs[r["source"]]
        whole = int(epochs + 1e-9)
        plan.append((r["source"], whole, round((epochs - whole) * r["n"]), max(1, -(-r["n"] // BLOCK_TOKENS), -(-r["rows"] // BLOCK_ROWS))))
    source_type = docs.schema[source_col].dataType.simpleString()
    sources = spark.createDataFrame(plan, f"of {source_type}, whole int, part long, n_blocks long")
    block = F.pmod("key", "n_blocks")
    edges = _edges(scratch, slim.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block).filter("part > 0"), seed)
    edges = scratch.keep(sources.join(edges.withColumnRenamed("source", "at"), F.col("of").eqNullSafe(F.col("at")), "left").drop("at"), "edges")

    rows = docs.select(*own, counts.cast("long").alias("n_tokens"), key.alias("key"), F.col(source_col).alias("__source"))
    rows = rows.toDF(*(f"c{i}" for i in range(len(own))), "n_tokens", "key", "source")
    joined = rows.join(F.broadcast(edges), F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block)  # a row for each source
    turn = block_turn(seed, "source", "block")
    before = (turn < F.col("edge_turn")) | ((turn == F.col("edge_turn")) & (F.col("block") < F.col("edge_block")))
    last = F.when(F.col("part") <= 0, 0).when(F.col("edge_turn").isNull() | before, 1)
    last = last.when((turn == F.col("edge_turn")) & (F.col("block") == F.col("edge_block")) & (F.col("key") <= F.col("edge_key")), 1).otherwise(0)
    return joined.select(*(f"c{i}" for i in range(len(own))), "n_tokens", "block", (F.col("whole") + last).alias("copies")).toDF(*own, "n_tokens", "block", "copies")


def keyed_hash(*parts: Column) -> Column:
    """HASH_BITS bits of the parts' md5; nulls are skipped."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def block_turn(seed: int, source: str, block: str) -> Column:
    """A block's place in its source's permutation; blocks of one hash go by their number."""
    return keyed_hash(F.lit(str(seed)), F.lit("turn"), F.col(block).cast("string"), F.col(source).cast("string"))


def _edges(scratch: Scratch, slim: DataFrame, seed: int) -> DataFrame:
    """(source, edge_turn, edge_block, edge_key): the block in which ``part`` is used up, and the last key of it that still fits (null: none).

    Blocks are summed by the beginning of their hash first, so that no window orders all blocks of a source.
    """

    def first(df: DataFrame, order: Sequence[str]) -> DataFrame:
        """The first row of each source after which part is used up; part becomes what is left there."""
        before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        over = df.withColumn("before", before).filter("before >= part OR before + n > part")
        top = over.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*order))).filter("rank = 1")
        return top.select("source", *order, F.greatest(F.lit(0), F.col("part") - F.col("before")).alias("part"))

    blocks = slim.groupBy("source", "block").agg(F.sum("n").alias("n"), F.first("part").alias("part")).withColumn("turn", block_turn(seed, "source", "block"))
    blocks = scratch.keep(blocks.withColumn("group", F.shiftright("turn", HASH_BITS - GROUP_BITS)), "blocks")
    group = first(blocks.groupBy("source", "group").agg(F.sum("n").alias("n"), F.first("part").alias("part")), ["group"])
    group = group.select(F.col("source").alias("of"), F.col("group").alias("chosen"), F.col("part").alias("left"))
    inside = blocks.join(F.broadcast(group), F.col("source").eqNullSafe(F.col("of")) & (F.col("group") == F.col("chosen")))  # a row for each source
    edge = scratch.keep(first(inside.select("source", "turn", "block", "n", F.col("left").alias("part")), ["turn", "block"]), "edge")
    asked = edge.select(F.col("source").alias("of"), F.col("block").alias("chosen"), F.col("part").alias("room"))
    docs = slim.select("source", "key", "n", "block").join(F.broadcast(asked), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("chosen"))).filter("room > 0")
    keys = docs.groupBy("source", "key").agg(F.sum("n").alias("n"), F.first("room").alias("room"))  # equal rows share their fate
    taken = keys.withColumn("sum", F.sum("n").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))).filter("sum <= room")
    last = taken.groupBy("source").agg(F.max("key").alias("edge_key")).withColumnRenamed("source", "of")
    found = edge.join(F.broadcast(last), F.col("source").eqNullSafe(F.col("of")), "left")
    return found.select("source", F.col("turn").alias("edge_turn"), F.col("block").alias("edge_block"), "edge_key")


def realise(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row of ``mix`` as often as it is taken, without the added columns."""
    added = ("n_tokens", "block", "copies")
    times = mixed.filter("copies > 0").withColumn("__time", F.explode(F.sequence(F.lit(1), "copies")))
    return times.drop("__time", *added)
