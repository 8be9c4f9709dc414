"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap. Each chunk is pre-tokenised
on its own, anywhere on the cluster. Two neighbouring chunks agree from the first pre-token
boundary which both of them find in their overlap: a match depends only on where it begins and on
the characters up to one past its end, so from a common start both go on alike. The text between
two such boundaries is one piece; pieces are encoded independently and their ids joined in order.
Neighbours that share no boundary (one match spans their whole overlap) stay together in one piece, up to
the next boundary that is sure.

A space followed by a non-space always begins a pre-token, whatever is before it. So a chunk's boundaries
are sure from its first such place on, or from where it met the chunk before. Inside a piece, the text is
cut there too and the cuts are looked up in a per-worker cache of already encoded strings.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.stage import prepare, tidied

SPACE_THEN_WORD = re.compile(r" (?=\S)")
SPACE_NO_WORD = re.compile(r" (?!\S)")
#: Entries of the per-worker cache; it is emptied when full.
CACHE_ENTRIES = 150_000
CACHE_CHARS = 64

_workers: dict[tuple[int, str], "PieceEncoder"] = {}


def cut_at_words(text: str) -> list[str]:
    """The text cut at each space that a non-space follows; those spaces are left out."""
    return SPACE_THEN_WORD.split(text) if SPACE_NO_WORD.search(text) else text.split(" ")


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class PieceEncoder:
    """Encodes strings that begin and end at pre-token boundaries; ids are little-endian uint32."""

    def __init__(self, raw: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = parse_ranks(raw)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        encode = self._encode_cut

        class AfterSpace(dict):
            def __missing__(self, cut: str) -> bytes:
                ids = encode(" " + cut)
                if len(cut) <= CACHE_CHARS:
                    if len(self) >= CACHE_ENTRIES:
                        self.clear()
                    self[cut] = ids
                return ids

        self.after_space = AfterSpace()

    def _encode_cut(self, cut: str) -> bytes:
        if len(cut) <= 1000:
            ids = self.encoding.encode_ordinary(cut)
        else:  # the library's own splitter overflows its stack on very long runs
            ids = [i for m in self.pattern.finditer(cut) for i in self.encoding._encode_single_piece(m.group())]
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode(self, piece: str) -> bytes:
        first, *rest = cut_at_words(piece)
        return (self._encode_cut(first) if first else b"") + b"".join(map(self.after_space.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def boundaries(self, text: str, begin: int, end: int) -> list[int]:
        """Starts of the matches in text, from begin to end."""
        return [m.start() for m in self.pattern.finditer(text) if begin <= m.start() < end]


def worker(ranks: Broadcast, pattern: str) -> PieceEncoder:
    key = (hash(ranks.value), pattern)
    if key not in _workers:
        _workers.clear()
        _workers[key] = PieceEncoder(ranks.value, pattern)
    return _workers[key]


def broadcast_file(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file, read on the driver and sent to the executors (a few MB at most)."""
    prepare(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())



def encode(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = 32_768, overlap_chars: int = 1_024, with_decoded: bool = False) -> DataFrame:
    """One row ``(id, ids)`` for each row of df; ids is binary, little-endian unsigned 32-bit.

    With ``with_decoded``, a column ``decoded`` has the bytes that decoding each piece's ids gives.
    Null text counts as empty; empty text has no ids. Repeated rows and null keys give a row each.
    Other columns of df are ignored.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("overlap_chars must be positive and below chunk_chars")
    ranks = broadcast_file(df.sparkSession, ranks_path)
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["ids", "decoded"][:1 + with_decoded]
    schema = f"id {id_type}, " + ", ".join(f"{n} binary" for n in names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker(ranks, pattern)
        for batch in batches:
            ids = [enc.encode(t) for t in batch.column(1).to_pylist()]
            out = [ids, map(enc.decode, ids)][:len(names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in out)], names=["id", *names])

    short = rows.filter(F.length("text") <= chunk_chars).mapInArrow(tidied(whole), schema)
    long = rows.filter(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id())
    pieces = _stitch(_chunks(long, id_type, chunk_chars, overlap_chars), ranks, pattern, id_type, names)
    return short.unionAll(pieces).withColumnRenamed("id", id_col)


def _chunks(long: DataFrame, id_type: str, size: int, overlap: int) -> DataFrame:
    """Chunk k begins at k * size and goes on for overlap characters into chunk k + 1."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                text = one.column(1)[0].as_py()
                parts = [text[at:at + size + overlap] for at in range(0, len(text), size)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [one.column(2).take(pa.array([0] * n)), one.column(0).take(pa.array([0] * n)), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())],
                    names=["row", "id", "chunk", "part"])

    chunks = long.mapInArrow(split, f"row long, id {id_type}, chunk int, part string")
    return chunks.repartition("row", "chunk").withColumns({"size": F.lit(size), "overlap": F.lit(overlap)})


def _stitch(chunks: DataFrame, ranks: Broadcast, pattern: str, id_type: str, names: list[str]) -> DataFrame:
    ints = pa.list_(pa.int32())

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker(ranks, pattern)
        for batch in batches:
            heads, tails, sure = [], [], []
            for part, size, overlap in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                heads.append(enc.boundaries(part[:overlap + 1], 0, overlap))
                tails.append([b - size for b in enc.boundaries(part, size, size + overlap)])
                sure.append(SPACE_THEN_WORD.search(part, 0, size) is not None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(heads, ints), pa.array(tails, ints), batch.column(4), pa.array(sure, pa.bool_())],
                                             names=["row", "id", "chunk", "part", "head", "tail", "size", "sure"])

    cut = chunks.mapInArrow(pretokenise, f"row long, id {id_type}, chunk int, part string, head array<int>, tail array<int>, size int, sure boolean")
    of_text = Window.partitionBy("row")
    in_order = of_text.orderBy("chunk")
    cut = cut.withColumn("last", F.lead("chunk").over(in_order).isNull())
    cut = cut.withColumn("sync", F.when(~F.col("last"), F.array_min(F.array_intersect("tail", F.lead("head").over(in_order)))))
    # the last chunk up to this one that is sure by itself, and the last that didn't meet the one before it
    up_to = in_order.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("missed", (F.col("chunk") > 0) & F.lag("sync").over(in_order).isNull())
    sure = F.max(F.when(F.col("sure") | (F.col("chunk") == 0), F.col("chunk"))).over(up_to) >= F.coalesce(F.max(F.when(F.col("missed"), F.col("chunk"))).over(up_to), F.lit(0))
    cut = cut.withColumn("sync", F.when(sure, F.col("sync")))
    cut = cut.withColumn("met", F.lag("sync").over(in_order))
    cut = cut.withColumns({"begin": F.coalesce("met", F.lit(0)), "piece": F.count("met").over(up_to).cast("int")})
    pieces = cut.groupBy("row", "piece").agg(
        F.first("id").alias("id"),
        F.sort_array(F.collect_list(F.struct("chunk", "part", "begin", "sync", "size", "last"))).alias("parts"))

    def encode_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker(ranks, pattern)
        for batch in batches:
            out = []
            for parts in batch.column(3).to_pylist():
                end = parts[-1]
                text = "".join(p["part"][:p["size"]] for p in parts[:-1]) + (end["part"] if end["last"] else end["part"][:end["size"] + end["sync"]])
                out.append(enc.encode(text[parts[0]["begin"]:]))
            columns = [out, map(enc.decode, out)][:len(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.binary()) for x in columns)], names=["row", "piece", "id", *names])

    ids = pieces.select("row", "piece", "id", "parts").repartition("row", "piece").mapInArrow(tidied(encode_piece), f"row long, piece int, id {id_type}, " + ", ".join(f"{n} binary" for n in names))
    in_order = [F.expr(f"listagg({n}) WITHIN GROUP (ORDER BY piece)").alias(n) for n in names]
    return ids.groupBy("row").agg(F.first("id").alias("id"), *in_order).drop("row")


def decode(df: DataFrame, ranks_path: str, pattern: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes of its ids in ``out_col`` (null ids: no bytes). An id outside the ranks is an error."""
    ranks = broadcast_file(df.sparkSession, ranks_path)
    kept = [f for f in df.schema.fields if f.name != out_col]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept])
    at = [f.name for f in kept].index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker(ranks, pattern)
        for batch in batches:
            decoded = pa.array([enc.decode(ids or b"") for ids in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, out_col])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out_col}` binary"])
    return source.mapInArrow(run, schema)
