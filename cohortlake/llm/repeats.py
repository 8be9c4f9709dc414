"""Removal of byte strings that occur more than once, across or within documents.

Every window of ``length`` bytes that also starts elsewhere is marked, and the marked bytes are cut
out. Windows are compared through their minimizer: of the shorter grams in a window, the one of
least hash (the leftmost of equals). Equal windows have equal minimizers at equal places, so only
windows of one minimizer need to meet. Runs of neighbouring windows with one minimizer form a piece;
a piece that occurs twice as a whole settles all its windows at once. What is left, pieces at the edges
of repeats, is cut into cells of windows whose distances to the minimizer are alike: if what all windows
of a cell cover together occurs twice, so does each of them; if what they have in common doesn't, none
does; only cells between the two are spread out into single windows. Windows can also be counted in
words, whose hashes then take the place of the bytes.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.graph import apart
from cohortlake.llm.stage import Scratch, tidied

#: Bytes hashed at a time; a place in them takes PLACE_BITS of a key.
PLACE_BITS = 18
BUFFER = 1 << PLACE_BITS
#: Cells that the windows of one minimizer are cut into.
CELLS = 12
ODD = np.uint64(0x9E3779B97F4A7C15)


class RollingHash:
    """Hashes of all windows of a buffer, by polynomials over 64-bit words of random byte values."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.power = self._powers(base)
        self.inverse = self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.ones(BUFFER + 1, dtype=np.uint64)
        known = 1
        while known < len(out):
            n = min(known, len(out) - known)
            out[known:known + n] = out[:n] * np.uint64(pow(base, known, 1 << 64))
            known += n
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Of bytes, or of words' hashes."""
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((self.of_byte[data] if data.dtype == np.uint8 else data) * self.power[:len(data)], out=total[1:])
        return total

    def window(self, sums: np.ndarray, begin: np.ndarray | slice, end: np.ndarray | slice, places: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[begin]) * self.inverse[places]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbouring values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - width + 1], before[width - 1:n])


_SPACE = np.isin(np.arange(256), [*b"\t\n\v\f\r "])
_word_hash = functools.cache(lambda buffer: RollingHash(2))


def in_bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words, runs without the six ASCII white space characters, begin and end."""
    space = np.concatenate([[True], _SPACE[in_bytes(text)], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def in_words(text: bytes) -> np.ndarray:
    """Hashes of the text's words."""
    begin, end = word_places(text)
    out, of, i = np.empty(len(begin), np.uint64), _word_hash(BUFFER), 0
    while i < len(begin):
        at, j = begin[i], int(np.searchsorted(end, begin[i] + BUFFER, side="right"))
        if j == i:  # a word longer than a buffer
            out[i], i = xxhash.xxh64_intdigest(text[at:end[i]]), i + 1
        else:
            sums = of.sums(in_bytes(text[at:end[j - 1]]))
            out[i:j], i = of.window(sums, begin[i:j] - at, end[i:j] - at, begin[i:j] - at), j
    return out


def _buffers(texts: Iterable[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least length symbols (bytes or words) put together: symbols, and each part's text number, place in the text and place in the buffer.

    A text longer than half a buffer is cut into parts that overlap by length - 1 symbols.
    """
    parts, size = [], 0

    def close():
        sizes = np.array([len(p) for p, _, _ in parts])
        return np.concatenate([p for p, _, _ in parts]), np.array([t for _, t, _ in parts]), np.array([at for _, _, at in parts]), np.concatenate([[0], np.cumsum(sizes)])

    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), BUFFER // 2 - length + 1):
            part = text[at:at + BUFFER // 2]
            if len(part) < length:
                continue
            if size + len(part) > BUFFER:
                yield close()
                parts, size = [], 0
            parts.append((part, number, at))
            size += len(part)
    if parts:
        yield close()


class Pieces:
    """Cuts texts into pieces: runs of windows that share a minimizer. Lengths and places are in symbols, as read gives them of a text."""

    def __init__(self, length: int, gram: int, read: Callable[[bytes], np.ndarray] = in_bytes):
        self.length, self.gram, self.read, self.hash = length, gram, read, RollingHash()

    def of(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """text (its number), first and last window, the minimizer's place, and hashes of the minimizer and of the piece."""
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("text", "first", "last", "place", "minimizer", "piece")}
        for data, number, at, starts in _buffers(map(self.read, texts), self.length):
            sums = self.hash.sums(data)
            grams = np.arange(len(data) - self.gram + 1)
            hashes = self.hash.window(sums, slice(None, -self.gram), slice(self.gram, None), grams)
            keys = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | grams.astype(np.uint64)
            least = _least(keys, self.length - self.gram + 1)
            # windows must end in the part they begin in
            sizes = np.diff(starts) - self.length + 1
            part = np.repeat(np.arange(len(sizes)), sizes)
            window = np.arange(len(part)) + (starts[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]))[part]
            key = least[window]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            last = np.concatenate([first[1:], [len(part)]]) - 1
            a, b, place, of = window[first], window[last], (key[first] & np.uint64(BUFFER - 1)).astype(np.int64), part[first]
            shift = at[of] - starts[of]
            for c, x in (("text", number[of]), ("first", a + shift), ("last", b + shift), ("place", place + shift), ("minimizer", hashes[place].view(np.int64)),
                         ("piece", self.hash.window(sums, a, b + self.length, a).view(np.int64))):
                out[c].append(x)
        return {c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in out.items()}

    @property
    def cell(self) -> int:
        """Windows of a cell: those of distance q * cell to q * cell + cell - 1 to their minimizer form cell q."""
        return max(1, (self.length - self.gram) // CELLS)

    def bodies(self, text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[bytes]]:
        """For pieces of one text, the symbols that their windows' cells cover, as far as the text goes: places and bytes."""
        at = word_places(text) if self.read is in_words else None
        n = len(text) if at is None else len(at[0])
        begins, ends = np.maximum(0, first - self.cell), np.minimum(n, last + self.length + self.cell)
        places = (begins, ends) if at is None else (at[0][begins], at[1][ends - 1])
        return begins.tolist(), [text[i:j] for i, j in zip(*(x.tolist() for x in places), strict=True)]

    def _packed(self, bodies: Sequence[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Bodies put together in buffers: the first and one past the last, sums, and each one's place in the buffer."""
        symbols, begin, size = [], 0, 0
        for number, body in enumerate(bodies):
            part = self.read(body)
            if symbols and size + len(part) > BUFFER:
                yield begin, number, self.hash.sums(np.concatenate(symbols)), np.cumsum([0, *map(len, symbols)])
                symbols, begin, size = [], number, 0
            symbols.append(part)
            size += len(part)
        if symbols:
            yield begin, len(bodies), self.hash.sums(np.concatenate(symbols)), np.cumsum([0, *map(len, symbols)])

    def cells(self, bodies: Sequence[bytes], at: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
        """Of pieces with their bodies (which begin at ``at``): each cell's piece and number, the hash of what its windows have in common and
        of what they cover together, and whether the text goes that far."""
        out: dict[str, list[np.ndarray]] = {c: [np.empty(0, np.int64)] for c in ("piece", "cell", "inner", "outer", "whole")}
        low, high = (place - last) // self.cell, (place - first) // self.cell
        for begin, end, sums, starts in self._packed(bodies):
            piece = np.repeat(np.arange(begin, end), (high - low + 1)[begin:end])
            cell = np.arange(len(piece)) - np.repeat(np.cumsum((high - low + 1)[begin:end]) - (high - low + 1)[begin:end] - low[begin:end], (high - low + 1)[begin:end])
            near, far = cell * self.cell, np.minimum(cell * self.cell + self.cell - 1, self.length - self.gram)
            here = (place - at)[piece] + starts[piece - begin]  # the minimizer in the buffer
            inner = self.hash.window(sums, here - near, here - far + self.length, here - near)
            a, b = here - far, here - near + self.length
            whole = (a >= starts[piece - begin]) & (b <= starts[piece - begin + 1])
            outer = self.hash.window(sums, np.where(whole, a, 0), np.where(whole, b, 0), np.where(whole, a, 0))
            turn = (cell + 1).astype(np.uint64) * ODD
            for c, x in (("piece", piece), ("cell", cell), ("inner", (inner + turn).view(np.int64)), ("outer", (outer + turn).view(np.int64)), ("whole", whole.astype(np.int64))):
                out[c].append(x)
        return {c: np.concatenate(x) for c, x in out.items()}

    def windows(self, bodies: Sequence[bytes], at: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows first to last (of one minimizer) with their bodies: each window's row, start, and hash (which its distance to the minimizer enters)."""
        out = [[np.empty(0, np.int64)] for _ in range(3)]
        sizes = last - first + 1
        for begin, end, sums, starts in self._packed(bodies):
            of = sizes[begin:end]
            row = np.repeat(np.arange(begin, end), of)
            start = np.arange(len(row)) - np.repeat(np.cumsum(of) - of - first[begin:end], of)
            here = start - at[row] + starts[row - begin]
            hashes = self.hash.window(sums, here, here + self.length, here) + (place[row] - start).astype(np.uint64) * ODD
            for c, x in zip(out, (row, start, hashes.view(np.int64)), strict=True):
                c.append(x)
        return tuple(np.concatenate(c) for c in out)


def mark_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 200, words: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(id, text, spans) for each row of docs: the text as bytes, and its repeated stretches as sorted, separate (begin, end).

    A byte is repeated if a string of length bytes that covers it also starts anywhere else in docs, in
    another row or in the same one, overlapping or not. With words, so is one from the first to the last
    byte of so many neighbouring words that also occur elsewhere, however long or short they are and
    whatever white space is between them. Null texts count as empty. Equal rows are each
    other's repeats. The columns in ``carry`` follow; others are ignored.
    """
    return _repeats(docs, id_col, text_col, length, gram, words, carry, None)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 200, words: int | None = None,
                   carry: Sequence[str] = (), whole_characters: bool = False) -> DataFrame:
    """mark_repeats and cut_spans in one pass over the texts: (id, n_bytes, spans, kept) for each row of docs, and the columns in ``carry``."""
    return _repeats(docs, id_col, text_col, length, gram, words, carry, whole_characters)


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order, those that touch made one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.concatenate([new[1:], [True]])]


class _Stretches:
    """A column of lists of (begin, end), a row at a time."""

    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def __init__(self, rows: int):
        self.counts, self.begins, self.ends = np.zeros(rows, np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def put(self, row: int, begin: np.ndarray, end: np.ndarray) -> None:
        if len(begin):
            begin, end = _merged(begin, end)
            self.counts[row] = len(begin)
            self.begins.append(begin)
            self.ends.append(end)

    def array(self) -> pa.Array:
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (self.begins, self.ends)], fields=list(self.kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int32)), values).cast(self.kind)


def _repeats(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, words: int | None, carry: Sequence[str], whole_characters: bool | None) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "repeats")
    id_type = docs.schema[id_col].dataType.simpleString()
    carried = [F.col(c).alias(f"carried{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *carried)
    rows = rows.withColumns({"k": F.xxhash64("id"), "t": F.xxhash64("text")})
    starts = _starts(scratch, rows, length, gram, in_bytes, "").withColumn("in_words", F.lit(False))
    if words is not None:
        starts = starts.unionAll(_starts(scratch, rows, words, -(-words // 2), in_words, "words-").withColumn("in_words", F.lit(True)))

    per_text = starts.groupBy("k", "t").agg(F.collect_set(F.struct("first", "last", "in_words")).alias("starts"))
    joined = rows.join(per_text, ["k", "t"], "left").select("id", "text", "starts", *(f"carried{i}" for i in range(len(carry))))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, texts = batch.column(2), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy()
            first, last, in_words = (c.to_numpy(zero_copy_only=False) for c in listed.flatten().flatten())
            found, stops = _Stretches(batch.num_rows), np.cumsum(sizes)
            for row in np.flatnonzero(sizes).tolist():
                at = slice(stops[row] - sizes[row], stops[row])
                worded = in_words[at]
                begin, end = first[at].astype(np.int64), last[at].astype(np.int64) + length
                if worded.any():
                    places = word_places(texts[row].as_py())
                    begin[worded], end[worded] = places[0][first[at][worded]], places[1][last[at][worded] + words - 1]
                found.put(row, begin, end)
            found = found.array()
            out = [batch.column(0), texts, found]
            if whole_characters is not None:
                kept = pa.array(map(_without, texts.to_pylist(), found.to_pylist(), itertools.repeat(whole_characters)), pa.binary())
                out = [batch.column(0), pc.binary_length(texts).cast(pa.int64()), found, kept]
            yield pa.RecordBatch.from_arrays([*out, *batch.columns[3:]], names=[*names, *batch.schema.names[3:]])

    stretches = "array<struct<begin:int,end:int>>"
    columns = {"id": id_type, "text": "binary", "spans": stretches} if whole_characters is None else {"id": id_type, "n_bytes": "long", "spans": stretches, "kept": "binary"}
    names = list(columns)
    schema = ", ".join([f"{c} {kind}" for c, kind in columns.items()] + [f"carried{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)])
    return joined.mapInArrow(tidied(spans), schema).toDF(id_col, *names[1:], *carry)


def _starts(scratch: Scratch, rows: DataFrame, length: int, gram: int, read: Callable[[bytes], np.ndarray], name: str) -> DataFrame:
    """(k, t, first, last): runs of windows of the rows' texts that also occur elsewhere; lengths and places are in the symbols that read gives."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(length, gram, read)
        for batch in batches:
            found = pieces.of(batch.column(2).to_pylist())
            of = pa.array(found["text"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(found[c].astype(np.int32)) for c in ("first", "last", "place")),
                                              pa.array(found["minimizer"]), pa.array(found["piece"])],
                                             names=["k", "t", "first", "last", "place", "minimizer", "piece"])

    long = rows.filter(F.octet_length("text") >= (2 * length - 1 if read is in_words else length)).select("k", "t", "text")
    pieces = scratch.keep(long.mapInArrow(tidied(cut), "k long, t long, first int, last int, place int, minimizer long, piece long"), f"{name}pieces")
    met = pieces.groupBy("minimizer", apart("minimizer")).count().filter("count > 1").select("minimizer")
    pieces = scratch.keep(pieces.join(met, "minimizer"), f"{name}met")
    scratch.drop(f"{name}pieces")

    # pieces that occur as a whole more than once, each with one occurrence that speaks for it
    one = F.struct("k", "t", "first", "last", "place")
    wholes = pieces.withColumn("key", F.xxhash64("piece", F.col("last") - F.col("first"), F.col("place") - F.col("first")))
    counted = wholes.groupBy("minimizer", "key", F.hash("minimizer", "key").alias("apart")).agg(F.count("*").alias("n"), F.min(one).alias("one"))
    counted = scratch.keep(counted.select("minimizer", "key", "n", "one"), f"{name}wholes")
    whole_spans = scratch.keep(wholes.join(counted.filter("n > 1").select("minimizer", "key"), ["minimizer", "key"]).select("k", "t", "first", "last"), f"{name}whole_spans")
    scratch.drop(f"{name}met")
    # a minimizer with one whole piece and nothing else is settled
    mixed = counted.groupBy("minimizer", apart("minimizer")).count().filter("count > 1").select("minimizer")
    speakers = counted.join(mixed, "minimizer").select("minimizer", (F.col("n") == 1).alias("alone"), "one.*")
    asked = speakers.groupBy("k", "t").agg(F.collect_list(F.struct("minimizer", "alone", "first", "last", "place")).alias("asked"))
    of_piece = "k long, t long, minimizer long, alone boolean, first int, last int, place int"
    names = ["k", "t", "minimizer", "alone", "first", "last", "place"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes around each piece, so that whole texts need not move again."""
        pieces = Pieces(length, gram, read)
        for batch in batches:
            listed = batch.column(3)
            of = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy()))
            columns = listed.flatten().flatten()
            first, last = (columns[i].to_numpy().astype(np.int64) for i in (2, 3))
            ends = np.cumsum(pc.list_value_length(listed).to_numpy())
            at, bodies = [], []
            for text, i, j in zip(batch.column(2).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                found = pieces.bodies(text, first[i:j], last[i:j])
                at += found[0]
                bodies += found[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *columns, pa.array(at, pa.int32()), pa.array(bodies, pa.binary())], names=[*names, "at", "body"])

    bodies = scratch.keep(long.join(asked, ["k", "t"]).select("k", "t", "text", "asked").mapInArrow(tidied(take), f"{of_piece}, at int, body binary"), f"{name}bodies")
    scratch.drop(f"{name}wholes")

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(length, gram, read)
        for batch in batches:
            first, last, place, at = (batch.column(i).to_numpy().astype(np.int64) for i in (4, 5, 6, 7))
            found = pieces.cells(batch.column(8).to_pylist(), at, first, last, place)
            of = pa.array(found["piece"])
            outer = pa.array(found["outer"], mask=found["whole"] == 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(7)), pa.array(found["cell"].astype(np.int32)), pa.array(found["inner"]), outer], names=[*names, "cell", "inner", "outer"])

    cells = scratch.keep(bodies.mapInArrow(tidied(cells_of), f"{of_piece}, cell int, inner long, outer long"), f"{name}cells")

    def twice(df: DataFrame, by: Sequence[str], where: str) -> DataFrame:
        """What occurs at different places, with one of them (equal rows are spread alike, so rows don't count)."""
        place = F.xxhash64("k", "t", where)
        return df.groupBy(*by, F.hash(*by).alias("apart")).agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select(*by, F.col("x").alias("speaks"))

    near = cells.join(twice(cells, ["minimizer", "inner"], "place").drop("speaks"), ["minimizer", "inner"])
    near = near.join(twice(cells.filter("outer IS NOT NULL"), ["minimizer", "outer"], "place"), ["minimizer", "outer"], "left")
    near = scratch.keep(near.select(*names, "cell", "speaks"), f"{name}near")
    scratch.drop(f"{name}cells")
    # the windows of the piece that are in the cell
    size, most = Pieces.cell.fget(Pieces(length, gram, read)), length - gram
    cell_first = F.greatest("first", F.col("place") - F.least(F.col("cell") * size + (size - 1), F.lit(most))).alias("first")
    cell_last = F.least("last", F.col("place") - F.col("cell") * size).alias("last")
    cell_spans = near.filter("alone AND speaks IS NOT NULL").select("k", "t", cell_first, cell_last)
    # of cells that occur as a whole one is enough for the others to be compared with
    asking = near.filter(F.col("speaks").isNull() | (F.col("speaks") == F.xxhash64("k", "t", "place"))).select("k", "t", F.col("first").alias("of"), "minimizer", "alone", cell_first, cell_last, "place")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(length, gram, read)
        for batch in batches:
            first, last, place, at = (batch.column(i).to_numpy().astype(np.int64) for i in (4, 5, 6, 7))
            row, start, hashes = pieces.windows(batch.column(8).to_pylist(), at, first, last, place)
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(4)), pa.array(start.astype(np.int32)), pa.array(hashes)], names=["k", "t", "minimizer", "alone", "start", "hash"])

    around = asking.join(bodies.select("k", "t", F.col("first").alias("of"), "at", "body").dropDuplicates(["k", "t", "of"]), ["k", "t", "of"]).select(*names, "at", "body")
    windows = scratch.keep(around.mapInArrow(tidied(spread), "k long, t long, minimizer long, alone boolean, start int, hash long"), f"{name}windows")
    scratch.drop(f"{name}bodies")
    found = twice(windows, ["minimizer", "hash"], "start").drop("speaks")
    single_spans = windows.filter("alone").join(found, ["minimizer", "hash"]).select("k", "t", F.col("start").alias("first"), F.col("start").alias("last"))
    starts = scratch.keep(whole_spans.unionAll(cell_spans).unionAll(single_spans), f"{name}starts")
    scratch.drop(f"{name}windows", f"{name}near", f"{name}whole_spans")
    return starts


def _without(data: bytes, cuts: Sequence[dict[str, int]], whole_characters: bool) -> bytes:
    """The bytes outside the cuts, or the characters that no cut touches."""

    def inside(at: int) -> bool:
        return whole_characters and at < len(data) and data[at] & 0xC0 == 0x80

    out, at = [], 0
    for cut in cuts:
        begin, end = cut["begin"], cut["end"]
        while inside(begin):
            begin -= 1
        while inside(end):
            end += 1
        out.append(data[at:begin])
        at = max(at, end)
    return b"".join([*out, data[at:]]) if cuts else data


def cut_spans(marked: DataFrame, *, out_col: str = "kept", whole_characters: bool = False) -> DataFrame:
    """marked (as mark_repeats gives it) with the bytes outside its spans in out_col.

    With whole_characters, a UTF-8 character that a span cuts into is removed as a whole.
    """
    names = [f.name for f in marked.schema.fields if f.name != out_col]
    text, spans = names.index("text"), names.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = map(_without, batch.column(text).to_pylist(), batch.column(spans).to_pylist(), itertools.repeat(whole_characters))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], names=[*names, out_col])

    schema = ", ".join([f"`{n}` {marked.schema[n].dataType.simpleString()}" for n in names] + [f"`{out_col}` binary"])
    return marked.select(*names).mapInArrow(run, schema)
