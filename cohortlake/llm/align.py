"""Two tokenizers' tokens of the same texts, side by side.

Each distinct text is tokenised and aligned once: texts are shuffled by their full text and counted, token
pairs are counted over the distinct texts with their numbers of copies, and what is measured of a text is joined
to the documents that hold it.

Tokens are intervals of bytes. Where the ends of both tokenizers' tokens are put in one sorted list, each interval
between neighbours lies in one token of either: it is one link. An end of both closes a group.

A text is cut first where neither tokenizer has a token over the cut: at single spaces and line ends between other
characters, and between letters and marks, as far as the vocabulary allows. What is between two cuts, a segment, is
tokenised and aligned once in each cache of a Python worker, and a text's measures are sums over its segments.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.bpe import broadcast_file
from cohortlake.llm.stage import Scratch, tidied

#: Pairs that are given to the executors whole: 24 bytes each. More are joined by shuffle.
BROADCAST_PAIRS = 2_000_000
#: Segments that a worker remembers, and the characters of all of them.
CACHE_SEGMENTS = 400_000
CACHE_CHARS = 8_000_000
#: Characters of the segments that are given to the tokenizers as one string.
JOINED_CHARS = 2_000
#: Characters of the texts that are looked at together.
GROUP_CHARS = 1 << 22
#: Pairs that a task holds before it passes its counts on.
HELD_PAIRS = 1 << 21
#: Bits of either tokenizer's ids: two of them and a place among the texts of a group go into 64.
ID_BITS = 20

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁ"
MARK = "▁"  # sentencepiece's space


def byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype, width: int | None = None):
        self.all, self.n = np.empty((1024,) if width is None else (1024, width), dtype), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.all):
            wider = np.empty((max(2 * len(self.all), self.n + len(rows)), *self.all.shape[1:]), self.all.dtype)
            wider[:self.n] = self.all[:self.n]
            self.all = wider
        self.all[self.n:self.n + len(rows)] = rows
        self.n += len(rows)


class Aligner:
    """Segments' tokens by a byte-level BPE (a tokenizers file) and by a sentencepiece model, aligned."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first.decode())
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        letters = byte_of_letter()
        vocabulary = self.first.get_vocab()
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.first_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.first_bytes, self.second_bytes)]
        # an id's text within a group and at its end
        self.names = [[np.array([f"{i}{mark}".encode() for i in range(len(x))], dtype=object) for mark in marks] for x, marks in zip(self.sizes, (",|", ",;"), strict=True)]
        if max(map(len, self.sizes)) > 1 << ID_BITS:
            raise ValueError("a vocabulary is too large")
        self.find = self._cuts(pieces).findall

    def _cuts(self, pieces: list[str]) -> re.Pattern[str]:
        """A pattern whose matches are a text's segments. Without sure cuts, the text as a whole."""
        mark, line = self.second.piece_to_id(MARK), self.second.piece_to_id("<0x0A>")
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces) or self.second.encode("\nx")[:2] != [mark, line]:
            return re.compile(r"(?s:.+)")
        joined = {p[m.end() - 1] for p in pieces for m in re.finditer(f"[{LETTERS}][^{LETTERS}]", p)}
        # the apostrophe begins matches of its own in the first tokenizer
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined | {"'"})
        cut = r"(?<=\S)[ \n]\S" + (f"|(?<=[{LETTERS}])[{marks}]" if marks else "")
        word = rf"[ \n]?[{LETTERS}]+(?=[ \n]\S" + (f"|[{marks}])|[{marks}]+(?=[ \\n]\\S)" if marks else ")")
        return re.compile(rf"{word}|(?s:.)(?:(?!{cut})(?s:.))*")

    def tokens(self, segments: list[str]) -> list[list[list[int]]]:
        """The ids of each segment by both tokenizers."""
        first = [e.ids for e in self.first.encode_batch_fast(segments, add_special_tokens=False)]
        # the second tokenizer puts a space before each string: a segment's own, or one before a line end that is then taken off
        spaced = [s[0] == " " for s in segments]
        second = self.second.encode([s[1:] if own else "\n" + s for s, own in zip(segments, spaced, strict=True)], num_threads=1)
        return [first, [ids if own else ids[2:] for ids, own in zip(second, spaced, strict=True)]]

    def _same(self, text: str, first: list[int], second: list[int]) -> bool:
        raw = text.encode()
        return b"".join(map(self.first_bytes.__getitem__, first)) == raw == b"".join(map(self.second_bytes.__getitem__, second))

    def align(self, segments: list[str], named: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of each segment: tokens of the first, of the second, groups and links, all 0 where bytes differ; links' pairs of ids; if named, its groups' text, each with a ; behind."""
        counts, names = np.zeros((len(segments), 4), np.int64), [b""] * len(segments)
        # what begins with a space or line end and ends with neither is cut off surely from whatever is before and behind it
        plain = [i for i, s in enumerate(segments) if s[0] in " \n" and len(s) > 1 and not s[1].isspace() and not s[-1].isspace()]
        chunks, sizes = [], np.cumsum([len(segments[i]) for i in plain])
        for k in np.flatnonzero(np.diff(sizes // JOINED_CHARS, append=-1)).tolist():
            begin = chunks[-1][1] if chunks else 0
            chunks.append((begin, k + 1))
        texts = ["".join([segments[i] for i in plain[j:k]]) for j, k in chunks]
        order, ids = [], [[], []]
        for (j, k), text, *both in zip(chunks, texts, *(self.tokens(texts) if texts else [[], []]), strict=True):
            if self._same(text, *both):
                order += plain[j:k]
                for every, own in zip(ids, both, strict=True):
                    every.append(own)
        done = set(order)
        if rest := [i for i in range(len(segments)) if i not in done]:
            for i, *both in zip(rest, *self.tokens([segments[i] for i in rest]), strict=True):
                if self._same(segments[i], *both):
                    order.append(i)
                    for every, own in zip(ids, both, strict=True):
                        every.append(own)
        if not order:
            return counts, np.empty(0, np.int64), names
        flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in ids]
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, flat, strict=True)]
        closes = np.cumsum([len(segments[i].encode()) for i in order])
        every = np.sort(np.concatenate(ends))
        twice = every[1:] == every[:-1]  # ends of one tokenizer differ
        both, every = every[1:][twice], every[np.append(True, ~twice)]
        at = [np.searchsorted(x, every) for x in ends]
        codes = (flat[0][at[0]] << ID_BITS) | flat[1][at[1]]
        until = [np.searchsorted(x, closes, "right") for x in (*ends, both, every)]
        counts[order] = np.diff(np.stack(until, axis=1), axis=0, prepend=0)
        if named:
            # each token's number and the mark behind it, in the order of groups and, in a group, of tokenizers
            group = [np.searchsorted(both, x) for x in ends]
            words = [np.where(np.append(np.diff(g), 1) > 0, last[x], within[x]) for g, x, (within, last) in zip(group, flat, self.names, strict=True)]
            placed = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
            words, stops, begin = np.concatenate(words)[placed].tolist(), (until[0] + until[1]).tolist(), 0
            for i, stop in zip(order, stops, strict=True):
                names[i], begin = b"".join(words[begin:stop]), stop
        # links of segments in the order in which they were given
        links = np.repeat(np.arange(len(order)), counts[order, 3])
        return counts, codes[np.argsort(np.asarray(order)[links], kind="stable")], names


class Segments:
    """A worker's aligned segments: with their groups and sums over their links if measured, else with their pairs of ids."""

    def __init__(self, first: bytes, second: bytes, measured: bool, pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
        self.aligner, self.measured, self.pairs = Aligner(first, second), measured, pairs
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.names: list[bytes] = []
        self.rows, self.codes, self.times, self.ends = Grown(np.int64, 6), Grown(np.int64), Grown(np.int64), Grown(np.int64)

    def _learn(self, new: list[str]) -> None:
        counts, codes, names = self.aligner.align(new, self.measured)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.chars += sum(map(len, new))
        owner = np.repeat(np.arange(len(new)), counts[:, 3])
        rows = np.zeros((len(new), 6), np.int64)
        rows[:, :4] = counts
        if self.measured:
            self.names += names
            if self.pairs is not None:
                known, n, best = self.pairs
                at = np.searchsorted(known, codes)
                np.add.at(rows[:, 4], owner, best[at])
                np.add.at(rows[:, 5], owner, n[at])
        else:
            owner, codes, times = reduced(owner, codes, np.ones(len(codes), np.int64))
            self.ends.add(self.codes.n + np.cumsum(np.bincount(owner, minlength=len(new))))
            self.codes.add(codes)
            self.times.add(times)
        self.rows.add(rows)

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all texts' segments, and where each text's begin. Each text has one segment at least."""
        if len(self.index) > CACHE_SEGMENTS or self.chars > CACHE_CHARS:
            self.clear()
        gc.disable()  # nothing here makes cycles, and each collection would walk through all that is remembered
        try:
            each = [self.aligner.find(" " + t) for t in texts]
            flat = list(chain.from_iterable(each))
            found = list(map(self.index.get, flat))
            if new := list(dict.fromkeys(compress(flat, map(is_, found, repeat(None))))):
                self._learn(new)
                found = list(map(self.index.__getitem__, flat))
        finally:
            gc.enable()
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(found, np.int64, len(found)), np.cumsum(sizes) - sizes

    def aligned(self, places: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether all segments of a text are the same bytes in both tokenizers."""
        return np.minimum.reduceat(self.rows.all[places, 0], begins) > 0

    def pairs_of(self, texts: list[str], timed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(text, code, and if timed how many links) for each pair of ids that a text links, by text."""
        places, begins = self.places(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(begins, append=len(places)))
        ok = self.aligned(places, begins)[text]
        text, places, repeats = reduced(text[ok], places[ok], np.ones(int(ok.sum()), np.int64) if timed else None)
        starts = np.where(places > 0, self.ends.all[places - 1], 0)
        sizes = self.ends.all[places] - starts
        source = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return reduced(np.repeat(text, sizes), self.codes.all[source], self.times.all[source] * np.repeat(repeats, sizes) if timed else None)

    def measures(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """n_a, n_b, n_groups, n_links, n_best, count_sum and the groups' digest of each text."""
        places, begins = self.places(texts)
        sums, ok = np.add.reduceat(self.rows.all[places], begins), self.aligned(places, begins)
        sums[~ok] = 0
        names, cut = list(map(self.names.__getitem__, places.tolist())), [*begins.tolist(), len(places)]
        return sums, [hashlib.sha256(b"".join(names[i:j])[:-1]).hexdigest() if fine else "" for i, j, fine in zip(cut, cut[1:], ok.tolist(), strict=False)]


def reduced(owner: np.ndarray, codes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Each owner and code once, in their order, with the sum of its counts if there are any."""
    keys = (owner << 2 * ID_BITS) | codes
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    keys = keys[begins]
    return keys >> 2 * ID_BITS, keys & ((1 << 2 * ID_BITS) - 1), counts if counts is None or not len(begins) else np.add.reduceat(counts, begins)


_workers: dict[object, Segments] = {}


def worker(first: Broadcast, second: Broadcast, run: str | None = None, pairs: Broadcast | None = None) -> Segments:
    """The Python worker's segments, kept from task to task: of a run's measures, or, without one, of pairs."""
    measured = run is not None
    key = (hash(first.value), hash(second.value), run)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Segments(first.value, second.value, measured, None if pairs is None else pairs.value)
    return _workers[key]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[object]]]:
    """Texts of GROUP_CHARS together, with the second column's values."""
    for batch in batches:
        texts, others, size = [], [], 0
        for text, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.append(text)
            others.append(other)
            size += len(text)
            if size >= GROUP_CHARS:
                yield texts, others
                texts, others, size = [], [], 0
        if texts:
            yield texts, others


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def pair_counts(distinct: DataFrame, first: Broadcast, second: Broadcast) -> DataFrame:
    """(code, n, best): in how many documents a pair of ids is linked, and whether no other pair of its first id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.int64), np.empty(0, np.int64)

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["code", "n"])

        for texts, copies in _groups(batches):
            text, codes, _ = worker(first, second).pairs_of(texts)
            both = np.concatenate([held[0], codes]), np.concatenate([held[1], np.asarray(copies, np.int64)[text]])
            held = reduced(np.zeros(len(both[0]), np.int64), *both)[1:]
            if len(held[0]) > HELD_PAIRS:
                yield counted()
                held = np.empty(0, np.int64), np.empty(0, np.int64)
        yield counted()

    each = distinct.select("text", "copies").mapInArrow(tidied(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # of one first id there are no more pairs than the second vocabulary has ids
    most = F.max("n").over(Window.partitionBy(F.shiftright("code", ID_BITS)))
    return each.select("code", "n", (F.col("n") == most).alias("best"))


def measure(df: DataFrame, first_path: str, second_path: str, *, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, copies) for each row of df.

    first_path is a byte-level BPE of the tokenizers library, whose tokens are those of a space and the text;
    second_path a sentencepiece model, which adds that space. A pair of ids counts in as many rows of df as hold it
    linked. n_best are links of a pair that no other pair of its first id outnumbers, count_sum sums counts over
    links. Null and empty texts, and those of which one tokenizer's tokens aren't the text's bytes (as the mark that
    sentencepiece has for a space), have zeros and an empty digest. copies are the rows of the same text. Null ids and
    repeated rows give a row each; other columns are ignored.
    """
    spark = df.sparkSession
    scratch, first, second = Scratch(spark, "align"), broadcast_file(spark, first_path), broadcast_file(spark, second_path)
    has_text = F.col("text").isNotNull() & (F.col("text") != "")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    distinct = scratch.keep(rows.filter(has_text).groupBy("text").agg(F.count("*").alias("copies")).select("text", "copies"), "distinct")
    pairs = scratch.keep(pair_counts(distinct, first, second), "pairs")
    small, run_id, known = pairs.count() <= broadcast_pairs, scratch.path, None
    if small:
        table = pairs.orderBy("code").toArrow()
        known = spark.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in range(3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, copies in _groups(batches):
            sums, digests = worker(first, second, run_id, known).measures(texts)
            keys = [hashlib.sha256(t.encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(copies, pa.int64()), *(pa.array(sums[:, i]) for i in range(6)), pa.array(digests, pa.string())], names=["key", "copies", *MEASURES, "groups_sha256"])

    def run_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in _groups(batches):
            text, codes, times = worker(first, second).pairs_of(texts, timed=True)
            keys = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(text)), pa.array(codes), pa.array(times)], names=["key", "code", "times"])

    columns = ", ".join(f"{c} long" for c in MEASURES)
    measured = distinct.select("text", "copies").mapInArrow(tidied(run), f"key binary, copies long, {columns}, groups_sha256 string")
    if not small:
        links = distinct.select("text", "copies").mapInArrow(tidied(run_links), "key binary, code long, times long").join(pairs, "code")
        sums = links.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        measured = measured.drop("n_best", "count_sum").join(sums, "key", "left")
    # rows without a text go by their id, so that they don't meet in one place
    keyed = rows.select("id", F.when(has_text, digest).otherwise(F.encode(F.coalesce(F.col("id").cast("string"), F.lit("")), "UTF-8")).alias("key"))
    found = keyed.join(scratch.keep(measured, "measured"), "key", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in MEASURES]
    return found.select(F.col("id").alias(id_col), *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"), F.coalesce("copies", F.lit(0)).alias("copies"))
