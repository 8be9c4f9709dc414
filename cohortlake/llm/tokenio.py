"""Token ids in Simple-8b files.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector says how many ids of how
many bits are packed. Ids are packed in blocks of ``BLOCK``, each beginning a new word, and the place
of each block's first word is kept, so blocks encode and decode side by side in numpy. An id of more
than 60 bits is stored as 0 and listed as an escape.

A file is a Parquet file of packets. A packet holds the ids of one or more whole documents in order:
``shard, packet, first, doc_ids, counts, n_ids, words, block_starts, escape_places, escape_ids``, where
``first`` counts the shard's ids before it.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortlake.llm.bpe import broadcast_file
from cohortlake.llm.stage import tidied

#: Simple-8b's selectors: ids in a word and bits of each (fixed values of the format; 0 and 1 are runs of zeros).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 256
#: Ids after which a packet is closed; a longer document has a packet of its own.
PACKET_IDS = 1 << 19
GROUP_BYTES = 8 << 20
#: Entries of the per-worker cache of encoded strings (of up to CACHE_CHARS).
CACHE_ENTRIES = 1_000_000
CACHE_CHARS = 64
#: Words that the library is given in one string.
JOINED = 128


def _needed(ids: np.ndarray) -> np.ndarray:
    return (1 + np.searchsorted(np.uint64(1) << BITS[1:].astype(np.uint64), ids, side="right")).astype(np.int8)


_NEED = _needed(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, each block's first word, and places and values of the escapes."""
    ids = np.asarray(ids, dtype=np.uint64)
    places = np.flatnonzero(ids >> np.uint64(60))
    escapes = ids[places]
    n = len(ids)
    if not n:
        return np.empty(0, "<u8"), np.empty(0, np.int32), places.astype(np.int32), escapes
    lanes = -(-n // BLOCK)
    grid = np.zeros(lanes * BLOCK, dtype=np.uint64)
    grid[:n] = ids
    grid[places] = 0
    left = np.minimum(BLOCK, n - np.arange(lanes) * BLOCK)
    # for each place, the first selector that holds its id, and the first whose whole count of ids it holds
    need = np.full((lanes, 2 * BLOCK), 127, dtype=np.int8)
    need[:, :BLOCK] = (_NEED[grid] if grid.max() < len(_NEED) else _needed(grid)).reshape(lanes, BLOCK)
    need[:, :BLOCK][np.arange(BLOCK) >= left[:, None]] = 127
    most, span = need, 1
    selector = np.full((lanes, BLOCK), 15, dtype=np.int8)
    for s in range(14, -1, -1):
        c = int(COUNTS[s])
        while 2 * span <= c:  # the most of twice as many neighbours
            after = np.full_like(most, 127)
            after[:, :-span] = most[:, span:]
            most, span = np.maximum(most, after), 2 * span
        fits = np.maximum(most[:, :BLOCK], most[:, c - span:c - span + BLOCK]) <= max(s, 1)
        if not fits.any() and s > 1:
            break  # more ids of fewer bits fit even less
        selector[fits] = s
    selector = selector.ravel()
    # all blocks take one word at each step
    at, words, owners = np.zeros(lanes, dtype=np.int64), [], []
    live = np.arange(lanes)
    while len(live):
        first = live * BLOCK + at[live]
        s = selector[first].astype(np.int64)
        word = s.astype(np.uint64) << np.uint64(60)
        for one in np.flatnonzero(np.bincount(s)[2:]) + 2:
            rows = np.flatnonzero(s == one)
            c, b = int(COUNTS[one]), int(BITS[one])
            taken = grid[first[rows][:, None] + np.arange(c)]
            word[rows] |= np.bitwise_or.reduce(taken << (np.arange(c, dtype=np.uint64) * np.uint64(b)), axis=1)
        words.append(word)
        owners.append(live)
        at[live] += COUNTS[s]
        live = live[at[live] < left[live]]
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(lanes))
    return np.concatenate(words)[order].astype("<u8"), starts.astype(np.int32), places.astype(np.int32), escapes


def unpack(words: np.ndarray, places: np.ndarray = (), escapes: np.ndarray = ()) -> np.ndarray:
    """The ids of whole blocks."""
    words = np.asarray(words, dtype=np.uint64)
    s = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[s])
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    begins = ends - COUNTS[s]
    for one in np.flatnonzero(np.bincount(s)[2:]) + 2:
        rows = np.flatnonzero(s == one)
        b, some, at = int(BITS[one]), words[rows], begins[rows]
        for i in range(int(COUNTS[one])):
            ids[at + i] = (some >> np.uint64(i * b)) & np.uint64((1 << b) - 1)
    ids[np.asarray(places, dtype=np.int64)] = np.asarray(escapes, dtype=np.uint64)
    return ids


def unpack_part(words: np.ndarray, block_starts: np.ndarray, places: np.ndarray, escapes: np.ndarray, n: int, begin: int, end: int) -> np.ndarray:
    """The ids from begin to end (not included) of n, from the blocks that hold them alone."""
    if begin >= end:
        return np.empty(0, np.uint64)
    one, last = begin // BLOCK, (end - 1) // BLOCK
    stop = block_starts[last + 1] if last + 1 < len(block_starts) else len(words)
    ids = unpack(np.asarray(words)[block_starts[one]:stop])
    places = np.asarray(places, dtype=np.int64)
    here = (places >= one * BLOCK) & (places < min(n, (last + 1) * BLOCK))
    ids[places[here] - one * BLOCK] = np.asarray(escapes, dtype=np.uint64)[here]
    return ids[begin - one * BLOCK:end - one * BLOCK]


#: A word of letters that every Unicode version knows, the marks behind it, and the same after a line end: each part is a match of the pre-tokeniser of its own.
WORD_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏЀ-ҁ]+)([!-&(-/:-@\[-`{-~]*)(?:\n([A-Za-zÀ-ÖØ-öø-ɏЀ-ҁ]+)([!-&(-/:-@\[-`{-~]*))?")


class LibraryEncoder:
    """The tokenizers library's ids of whole texts, as uint32, through a cache of the strings between spaces.

    The library's byte-level pre-tokeniser always begins a match at a space that a non-space follows, so
    a text's ids are those of its cuts there. Of a cut not yet in the cache, words, marks behind them and a
    word after a line end are matches of their own; new ones are encoded many in one string, each behind its
    space or line end, whose token then begins it. Texts that hold one of the tokenizer's added tokens go to
    the library whole, unless special_as_text makes them ordinary text.
    """

    def __init__(self, raw: bytes, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = special_as_text
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and token.special)]
        self.added = "|".join(re.escape(content) for content in added if content)
        vocabulary = self.tokenizer.get_vocab()
        # the byte-level alphabet's space and line end
        self.begins = {first: np.zeros(max(vocabulary.values()) + 1, dtype=bool) for first in " \n"}
        self.begins[" "][[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.begins["\n"][[i for token, i in vocabulary.items() if token == "\u010a"]] = True
        # ids of strings behind a space
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.after_line: dict[str, bytes] = {}  # ids of words behind a line end, with it
        self.marks: dict[str, bytes] = {"": b""}

    def _known(self, strings: list[str]) -> list[bytes | None]:
        return list(map(self.young.get, strings, map(self.old.get, strings)))

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_after(self, first: str, words: list[str]) -> list[bytes]:
        """The ids of each word with ``first`` before it."""
        found = []
        for i in range(0, len(words), JOINED):
            some = words[i:i + JOINED]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join([first + w for w in some])], add_special_tokens=False)[0].ids, dtype="<u4")
            at = (np.flatnonzero(self.begins[first][ids]) * 4).tolist()
            if len(at) != len(some):
                found += self._encode_each([first + w for w in some])
                continue
            raw = ids.tobytes()
            found += [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)]
        return found

    def _learn(self, cuts: list[str]) -> dict[str, bytes]:
        """The ids of cuts that aren't known; they are then, but for long ones."""
        if len(self.after_line) > CACHE_ENTRIES // 8:
            self.after_line.clear()
        if len(self.marks) > CACHE_ENTRIES // 64:
            self.marks = {"": b""}
        lines, marks, words, split, odd = self.after_line, self.marks, set(), [], []
        for c in cuts:
            if len(c) > CACHE_CHARS:
                odd.append(c)
            elif c.isascii() and c.isalpha():
                words.add(c)
            elif m := WORD_AND_MARKS.fullmatch(c):
                split.append((c, m.groups()))
                words.add(m[1])
            else:
                odd.append(c)
        words = list(words)
        found = dict(zip(words, self._known(words), strict=True))
        new = [w for w, ids in found.items() if ids is None]
        found.update(zip(new, self._encode_after(" ", new), strict=True))
        new = [w for w in {x[2] for _, x in split if x[2]} if w not in lines]
        lines.update(zip(new, self._encode_after("\n", new), strict=True))
        new = [m for m in {m for _, x in split for m in (x[1], x[3] or "")} if m not in marks]
        marks.update(zip(new, self._encode_each(new), strict=True))
        for c, (word, behind, line, end) in split:
            found[c] = found[word] + marks[behind] + (lines[line] + marks[end] if line else b"")
        found.update(zip(odd, self._encode_each([" " + c for c in odd]), strict=True))
        self.young.update(found)
        for c in odd:
            if len(c) > CACHE_CHARS:
                del self.young[c]
        return found

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), each with the ids of ``end`` behind, and where each text's begin; one number more than texts."""
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        gc.disable()  # nothing here makes cycles, and each collection would walk through the cache
        try:
            return self._encode(texts, end)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        # a text with a space that no word follows can't be cut at every space: the library takes it as a whole
        whole = pc.match_substring_regex(texts, pattern=r" ([\s\p{Z}]|\x1c|\x1d|\x1e|\x1f|\x{85}|$)" + (f"|{self.added}" if self.added else ""))
        cut = pc.split_pattern(pc.if_else(whole, pa.scalar("", texts.type), texts), " ")
        begins = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        at, strings = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # the first cut of a text has no space before it
        heads = pc.if_else(whole, texts, pc.list_element(cut, 0)).to_pylist()
        at[begins[:-1]] = len(strings) + np.arange(len(heads))
        used = np.zeros(len(strings) + len(heads), dtype=bool)
        used[at] = True
        known = self._known(strings)
        new = [i for i, (x, u) in enumerate(zip(known, used.tolist())) if x is None and u]
        learned = self._learn([strings[i] for i in new])
        for i in new:
            known[i] = learned[strings[i]]
        if len(self.young) > CACHE_ENTRIES // 2:  # what this group asked for stays, the rest will be forgotten if it isn't asked for again
            self.young, self.old = {s: x for s, x in zip(strings, known, strict=True) if x is not None and len(s) <= CACHE_CHARS}, self.young
        known = [x or b"" for x in known]  # a string that only begins texts isn't asked for behind a space
        ids = [*known, *self._encode_each(heads), end]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, starts = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(sizes) - sizes
        at = np.insert(at, begins[1:], len(ids) - 1)
        begins = begins + np.arange(len(begins))
        ends = np.cumsum(sizes[at])
        source = np.arange(int(ends[-1]))
        source += np.repeat(starts[at] - (ends - sizes[at]), sizes[at])
        return table[source], np.concatenate([[0], ends])[begins]


_workers: dict[tuple[int, bool], LibraryEncoder] = {}


def encoder_of(raw: bytes, special_as_text: bool) -> LibraryEncoder:
    """The Python worker's encoder, which keeps its cache from task to task.

    A function of the module's own is sent to workers by name; what a nested function refers to would be copied for each task.
    """
    key = (hash(raw), special_as_text)
    if key not in _workers:
        _workers.clear()
        _workers[key] = LibraryEncoder(raw, special_as_text)
    return _workers[key]


PACKETS = "shard int, packet int, first long, doc_ids array<{id}>, counts array<int>, n_ids long, words binary, block_starts array<int>, escape_places array<int>, escape_ids array<decimal(20,0)>"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of GROUP_BYTES or more together: words repeat more often in a larger group."""
    group, size = [], 0
    for batch in batches:
        if batch.num_rows:
            group.append(batch)
            size += batch.nbytes
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> None:
    """Writes the ids of whole texts, each with end_id after it, in ascending order of id_col (nulls first; rows of one id by a hash of the text).

    Shards are ranges of that order: shard k is written by one task and holds what is before shard k + 1.
    Rows that repeat an id, or have none, spread over several shards if there are many. Null texts count as
    empty. Repeated rows are written each. Other columns are ignored. A special token's string in a text
    becomes that token, as the library has it by default, unless special_as_text.
    """
    tokenizer = broadcast_file(docs.sparkSession, tokenizer_path)
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the last key only tells equal rows apart, so that any number of them can be dealt out
    rows = rows.withColumns({"turn": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("id", "turn", "row").sortWithinPartitions("id", "turn", "row").select("id", "text")
    arrow_id, ints = to_arrow_type(id_type), pa.list_(pa.int32())
    types = {"shard": pa.int32(), "packet": pa.int32(), "first": pa.int64(), "doc_ids": pa.list_(arrow_id), "counts": ints, "n_ids": pa.int64(), "words": pa.binary(), "block_starts": ints, "escape_places": ints, "escape_ids": pa.list_(pa.decimal128(20, 0))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, packet = encoder_of(tokenizer.value, special_as_text), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], dtype="<u4").tobytes()
        keys, waiting, n, first = [], [], 0, 0

        def close() -> pa.RecordBatch:
            words, starts, places, escapes = pack(np.concatenate(waiting))
            row = [shard, packet, first, keys, [len(x) for x in waiting], n, words.tobytes(), starts.tolist(), places.tolist(), [int(x) for x in escapes]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types.values(), strict=True)], names=list(types))

        for group in _grouped(batches):
            ids, begins = encoder.encode(pa.concat_arrays([b.column(1) for b in group]), end)
            for key, i, j in zip((k for b in group for k in b.column(0).to_pylist()), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                if keys and n + j - i > PACKET_IDS:
                    yield close()
                    keys, waiting, n, packet, first = [], [], 0, packet + 1, first + n
                keys.append(key)
                waiting.append(ids[i:j])
                n += j - i
        if keys:
            yield close()

    rows.mapInArrow(tidied(run), PACKETS.format(id=id_type.simpleString())).write.mode("error").parquet(path)


def read_ids(spark: SparkSession, path: str, *, id_type: str = "bigint", only: Sequence[object] | None = None) -> DataFrame:
    """(shard, packet, doc_id, place, start, ids) for each document of the files; ids is binary, little-endian uint32.

    ``start`` counts the ids of all documents before it, ``place`` is its number in the packet. With
    ``only``, a list of ids, packets without any of them are skipped and of the others just the blocks
    that hold them are decoded.
    """
    packets = spark.read.schema(PACKETS.format(id=id_type)).parquet(path)
    # a row for each shard, that is for each task that wrote: few enough for one window and a broadcast
    shards = packets.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    arrow_id = to_arrow_type(packets.schema["doc_ids"].dataType.elementType)
    wanted = None if only is None else set(only)
    if only is not None:
        packets = packets.filter(F.arrays_overlap("doc_ids", F.array(*map(F.lit, only)).cast(f"array<{id_type}>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, packet, first, keys, counts, n_ids, places, escapes = (batch.column(j)[i].as_py() for j in (0, 1, 2, 3, 4, 5, 8, 9))
                words = np.frombuffer(batch.column(6)[i].as_buffer(), dtype="<u8")
                escapes = [int(x) for x in escapes]
                ends = np.cumsum(counts)
                begins = ends - np.asarray(counts)
                if wanted is None:
                    ids = unpack(words, places, escapes).astype("<u4")
                    taken, offsets = range(len(keys)), np.concatenate([[0], ends * 4]).astype("<i4" if len(ids) < 1 << 29 else "<i8")
                    found = pa.Array.from_buffers(pa.binary() if offsets.itemsize == 4 else pa.large_binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
                else:
                    starts = batch.column(7)[i].values.to_numpy()
                    taken = [j for j, key in enumerate(keys) if key in wanted]
                    found = pa.array([unpack_part(words, starts, places, escapes, n_ids, int(begins[j]), int(ends[j])).astype("<u4").tobytes() for j in taken], pa.binary())
                n = len(taken)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([packet] * n, pa.int32()), pa.array([keys[j] for j in taken], arrow_id), pa.array(taken, pa.int32()), pa.array(first + begins[list(taken)], pa.int64()),
                     found],
                    names=["shard", "packet", "doc_id", "place", "offset", "ids"])

    docs = packets.mapInArrow(tidied(run), f"shard int, packet int, doc_id {id_type}, place int, offset long, ids binary")
    starts = (F.col("shard_start") + F.col("offset")).alias("start")
    return docs.join(F.broadcast(shards), "shard").select("shard", "packet", "doc_id", "place", starts, "ids")
