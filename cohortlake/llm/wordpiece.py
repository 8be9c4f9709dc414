"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word, and pieces that continue one.
Each node has a failure link, followed when the next character has no edge, and the number of
pieces that following it pops; both are computed once, breadth first. A word is then counted in one
pass over its characters, whatever its length, and no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.stage import prepare

#: Entries of the per-worker cache of counted words (words of up to CACHE_CHARS); it is emptied when full.
CACHE_ENTRIES = 500_000
CACHE_CHARS = 64
NOWHERE = -1

_workers: dict[int, "LongestMatch"] = {}


class LongestMatch:
    """Greedy longest-match piece counts. A word that some character keeps from being covered counts as one unknown piece."""

    def __init__(self, begin: Iterable[str], inside: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        accepts = [False, False]
        for root, pieces in ((0, begin), (1, inside)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        accepts.append(False)
                    node = self.edges[node][c]
                accepts[node] = node != 1  # an empty continuation would never end
        self.fail, self.pops = [NOWHERE] * len(self.edges), [0] * len(self.edges)
        if accepts[0]:
            self.fail[0], self.pops[0] = 1, 1
        level = [0, 1]
        while level:
            deeper = []
            for node in level:
                for c, child in self.edges[node].items():
                    deeper.append(child)
                    if accepts[child]:
                        self.fail[child], self.pops[child] = 1, 1
                        continue
                    popped, at = self.pops[node], self.fail[node]
                    while at != NOWHERE and c not in self.edges[at]:
                        popped, at = popped + self.pops[at], self.fail[at]
                    if at != NOWHERE:
                        self.fail[child], self.pops[child] = self.edges[at][c], popped
            level = deeper
        count = self.count

        class Counted(dict):
            def __missing__(self, word: str) -> int:
                n = count(word)
                if len(word) <= CACHE_CHARS:
                    if len(self) >= CACHE_ENTRIES:
                        self.clear()
                    self[word] = n
                return n

        self.counted = Counted()

    def count(self, word: str) -> int:
        """Pieces of the word; 0 if it can't be covered."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = n = 0
        for c in word:
            while (after := edges[node].get(c)) is None:
                n, node = n + pops[node], fail[node]
                if node < 0:
                    return 0
            node = after
        while node != 1:
            n, node = n + pops[node], fail[node]
            if node < 0:
                return 0
        return n


def sentencepiece_pieces(path: str, mark: str = "▁") -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece model that begin a word (mark taken off) and that continue one.

    Pieces with the mark elsewhere, control pieces, the unknown piece and single-byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [p[1:] for p in plain if p.startswith(mark) and mark not in p[1:]], [p for p in plain if p and mark not in p]


def automaton_of(key: int, pieces: Broadcast) -> LongestMatch:
    """The Python worker's automaton, which keeps its cache from task to task."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = LongestMatch(*pieces.value)
    return _workers[key]


def count_tokens(df: DataFrame, begin: list[str], inside: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) for each row of df; words are the runs between white space.

    A word the pieces can't cover is one token and counts in n_unknown too. Null and empty texts have
    none. Null keys and repeated rows give a row each; other columns of df are ignored.
    """
    prepare(df.sparkSession)
    pieces = df.sparkSession.sparkContext.broadcast((begin, inside))  # a vocabulary: its size doesn't depend on df
    key = hash((tuple(begin), tuple(inside)))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = automaton_of(key, pieces).counted
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                counts = list(map(counted.__getitem__, (text or "").split()))
                none = counts.count(0)
                words.append(len(counts))
                tokens.append(sum(counts) + none)
                unknown.append(none)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=["id", "n_words", "n_tokens", "n_unknown"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
