"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's leaves are the ranks of the adjacent pairs of a pre-token's symbols. Its root tells the lowest rank, a walk
down to the left its leftmost place. A merge updates three leaves in logarithmic time, so a pre-token of m bytes
takes O(m log m), however long it is. Each process keeps the ids of pre-tokens it has met, up to ``CACHE``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.text import PRE_TOKEN, Vocabulary, vocabulary

#: Pre-tokens whose ids a process keeps (memory bound; when full, it starts anew).
CACHE = 1 << 19
#: Rows handed back to Spark at once, and the bytes of text after which rows are handed back anyway.
ROWS, BYTES = 512, 4 << 20
NONE = 1 << 40


class PairTree:
    """Ranks of adjacent pairs in a segment tree of minima."""

    def __init__(self, ranks: list[int]) -> None:
        self.size = 1
        while self.size < len(ranks):
            self.size *= 2
        self.low = [NONE] * self.size + ranks + [NONE] * (self.size - len(ranks))
        for k in range(self.size - 1, 0, -1):
            self.low[k] = min(self.low[2 * k], self.low[2 * k + 1])

    def leftmost_lowest(self) -> int:
        """The leftmost place of the lowest rank, or -1 if no pair can be merged."""
        low, k = self.low, 1
        best = low[1]
        if best == NONE:
            return -1
        while k < self.size:
            k *= 2
            if low[k] != best:
                k += 1
        return k - self.size

    def update(self, place: int, rank: int) -> None:
        low, k = self.low, place + self.size
        low[k] = rank
        k //= 2
        while k:
            now = min(low[2 * k], low[2 * k + 1])
            if low[k] == now:
                break
            low[k] = now
            k //= 2


def merge_piece(piece: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one pre-token."""
    ids = [vocab.byte_id[b] for b in piece]
    n = len(ids)
    if n < 2:
        return ids
    merges = vocab.merges

    def rank(a: int, b: int) -> int:
        found = merges.get((ids[a], ids[b]))
        return found[0] if found else NONE

    tree = PairTree([rank(k, k + 1) for k in range(n - 1)])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (k := tree.leftmost_lowest()) >= 0:
        gone = after[k]
        ids[k] = merges[ids[k], ids[gone]][1]
        ids[gone] = -1
        after[k] = far = after[gone]
        if gone < n - 1:
            tree.update(gone, NONE)
        if far < n:
            before[far] = k
            tree.update(k, rank(k, far))
        else:
            tree.update(k, NONE)
        if before[k] >= 0:
            tree.update(before[k], rank(before[k], k))
    return [i for i in ids if i >= 0]


class Encoder:
    """Encodes and decodes whole texts with a vocabulary."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> array:
        """Ids as unsigned 32-bit integers; a special string in the text becomes its id."""
        ids, known = array("I"), self.known
        for k, section in enumerate(self.vocab.sections(text or "")):
            if k % 2:
                ids.append(self.vocab.special[section])
                continue
            for piece in PRE_TOKEN.findall(section):
                got = known.get(piece)
                if got is None:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = got = merge_piece(piece.encode(), self.vocab)
                ids.extend(got)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, ids (binary: little-endian unsigned 32-bit) and decoded (the ids' text).

    Rows are handled where they are read, without a shuffle. A null or empty text has no ids and decodes to the empty
    text; repeated rows are encoded each; a null doc_id stays null; other columns are left out.
    """
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            keys, rows, size = batch.column(0), [], 0
            start = 0
            for at, value in enumerate(batch.column(1)):
                ids = encoder.encode(value.as_py())
                rows.append((ids.tobytes(), decoded := encoder.decode(ids)))
                size += len(decoded)
                if len(rows) >= ROWS or size > BYTES or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(start, len(rows)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                        ["doc_id", "ids", "decoded"],
                    )
                    start, rows, size = at + 1, [], 0

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, ids binary, decoded string")
