"""Packing as vector bin packing: sequences under limits on tokens, segments and loss-bearing tokens.

One sequence is open at a time. The dot-product heuristic puts into it, of the waiting pieces that fit in every limit,
the one whose demands (as shares of the limits) have the largest dot product with what is left. If none fits, the
piece with most room is cut to fill the rest. Documents longer than a sequence give full sequences of their own first.
Tasks pack their own documents, dealt out by a hash of their id and sorted, so that a task that runs again after
a loss packs alike; what is open at a task's end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.text import PRE_TOKEN, vocabulary

#: Limits of a sequence in ``pack_limited``: tokens, segments, tokens that bear loss.
TOKENS, SEGMENTS, LOSS = 2048, 12, 1984
#: Bytes of text for each leading token that counts as prompt there: an eighth of a text or so.
PROMPT_BYTES = 32
#: Pieces among which the heuristic chooses (a task's memory bound; all pieces are placed).
WAITING = 1024


class Packer:
    """Places pieces (key, start, length, loss) into sequences; ``done`` holds the finished ones."""

    def __init__(self, tokens: int, segments: int, loss: int) -> None:
        self.limits = np.array([tokens, segments, loss], dtype=float)
        self.keys: list = []
        self.demand = np.zeros((0, 3))
        self.fresh: list = []
        self.open: list = []
        self.left = self.limits.copy()
        self.done: list[list] = []

    def add(self, key: object, start: int, length: int, prompt: int) -> None:
        """A piece; ids of its document before ``prompt`` bear no loss."""
        whole, most = int(self.limits[0]), self._loss_room(start, prompt)
        while length >= whole and most >= whole:
            self.done.append([(key, start, whole)])
            start, length = start + whole, length - whole
            most = self._loss_room(start, prompt)
        while length:
            take = min(length, whole - 1 if length > whole else length)
            loss = max(0, start + take - max(start, prompt))
            if loss > self.limits[2]:
                take -= int(loss - self.limits[2])
                loss = int(self.limits[2])
            self.fresh.append((key, start, take, prompt, loss))
            start, length = start + take, length - take
        if len(self.fresh) + len(self.keys) >= WAITING:
            self.place(WAITING // 2)

    def _loss_room(self, start: int, prompt: int) -> float:
        return self.limits[2] + max(0, prompt - start)

    def place(self, keep: int) -> None:
        """Places waiting pieces until ``keep`` of them are left."""
        if self.fresh:
            self.keys += self.fresh
            self.demand = np.concatenate([self.demand, np.array([(x[2], 1, x[4]) for x in self.fresh], dtype=float)])
            self.fresh = []
        alive = np.ones(len(self.keys), dtype=bool)
        n = len(self.keys)
        while n > keep:
            fits = alive & (self.demand <= self.left).all(axis=1)
            if fits.any():
                at = int(np.argmax(np.where(fits, (self.demand / self.limits) @ (self.left / self.limits), -1.0)))
                self._put(self.keys[at])
                alive[at] = False
                n -= 1
            elif self.left[1] >= 1 and self.left[0] >= 1 and self.left[2] >= 1:
                at = int(np.argmax(np.where(alive, self.demand[:, 0], -1.0)))
                key, start, length, prompt, _ = self.keys[at]
                cut = int(min(self.left[0], self._room(start, prompt), length))
                self._put((key, start, cut, prompt, self._loss(start, cut, prompt)))
                rest = (key, start + cut, length - cut, prompt, self._loss(start + cut, length - cut, prompt))
                if rest[2]:
                    self.keys[at] = rest
                    self.demand[at] = (rest[2], 1, rest[4])
                else:
                    alive[at] = False
                    n -= 1
            else:
                self._close()
            if self.left[0] < 1:
                self._close()
        self.keys = [k for k, a in zip(self.keys, alive, strict=True) if a]
        self.demand = self.demand[alive]

    def _room(self, start: int, prompt: int) -> float:
        return self.left[2] + max(0, prompt - start)

    @staticmethod
    def _loss(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    def _put(self, piece: tuple) -> None:
        self.open.append(piece[:3])
        self.left -= (piece[2], 1, piece[4])

    def _close(self) -> None:
        if self.open:
            self.done.append(self.open)
        self.open, self.left = [], self.limits.copy()

    def finish(self) -> None:
        """Places all that waits; the last sequence is cut into such whose lengths are powers of two."""
        self.place(0)
        rest = [list(p) for p in self.open]
        total = sum(p[2] for p in rest)
        whole = int(self.limits[0])
        while total:
            size = min(1 << (total.bit_length() - 1), whole)
            total -= size
            one = []
            while size:
                key, start, length = rest[0]
                cut = min(size, length)
                one.append((key, start, cut))
                size -= cut
                if cut == length:
                    rest.pop(0)
                else:
                    rest[0] = [key, start + cut, length - cut]
            self.done.append(one)
        self.open, self.left = [], self.limits.copy()

    def take(self) -> list[list]:
        done, self.done = self.done, []
        return done


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    """The file's vocabulary in a library that encodes whole texts faster; merges are in the order of their ids."""
    import tiktoken

    vocab = vocabulary(path)
    ranks = {b: i for i, b in vocab.bytes_of.items() if i not in vocab.special.values()}
    return tiktoken.Encoding("file", pat_str=PRE_TOKEN.pattern, mergeable_ranks=ranks, special_tokens=vocab.special)


@lru_cache(maxsize=2)
def _own_library(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def ids_of(text: str | None, path: str) -> list[int]:
    """Ids as the file's own library gives them, special strings in the text included.

    The faster library gives up on a run of a million spaces or so (its pattern backtracks); such a text is encoded by the file's own.
    """
    if not text:
        return []
    try:
        return _encoding(path).encode(text, allowed_special="all")
    except ValueError:
        return _own_library(path).encode(text, add_special_tokens=False).ids


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 1, tokens: int = 2048, segments: int = 512, loss: int | None = None, prompt: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    A document is its text's ids and then ``end``; ``prompt`` names a column with the number of leading ids that bear
    no loss (null: 0). A null or empty text is its end id alone; repeated rows are documents of their own; a null
    doc_id stays null; an empty table gives no pieces; other columns are left out.
    """
    most = tokens if loss is None else loss
    kind = docs.schema[doc_id].dataType.simpleString()
    head = F.coalesce(F.col(f"`{prompt}`").cast("long"), F.lit(0).cast("long")) if prompt else F.lit(0).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), head.alias("prompt"))
    rows = rows.repartition(F.xxhash64("doc_id", F.length("text"))).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, next_id, n = Packer(tokens, segments, most), TaskContext.get().partitionId() << 33, 0
        held: dict[int, list] = {}  # a document's id, ids and how many of them are not handed on yet

        def out(done: list[list], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            cols: list[list] = [[] for _ in range(7)]
            for sequence in done:
                offset = 0
                for key, start, length in sequence:
                    doc = held[key]
                    for c, v in zip(cols, (doc[0], start, length, doc[1][4 * start : 4 * (start + length)], len(doc[1]) // 4, next_id, offset), strict=True):
                        c.append(v)
                    offset += length
                    doc[2] -= length
                    if not doc[2]:
                        del held[key]
                next_id += 1
            types = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        key_kind = None
        for batch in batches:
            key_kind = batch.schema.field(0).type
            for key, value, before in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = array("I", ids_of(value.as_py(), tokenizer))
                ids.append(end)
                held[n] = [key, ids.tobytes(), len(ids)]
                packer.add(n, 0, len(ids), before)
                n += 1
                if len(packer.done) >= 256:
                    yield from out(packer.take(), key_kind)
        if key_kind is not None:
            packer.finish()
            yield from out(packer.take(), key_kind)

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_limited(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``pack`` for documents without prompts of their own: one leading token for every ``PROMPT_BYTES`` bytes bears no loss."""
    head = F.floor(F.octet_length(F.col(f"`{text}`")) / PROMPT_BYTES)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), head.alias("prompt"))
    return pack(rows, tokenizer, tokens=TOKENS, segments=SEGMENTS, loss=LOSS, prompt="prompt")
