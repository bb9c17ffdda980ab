"""Substring dedup by relative Lempel-Ziv parsing against every indexed reference block.

Each block of documents is a reference block; its index holds the hash of every window of ``window`` words with the
smallest document that has it and the place there, and the blocks' indexes are sharded by hash. A document is parsed
greedily from left to right: where the window at hand is indexed under an earlier document, a factor copies from that
place as far as the document's next windows are indexed at the next places; else a single literal word follows. Factors
are at least ``window`` words long and are duplicate spans. A duplicate window that lies in no factor must reach over a
factor's end, so these are checked too, and the spans cover exactly the words of all windows that an earlier document holds.

Windows are equal if 56 bits of their hash and its shard are; more data has more shards and so more bits.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm import blocks
from kinetra.llm.text import words

SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start:long,length:long,source:long,at:long>>, carried {}"
FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("at", pa.int64())]))


def parse(source: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, source, place in the source); ``source`` has each window's earlier document or -1."""
    hits = np.flatnonzero(source >= 0)
    if not len(hits):
        return []
    breaks = np.flatnonzero((source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    ends = np.append(breaks, len(source))
    factors, at = [], 0
    while (k := np.searchsorted(hits, at)) < len(hits):
        start = int(hits[k])
        end = int(ends[np.searchsorted(breaks, start, side="right")])
        length = end - start + window - 1
        factors.append((start, length, int(source[start]), int(place[start])))
        at = start + length
    return factors


def covered(factors: list[tuple[int, int, int, int]], source: np.ndarray, window: int, n: int) -> np.ndarray:
    """Words in a factor, or in a duplicate window that reaches over a factor's end."""
    edge = np.zeros(n + 1, np.int64)
    if factors:
        start = np.array([f[0] for f in factors])
        end = start + np.array([f[1] for f in factors])
        hits = np.flatnonzero(source >= 0)
        k = np.searchsorted(end, hits, side="right")
        over = hits[(k < len(end)) & (end[np.minimum(k, len(end) - 1)] < hits + window)]
        np.add.at(edge, np.concatenate([start, over]), 1)
        np.add.at(edge, np.concatenate([end, over + window]), -1)
    return np.cumsum(edge[:-1]) > 0


def _block(docs: pa.Table, window: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block in order of ids, its windows, each window's document, and where each document's windows start.

    Words are split one document at a time and not kept: as objects they take ten times the room of the text.
    """
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
    ids, hashes, sizes = docs.column("doc_id").to_pylist(), [], []
    for key, text in zip(ids, docs.column("text"), strict=True):
        h = blocks.window_hashes(blocks.word_hashes(words(text.as_py())), window) if key is not None else np.zeros(0, np.uint64)
        hashes.append(h)
        sizes.append(len(h))
    owner = np.repeat(np.array([i if i is not None else 0 for i in ids], np.int64), sizes)
    return docs, np.concatenate(hashes), owner, np.concatenate([[0], np.cumsum(sizes)])


def dedup(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by a space), factors and carried.

    ``carried`` is a struct of the columns named in ``carry``. With ``as_is``, a text that loses nothing stays as it was.
    A word goes if a window over it also stands in a document with a smaller doc_id. A null text has no words; one
    with fewer words than a window keeps all; rows with a null doc_id are no source and keep all; rows of one doc_id
    are no sources of each other; an empty table gives no rows; other columns are not read.
    """
    others = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in carry or []])
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), others.alias("carried"))
    n_blocks, shards = blocks.counts(rows)

    def offer(table: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple]:
        ordered, h, owner, at = _block(table, window)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        order = np.argsort(first)  # offered in reading order; as documents are in order, the first has the smallest id
        place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
        return h[first[order]], np.stack([owner, place], axis=1)[first[order]], (ordered, owner, place, at, first, back, order)

    def resolve(keys: np.ndarray, numbers: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((numbers[:, 0], keys))  # a document's place is the same in all its entries: it is in one block
        new = np.append(True, keys[order][1:] != keys[order][:-1])
        least = np.empty_like(numbers)
        least[order] = numbers[order][new][np.cumsum(new) - 1]
        places = np.flatnonzero(least[:, 0] < numbers[:, 0])
        return places, least[places]

    def finish(state: tuple, places: np.ndarray, answers: np.ndarray) -> pa.Table:
        ordered, owner, place, at, first, back, order = state
        least = np.stack([owner, place], axis=1)[first]
        least[order[places]] = answers
        source, place = least[back].T
        source = np.where(source >= owner, -1, source)
        out: list[tuple] = []
        for k, text in enumerate(ordered.column("text")):
            w, mine = words(text.as_py()), source[at[k] : at[k + 1]]
            factors = parse(mine, place[at[k] : at[k + 1]], window)
            gone = covered(factors, mine, window, len(w))
            kept = text.as_py() if as_is and not factors else b" ".join(compress(w, ~gone)).decode()
            out.append((len(w), int(gone.sum()), kept, [dict(zip(("start", "length", "source", "at"), f, strict=True)) for f in factors]))
        types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "factors": FACTORS}
        made = {c: pa.array([r[j] for r in out], t) for j, (c, t) in enumerate(types.items())}
        carried = ordered.column("carried").combine_chunks()
        carried = carried.chunk(0) if isinstance(carried, pa.ChunkedArray) else carried
        carried = pa.StructArray.from_arrays(carried.flatten(), [f.name for f in carried.type])  # all fields nullable
        return pa.table({"doc_id": ordered.column("doc_id")} | made | {"carried": carried})

    schema = SCHEMA.format(rows.schema["carried"].dataType.simpleString())
    parsed = blocks.exchange(blocks.in_blocks(rows, n_blocks), shards, offer, resolve, finish, schema, width=2, told=2)
    return parsed.withColumn("carried", F.col("carried").dropFields("none")) if carry else parsed.drop("carried")
