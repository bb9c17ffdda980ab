"""Blocks of documents that meet at a sharded index of hashes.

Documents are dealt into blocks of some MB by a hash. A block's task offers its distinct 64-bit hashes, packed by
shard, each hash once for a block however often it stands there; a shard's task sees all blocks' entries of its
hashes and answers each block; the block's documents, from the same exchange, are then finished with the answers.
So a hash that a third of all documents hold costs one entry for each block, and nothing is held whole anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, about (a single longer text is a block's whole): the least, and the most for large tables.
BLOCK_BYTES, LARGEST_BLOCK = 4 << 20, 32 << 20
#: Blocks up to which they stay at the least size; packed rows are blocks times shards, so beyond it blocks grow first.
MANY = 8192
#: Shards of an index, at least.
SHARDS = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def counts(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Blocks and shards for a table, by its bytes of text; at least two blocks for each shuffle partition.

    The number of shards does not follow the partitions, so that packed rows (blocks times shards) stay few.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    by_size = -(-total // min(LARGEST_BLOCK, max(BLOCK_BYTES, total // MANY)))
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_size), max(SHARDS, by_size)


def in_blocks(docs: DataFrame, n: int, by: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The rows with a block number from a hash of the columns ``by``."""
    return docs.select("*", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int").alias("block"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of each hash spread over all its places."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= MIX
        out += hashes[j : j + n]
    return mixed(out)


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers as compressed differences."""
    return zstandard.compress(np.diff(values.astype(np.int64), prepend=np.int64(0)).tobytes(), 1)


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int64))


def pack_keys(h: np.ndarray, shards: int, size: int = 7) -> bytes:
    """Hashes of one shard in ``size`` bytes each: the quotient by the number of shards (the remainder is the shard)."""
    q = h // np.uint64(shards)
    return np.ascontiguousarray(q.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack_keys(data: bytes, size: int = 7) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view(np.uint64).ravel()


def by_shard(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of entries by shard (as they were within one), the shards present, and where each begins and the end."""
    shard = (h % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    present, starts = np.unique(shard[order], return_index=True)
    return order, present, np.append(starts, len(h))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal keys together, where each group starts in it, and each ordered entry's group."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(first), np.cumsum(first) - 1


OFFER = "block int, shard int, keys binary, extra binary"
ANSWER = "block int, shard int, answer binary"


def exchange(rows: DataFrame, shards: int, offer: Callable, resolve: Callable, finish: Callable, schema: str, width: int = 1, key_bytes: int = 7, told: int = 1) -> DataFrame:
    """Runs a block operator over ``rows`` (with a block); an answer has ``width`` numbers, a key ``key_bytes`` besides its shard.

    ``offer(docs)`` gives a block's distinct hashes, a number for each (say the smallest doc_id that has it; a row of
    ``told`` numbers if those are more than one) and what ``finish`` needs of it.
    ``resolve(keys, numbers, blocks)`` sees a shard's entries and gives the places of those it answers, in order, and
    a row of answers for each.
    ``finish(state, places, answers)`` gets the answers by place in what ``offer`` gives again for the same block.
    """

    def offered(table: pa.Table) -> pa.Table:
        h, number, _ = offer(table)
        order, present, at = by_shard(h, shards)
        h, number = h[order], number[order]
        spans = list(zip(present.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(spans), pa.int32()),
                "shard": pa.array([s for s, _, _ in spans], pa.int32()),
                "keys": pa.array([pack_keys(h[a:b], shards, key_bytes) for _, a, b in spans], pa.binary()),
                "extra": pa.array([pack_numbers(number[a:b].T.ravel()) for _, a, b in spans], pa.binary()),
            }
        )

    def resolved(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("keys").to_pylist(), table.column("extra").to_pylist(), strict=True))
        keys = [unpack_keys(k, key_bytes) for _, k, _ in rows]
        sizes = np.array([len(k) for k in keys])
        ends = np.cumsum(sizes)
        numbers = np.concatenate([unpack_numbers(x).reshape(told, -1).T for _, _, x in rows])
        places, answers = resolve(np.concatenate(keys), numbers[:, 0] if told == 1 else numbers, np.repeat([b for b, _, _ in rows], sizes))
        cuts = np.searchsorted(places, ends)
        shard, out, a = table.column("shard")[0].as_py(), [], 0
        for (block, _, _), start, b in zip(rows, ends - sizes, cuts, strict=True):
            if b > a:
                at = pack_numbers(places[a:b] - start)
                out.append((block, len(at).to_bytes(4, "little") + at + pack_numbers(answers[a:b].T.ravel())))
            a = b
        return pa.table({"block": pa.array([x[0] for x in out], pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()), "answer": pa.array([x[1] for x in out], pa.binary())})

    def finished(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        h, _, state = offer(docs)
        order, present, at = by_shard(h, shards)
        begin = dict(zip(present.tolist(), at[:-1].tolist(), strict=True))
        places, answers = [np.zeros(0, np.int64)], [np.zeros((0, width), np.int64)]
        for shard, data in zip(replies.column("shard").to_pylist(), replies.column("answer").to_pylist(), strict=True):
            cut = 4 + int.from_bytes(data[:4], "little")
            places.append(order[begin[shard] + unpack_numbers(data[4:cut])])
            answers.append(unpack_numbers(data[cut:]).reshape(width, -1).T)
        return finish(state, np.concatenate(places), np.concatenate(answers))

    offers = rows.groupBy("block").applyInArrow(offered, OFFER)
    replies = offers.groupBy("shard").applyInArrow(resolved, ANSWER)
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finished, schema)
