"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

A bounded sample (``SAMPLE`` rows, those with the smallest hash of their id) gives a centre, principal axes and a
rotation (iterative quantisation) that turns vectors into codes of one bit for each axis, and the Hamming radius that
holds ``TARGET`` of the sample's own neighbours, which lie farther than those among all rows. Every row is indexed:
codes are cut into substrings of 16 bits with a table each. By the pigeonhole principle a code within the radius of
the query's differs, in one substring at least, by no more than that substring's share of the radius, so probing all
values within these shares finds every such code; the others drop out by their whole Hamming distance, and what stays
is ranked by Euclidean distance on the original vectors.

A table is dealt out by the first bits of its substring (its buckets, more with more rows). A row goes to its bucket of
each table, a query only to the buckets that its share reaches; buckets with many rows or queries are split by counts
taken before. A pair counts in the first table that has it within its share, so it is met once. Queries with fewer than
``k`` rows within the radius are asked again within the largest distance of the sample's neighbours, and at last against all codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.shared import written

SAMPLE, TARGET, ROUNDS = 4096, 0.95, 30
#: Rows and queries that meet in a task at once, at most about, and the first bits of a substring that buckets have at most.
BLOCK, QUERIES, BUCKET_BITS = 16384, 4096, 12
BITS = 16
KEYS = ("j", "bucket", "part", "group")


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows with an id and a vector of ``dim`` finite components that are not all zero."""
    v = F.col("v")
    return vectors.where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) == dim)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )


class Codes:
    """Learned binary codes: centre, projection, radius, and the radius that holds all of the sample's neighbours."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7) -> None:
        self.centre = sample.mean(axis=0)
        z = sample - self.centre
        axes = np.linalg.svd(z, full_matrices=True)[2].T
        z = z @ axes
        rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(z.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(z @ rotation >= 0, 1.0, -1.0).T @ z)
            rotation = (u @ vt).T
        self.turn = axes @ rotation
        self.bits = self.turn.shape[1]
        self.radius, self.widest = self._radii(sample, k)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        on = (x - self.centre) @ self.turn >= 0
        on = np.pad(on, ((0, 0), (0, -on.shape[1] % BITS)))
        return np.packbits(on, axis=1, bitorder="little").view(np.uint16)

    def _radii(self, sample: np.ndarray, k: int) -> tuple[int, int]:
        codes, near = self.of(sample), []
        for at in range(0, len(sample), max(1, len(sample) // 128)):
            d = ((sample - sample[at]) ** 2).sum(axis=1)
            d[at] = np.inf
            best = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            near.append(np.bitwise_count(codes[best] ^ codes[at]).sum(axis=1))
        if len(sample) < 2:
            return self.bits, self.bits
        return int(np.quantile(np.concatenate(near), TARGET, method="higher")), int(max(d.max() for d in near))

    def shares(self) -> list[int]:
        """Radius of each substring: together one less for each substring but one, which the principle allows.

        A table with a negative one is not asked; if all codes are, one table is enough.
        """
        m = -(-self.bits // BITS)
        if self.radius >= self.bits:
            return [BITS, *[-1] * (m - 1)]
        total = self.radius - m + 1
        return [total // m + (j < total % m) for j in range(m)]


@lru_cache(maxsize=1)
def _by_weight() -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit masks by their number of bits, and how many have at most so many bits."""
    masks = np.arange(1 << BITS, dtype=np.uint16)
    weight = np.bitwise_count(masks)
    return masks[np.argsort(weight, kind="stable")], np.cumsum(np.bincount(weight, minlength=BITS + 1))


def probe(table: tuple[np.ndarray, np.ndarray], value: int, share: int) -> np.ndarray:
    """Places in a table whose substring is within ``share`` of the value: by looking up every such substring."""
    masks, within = _by_weight()
    order, start = table
    values = (masks[: within[min(share, BITS)]] ^ np.uint16(value)).astype(np.int64)
    lo, size = start[values], start[values + 1] - start[values]
    lo, size = lo[size > 0], size[size > 0]
    return order[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's ``k`` nearest of the rows found, ties to smaller ids.

    A query has ``k`` rows, or all its candidates where there are fewer.

    Both tables have an id and a vector. Vectors that are null, zero, of another length than most, or with null or
    non-finite components take no part, nor do null ids; a query's own id is no candidate; repeated rows of an id each
    count, but a query that is repeated as it is counts once; without usable vectors or queries the result is empty; other columns are not read.
    """
    rows, asked = (t.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v")) for t in (vectors, queries))
    empty = "query_id long, rank int, vec_id long, score double"
    common = rows.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return rows.sparkSession.createDataFrame([], empty)
    dim = common["dim"]
    rows, asked = usable(rows, dim), usable(asked, dim).dropDuplicates(["vec_id", "v"])
    n = rows.count()
    if not n or asked.isEmpty():
        return rows.sparkSession.createDataFrame([], empty)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    codes = Codes(_matrix(picked.column("v"), dim), k)
    parts, radii = [], sorted({codes.radius, max(codes.radius, codes.widest), codes.bits})
    for radius in radii:
        codes.radius = radius
        ranked = _ranked(rows, asked, codes, k, dim, min(BUCKET_BITS, max(2, (n // BLOCK).bit_length())))
        if radius == radii[-1]:
            parts.append(ranked)
            break
        ranked = written(ranked)
        full = ranked.where(F.col("held") >= k)
        parts.append(full)
        asked = written(asked.join(full.where("rank = 1").select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"))
        if asked.isEmpty():
            break
    return reduce(DataFrame.union, parts).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ranked(rows: DataFrame, asked: DataFrame, codes: Codes, k: int, dim: int, bits: int) -> DataFrame:
    """(query_id, vec_id, score, rank, held): the ``k`` nearest rows within the radius of the codes, and their number."""
    shares, shift = codes.shares(), BITS - bits
    tables = [j for j, share in enumerate(shares) if share >= 0]
    every = np.arange(1 << bits, dtype=np.uint16)

    def reached(x: np.ndarray, asks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, table, bucket) of rows, or of the buckets that queries reach."""
        index, out = codes.of(x), []
        for j in tables:
            top = index[:, j] >> shift
            at, bucket = np.nonzero(np.bitwise_count(every ^ top[:, None]) <= shares[j]) if asks else (np.arange(len(x)), top)
            out.append((at, np.full(len(at), j), bucket.astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]

    def sizes(df: DataFrame, asks: bool, most: int) -> np.ndarray:
        """Into how many parts each bucket of each table is split: a table of tables times buckets, however many rows there are."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(shares), 1 << bits), np.int64)
            for batch in batches:
                _, j, bucket = reached(_matrix(batch.column(0), dim), asks)
                np.add.at(total, (j, bucket), 1)
            j, bucket = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(bucket), pa.array(total[j, bucket])], ["j", "bucket", "n"])

        found = df.select("v").mapInArrow(count, "j long, bucket long, n long").groupBy("j", "bucket").agg(F.sum("n").alias("n")).toArrow()
        parts = np.ones((len(shares), 1 << bits), np.int64)
        parts[found.column("j").to_numpy(), found.column("bucket").to_numpy()] = -(-found.column("n").to_numpy() // most)
        return parts

    n_rows, n_asks = sizes(rows, False, BLOCK), sizes(asked, True, QUERIES)

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        """Each row under (table, bucket, part of its rows, part of its queries); all parts of the other side."""
        own, other = (n_asks, n_rows) if asks else (n_rows, n_asks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, j, bucket = reached(_matrix(batch.column(1), dim), asks)
                mine = batch.column(2).to_numpy()[at] % own[j, bucket]
                times = other[j, bucket]
                theirs = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, j, bucket, mine = (np.repeat(c, times) for c in (at, j, bucket, mine))
                part, group = (theirs, mine) if asks else (mine, theirs)
                for a in range(0, len(at), BLOCK):
                    cut = slice(a, a + BLOCK)
                    some = batch.take(pa.array(at[cut]))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *[pa.array(c[cut].astype(np.int64)) for c in (j, bucket, part, group)]], ["vec_id", "v", *KEYS])

        kind = df.schema["v"].dataType.simpleString()
        return df.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)).alias("h")).mapInArrow(run, f"vec_id long, v {kind}, {', '.join(f'{c} long' for c in KEYS)}")

    def run(key: tuple, block: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if block.num_rows and ask.num_rows:
            j = key[0].as_py()
            x, q, ids = _matrix(block.column("v"), dim), _matrix(ask.column("v"), dim), block.column("vec_id").to_numpy()
            index, limits = codes.of(x), np.array(shares)
            order = np.argsort(index[:, j], kind="stable")
            table = order, np.searchsorted(index[order, j], np.arange((1 << BITS) + 1))
            few = _by_weight()[1][min(shares[j], BITS)] < len(x)  # else comparing all substrings is less work than looking up
            for query, vec, code in zip(ask.column("vec_id").to_pylist(), q, codes.of(q), strict=True):
                at = probe(table, code[j], shares[j]) if few else np.flatnonzero(np.bitwise_count(index[:, j] ^ code[j]) <= shares[j])
                far = np.bitwise_count(index[at] ^ code)
                at = at[(far.sum(axis=1) <= codes.radius) & ((far <= limits).argmax(axis=1) == j) & (ids[at] != query)]
                score = np.sqrt(((x[at] - vec) ** 2).sum(axis=1))
                best = np.lexsort((ids[at], score))[:k]
                for c, v in zip(out, ([query] * len(best), ids[at][best].tolist(), score[best].tolist()), strict=True):
                    c += v
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = dealt(rows, False).groupBy(*KEYS).cogroup(dealt(asked, True).groupBy(*KEYS)).applyInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.withColumn("held", F.count("*").over(Window.partitionBy("query_id")))
