"""Language-model scoring by context-tree weighting over binary-decomposed byte contexts.

A text is its words in lower case with a space after each, and one byte for its end. Each byte is eight binary decisions;
a decision's node is the bits so far and the ``depth`` bytes before it in the running text (spaces before its start), so
contexts cross the spaces between words. Nodes of depth 0 to ``depth`` form the context trees: each has
Krichevsky-Trofimov estimates of its counts, and the weighted probability of a node mixes its own estimate with the
product of its children's, half and half, from the deepest nodes up. Scoring mixes the estimates of all depths on a
decision's path by the posterior weights that this gives; contexts that were never seen leave their share to an even bit.

A gram is a byte with its context. Tasks count grams before they shuffle them, packed by shard; a shard holds all grams
below its contexts of ``TOP`` bytes, so it builds those trees alone, and what lies above are plain aggregates and joins. To
score, blocks of documents offer their distinct grams to the shards and add up the answers (see ``blocks``): no table of
grams is collected or broadcast, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm import blocks, dictionary
from kinetra.llm.shared import written

#: Context bytes: a gram is a byte more, and its number has to fit 63 bits.
DEPTH = 6
#: Context bytes at which trees are cut into shards.
TOP = 3
#: Shards by the bytes of text: about one for each so many, within bounds (contexts of ``TOP`` bytes are some ten thousands).
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 4 << 20, 64, 1 << 14
#: Bytes of text in a block to score, and blocks that one task answers for a shard.
BLOCK_BYTES, ANSWERED = 16 << 20, 1024
#: Bytes of text whose positions are held at once, distinct grams that are gathered before they are merged, and that a task holds before it hands them on.
PIECE, GATHERED, HELD = 1 << 18, 1 << 19, 1 << 20
#: Rows of a batch that are looked at together.
ROWS = 512
#: Most frequent tokens that are summed in place (see ``dictionary``).
HEAD = 1 << 18
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*(text.encode().lower().split() if text else ()), END]


def running(text: str | None) -> bytes:
    """The text's tokens in a row."""
    return b" ".join(tokens(text))


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight places up, and back down by the product."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(reduce(lambda p, k: p * (x + k), range(1, 8), x))


def ln_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return _ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - math.log(math.pi) - _ln_gamma(a + b + 1.0)


def mixed_up(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weighted log probability, half its own estimate and half its children's product, and the own one's share."""
    own = ln_kt(a, b)
    both = np.logaddexp(own, below)
    return both - math.log(2), np.exp(own - both)


def one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b + 0.5) / (a + b + 1)


def placed_bytes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text: its gram as one number (the context backwards, nearest byte highest, then the byte itself), and the text's place."""
    parts = [b" " * depth + t for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    key = data.copy()
    for j in range(1, depth + 1):
        key[j:] |= data[: len(data) - j] << (8 * (depth + 1 - j))
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= depth
    return key[inside], owner[inside]


def pieces(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Running texts in pieces of about ``PIECE`` bytes, each with the place of its first."""
    at, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(running(text.as_py()))
        size += len(held[-1])
        if size >= PIECE:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def _summed(keys: np.ndarray, *values: np.ndarray, runs: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of their values; keys in sorted ``runs`` are merged, which is faster."""
    order = np.argsort(keys, kind="stable" if runs else None)
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values)


class Grams:
    """Distinct grams with their counts; sorted parts are merged when they have doubled."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))]
        self.fresh = 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        distinct, n = np.unique(keys, return_counts=True)
        self.parts.append((distinct, n * float(weight)))
        self.fresh += len(distinct)
        if self.fresh > max(GATHERED, len(self.parts[0][0]) // 2):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [_summed(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]), runs=True)]
            self.fresh = 0
        return self.parts[0]


def shard_of(top: np.ndarray, shards: int) -> np.ndarray:
    return (top * 0x9E3779B1 >> 12 & 0xFFFFF) % shards


def _shard_column(top: Column, shards: int) -> Column:
    return (F.shiftright(top * F.lit(0x9E3779B1), 12).bitwiseAND(F.lit(0xFFFFF)) % shards).cast("int")


def _split(keys: np.ndarray, depth: int, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of sorted grams by shard, and (shard, begin, end) in it."""
    shard = shard_of(keys >> 8 * (depth - TOP + 1), shards)
    order = np.argsort(shard, kind="stable")
    present, starts = np.unique(shard[order], return_index=True)
    return order, list(zip(present.tolist(), starts.tolist(), [*starts.tolist(), len(keys)][1:], strict=True))


def packed(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Whole numbers, compressed byte by byte; of sorted ones the differences."""
    values = np.diff(values, prepend=0) if sorted_ else values
    return zstandard.compress(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes, sorted_: bool = False) -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(values) if sorted_ else values


class Subtree:
    """The trees below contexts of ``TOP`` bytes: nodes (context, bits so far) by depth, with their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int) -> None:
        self.n, k = len(keys), np.arange(8)
        byte = (keys & 255)[:, None]
        self.bit = ((byte >> (7 - k)) & 1).ravel()
        node = (((keys >> 8) << 8)[:, None] | (1 << k) | (byte >> (8 - k))).ravel()
        n = np.repeat(counts, 8)
        nodes, a, b = _summed(node, n * (1 - self.bit), n * self.bit)
        self.of_decision = np.searchsorted(nodes, node)
        self.levels = [(nodes, a, b, ln_kt(a, b), np.ones(len(nodes)), None)]
        for _ in range(depth - TOP):
            nodes, a, b, weighted, _, _ = self.levels[-1]
            above = nodes >> 16 << 8 | nodes & 255
            up, a, b, below = _summed(above, a, b, weighted)
            weighted, own = mixed_up(a, b, below)
            self.levels.append((up, a, b, weighted, own, np.searchsorted(up, above)))

    def top(self) -> tuple[np.ndarray, ...]:
        """Nodes of depth ``TOP``: names, counts, weighted log probabilities and shares."""
        return self.levels[-1][:5]

    def scores(self, mix: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 probability of each gram, given the probability of a one and the weight left above the nodes of ``TOP``."""
        for k in range(len(self.levels) - 1, -1, -1):
            _, a, b, _, own, _ = self.levels[k]
            mix, rest = mix + rest * own * one(a, b), rest * (1 - own)
            if k:
                parent = self.levels[k][5]
                mix, rest = mix[parent], rest[parent]
        p = mix[self.of_decision]
        return np.log10(np.where(self.bit == 1, p, 1 - p)).reshape(self.n, 8).sum(axis=1)


def count_grams(rows: DataFrame, depth: int, shards: int) -> DataFrame:
    """(shard, keys, counts): one row for each shard with all its grams, from rows (text, weight).

    Grams of rows with weight 0 are listed without being counted, so that every gram to be scored has its nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Grams()

        def out() -> pa.RecordBatch:
            keys, n = held.merged()
            order, spans = _split(keys, depth, shards)
            keys, n = keys[order], n[order]
            columns = ([s for s, _, _ in spans], [packed(keys[a:b], True) for _, a, b in spans], [packed(n[a:b]) for _, a, b in spans])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "keys", "counts"])

        for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            weights = part.column(1).to_numpy(zero_copy_only=False)
            for weight in (0, 1):
                for _, texts in pieces(part.column(0).filter(pa.array(weights == weight))):
                    held.add(placed_bytes(texts, depth)[0], weight)
                    if held.fresh + len(held.parts[0][0]) >= HELD and len(held.merged()[0]) >= HELD // 2:
                        yield out()
                        held = Grams()
        yield out()

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(x.as_py(), True) for x in table.column("keys")])
        keys, n = _summed(keys, np.concatenate([unpacked(x.as_py()) for x in table.column("counts")]).astype(float), runs=True)
        return pa.table({"shard": table.column("shard")[:1], "keys": pa.array([packed(keys, True)], pa.binary()), "counts": pa.array([packed(n)], pa.binary())})

    schema = "shard int, keys binary, counts binary"
    return rows.select("text", "weight").mapInArrow(run, schema).groupBy("shard").applyInArrow(merge, schema)


def _tree(row: dict, depth: int) -> tuple[np.ndarray, Subtree]:
    keys = unpacked(row["keys"], True)
    return keys, Subtree(keys, unpacked(row["counts"]).astype(float), depth)


def _table(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


def gram_scores(grams: DataFrame, depth: int, shards: int) -> DataFrame:
    """(shard, keys, scores): log10 probability (4 bytes each) of each byte in its context, one row for each shard."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _table("node a b w own", *_tree(row, depth)[1].top())

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, w = (batch.column(c).to_numpy() for c in "abw")
            yield _table("node a b w own", batch.column("node"), a, b, *mixed_up(a, b, w))

    schema = "node long, a double, b double, w double, own double"
    above = F.expr("(shiftright(node, 16) << 8) | (node & 255)")
    levels = [written(grams.mapInArrow(up, schema))]
    for _ in range(TOP):
        sums = levels[-1].groupBy(above.alias("node")).agg(*[F.sum(c).alias(c) for c in "abw"])
        levels.append(written(sums.mapInArrow(mixed, schema)))
    # From the root down: the probability of a one that the nodes above give, and the weight that they leave.
    p = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    path = levels[-1].select("node", F.lit(0.0).alias("mix"), F.lit(1.0).alias("rest"), (F.col("own") * p).alias("gives"), F.col("own"))
    for d in range(TOP):
        before = path.select(F.col("node").alias("parent"), (F.col("mix") + F.col("rest") * F.col("gives")).alias("mix"), (F.col("rest") * (1 - F.col("own"))).alias("rest"))
        path = levels[TOP - 1 - d].withColumn("parent", above).join(before, "parent").select("node", "mix", "rest", (F.col("own") * p).alias("gives"), "own")
    path = path.select("node", "mix", "rest", _shard_column(F.shiftright("node", 8), shards).alias("shard"))

    def down(table: pa.Table, given: pa.Table) -> pa.Table:
        keys, tree = _tree(table.to_pylist()[0], depth)
        order = np.argsort(given.column("node").to_numpy())
        s = tree.scores(given.column("mix").to_numpy()[order], given.column("rest").to_numpy()[order])
        return pa.table({"shard": table.column("shard"), "keys": table.column("keys"), "scores": pa.array([s.astype(np.float32).tobytes()], pa.binary())})

    return grams.groupBy("shard").cogroup(path.groupBy("shard")).applyInArrow(down, "shard int, keys binary, scores binary")


def text_scores(rows: DataFrame, scores: DataFrame, depth: int, shards: int, n_blocks: int, finish: Callable, schema: str) -> DataFrame:
    """What ``finish(table, scores, block)`` makes, under ``schema``, of each block of ``rows`` (with doc_id and text) and the log10 probabilities of its running texts."""
    dealt = blocks.in_blocks(rows, n_blocks, by=("doc_id", "text"))
    salts = -(-n_blocks // ANSWERED)

    def offered(table: pa.Table) -> pa.Table:
        held, block = Grams(), table.column("block")[0].as_py()
        for _, texts in pieces(table.column("text")):
            held.add(placed_bytes(texts, depth)[0], 0)
        keys = held.merged()[0]
        order, spans = _split(keys, depth, shards)
        keys = keys[order]
        columns = ([block] * len(spans), [s for s, _, _ in spans], [block % salts] * len(spans), [packed(keys[a:b], True) for _, a, b in spans])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (*[pa.int32()] * 3, pa.binary()), strict=True)], ["block", "shard", "salt", "keys"])

    def answered(asks: pa.Table, known: pa.Table) -> pa.Table:
        out: list[bytes] = []
        if known.num_rows and asks.num_rows:
            keys, s = unpacked(known.column("keys")[0].as_py(), True), np.frombuffer(known.column("scores")[0].as_py(), np.float32)
            out = [s[np.searchsorted(keys, unpacked(x.as_py(), True))].tobytes() for x in asks.column("keys")]
        return pa.table({"block": asks.column("block"), "keys": asks.column("keys"), "scores": pa.array(out, pa.binary())})

    def added(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.int64), *(unpacked(x.as_py(), True) for x in answers.column("keys"))])
        s = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x.as_py(), np.float32) for x in answers.column("scores"))])
        order = np.argsort(keys, kind="stable")
        keys, s = keys[order], s[order]
        total = np.zeros(table.num_rows)
        for first, texts in pieces(table.column("text")):
            key, owner = placed_bytes(texts, depth)
            own, back = np.unique(key, return_inverse=True)
            total[first : first + len(texts)] = np.bincount(owner, s[np.searchsorted(keys, own)][back], len(texts))
        return finish(table, total, table.column("block")[0].as_py())

    offers = dealt.groupBy("block").applyInArrow(offered, "block int, shard int, salt int, keys binary")
    known = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answers = offers.groupBy("shard", "salt").cogroup(known.groupBy("shard", "salt")).applyInArrow(answered, "block int, keys binary, scores binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(added, schema)


def score(docs: DataFrame, learn: Column, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Rows for which ``learn`` holds are learned from; all are scored. ``base_score`` is the add-one unigram baseline. A
    null or empty text is its end alone; repeated rows count and are scored each; null ids stay null; without rows to
    learn from all bits are even; an empty table gives no rows; other columns are not read. A text's score adds up
    single-precision scores of its bytes (about seven digits).
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    weight = F.coalesce(learn.cast("int"), F.lit(0))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), size.alias("n_bytes"), F.col(f"`{text}`").alias("text"), weight.alias("weight"))
    total_bytes = rows.agg(F.sum("n_bytes")).first()[0] or 0
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, total_bytes // SHARD_BYTES))
    n_blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // BLOCK_BYTES))
    counts = written(dictionary.term_counts(rows.select("text", (F.col("weight") - 1).alias("label")), tokens, "binary"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    grams = written(count_grams(rows, depth, shards))
    scores = written(gram_scores(grams, depth, shards))
    table = written(counts.select("term", "n", F.log10(F.col("n") + 1.0).alias("plus"), (F.col("n") > 0).cast("double").alias("known")))
    keys, values = ["doc_id", "n_bytes", "score"], ["plus", "known"]
    known = dictionary.head_of(table, values, head)

    def finish(block: pa.Table, score: np.ndarray, number: int) -> pa.Table:
        """Both sums of a block's texts by one worker: those of its bytes, and those of its tokens."""
        keyed = block.select(keys[:2]).append_column("score", pa.array(score))
        return pa.Table.from_batches(list(dictionary.spread(keyed, block.column("text"), tokens, known.value, number << 33, "binary")))

    texts = rows.drop("weight")
    schema = dictionary.spread_schema(texts.withColumn("score", F.lit(0.0)), keys, len(values), "binary")
    out = dictionary.gathered(text_scores(texts, scores, depth, shards, n_blocks, finish, schema), table, values, keys)
    base = F.col("plus") - F.col("n_terms") * math.log10(total["n"] + total["v"] + 1)
    return out.select(
        "doc_id", F.col("n_terms").alias("n_tokens"), F.round("known").cast("long").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
