"""Sums over the terms of documents against a table of terms, without a row for each occurrence.

Term frequencies differ by orders of magnitude, so the table is split: its ``HEAD`` most frequent terms (bounded in
number and bytes) go to all tasks, which sum them in place; only occurrences of the remaining terms become rows (document, term,
frequency), which a plain join meets with the rest of the table. Both parts together cover every term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that are broadcast at most, and their longest in bytes: 32 MB. Longer ones always meet the table in the join.
HEAD, LONGEST = 1 << 19, 64
#: Distinct terms a task counts before it hands its counts on.
FLUSH = 1 << 19
#: Documents whose rows are handed back at once.
ROWS = 256

Splitter = Callable[[object], list]


def term_counts(docs: DataFrame, split: Splitter, term_type: str = "string", classes: int = 1) -> DataFrame:
    """(term, n, n0, n1, ...): occurrences over all rows of the columns (text, label), in all and by label.

    Terms of rows with a negative label are listed, too, but not counted. Tasks count before they shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        kind = pa.binary() if term_type == "binary" else pa.string()

        def out() -> Iterator[pa.RecordBatch]:
            for label, mine in counts.items():
                n = np.fromiter(mine.values(), np.int64, len(mine)) if label >= 0 else np.zeros(len(mine), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(mine), kind), pa.array([label] * len(mine), pa.int32()), pa.array(n)], ["term", "label", "n"])
            counts.clear()

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(label, Counter()).update(split(text.as_py()))
                if sum(map(len, counts.values())) > FLUSH:
                    yield from out()
        yield from out()

    found = docs.mapInArrow(run, f"term {term_type}, label int, n long")
    by_class = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(classes)]
    return found.groupBy("term").agg(F.sum("n").alias("n"), *by_class)


def frequent(table: DataFrame, head: int) -> DataFrame:
    """The most frequent terms of up to ``LONGEST`` bytes, ``head`` at most: all from a power of 2^(1/8) on, so that no task has to sort them."""
    table = table.where((F.col("n") > 0) & (F.octet_length("term") <= LONGEST))
    power = F.floor(8 * F.log2("n"))
    sizes = table.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()
    least, total = None, 0
    for row in sizes:
        total += row["count"]
        if total > head:
            break
        least = row["power"]
    return table.where(power >= least) if least is not None else table.limit(0)


def head_of(table: DataFrame, values: list[str], head: int) -> Broadcast:
    """The most frequent terms' places and values for all tasks."""
    top = frequent(table, head).select("term", *[F.col(v).cast("double") for v in values]).toArrow()
    place = {t: k for k, t in enumerate(top.column("term").to_pylist())}
    matrix = np.stack([top.column(v).to_numpy() for v in values], axis=1) if place else np.zeros((0, len(values)))
    return table.sparkSession.sparkContext.broadcast((place, matrix))


def spread_schema(docs: DataFrame, keys: list[str], n_values: int, term_type: str) -> str:
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    return f"uid long, {kinds}, n_terms long, term {term_type}, freq long, {', '.join(f'h{j} double' for j in range(n_values))}"


def spread(keys: pa.RecordBatch | pa.Table, texts: pa.Array | pa.ChunkedArray, split: Splitter, known: tuple, uid: int, term_type: str) -> Iterator[pa.RecordBatch]:
    """Documents as rows under ``spread_schema``: each with what the frequent terms give, and one for each other term.

    ``uid`` and the numbers after it are the documents' own.
    """
    place, matrix = known
    kind = pa.binary() if term_type == "binary" else pa.string()
    own = [f"h{j}" for j in range(matrix.shape[1])]
    for at in range(0, keys.num_rows, ROWS):
        n_terms, totals, tail = [], [], []
        for k, text in enumerate(texts.slice(at, ROWS)):
            terms = Counter(split(text.as_py()))
            found = [place.get(t, -1) for t in terms]
            freq, spot = np.fromiter(terms.values(), np.int64, len(terms)), np.array(found, np.int64)
            n_terms.append(int(freq.sum()))
            totals.append(freq[spot >= 0] @ matrix[spot[spot >= 0]])
            if -1 in found:
                tail += [(uid + k, t, f) for (t, f), s in zip(terms.items(), found, strict=True) if s < 0]
        n, m = len(n_terms), len(tail)
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (keys.column(j).slice(at, n) for j in range(keys.num_columns))]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        # A document's own row takes part in the join under a name that no term has, so that none of them meet.
        names = [f"\x00 {uid + k} \x00" for k in range(n)]
        names = [x.encode() for x in names] if kind == pa.binary() else names
        total = np.stack(totals)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*range(uid, uid + n), *(t[0] for t in tail)], pa.int64()), *[pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in columns], pa.array(n_terms + [None] * m, pa.int64()),
                pa.array([*names, *(t[1] for t in tail)], kind), pa.array([0] * n + [t[2] for t in tail], pa.int64()),
                *[pa.concat_arrays([pa.array(total[:, j]), pa.nulls(m, pa.float64())]) for j in range(len(own))],
            ],
            ["uid", *keys.schema.names, "n_terms", "term", "freq", *own],
        )
        uid += n


def gathered(rows: DataFrame, table: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Per document of such rows: keys, n_terms and the sum of each value; the terms that are not frequent meet the table in a join."""
    met = rows.join(table.select("term", *[F.col(v).cast("double").alias(f"t{j}") for j, v in enumerate(values)]), "term", "left")
    total = [F.sum(F.coalesce(f"h{j}", F.col("freq") * F.col(f"t{j}"), F.lit(0.0))).alias(v) for j, v in enumerate(values)]
    return met.groupBy("uid").agg(*[F.max(c).alias(c) for c in keys], F.max("n_terms").alias("n_terms"), *total).drop("uid")


def sums(docs: DataFrame, table: DataFrame, split: Splitter, values: list[str], keys: list[str], term_type: str = "string", head: int = HEAD) -> DataFrame:
    """Per row of ``docs`` (columns: keys, then text): keys, n_terms and the sum of each value (a double) over its terms.

    ``table`` has term, n and the values (a term that it lacks adds nothing). It is read twice, so give one that is
    written or checkpointed.
    """
    known = head_of(table, values, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            yield from spread(batch.select(keys), batch.column(len(keys)), split, known.value, uid, term_type)
            uid += batch.num_rows

    rows = docs.select(*keys, "text").mapInArrow(run, spread_schema(docs, keys, len(values), term_type))
    return gathered(rows, table, values, keys)
