"""Line dedup by levelled sorted runs of line hashes.

A run has one entry for each line key of a batch of documents: how many documents hold it and the largest of their ids.
Runs are dealt by key over the same partitions and sorted, so they merge where they lie. A new batch is counted, joined
by a merge anti join with each run (entries that a run has settled already, enough documents and one as late as the
batch's, add nothing) and becomes a run of its own; every ``FANOUT`` runs of a level are merged into one of the next.
With the latest documents first, a common line stops costing anything after the batch that settles it.

In the end all runs are merged, and the lines of settled keys go from all documents but the latest. Keys that very many
documents hold are few, by count, and are broadcast; the others meet the lines in a shuffled join. DataFrame functions
only. A key is 128 bits of hash of the stripped and lower-cased line.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm.shared import written

#: Fixed values of the key: what is stripped, and the letters that are made small.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Batches that a table is taken in, and runs of one level that are merged.
BATCHES, FANOUT = 5, 3
#: A key is hot if it has more than this share of all entries; so there are at most 2^14 hot keys.
HOT_SHARE = 1 << 14
KEY = ["h1", "h2"]


def key_of(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def row_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text)


def line_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, t, at, h1, h2): a row for each line that is long enough, of documents with an id (columns doc_id and text)."""
    lines = docs.where("doc_id is not null").select("doc_id", row_hash(F.col("text")).alias("t"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keys = lines.select("doc_id", "t", "at", key_of(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keys.select("doc_id", "t", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


@contextmanager
def _planned_ahead(spark: SparkSession) -> Iterator[None]:
    """Plans made within keep how their rows are dealt and sorted when they are written, as adaptive plans don't; so runs merge where they lie."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def _run(entries: DataFrame) -> DataFrame:
    """Entries as a written run."""
    with _planned_ahead(entries.sparkSession):
        return written(entries)


class LineRuns:
    """Runs of (h1, h2, docs, last), level by level; ``least`` documents settle a key.

    Documents are counted once if all rows of one doc_id come in one batch.
    """

    def __init__(self, least: int = 3, fanout: int = FANOUT) -> None:
        self.least, self.fanout = least, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Takes in a batch of ``line_keys``."""
        partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counted = keys.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        for run in self.runs():
            settled = run.where(F.col("docs") >= self.least).select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("last").alias("_last"))
            same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("_last") >= F.col("last"))
            counted = counted.join(settled.hint("merge"), same, "left_anti")
        self._put(0, _run(counted.repartition(partitions, *KEY).sortWithinPartitions(*KEY)))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = _run(_merged(self.levels[level]))
            self.levels[level] = []
            self._put(level + 1, merged)

    def settled(self) -> DataFrame:
        """All runs merged into one; its keys that enough documents hold."""
        runs = self.runs()
        if len(runs) > 1:
            self.levels = [[] for _ in self.levels] + [[_run(_merged(runs))]]
        return self.levels[-1][0].where(F.col("docs") >= self.least)


def _merged(runs: list[DataFrame]) -> DataFrame:
    """Runs as one: as all are dealt alike, their union is aggregated where it lies."""
    together = reduce(DataFrame.union, runs)
    return together.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last")).sortWithinPartitions(*KEY)


def _dropped(keys: DataFrame, settled: DataFrame) -> DataFrame:
    """(doc_id, t, dropped): places of the lines that go, by row."""
    total = settled.agg(F.sum("docs")).first()[0] or 0
    hot = F.col("docs") > total // HOT_SHARE
    few, rest = F.broadcast(settled.where(hot).drop("docs")), settled.where(~hot).drop("docs")
    often = keys.join(few, KEY)
    seldom = keys.join(few, KEY, "left_anti").join(rest, KEY)
    gone = often.unionByName(seldom).where("doc_id < last")
    return gone.groupBy("doc_id", "t").agg(F.collect_set("at").alias("dropped"))


def dedup(docs: DataFrame, least: int = 3, least_chars: int = 20, batches: int = BATCHES, fanout: int = FANOUT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_text (the lines that stay, joined by a line feed).

    A line whose key has ``least_chars`` code points or more and stands in ``least`` documents or more goes, unless its
    document is the one with the largest doc_id that holds it; there every such line stays. A null or empty text is one
    empty line; rows of one doc_id are one document, whose lines are judged in each row; rows with a null doc_id hold no
    keys and lose nothing; an empty table gives no rows; other columns are not read; texts are whole, however long.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    keys = written(line_keys(rows, least_chars))
    cuts = keys.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("cuts")).first()["cuts"] or []
    runs, above = LineRuns(least, fanout), None
    for low in [*sorted(set(cuts), reverse=True), None]:  # the latest documents first
        batch = keys if above is None else keys.where(F.col("doc_id") <= above)
        runs.add(batch if low is None else batch.where(F.col("doc_id") > low))
        above = low
    dropped = _dropped(keys, runs.settled()).withColumnsRenamed({"doc_id": "_doc_id", "t": "_t"})
    lines = lines_of(F.col("text"))
    met = rows.withColumn("t", row_hash(F.col("text"))).join(dropped, (F.col("doc_id") == F.col("_doc_id")) & (F.col("t") == F.col("_t")), "left")
    # Lines are bound once, for the lambda to index them; places are subtracted as sets.
    bound = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped")).alias("kept")))
    kept = F.get(F.transform(bound, lambda b: F.transform(b["kept"], lambda i: F.get(b["lines"], i))), F.lit(0))
    return met.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
