"""N-gram Jaccard join by vertical partitioning, and the classes of linked documents.

Equal texts are one node, so copies are never paired. The n-grams of all nodes are in one global order, rarest first
(by the number of nodes that hold them, then by hash). Frequencies come from a sharded index of all n-grams
(``blocks``); its short keys may take two n-grams for one, which only makes a frequency too large, alike for all.

* Two sets that link share an n-gram within the first few of both (the prefix that their sizes leave), and it has enough
  n-grams after it in both. So each place of a prefix has a largest partner size. A node whose n-grams are mostly its
  own has no place left and drops out before anything is paired.
* First each node meets one hub for each n-gram of its prefix: the node that holds it with the fewest n-grams of its
  own, the middle of a group of near copies. Links found give components; then, for n-grams that nodes of more than one
  component hold, the pairs across components follow whose sizes and places allow a link.
* The global n-gram order is cut into fragments (by hash); the overlap of a pair is counted for each fragment separately
  and summed for the pair, which is exact. N-grams that one node holds alone are in no overlap and left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm import blocks
from kinetra.llm.components import components
from kinetra.llm.shared import written

#: Fragments in which overlaps are counted.
FRAGMENTS = 8
#: Ids of copies are broadcast up to so many, beyond that a shuffled join takes them out.
BROADCAST_IDS = 1 << 20
#: Bytes of an n-gram in the index besides its shard (the number of shards follows the data).
KEY_BYTES = 4


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams, A-Z in lower case; a shorter text is one n-gram, none for no words."""
    w = text.encode().lower().split() if text else []
    h = blocks.word_hashes(w)
    if len(w) < size:
        return blocks.mixed(blocks.window_hashes(h, len(w)) + np.uint64(len(w))) if w else h
    return np.unique(blocks.window_hashes(h, size))


def prefix(often: np.ndarray, grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a set's n-grams in its prefix that others hold, too, and the largest partner for each.

    At place i of n n-grams in global order the overlap with a set of m can be n - i at most; a link needs
    percent * (n + m) / (100 + percent).
    """
    n = len(grams)
    order = np.lexsort((grams, often))[: n - -(-percent * n // 100) + 1]
    at = np.flatnonzero(often[order] > 1)
    return order[at], (n - at) * (100 + percent) // percent - n


def _sets(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Per node: n, own (n-grams that no other node holds), keys and limits of its prefix, and its other n-grams by fragment."""
    n_blocks, shards = blocks.counts(rows)

    def offer(table: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple]:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        texts, linked = table.column("text"), table.column("links").to_numpy(zero_copy_only=False)[first]
        sets = [shingles(texts[int(k)].as_py(), size) for k in first]
        h = np.concatenate([np.zeros(0, np.uint64), *[s for s, use in zip(sets, linked, strict=True) if use]])
        distinct, back, count = np.unique(h, return_inverse=True, return_counts=True)
        return distinct, count, (nodes.tolist(), sets, linked, back, count)

    def resolve(keys: np.ndarray, count: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, starts, group = blocks.grouped(keys)
        often = np.empty(len(keys), np.int64)
        often[order] = np.add.reduceat(count[order], starts)[group]
        places = np.flatnonzero(often > 1)
        return places, often[places, None]

    def finish(state: tuple, places: np.ndarray, answers: np.ndarray) -> pa.Table:
        nodes, sets, linked, back, often = state
        often[places] = answers[:, 0]
        rows, at = [], 0
        cuts = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS)
        for node, s, use in zip(nodes, sets, linked, strict=True):
            row: tuple = (node, len(s), None, [], [], [])
            if use:
                f = often[back[at : at + len(s)]]
                at += len(s)
                shared = s[f > 1]
                if len(s) and 100 * len(shared) >= percent * len(s):
                    keys, limits = prefix(f, s, percent)
                    parts = np.split(shared.view(np.int64), np.searchsorted(shared, cuts))
                    row = (node, len(s), len(s) - len(shared), s[keys].view(np.int64), limits, parts)
            rows.append(row)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
        return pa.table({c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate(zip(("node", "n", "own", "keys", "limits", "parts"), types, strict=True))})

    dealt = blocks.in_blocks(rows, n_blocks, by=("node",))
    return blocks.exchange(dealt, shards, offer, resolve, finish, "node long, n long, own long, keys array<long>, limits array<long>, parts array<array<long>>", key_bytes=KEY_BYTES)


def _fit(a: Column, b: Column) -> Column:
    """The places of a and b at a key they share leave room for a link."""
    return (a["n"] <= b["most"]) & (b["n"] <= a["most"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link: partial overlaps by fragment, summed."""
    cut = sets.select("node", "n", F.posexplode("parts").alias("fragment", "grams")).where(F.size("grams") > 0)
    left = cut.select(F.col("node").alias("a"), F.col("n").alias("a_n"), "fragment", F.col("grams").alias("a_grams"))
    right = cut.select(F.col("node").alias("b"), F.col("n").alias("b_n"), "fragment", F.col("grams").alias("b_grams"))
    met = pairs.join(left, "a").join(right, ["b", "fragment"])
    partial = met.select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_grams", "b_grams")).alias("part"))
    total = partial.groupBy("a", "b", "a_n", "b_n").agg(F.sum("part").alias("both"))
    return total.where(100 * F.col("both") >= percent * (F.col("a_n") + F.col("b_n") - F.col("both"))).select("a", "b")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a["node"], b["node"]).alias("a"), F.greatest(a["node"], b["node"]).alias("b")]


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) by components of all nodes of ``sets`` that link."""
    entry = F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", F.col("place.limits").alias("most"))
    places = sets.where(F.size("keys") > 0).select("*", F.explode(F.arrays_zip("keys", "limits")).alias("place")).select(F.col("place.keys").alias("key"), entry.alias("x"))
    hubs = places.groupBy("key").agg(F.min("x").alias("hub"))
    x, hub = F.col("x"), F.col("hub")
    stars = written(places.join(hubs, "key").where((x["node"] != hub["node"]) & _fit(x, hub)).select(*_ordered(x, hub)).distinct())
    found = written(_linked(stars, sets, percent))
    roots = written(components(found))
    labelled = places.withColumn("node", x["node"]).join(roots, "node", "left").select("key", "x", F.coalesce("root", "node").alias("label"))
    apart = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    left = labelled.join(apart, "key", "left_semi")
    right = left.select("key", F.col("x").alias("y"), F.col("label").alias("other"))
    y = F.col("y")
    across = left.join(right, "key").where((F.col("label") < F.col("other")) & _fit(x, y)).select(*_ordered(x, y)).distinct()
    more = written(_linked(across.join(stars, ["a", "b"], "left_anti"), sets, percent))
    if more.isEmpty():
        return roots
    of = lambda side: roots.withColumnsRenamed({"node": side, "root": f"{side}_root"})
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    joined = written(components(between)).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return roots.join(joined, "root", "full").select(F.coalesce("node", "root").alias("node"), F.coalesce("last", "root").alias("root"))


def text_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits of a text in two numbers."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def _noded(rows: DataFrame) -> DataFrame:
    """``rows`` (h1, h2 and others) with ``node``, a number for each distinct (h1, h2): h1, or where different texts have it a hash of both."""
    met = written(rows.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo != hi").select(F.col("h1").alias("_met")))
    if met.isEmpty():
        return rows.withColumn("node", F.col("h1"))
    met = F.broadcast(met) if met.count() <= BROADCAST_IDS else met
    return rows.join(met, F.col("h1") == F.col("_met"), "left").withColumn("node", F.when(F.col("_met").isNotNull(), F.xxhash64("h1", "h2")).otherwise(F.col("h1"))).drop("_met")


def classes(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), h1 and h2 (see ``text_hashes``).

    Two documents link if 100 * overlap >= percent * union of their n-gram sets. A null text or one without words has an
    empty set and links with nothing, also not with its like: the own id is its component; one with fewer words than ``size`` has its whole sequence as the one n-gram;
    copies link; rows of one doc_id are judged by their texts; rows with a null doc_id link with nothing and have a
    null component; an empty table gives no rows; other columns are not read; ids that are no numbers fail the job. Texts are equal if 128 bits of
    their hashes are.
    """
    h1, h2 = text_hashes(F.col("text"))
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumns({"h1": h1, "h2": h2})
    ids = written(_noded(plain.select("doc_id", "h1", "h2")))
    named = written(ids.join(ids.groupBy("node").agg(F.min("doc_id").alias("rep")), "node"))
    # Of equal texts the one with the smallest id goes on; its node links if it has an id.
    firsts = named.where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "h1", "h2", "node").distinct()
    copies = named.where(~F.col("doc_id").eqNullSafe(F.col("rep"))).select(F.col("doc_id").alias("copy"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    rows = plain.join(copies, F.col("doc_id").eqNullSafe(F.col("copy")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left_anti")
    rows = rows.withColumn("node", F.col("h1")) if firsts.where("node != h1").isEmpty() else rows.join(firsts.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "node").distinct(), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    sets = written(_sets(rows.select("node", "text", F.col("doc_id").isNotNull().alias("links")), size, percent))
    roots = links(sets, percent)
    reps = firsts.where("doc_id is not null").select("node", F.col("doc_id").alias("rep"))
    joined = roots.join(reps, "node")
    joined = joined.join(joined.groupBy("root").agg(F.min("rep").alias("component")), "root").select("node", "component")
    # Written, so that both sides of the last join are dealt anew and a node with many copies can be split.
    out = written(sets.select("node", "n").join(joined, "node", "left"))
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return named.join(out, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "h1", "h2")
