"""Merkle manifest of a table: a tree of digests for each source, one over their roots, and proofs of membership.

Leaves are dealt by range of (tree, order), so each partition holds a stretch of consecutive leaves of a tree, whose place
in it follows from the partitions' counts. A partition keeps a mountain range: for each level the nodes of the run at hand.
A full run, or a tree's last and shorter one, becomes a node of the next level at once, as a carry does. What is left, the
nodes of runs that reach over a partition's ends, are peaks; they are merged level by level as groups of one run each, so
a tree of any size has no task of its own. A second pass over the partitions gets the merged runs at its edges and folds
each leaf's path. Nothing is padded: a short run is hashed as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.line_runs import LOWER, UPPER
from kinetra.llm.shared import written

FANOUT = 16
#: Leaves of a partition, about.
LEAVES = 1 << 17
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PEAKS = "tree string, level int, place long, total long, digest string, kind string"
SIDE = "part int, tree string, kind string, level int, place long, total long, digests array<string>"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row's values: each ``-`` if null, else its length in bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def tree_of(source: Column) -> Column:
    """A key that is never null and sorts as the source does, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def sizes(total: int, fanout: int) -> list[int]:
    """Nodes of each level, from the leaves to the one root."""
    found = [total]
    while found[-1] > 1:
        found.append(-(-found[-1] // fanout))
    return found


class MountainRange:
    """The open runs of a stretch of a tree's leaves, lowest level first; ``done`` takes nodes (level, place, digest) as they are complete."""

    def __init__(self, total: int, fanout: int, done: Callable[[int, int, str], None]) -> None:
        self.sizes, self.fanout, self.done = sizes(total, fanout), fanout, done
        self.open: list[list[tuple[int, str]]] = [[] for _ in self.sizes]
        self.peaks: list[tuple[int, int, str]] = []

    def push(self, place: int, h: str) -> None:
        """Takes in the next leaf and carries as far as runs are full."""
        for level, size in enumerate(self.sizes):
            run = self.open[level]
            run.append((place, h))
            if size == 1 or (place % self.fanout != self.fanout - 1 and place != size - 1):
                return
            self.open[level] = []
            if run[0][0] % self.fanout:
                self.peaks += [(level, p, d) for p, d in run]
                return
            place, h = place // self.fanout, digest([d for _, d in run])
            self.done(level + 1, place, h)

    def left(self) -> list[tuple[int, int, str]]:
        """All nodes whose run is not complete here, and a lone leaf."""
        return self.peaks + [(level, p, d) for level, run in enumerate(self.open) for p, d in run if self.sizes[level] > 1 or not level]


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, place_by, leaf, and others) dealt by range, with the number of the partition; equal rows may lie apart."""
    leaves = written(leaves)
    parts = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // LEAVES))
    dealt = leaves.withColumn("tie", F.rand(1)).repartitionByRange(parts, "tree", "place_by", "leaf", "tie").drop("tie")
    return written(dealt.withColumn("part", F.spark_partition_id()))


def _stretches(placed: DataFrame) -> DataFrame:
    """(part, tree, place of the first leaf, n, total): a tree has one for each partition at most."""
    counts = placed.groupBy("part", "tree").agg(F.count("*").alias("n"))
    own = Window.partitionBy("tree")
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    keys = [F.col(c).alias(c) for c in ("part", "tree")]  # columns of their own, for the cogroup with the leaves
    return written(counts.select(*keys, F.coalesce(before, F.lit(0)).alias("place"), "n", F.sum("n").over(own).alias("total")))


def _sorted_leaves(table: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    """A partition's leaves by tree, in order."""
    keys = [(c, "ascending") for c in ("tree", "place_by", "leaf")]
    table = table.combine_chunks().sort_by(keys) if table["place_by"].null_count == 0 else table.append_column("filled", table["place_by"].is_valid()).combine_chunks().sort_by([keys[0], ("filled", "ascending"), *keys[1:]])
    trees = table["tree"].to_pylist()
    start = 0
    for k in range(1, len(trees) + 1):
        if k == len(trees) or trees[k] != trees[start]:
            yield trees[start], table.slice(start, k - start)
            start = k


def _side(stretches: DataFrame) -> DataFrame:
    return stretches.select("part", "tree", F.lit("stretch").alias("kind"), F.lit(0).alias("level"), "place", "total", F.lit(None).cast("array<string>").alias("digests"))


def _peaks(placed: DataFrame, stretches: DataFrame, fanout: int) -> DataFrame:
    """Of each partition: complete nodes (kind ``node``), peaks of runs that others share (``peak``) and roots of trees (``root``)."""

    def run(_: tuple, leaves: pa.Table, side: pa.Table) -> pa.Table:
        about = {r["tree"]: r for r in side.to_pylist()}
        out: list[tuple] = []
        for tree, mine in _sorted_leaves(leaves) if leaves.num_rows else ():
            place, total = about[tree]["place"], about[tree]["total"]
            range_ = MountainRange(total, fanout, lambda level, at, h, tree=tree, total=total: out.append((tree, level, at, total, h, "node")))
            for k, h in enumerate(mine["leaf"].to_pylist()):
                range_.push(place + k, h)
            out += [(tree, level, at, total, h, "root" if range_.sizes[level] == 1 else "peak") for level, at, h in range_.left()]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table({c: pa.array([r[j] for r in out], t) for j, (c, t) in enumerate(zip(("tree", "level", "place", "total", "digest", "kind"), kinds, strict=True))})

    return written(placed.groupBy("part").cogroup(_side(stretches).groupBy("part")).applyInArrow(run, PEAKS))


def _merged(peaks: DataFrame, fanout: int) -> tuple[DataFrame | None, DataFrame]:
    """Runs over partitions' ends (tree, level, place of the parent, digests), and all nodes above the leaves, roots among them."""
    at_edge = peaks.where("kind = 'peak'").select("tree", "level", "place", "total", "digest")
    nodes = peaks.where("kind != 'peak'").select("tree", "level", "place", "total", "digest")
    most = at_edge.agg(F.max("total")).first()[0]
    if not most:
        return None, nodes
    runs, carried = [], None
    for level in range(len(sizes(most, fanout)) - 1):
        here = at_edge.where(F.col("level") == level)
        here = here.unionByName(carried.where(F.col("total") > fanout**level)) if carried is not None else here
        run = here.groupBy("tree", F.floor(F.col("place") / fanout).alias("place")).agg(F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("digests"))
        run = written(run.withColumn("level", F.lit(level)))
        runs.append(run.select("tree", "level", "place", "digests"))
        carried = run.select("tree", F.lit(level + 1).alias("level"), "place", "total", F.sha2(F.array_join("digests", ""), 256).alias("digest"))
        nodes = nodes.unionByName(carried)
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out, nodes


def _asked(stretches: DataFrame, runs: DataFrame, levels: int, fanout: int) -> DataFrame:
    """The merged runs that each partition's leaves have on their paths: at each level those over its first and last leaf."""
    ends = []
    for level in range(levels):
        wide = fanout ** (level + 1)
        for at in (F.col("place"), F.col("place") + F.col("n") - 1):
            ends.append(F.struct(F.lit(level).alias("level"), F.floor(at / wide).cast("long").alias("parent")))
    asked = stretches.where("n < total").select("part", "tree", F.explode(F.array_distinct(F.array(*ends))).alias("end")).select("part", "tree", "end.level", F.col("end.parent").alias("place"))
    return asked.join(runs, ["tree", "level", "place"]).select("part", "tree", F.lit("run").alias("kind"), "level", "place", F.lit(0).cast("long").alias("total"), "digests")


def _paths(leaves: list[str], place: int, total: int, fetched: dict[tuple[int, int], list[str]], fanout: int) -> list[dict[int, list[str]]]:
    """Of each level but the root's the runs over these leaves, by place of their parent."""
    found = []
    nodes = dict(enumerate(leaves, place))
    for level, size in enumerate(sizes(total, fanout)[:-1]):
        runs: dict[int, list[str]] = {}
        for parent in dict.fromkeys(p // fanout for p in nodes):
            run = fetched.get((level, parent))
            runs[parent] = run if run is not None else [nodes[p] for p in range(parent * fanout, min(size, (parent + 1) * fanout))]
        nodes = {parent: digest(run) for parent, run in runs.items()}
        found.append(runs)
    return found


def _fold(claim: str, place: int, levels: list[dict[int, list[str]]], fanout: int) -> tuple[list[str], str]:
    """Siblings on the path of a leaf, and its tree's root as ``claim`` in the leaf's place gives it."""
    siblings: list[str] = []
    for runs in levels:
        place, own = divmod(place, fanout)
        run = runs[place]
        left, right = run[:own], run[own + 1 :]
        siblings += left + right
        claim = digest([*left, claim, *right])
    return siblings, claim


class Forest:
    """Trees over ``leaves`` (tree, place_by, leaf, and others), a distributed table.

    ``nodes``: all nodes above the leaves as (tree, level, place, total, digest); a tree of one leaf has it as its root.
    """

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT) -> None:
        self.fanout = fanout
        self.placed = _placed(leaves)
        self.stretches = _stretches(self.placed)
        self.levels = len(sizes(self.stretches.agg(F.max("total")).first()[0] or 1, fanout)) - 1
        self.runs, self.nodes = _merged(_peaks(self.placed, self.stretches, fanout), fanout)

    def roots(self) -> DataFrame:
        """(tree, digest)."""
        top = F.lit(0)
        for level in range(self.levels):
            top = F.when(F.col("total") > self.fanout**level, level + 1).otherwise(top)
        return self.nodes.where(F.col("level") == top).select("tree", "digest")

    def folded(self, fold: Callable, schema: str, above: DataFrame | None = None) -> DataFrame:
        """What ``fold`` makes of a stretch's leaves, the place of the first and the runs over them by level.

        ``above`` (tree, level, digests left and right) holds what goes on from a tree's root; ``fold`` gets the tree's own.
        """
        side = _side(self.stretches)
        if self.runs is not None:
            side = side.unionByName(_asked(self.stretches, self.runs, self.levels, self.fanout))
        if above is not None:
            upper = self.stretches.select("part", "tree").join(above, "tree")
            side = side.unionByName(upper.select("part", "tree", F.lit("above").alias("kind"), "level", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("total"), "digests"))
        fanout = self.fanout

        def run(_: tuple, leaves: pa.Table, side: pa.Table) -> pa.Table:
            about: dict[str, dict] = {}
            fetched: dict[str, dict[tuple[int, int], list[str]]] = {}
            upper: dict[str, dict[int, list[str]]] = {}
            for r in side.to_pylist():
                if r["kind"] == "stretch":
                    about[r["tree"]] = r
                elif r["kind"] == "run":
                    fetched.setdefault(r["tree"], {})[r["level"], r["place"]] = r["digests"]
                else:
                    upper.setdefault(r["tree"], {})[r["level"]] = r["digests"]
            tables = []
            for tree, mine in _sorted_leaves(leaves) if leaves.num_rows else ():
                place, total = about[tree]["place"], about[tree]["total"]
                levels = _paths(mine["leaf"].to_pylist(), place, total, fetched.get(tree, {}), fanout)
                above_ = [upper[tree][k] for k in sorted(upper.get(tree, {}))]
                tables.append(fold(mine, place, levels, above_, fanout))
            return pa.concat_tables(tables) if tables else empty

        empty = _empty(schema)
        return self.placed.groupBy("part").cogroup(side.groupBy("part")).applyInArrow(run, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in fields})


def _above(mine: pa.Table, place: int, levels: list[dict[int, list[str]]], _: list, fanout: int) -> pa.Table:
    """Per leaf of the upper tree and level: what stands left and right of it, and of what holds it."""
    rows = []
    for k, tree in enumerate(mine["place_by"].to_pylist()):
        at = place + k
        for level, runs in enumerate(levels):
            parent, own = divmod(at, fanout)
            rows.append((tree, level, ["".join(runs[parent][:own]), "".join(runs[parent][own + 1 :])]))
            at = parent
    return pa.table({"tree": pa.array([r[0] for r in rows], pa.string()), "level": pa.array([r[1] for r in rows], pa.int32()), "digests": pa.array([r[2] for r in rows], pa.list_(pa.string()))})


def _proved(mine: pa.Table, place: int, levels: list[dict[int, list[str]]], above: list[list[str]], fanout: int) -> pa.Table:
    leaves, out = mine["leaf"].to_pylist(), []
    subroot = root = digest(levels[-1][0]) if levels else leaves[0]
    for left, right in above:
        root = digest([left, root, right])
    for k, (leaf, claim) in enumerate(zip(leaves, mine["claim"].to_pylist(), strict=True)):
        siblings, folded = _fold(claim, place + k, levels, fanout)
        for left, right in above:
            siblings += [left, right]
            folded = digest([left, folded, right])
        out.append((leaf, subroot, root, digest(siblings), folded, folded == root))
    kinds = {"leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof": pa.string(), "folded_root": pa.string(), "verified": pa.bool_()}
    return pa.table({"doc_id": mine["place_by"]} | {c: pa.array([r[j] for r in out], t) for j, (c, t) in enumerate(kinds.items())})


class Manifest:
    """The trees of a table by ``source``, and the tree over their roots.

    Leaves ascend by doc_id, null first, then by digest; rows that are alike in all fields are leaves of their own, side by
    side. Null is a source of its own, the first. A source's lone leaf is its root; of one source the root is the
    whole table's. An empty table has no nodes. Values are hashed whole as text; other columns than ``fields`` are not read.
    """

    def __init__(self, docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, source: str = "source", doc_id: str = "doc_id", text: str = "text", fanout: int = FANOUT) -> None:
        values = {c: F.col(f"`{c}`") for c in fields}
        leaf = leaf_of(list(values.values()))
        claim = leaf if tampered is None else F.when(tampered, leaf_of([small(v) if c == text else v for c, v in values.items()])).otherwise(leaf)
        self.trees = Forest(docs.select(tree_of(F.col(f"`{source}`")).alias("tree"), F.col(f"`{doc_id}`").cast("long").alias("place_by"), leaf.alias("leaf"), claim.alias("claim")), fanout)
        subroots = self.trees.roots()
        self.top = Forest(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("place_by"), F.col("digest").alias("leaf")), fanout)

    def nodes(self) -> DataFrame:
        """(source, level, place, digest): the manifest's nodes above the leaves; level -1 is the tree over the sources' roots, by level below 0."""
        named = lambda n: n.where("level > 0").select(F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 30)).alias("source"), "level", "place", "digest")
        top = self.top.nodes.where("level > 0").select(F.lit(None).cast("string").alias("source"), (-F.col("level")).alias("level"), "place", "digest")
        return named(self.trees.nodes).unionByName(top)

    def root(self) -> DataFrame:
        return self.top.roots().select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """Per row: doc_id, leaf, subroot, root, proof (digest of the siblings), folded_root (from the row as ``tampered`` has it) and verified."""
        above = written(self.top.folded(_above, "tree string, level int, digests array<string>"))
        schema = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
        return self.trees.folded(_proved, schema, above)


def small(text: Column) -> Column:
    """A-Z in lower case."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
