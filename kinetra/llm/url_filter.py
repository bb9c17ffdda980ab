"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A list row is a canonical host and path prefix with an action. A page is looked up under those of its host's
suffixes (whole labels) that have as many labels as a listed host, with each listed length of path prefix. The Bloom filter (blocks of four 64-bit words,
one bit in each word) lets through possible hits only; the join on the key itself removes false positives.
DataFrame functions only.

Defined cases: a null url or one without ``://`` has an empty host and path and meets no list row; list rows with
a null host or path list nothing; repeated list rows count once (a block wins over an allow of the same key);
repeated pages are judged one by one; other columns are carried untouched, of an equal name the new one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed key; a block has 256.
BITS_PER_KEY = 24
#: A filter of at most so many blocks (36 bytes each) is sent to all executors; a larger one is joined by its block.
BROADCAST_BLOCKS = 1 << 18
#: The exact list is broadcast up to so many keys; beyond that the possible hits and the list are shuffled by key.
BROADCAST_KEYS = 1 << 16


def _tail(url: Column) -> Column:
    """What follows the first ``://``."""
    return F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Up to the first of ``/?#``, with A-Z in lower case (other letters as they are)."""
    raw = F.regexp_extract(_tail(F.coalesce(url, F.lit(""))), r"(?s)^([^/?#]*)", 1)
    return _lowered(raw)


def path_of(url: Column) -> Column:
    """From the host's end up to the first of ``?#``."""
    return F.regexp_extract(_tail(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def _lowered(host: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _block(h: Column, n_blocks: int) -> Column:
    return F.pmod(h, F.lit(n_blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each of a block's four words, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 8 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(4)]


def listed(rules: DataFrame, is_rule: bool = True) -> DataFrame:
    """Canonical keys of a list (host, path, action): one row for each key."""
    r = rules.select(_lowered(F.col("host")).alias("host"), F.col("path"), "action").where("host is not null and path is not null and host != ''")
    return r.groupBy("host", "path").agg(F.max("action").alias("action")).select(
        "host", "path", "action", F.lit(is_rule).alias("is_rule"), F.concat("host", F.lit("\n"), "path").alias("key")
    )


def bloom(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The filter as rows (block, w0..w3) and its number of blocks, which grows with the list."""
    n_blocks = max(1, -(-n_keys * BITS_PER_KEY // 256))
    rows = keys.select(_block(F.xxhash64("key"), n_blocks).alias("block"), *[b.alias(f"w{j}") for j, b in enumerate(_bits(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(4)]), n_blocks


def judge(pages: DataFrame, rules: DataFrame, blocked: DataFrame | None = None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (host + path of the longest rule that fits, or null) and verdict.

    ``rules`` (host, path, action) decide first: the longest that fits wins; of equal lengths the one with the
    longer host, which leaves one, as a page has one host suffix and one path prefix of each length. A page without
    a rule is blocked if the canonical list ``blocked`` (host, path) has it, else allowed. Both share one filter.
    """
    new = ("host", "path", "rule", "verdict")
    keys = listed(rules)
    if blocked is not None:
        keys = keys.union(listed(blocked.select("host", "path", F.lit("block").alias("action")), False))
    labels = F.size(F.split("host", r"\."))
    sizes = keys.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.sort_array(F.collect_set(labels)).alias("labels")).first()
    carried = [c for c in pages.columns if c not in new]
    base = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"),
        host_of(F.col(f"`{url}`")).alias("host"),
        path_of(F.col(f"`{url}`")).alias("path"),
    )
    columns = [F.col("_row")[c].alias(c) for c in carried] + [F.col("host"), F.col("path")]
    if not sizes["n"]:
        return base.select(*columns, F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    filt, n_blocks = bloom(keys, sizes["n"])
    if n_blocks <= BROADCAST_BLOCKS:
        filt = F.broadcast(filt)
    # Only suffixes of as many labels as a listed host has, so that a host of very many labels costs no more than its length.
    suffixes = F.transform(F.filter(F.array(*[F.lit(x) for x in sizes["labels"]]), lambda k: k <= labels), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    lengths = F.filter(F.array(*[F.lit(x) for x in sizes["lengths"]]), lambda k: k <= F.length("path"))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda k: F.concat(s, F.lit("\n"), F.substr(F.col("path"), F.lit(1), k)))))
    tries = base.where("host != ''").select("host", "path", F.explode(pairs).alias("key"))
    possible = tries.withColumn("block", _block(F.xxhash64("key"), n_blocks)).join(filt, "block")
    for j, b in enumerate(_bits(F.col("key"))):
        possible = possible.where(F.col(f"w{j}").bitwiseAND(b) != 0)
    exact = keys.select(
        "key", "is_rule", "action", F.concat("host", "path").alias("rule"),
        F.length("host").alias("n_host"), F.length(F.concat("host", "path")).alias("n_rule"),
    )
    if sizes["n"] <= BROADCAST_KEYS:
        exact = F.broadcast(exact)
    hits = possible.select("host", "path", "key").join(exact, "key")
    best = hits.groupBy("host", "path").agg(
        F.max(F.when(F.col("is_rule"), F.struct("n_rule", "n_host", "rule", "action"))).alias("best"),
        F.bool_or(~F.col("is_rule")).alias("hit"),
    )
    verdict = F.coalesce("best.action", F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    # Pages without a host meet nothing: a key of their own each spreads them over the tasks.
    spread = F.when(F.col("host") == "", F.concat(F.lit("\n"), F.xxhash64("_row").cast("string"))).otherwise(F.col("path"))
    keyed = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best", "hit")
    return base.join(keyed, (F.col("host") == F.col("_host")) & (spread == F.col("_path")), "left").select(*columns, F.col("best.rule").alias("rule"), verdict.alias("verdict"))
