"""URL filter, vector search, blocks and components: against brute force, and their defined cases."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.llm import ann_mih, blocks, components, url_filter


def brute_verdict(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:k], rest[k:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = lambda h, p: host and (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max(((len(h + p), len(h), h + p, a) for h, p, a in rules if fits(h, p)), default=None)
    hit = any(fits(h, p) for h, p in blocked)
    return host, path, best[2] if best else None, best[3] if best else ("block" if hit else "allow")


def test_urls(spark):
    rng = random.Random(3)
    hosts = ["a.com", "A.Com", "x.a.com", "b.net", "www.b.net", "ba.com", "", "com", "c.org", "x..c.org"]
    paths = ["", "/", "/en", "/en/", "/en/1?x=/fr/", "/fr/2#/en/", "?q", "#f", "/en/\n", "/é/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "http://a.com://b.net/", "http://a.com/en/"]
    rng.shuffle(urls)
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("x.a.com", "/en/", "allow"), ("b.net", "/en", "block"), ("b.net", "/en", "allow")]
    blocked = [("c.org", "/"), ("b.net", "/fr/"), (None, "/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    r = spark.createDataFrame(rules, "host string, path string, action string")
    b = spark.createDataFrame(blocked, "host string, path string")
    one = [x for x in rules if x != ("b.net", "/en", "allow")]  # of two actions for a key the block stays
    for row in url_filter.judge(pages, r, b).collect():
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == brute_verdict(row["url"], one, [x for x in blocked if x[0]])
    assert url_filter.judge(pages.limit(0), r, b).count() == 0
    assert {x["verdict"] for x in url_filter.judge(pages, r.limit(0)).collect()} == {"allow"}


def test_hosts_of_very_many_labels(spark):
    """A host of a megabyte costs no more than its length, whether labels or one letter; it still meets the rule."""
    hosts = ["a." * 500_000 + "com", "b" * 1_000_000 + ".com", "." * 300_000 + "net"]
    pages = spark.createDataFrame([(k, f"http://{h}/en/") for k, h in enumerate(hosts)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block"), ("x.com", "/en/", "allow"), ("a.b.c.net", "/", "block")], "host string, path string, action string")
    url_filter.judge(pages.limit(0), rules).count()
    began = time.perf_counter()
    got = {r["page_id"]: (len(r["host"]), r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {0: (1_000_003, "com/", "block"), 1: (1_000_004, "com/", "block"), 2: (300_003, None, "allow")}
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("bound", [0, 1 << 18])
def test_lists_beyond_the_broadcast(spark, monkeypatch, bound):
    """The filter and the list are joined by shuffles where they are too large to be sent; blocks are many."""
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", bound)
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", bound)
    rng = random.Random(6)
    rules = [(f"h{k % 300}.{rng.choice(['com', 'net'])}", rng.choice(["/", "/en/", "/en/x"]), rng.choice(["allow", "block"])) for k in range(400)]
    rules = list({r[:2]: r for r in rules}.values())
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}h{rng.randrange(600)}.{rng.choice(['com', 'net', 'org'])}{rng.choice(['/', '/en/', '/en/xy', ''])}" for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    assert len(found) == 500
    for row in found:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == brute_verdict(row["url"], rules, [])


def test_bloom_has_no_false_negatives(spark):
    keys = url_filter.listed(spark.range(500).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"), F.lit("block").alias("action")))
    filt, n = url_filter.bloom(keys, 500)
    assert filt.count() <= n
    met = keys.withColumn("block", url_filter._block(F.xxhash64("key"), n)).join(filt, "block")
    for j, bit in enumerate(url_filter._bits(F.col("key"))):
        met = met.where(F.col(f"w{j}").bitwiseAND(bit) != 0)
    assert met.count() == 500


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 900)] + 0.4 * rng.normal(size=(900, 24))
    x[17] = x[18] = x[16]  # ties go to smaller ids
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0]), (1004, [None] + [1.0] * 23), (None, [1.0] * 24), (1100, [float("inf")] * 24)]
    df = spark.createDataFrame([(a, b, "q") for a, b in rows], "vec_id long, embedding array<float>, score string")
    got: dict = {}
    for r in ann_mih.search(df, df.where("vec_id % 10 = 6 or vec_id >= 1000"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.array([b for _, b in rows[:900]], dtype=float)
    hit = 0
    assert set(got) == set(range(6, 900, 10))
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:5]
        hit += len(set(best) & {f[1] for f in found})
        assert [f[0] for f in sorted(found)] == list(range(1, len(found) + 1))
        assert all(s == d[i] for _, i, s in found)
    assert hit >= 0.9 * 5 * len(got)
    assert [f[1] for f in sorted(got[16])][:2] == [17, 18]
    assert ann_mih.search(df.limit(0), df.limit(0)).count() == 0


def test_vector_search_leaves_no_query_short(spark):
    rng = np.random.default_rng(5)
    copies = np.repeat(rng.normal(size=(4, 24)), 300, axis=0) + 1e-4 * rng.normal(size=(1200, 24))
    skewed = np.concatenate([copies, 20 * rng.normal(size=(12, 24))])  # the radius is that of the dense groups
    for x, k in ((skewed, 10), (rng.normal(size=(11, 24)), 10), (rng.normal(size=(5, 24)), 10), (rng.normal(size=(2, 24)), 3)):
        v = x.astype(np.float32).astype(float)
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
        asked = df.where(f"vec_id >= {len(v) - 12} or vec_id % 100 = 0")
        got: dict = {}
        for r in ann_mih.search(df, asked.union(asked), k=k).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert set(got) == {r["vec_id"] for r in asked.collect()}
        for q, found in got.items():
            want = min(k, len(v) - 1)
            assert [f[0] for f in sorted(found)] == list(range(1, want + 1))
            assert len({f[1] for f in found} - {q}) == want
            if want == len(v) - 1:
                assert {f[1] for f in found} == set(range(len(v))) - {q}


def test_probing_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 40))
    codes = ann_mih.Codes(x, 10)
    codes.radius = 9
    index = codes.of(x)
    tables = []
    for sub in index.T:
        order = np.argsort(sub, kind="stable")
        tables.append((order, np.searchsorted(sub[order], np.arange(1 << 16 | 1))))
    for q in range(0, 600, 37):
        near = np.flatnonzero(np.bitwise_count(index ^ index[q]).sum(axis=1) <= 9)
        found = [set(ann_mih.probe(t, v, s)) for t, v, s in zip(tables, index[q], codes.shares(), strict=True)]
        assert set(near) <= set().union(*found)
        assert all(f == set(np.flatnonzero(np.bitwise_count(sub ^ v) <= s)) for f, sub, v, s in zip(found, index.T, index[q], codes.shares(), strict=True))


def test_vector_search_with_split_buckets(spark, monkeypatch):
    """Buckets of many rows and queries are split; each pair is met once whatever the split."""
    rng = np.random.default_rng(9)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 80, axis=0), rng.normal(size=(120, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann_mih.search(df, df.where("vec_id % 10 = 0"), k=7).collect()))
    monkeypatch.setattr(ann_mih, "BLOCK", 16)
    monkeypatch.setattr(ann_mih, "QUERIES", 3)
    assert sorted(map(tuple, ann_mih.search(df, df.where("vec_id % 10 = 0"), k=7).collect())) == whole
    assert len(whole) == 20 * 7 and len({(q, v) for q, _, v, _ in whole}) == len(whole)


def test_packing_of_keys():
    h = np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    for shards in (1, 7, 64):
        back = blocks.unpack_keys(blocks.pack_keys(h, shards))
        assert (back == (h // np.uint64(shards)) & np.uint64((1 << 56) - 1)).all()
    n = np.array([5, -3, 1 << 60, 0])
    assert (blocks.unpack_numbers(blocks.pack_numbers(n)) == n).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(17)] + [(5, 5)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
