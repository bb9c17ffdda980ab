"""The queries opN_ and the stages over small tables with nulls, repeats and clashing columns, against plain restatements."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from kinetra.llm import lang_id, queries, vector_packing
from tests.llm.test_other_operators import brute_verdict
from tests.llm.test_text_operators import LIBRARY, brute_classes, brute_running, corpus, words

CLASH = ("score", "block", "shard", "weight", "node", "term", "h", "v", "rank", "host", "rule", "ledger", "language", "carried", "prompt")


def documents():
    rows = [(i, t, random.Random(i).choice(["en", "de", None])) for i, t, *_ in corpus(30, 4) if t is None or len(t) < 9000]
    passage = " ".join(f"w{k}" for k in range(40))
    rows += [(None, rows[3][1], "en"), (None, None, None), rows[5], (900, f"{passage} end", "de"), (901, f"begin {passage}", "de"), (902, " " * 5000 + "x", "en")]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = documents()
    rng = np.random.default_rng(4)
    vectors = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(rng.normal(size=(400, 16)))] + [(None, [1.0] * 16), (500, None), (600, [0.0] * 16), (7, [2.0] * 16)]
    urls = ["http://www.example.com/en/x", "https://EXAMPLE.com/en/?q", "http://a.net/es/1", "http://cheap-pills.example.net/x", "x", None, "ftp://u.org", "http://a.net/fr/", "http://a.net/fr"]
    made = {
        "documents": spark.createDataFrame([(i, t, v, "s", len(t or "")) for i, t, v in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>"),
        "pages": spark.createDataFrame([(k if k else None, u) for k, u in enumerate([*urls, urls[0]])], "page_id long, url string"),
    }
    for name, df in made.items():
        df = df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
        df.limit(0).write.parquet(f"{folder}/none/{name}.parquet")
    return folder, rows, vectors, [*urls, urls[0]]


def result(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0]).collect()


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tables, name):
    assert queries.QUERIES[name](spark, f"{tables[0]}/none").count() == 0


def test_op1(spark, tables):
    rows, first = tables[1], {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    want = []
    for i, t, _ in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert any(r[2] for r in want)
    same(result(spark, tables, "op1_substring_rlz"), want)


def test_op2(spark, tables):
    usable = [(k, np.array(v, float)) for k, v in tables[2] if k is not None and v is not None and any(v)]
    got: dict = {}
    for r in result(spark, tables, "op2_ann_mih"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {k for k, _ in usable if k % 100 == 0}
    hit = 0
    for q, vec in ((k, v) for k, v in usable if k % 100 == 0):
        best = sorted((float(np.sqrt(((v - vec) ** 2).sum())), k) for k, v in usable if k != q)
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11)) and all((f[2], f[1]) in best for f in found)
        hit += len({b[1] for b in best[:10]} & {f[1] for f in found})
    assert hit >= 0.9 * 10 * len(got)


def test_op3_op9(spark, tables):
    ids = [(i, LIBRARY.encode(t or "", add_special_tokens=False).ids, len((t or "").encode())) for i, t, _ in tables[1]]
    same(result(spark, tables, "op3_token_counts"), [(i, n, len(x), len(x) > 512) for i, x, n in ids])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    same(result(spark, tables, "op9_bpe_tree"), [(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(LIBRARY.decode(x, skip_special_tokens=False).encode())) for i, x, _ in ids])


def test_op4(spark, tables):
    want = [(k if k else None, *brute_verdict(u, queries.URL_RULES, queries.URL_BLOCKED)) for k, u in enumerate(tables[3])]
    assert {w[4] for w in want} == {"allow", "block"}
    same(result(spark, tables, "op4_url_filter"), want)


def test_op5(spark, tables):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(x.lower() for x in words(t)), b"\n"]
    learned = [t for i, t, _ in tables[1] if i is not None and not held(i)]
    train = Counter(x for t in learned for x in tokens(t))
    n, v, score = sum(train.values()), len(train), brute_running(learned, 6)
    want = {}
    for i, t, _ in tables[1]:
        terms = tokens(t)
        want.setdefault(i, []).append((len(terms), sum(x in train for x in terms), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in terms), score(t)))
    got: dict = {}
    for r in result(spark, tables, "op5_context_tree"):
        assert bool(r["held_out"]) == held(r["doc_id"])
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    assert set(got) == set(want)
    for i, mine in want.items():
        for a, b in zip(sorted(got[i]), sorted(mine), strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-6)


def test_op6(spark, tables):
    got = result(spark, tables, "op6_rule_ledger")
    want = []
    for i, t, _ in tables[1]:
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = len({k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[g] > 1 for j in range(3)})
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)))
    same([tuple(r)[:7] for r in got], want)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)


def plain_prediction(model, text):
    """The definition in plain loops: runs of one to four bytes, their embeddings' mean, a softmax."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    z, total = np.zeros(model.embed.shape[1]), 0
    for at in range(len(data)):
        h = 0
        for n in range(1, 5):
            if at + n > len(data):
                break
            h = (h * 0x01000193 + data[at + n - 1] + n) % (1 << 32)
            z += model.embed[(h * 0x9E3779B1) % (1 << 32) >> 19]
            total += 1
    logits = (z / total * model.scale @ model.out + model.bias) / model.heat
    p = np.exp(logits - logits.max())
    p /= p.sum()
    return model.labels[int(p.argmax())], float(p.max())


def test_op7(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    model = lang_id.train(docs.where(~lang_id.held_out(F.col("doc_id"))))
    want = {}
    for i, t, _ in tables[1]:
        want.setdefault(i, []).append(plain_prediction(model, t))
    got: dict = {}
    for r in result(spark, tables, "op7_lang_id"):
        assert bool(r["held_out"]) == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    for i, mine in want.items():
        for a, b in zip(sorted(got[i]), sorted(mine), strict=True):
            assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-4)


def test_rare_languages_are_learned(spark):
    parts = {"aa": "tha", "bb": "los", "cc": "zun"}
    rows = [(k, f"{parts[v]}{k} {parts[v] * 3} {parts[v]}", v) for k, v in enumerate(["aa"] * 1500 + ["bb"] * 1500 + ["cc"] * 4)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=400)
    assert model.labels == ["aa", "bb", "cc"]
    assert lang_id.train(spark.createDataFrame([(1, "x" * (lang_id.SAMPLE_BYTES + 1), "aa")], "doc_id long, text string, lang string")) is None


def test_op8(spark, tables):
    named = [(i, t) for i, t, _ in tables[1] if i is not None]
    classes = brute_classes(list(dict.fromkeys(named)), 4, 85)
    want = [(i, *classes[i]) for i, _ in named]
    got = result(spark, tables, "op8_jaccard_vertical")
    same([r for r in got if r["doc_id"] is not None], want)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]


def test_op10(spark, tables):
    want: dict = {}
    for i, t, _ in tables[1]:
        want.setdefault(i, []).append((np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), len((t or "").encode()) // vector_packing.PROMPT_BYTES))
    rows = result(spark, tables, "op10_vector_packing")
    assert sum(r["length"] for r in rows) == sum(len(x) for many in want.values() for x, _ in many)
    sequences: dict = {}
    for r in rows:
        fits = [p for x, p in want[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert fits
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], max(0, r["start"] + r["length"] - max(r["start"], fits[0]))))
    for parts in sequences.values():
        ends = 0
        for offset, length, _ in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= vector_packing.TOKENS and len(parts) <= vector_packing.SEGMENTS and sum(p[2] for p in parts) <= vector_packing.LOSS


def test_stages_with_nulls_and_repeats(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == columns and stage(spark, docs.limit(0), "").count() == 0
    kept = pipeline.quality_rules(spark, docs, "")
    assert kept.where("text is null").count() == docs.where("text is null").count()
    assert pipeline.language(spark, docs, "").where("text is null").count() == 0
    single = pipeline.near_duplicates(spark, docs, "").collect()
    assert sum(r["doc_id"] is None for r in single) == 2
    ids = [r["doc_id"] for r in single if r["doc_id"] is not None]
    classes = brute_classes(list(dict.fromkeys((i, t) for i, t, _ in tables[1] if i is not None)), pipeline.SHINGLE, pipeline.PERCENT)
    assert sorted(ids) == sorted({c for _, c in classes.values()})
    cut = pipeline.repeated_passages(spark, docs, "").collect()
    assert len(cut) == len(tables[1]) and sum(r["text"] is None for r in cut) == sum(t is None for _, t, _ in tables[1])
    assert pipeline.packing(spark, docs, "").count() > 0 and pipeline.packing(spark, docs.limit(0), "").count() == 0
