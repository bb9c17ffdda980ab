"""Each stage of the pipeline against a plain restatement, on one small table."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from tests.llm.test_text_operators import LIBRARY, brute_classes


def table(spark):
    rng = random.Random(8)
    syllables = {"en": ["the", "ing", "on", "er"], "es": ["que", "los", "ción", "ar"], "de": ["sch", "ung", "zu", "der"]}
    word = lambda v: "".join(rng.choices(syllables[v], k=rng.randint(1, 3)))
    text = lambda v, n: " ".join(word(v) for _ in range(n))
    rows = [(v, text(v, rng.randint(60, 140))) for v in rng.choices(list(syllables), k=60)]
    passage = text("en", 70)
    rows += [("en", f"{text('en', 40)} {passage} {text('en', 30)}") for _ in range(3)]
    rows += [rows[0], (rows[1][0], rows[1][1] + " ing"), ("en", "short but clean the ing"), ("en", " ".join(w + "###" for w in text("en", 60).split()))]
    rows += [("en", "THE!! ING!! " * 40), ("de", "\n".join([text("de", 12)] * 9)), ("en", "1234 5678 90"), (None, text("es", 80)), ("en", None)]
    return spark.createDataFrame([(k, t, v, "src", len(t or "")) for k, (v, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_stages(spark):
    docs, rows = table(spark)
    kept = pipeline.quality_rules(spark, docs, "").cache()
    ids = {r["doc_id"] for r in kept.collect()}
    junk = {66, 67, 68}
    assert kept.columns == docs.columns and not ids & junk and set(range(60)) <= ids and 65 in ids
    named = pipeline.language(spark, kept, "").cache()
    after = {r["doc_id"]: r for r in named.collect()}
    assert set(after) <= ids and {k for k, (_, t) in enumerate(rows) if k in ids and (t is None or not any(c.isalpha() for c in t))}.isdisjoint(after)
    assert set(range(60)) <= set(after)
    single = pipeline.near_duplicates(spark, named, "").cache()
    left = {r["doc_id"]: r for r in single.collect()}
    classes = brute_classes([(k, r["text"]) for k, r in after.items()], pipeline.SHINGLE, pipeline.PERCENT)
    assert set(left) == {k for k, (_, c) in classes.items() if c == k} and single.columns == docs.columns
    cut = pipeline.repeated_passages(spark, single, "").cache()
    seen: dict = {}
    for k in sorted(left):
        w = left[k]["text"].encode().split()
        for i in range(len(w) - pipeline.PASSAGE + 1):
            seen.setdefault(tuple(w[i : i + pipeline.PASSAGE]), k)
    changed = 0
    for r in cut.collect():
        w = left[r["doc_id"]]["text"].encode().split()
        gone = {j for i in range(len(w) - pipeline.PASSAGE + 1) if seen[tuple(w[i : i + pipeline.PASSAGE])] < r["doc_id"] for j in range(i, i + pipeline.PASSAGE)}
        expect = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else left[r["doc_id"]]["text"]
        assert r["text"] == expect and r["n_chars"] == len(expect) and r["lang"] == left[r["doc_id"]]["lang"]
        changed += bool(gone)
    assert changed == 2 and cut.count() == len(left)
    total = sum(len(LIBRARY.encode(r["text"], add_special_tokens=False).ids) + 1 for r in cut.collect())
    assert sum(r["length"] for r in pipeline.packing(spark, cut, "").collect()) == total


def test_run_and_empty(spark, tmp_path):
    docs, _ = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
