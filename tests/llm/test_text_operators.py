"""Operators on texts against brute force, and their defined cases."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kinetra.llm import bpe_tree, ctw, dictionary, jaccard_join, lang_id, rule_ledger, substring_dedup, token_counts, vector_packing
from kinetra.llm.text import vocabulary

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(TOKENIZER)
SCHEMA = "doc_id long, text string, lang string, n_words string, ids string, ledger string"


def corpus(n=40, seed=1):
    """Documents with copies, near copies, shared passages, nulls, blanks and a long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioust") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    docs = [text(rng.randint(1, 90)) for _ in range(n)]
    passage = text(30)
    docs += [docs[3], docs[5], docs[5] + " end", text(10) + "\n" + passage + " " + text(5), passage + "\t" + text(20), passage.upper()]
    near = docs[7].split()
    docs += [" ".join([*near[:-1], "changed"]), None, "", "   \n\t ", "a", text(4000), "<|endoftext|> and <|endoftext|>x", "naïve café — 東京 🙂  x y", "x" * 3000, "\x00 \x00"]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, t, "en", "w", "i", "l") for i, t in zip(order, docs, strict=True)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(t):
    return (t or "").encode().split()


def test_substring_dedup_is_exact(spark, docs):
    rows, df = docs
    for window in (3, 13):
        first: dict = {}
        for i, t in sorted((r[0], r[1]) for r in rows):
            w = words(t)
            for k in range(len(w) - window + 1):
                first.setdefault(tuple(w[k : k + window]), i)
        for r in substring_dedup.dedup(df, window, carry=["lang"]).collect():
            w = words(dict((x[0], x[1]) for x in rows)[r["doc_id"]])
            gone = np.zeros(len(w), bool)
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < r["doc_id"]:
                    gone[k : k + window] = True
            assert r["n_words"] == len(w) and r["n_removed"] == gone.sum() and r["carried"]["lang"] == "en"
            assert r["kept_text"].encode() == b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
            for f in r["factors"]:  # each factor is a copy that is there
                source = words(dict((x[0], x[1]) for x in rows)[f["source"]])
                assert f["length"] >= window and f["source"] < r["doc_id"]
                assert source[f["at"] : f["at"] + f["length"]] == w[f["start"] : f["start"] + f["length"]]


def test_substring_dedup_copies_run_on_in_the_source(spark):
    df = spark.createDataFrame([(1, "a b c x b c d"), (2, "a b c d"), (3, "q b c d b c d")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], [tuple(f) for f in r["factors"]]) for r in substring_dedup.dedup(df, 3).collect()}
    assert got == {1: (0, []), 2: (4, [(0, 3, 1, 0)]), 3: (6, [(1, 3, 1, 4), (4, 3, 1, 4)])}


def test_substring_dedup_defined_cases(spark):
    t = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(None, t), (2, t), (2, t), (1, None), (3, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.dedup(df).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (2, 0), (3, 20)]
    assert substring_dedup.dedup(df.limit(0)).count() == 0


def test_substring_dedup_leaves_untouched_texts(spark):
    df = spark.createDataFrame([(1, "a  b\n c"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept_text"] for r in substring_dedup.dedup(df, as_is=True).collect()} == {1: "a  b\n c", 2: None}


def brute_classes(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_classes(spark, docs):
    rows, df = docs
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(160)]
    chain = []
    for k in range(25):  # a chain of near copies: ends link only through the middle
        base[rng.randrange(160)] = f"new{k}"
        chain.append((1000 + k, " ".join(base)))
    tiny = [(2000 + k, t) for k, t in enumerate(["a b c d", "a b c d e", "a b c", "A B C", "a b c d e f g h", "a b c d e f g h i"])]
    extra = spark.createDataFrame([(i, t, "en", "w", "i", "l") for i, t in chain + tiny], SCHEMA)
    pairs = [(r[0], r[1]) for r in rows] + chain + tiny
    for size, percent in ((4, 85), (5, 80), (2, 50)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(df.union(extra), size, percent).collect()}
        assert got == brute_classes(pairs, size, percent)


def test_jaccard_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["component_id"]) for r in jaccard_join.classes(df).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 2)]
    assert jaccard_join.classes(df.limit(0)).count() == 0


def test_documents_without_words_link_with_nothing(spark):
    """Not with their like either: two of each kind, in the operator, in the query's terms and in the stage, which keeps all."""
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, " \n"), (6, " \n"), (7, "a b c"), (8, "a b c"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((4, 85), (5, 80)):
        got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(df, size, percent).collect())
        assert got == [(0, 0, None), (0, 0, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7)]
    docs = df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7]


def test_texts_of_one_hash_stay_apart(spark, docs, monkeypatch):
    """64 bits that collide at every turn: the other 64 tell the texts apart, in the classes and in the stage."""
    rows, df = docs
    monkeypatch.setattr(jaccard_join, "text_hashes", lambda t: (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") % 3, F.xxhash64(t)))
    extra = [(5000, None), (5001, None), (5002, ""), (5003, "only here"), (5004, "only here"), (5005, "only HERE")]
    pairs = [(r[0], r[1]) for r in rows] + extra
    table = df.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = brute_classes(pairs, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(table, 4, 85).collect()} == want
    full = table.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, full, "").collect())
    assert kept == sorted({c for _, c in brute_classes(pairs, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT).values()})


def test_long_terms_are_not_broadcast(spark):
    """Terms beyond the bound in bytes meet the table in the join, and the sums stay right."""
    rng = random.Random(1)
    rows = [(k, " ".join(["x" * 400_000 + str(k % 3), "word", *rng.choices(["a", "bb", "c" * 65], k=5)])) for k in range(12)] + [(99, "y" * 5_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, TOKENIZER).collect()} == {k: len(LIBRARY.encode(t, add_special_tokens=False).ids) for k, t in rows}
    table = dictionary.term_counts(df.select("text", F.lit(0).alias("label")), lambda t: t.split())
    known = dictionary.head_of(table, ["n"], 1 << 19).value[0]
    assert set(known) == {"word", "a", "bb"}


def test_counts_codes_and_packing(spark, docs):
    rows, df = docs
    ids = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    for head in (0, 50, 1 << 19):
        assert {r["doc_id"]: (r["n_tokens"], r["n_bytes"]) for r in token_counts.count_tokens(df, TOKENIZER, head=head).collect()} == {i: (len(ids[i]), len((t or "").encode())) for i, t, *_ in rows}
    for r in bpe_tree.encode_decode(df, TOKENIZER).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]]
        assert r["decoded"] == LIBRARY.decode(ids[r["doc_id"]], skip_special_tokens=False)
    pieces = vector_packing.pack(df, TOKENIZER, tokens=256).collect()
    made = {i: np.array([*x, 1], "<u4") for i, x in ids.items()}
    for r in pieces:
        assert r["ids"] == made[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(made[r["doc_id"]])
    assert sum(r["length"] for r in pieces) == sum(map(len, made.values()))
    by_sequence: dict = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    for operator in (token_counts.count_tokens, bpe_tree.encode_decode, vector_packing.pack):
        assert operator(df.limit(0), TOKENIZER).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 60)), max_size=60), st.integers(1, 6), st.integers(5, 32))
def test_packer_keeps_all_limits(items, segments, loss):
    packer = vector_packing.Packer(32, segments, loss)
    for k, (length, prompt) in enumerate(items):
        packer.add(k, 0, length, prompt)
    packer.finish()
    covered = [set() for _ in items]
    for sequence in packer.take():
        assert len(sequence) <= segments and sum(n for _, _, n in sequence) <= 32
        assert sum(max(0, s + n - max(s, items[k][1])) for k, s, n in sequence) <= loss
        for k, s, n in sequence:
            assert not covered[k] & set(range(s, s + n))
            covered[k] |= set(range(s, s + n))
    assert [len(c) for c in covered] == [n for n, _ in items]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_segment_tree_merges_like_the_library(text):
    encoder = bpe_tree.Encoder(TOKENIZER)
    ids = encoder.encode(text)
    assert list(ids) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == LIBRARY.decode(list(ids), skip_special_tokens=False)
    assert vector_packing.ids_of(text, TOKENIZER) == list(ids)
    assert len(vocabulary(TOKENIZER).pre_tokens(text)) <= len(ids)


def test_rules(spark, docs):
    rows, df = docs
    got = {r["doc_id"]: r for r in rule_ledger.with_ledger(df).select("doc_id", "lang", "ledger.*").collect()}
    for i, t, *_ in rows:
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), len(repeat), len(lines) - len(set(lines)))
        assert got[i]["word_chars"] == sum(len(x.decode()) for x in w)
        assert bool(got[i]["bits"] & 1) == (len(w) < 50)
    ledger = rule_ledger.with_ledger(df).select("ledger.bits")
    one = {r["rule"]: r for r in rule_ledger.ablations(ledger, "base-1").collect()}
    bits = [r["bits"] for r in ledger.collect()]
    assert one["few_words"]["n_failed"] == sum(b & 1 for b in bits) and one["few_words"]["n_only"] == sum((b & 3) == 1 for b in bits)
    assert rule_ledger.with_ledger(df.limit(0)).count() == 0


def test_rules_filter_once(spark, docs):
    kept = rule_ledger.with_ledger(docs[1], out="x").where(rule_ledger.passes("corpus-1", F.col("x.bits")))
    assert 0 < kept.count() < len(docs[0])


def test_language(spark):
    rng = random.Random(2)
    parts = {"aa": ["tha", "ing", "er"], "bb": ["ção", "los", "que"], "cc": ["sch", "ung", "zu"]}
    rows = [(k, " ".join("".join(rng.choices(parts[v], k=3)) for _ in range(rng.randint(5, 40))), v) for k, v in enumerate(rng.choices(list(parts), k=240))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df.where("doc_id % 5 != 0"))
    got = lang_id.with_language(df, model).where("doc_id % 5 = 0").select("lang", "language.*").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 !", "x")], "doc_id long, text string, language string")
    assert [(r["language"]["lang_pred"], r["language"]["accepted"]) for r in lang_id.with_language(odd, model).collect()] == [("und", False)] * 3
    assert lang_id.train(df.limit(0)) is None


def brute_running(train, depth):
    """Sequential definition on dictionaries: log10 probability of a text from trained context trees."""
    nodes: dict = {}
    padded = lambda text: b" " * depth + b" ".join(ctw.tokens(text))
    decisions = lambda s: [(s, i, (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1) for i in range(depth, len(s)) for k in range(8)]
    for text in train:
        for s, i, q, bit in decisions(padded(text)):
            for d in range(depth + 1):
                nodes.setdefault((s[i - d : i], q), [0, 0])[bit] += 1
    lkt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted, below = {}, Counter()
    for c, q in sorted(nodes, key=lambda x: -len(x[0])):
        mine = lkt(*nodes[c, q])
        weighted[c, q] = mine if len(c) == depth else np.logaddexp(mine, below[c, q]) - math.log(2)
        if c:
            below[c[1:], q] += weighted[c, q]

    def score(text):
        total = 0.0
        for s, i, q, bit in decisions(padded(text)):
            p, rest = 0.0, 1.0
            for d in range(depth + 1):
                at = s[i - d : i], q
                if at not in nodes:
                    break
                a, b = nodes[at]
                share = 1.0 if d == depth else 1 / (1 + math.exp(min(700, below[at] - lkt(a, b))))
                p, rest = p + rest * share * (b + 0.5) / (a + b + 1), rest * (1 - share)
            total += math.log10(p + rest / 2 if bit else 1 - p - rest / 2)
        return total

    return score


def test_context_trees(spark, monkeypatch):
    texts = ["the cat sat", "the cat ran", "A cat sat the", "sat the cat", None, "", "ünseen the", "the \x00", "word " * 300]
    rows = [(i % 7 if i < 8 else None, t, "xxyyyxyxy"[i]) for i, t in enumerate(texts)]  # an id is there twice, one is null
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(2)
    learned = [t for i, t, _ in rows if i is not None and i != 3]
    train = Counter(x for t in learned for x in ctw.tokens(t))
    n, v = sum(train.values()), len(train)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for depth, piece, held, head in ((6, 1 << 20, 1 << 21, 100), (4, 8, 5, 0)):  # whole, then in small pieces
        for name, value in (("PIECE", piece), ("GATHERED", held), ("HELD", held), ("ANSWERED", head or 1)):
            monkeypatch.setattr(ctw, name, value)
        got = sorted(((r["doc_id"], r["n_tokens"], r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in ctw.score(df, F.col("doc_id") != 3, depth=depth, head=head).collect()), key=key)
        brute = brute_running(learned, depth)
        want = []
        for i, t, _ in rows:
            terms = ctw.tokens(t)
            base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in terms)
            want.append((i, len(terms), brute(t), base, sum(x in train for x in terms), n))
        want.sort(key=key)
        assert [(g[0], g[1], *g[4:]) for g in got] == [(w[0], w[1], *w[4:]) for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6)
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9)
        assert brute("the cat sat") > brute("sat cat the")  # a shuffle of the words scores less
    assert ctw.score(df.limit(0), F.col("doc_id") != 4).count() == 0
    even = ctw.score(df.where("doc_id = 3"), F.lit(False)).first()  # nothing learned: every bit is even
    assert even["score"] == pytest.approx(-8 * len(ctw.running("sat the cat")) * math.log10(2), rel=1e-6)


def test_long_runs_are_packed_like_the_library():
    for text in (" " * 2_000_000, "\n" * 1_500_000 + "x", "a" * 1_000_000):
        assert vector_packing.ids_of(text, TOKENIZER) == LIBRARY.encode(text, add_special_tokens=False).ids
