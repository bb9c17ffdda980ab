"""The queries opN_<name> over the driver's tables: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm import ann_mih, bpe_tree, ctw, jaccard_join, lang_id, line_runs, merkle, rule_ledger, substring_dedup, token_counts, url_filter, vector_packing, whitening

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Rules of the url contract (host, path, action).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Canonical urls (host, path) that the filter blocks where no rule speaks.
URL_BLOCKED = [("cheap-pills.example.com", "/"), ("cheap-pills.example.net", "/"), ("cheap-pills.example.org", "/")]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _literal(spark: SparkSession, rows: list[tuple[str, ...]], names: str) -> DataFrame:
    """A small table as SQL text, so that no Python data reaches the executors."""
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {values} as t({names})")


def op1_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substring_dedup.dedup(_table(spark, sf_dir, "documents", "doc_id", "text"), window=13)
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_ann_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann_mih.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    rules = _literal(spark, URL_RULES, "host, path, action")
    blocked = _literal(spark, URL_BLOCKED, "host, path")
    return url_filter.judge(pages, rules, blocked).select("page_id", "host", "path", "rule", "verdict")


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = ctw.score(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rule_ledger.with_ledger(_table(spark, sf_dir, "documents", "doc_id", "text"))
    bits = F.col("ledger.bits")
    return ledger.select(
        "doc_id",
        *[f"ledger.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~rule_ledger.passes("base-1", bits)).alias("base_failed"),
        rule_ledger.passes("strict-1", bits).alias("kept"),
        bits.alias("failed_rules"),
    )


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = lang_id.train(docs.where(~lang_id.held_out(F.col("doc_id"))))
    named = lang_id.with_language(docs.select("doc_id", "text"), model)
    return named.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.accepted")


def op8_jaccard_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_table(spark, sf_dir, "documents", "doc_id", "text"), size=4, percent=85).drop("h1", "h2")


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_tree.encode_decode(_table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = vector_packing.pack_limited(_table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup(_table(spark, sf_dir, "documents", "doc_id", "text"), least=3, least_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_merkle_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", *merkle.FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return merkle.Manifest(docs, tampered).proofs().withColumnRenamed("proof", "proof_sha256")


def op13_welford_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_rlz": op1_substring_rlz,
    "op2_ann_mih": op2_ann_mih,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_context_tree": op5_context_tree,
    "op6_rule_ledger": op6_rule_ledger,
    "op7_lang_id": op7_lang_id,
    "op8_jaccard_vertical": op8_jaccard_vertical,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_vector_packing": op10_vector_packing,
    "op11_line_runs": op11_line_runs,
    "op12_merkle_range": op12_merkle_range,
    "op13_welford_whitening": op13_welford_whitening,
}

#: Levels of the SQL's trees: enough for 16^6 leaves.
MERKLE_LEVELS = 6


def _merkle_sql() -> str:
    """Levels of the trees one after another: a run's digests left and right of each node by windows; then paths are joined upwards."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str) -> list[str]:
        parts = []
        for k in range(MERKLE_LEVELS):
            run = "partition by tree, spot // 16 order by spot rows between"
            parts.append(f"""{name}{k}p as (
  select tree, spot, h, n, case when n > 1 then coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') else '' end as l,
    case when n > 1 then coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') else '' end as r from {name}{k})""")
            parts.append(f"""{name}{k + 1} as (
  select tree, spot // 16 as spot, case when any_value(n) > 1 then sha256(string_agg(h, '' order by spot)) else any_value(h) end as h, (any_value(n) + 15) // 16 as n from {name}{k} group by tree, spot // 16)""")
        return parts

    def climb(name: str, start: str, spot: str, on: str) -> list[str]:
        parts = []
        for k in range(MERKLE_LEVELS):
            parts.append(f"""{name}f{k + 1} as (
  select f.* replace (f.proof || p.l || p.r as proof, case when p.n > 1 then sha256(p.l || f.fold || p.r) else f.fold end as fold, f.{spot} // 16 as {spot})
  from {start if k == 0 else f"{name}f{k}"} f join {name}{k}p p on p.tree = f.{on} and p.spot = f.{spot})""")
        return parts

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # DuckDB has no crc32: its table is made by rule, and the digits of the id are taken in one by one.
    crc = """bits(i, k, v) as (select i, 0, i from range(256) t(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crct as (select list(v order by i) as t from bits where k = 8),
crc as (
  select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) as crc from documents, crct)"""
    parts = [
        crc,
        f"""d as (
  select doc_id, coalesce('1' || source, '0') as tree, {leaf("text")} as leaf,
    case when crc % 5 = 0 then {leaf(f"translate(text, '{upper}', '{lower}')")} else {leaf("text")} end as claim from documents left join crc using (doc_id))""",
        "a0 as (select tree, row_number() over (partition by tree order by doc_id) - 1 as spot, leaf as h, count(*) over (partition by tree) as n, doc_id, claim from d)",
        *levels("a"),
        f"b0 as (select '' as tree, row_number() over (order by tree) - 1 as spot, h, count(*) over () as n, tree as source from a{MERKLE_LEVELS})",
        *levels("b"),
        "s as (select doc_id, tree as source, '' as top, spot, h as leaf, claim as fold, '' as proof from a0)",
        *climb("a", "s", "spot", "source"),
        f"u as (select f.* replace (b0.spot as spot), b0.h as subroot from af{MERKLE_LEVELS} f join b0 using (source))",
        *climb("b", "u", "spot", "top"),
    ]
    return f"""with recursive {", ".join(parts)}
select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, fold as folded_root, fold = r.h as verified from bf{MERKLE_LEVELS}, b{MERKLE_LEVELS} r"""


ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": r"""
with p as (
  select page_id,
    case when contains(url, '://') then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
r(h, d, a) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (
  select page_id, max_by(h || d, length(h || d)) as rule, max_by(a, length(h || d)) as action
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, d) group by page_id),
b(h) as (values ('cheap-pills.example.com'), ('cheap-pills.example.net'), ('cheap-pills.example.org')),
l as (select distinct page_id from p join b on (host = h or ends_with(host, '.' || h)) and starts_with(path, '/'))
select p.page_id, p.host, p.path, m.rule,
  coalesce(m.action, case when l.page_id is not null then 'block' end, 'allow') as verdict
from p left join m using (page_id) left join l using (page_id)
""",
    "op6_rule_ledger": r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, list_filter(regexp_split_to_array(text, '[\x09-\x0D ]+'), lambda x: x <> '') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) as lines from t),
g as (
  select doc_id, i, (w[i], w[i + 1], w[i + 2]) as g
  from w, unnest(range(1, greatest(len(w) - 1, 1))) as r(i)),
d as (select doc_id, g from g group by doc_id, g having count(*) > 1),
c as (
  select doc_id, count(distinct i + k) as n
  from g join d using (doc_id, g), (values (0), (1), (2)) as o(k) group by doc_id),
m as (
  select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (length(text) - length(replace(text, '!', '')))::bigint as n_excl, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from w left join c on w.doc_id = c.doc_id),
f as (
  select *, case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 100 * n_repeat_words > 70 * n_words then 4 else 0 end + case when 10 * n_symbols > 3 * n_words then 8 else 0 end
    + case when 10 * n_dup_lines > 4 * n_lines then 16 else 0 end + case when 2 * n_excl > n_words then 32 else 0 end
    + case when word_chars < 2 * n_words or word_chars > 15 * n_words then 64 else 0 end as bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 as base_failed,
  (bits & 123) = 0 as kept, bits::bigint as failed_rules
from f
""",
    "op11_line_runs": r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (
  select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
g as (
  select k.*, coalesce(doc_id < last, false) as gone from k left join s using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from g group by doc_id
""",
    "op12_merkle_range": _merkle_sql(),
}
