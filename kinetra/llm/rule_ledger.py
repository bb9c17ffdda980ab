"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. Its measurements and one failure bit per rule are stored; a policy
is a named, versioned set of rules (a bit mask), so a new policy or an ablation reads the ledger, not the texts.

Defined cases: a null or blank text has no words (all measurements 0; it fails ``few_words``); repeated rows each
get their own ledger; columns of the input other than the text are carried untouched, and an input column that
has the ledger's name is replaced by it; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x09-\x0D ]+"
SYMBOLS = "#*$%&|<>"

#: Rule names in bit order; bits are stored, so names are only ever appended.
RULES = ("few_words", "repeat_half", "repeat_most", "symbols", "repeated_lines", "exclamations", "word_length")

#: Policies by version: the rules that reject a document.
POLICIES = {
    "base-1": ("few_words", "repeat_half"),
    "strict-1": ("few_words", "repeat_half", "symbols", "repeated_lines", "exclamations", "word_length"),
    "corpus-1": ("repeat_most", "symbols", "repeated_lines", "exclamations", "word_length"),
}


def mask(policy: str) -> int:
    """The bits of the rules of a policy."""
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _count_of(text: Column, chars: str) -> Column:
    """Occurrences of single-byte characters: what replacing them takes off the byte length."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it stands in it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered_by_repeats(hashes: Column) -> Column:
    """Words inside three-word windows found twice: windows sorted by hash lie beside their equals."""

    def covered(s: Column) -> Column:
        twice = F.transform(
            s,
            lambda e, j: F.when((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"]),
        )
        at = F.filter(twice, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    return _once(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)


def with_ledger(docs: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """``docs`` with a struct column ``out``: the measurements and ``bits`` (bit k set: rule k failed)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    base = docs.select(F.struct(*kept).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    base = base.withColumns({"_w": _words(F.col("_t")), "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x09-\x0D ]"))})
    w = F.col("_w")
    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    base = base.select(
        "_row",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count_of(F.col("_t"), SYMBOLS).alias("n_symbols"),
        _count_of(F.col("_t"), "!").alias("n_exclamations"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    h = F.col("_h")
    base = base.withColumn(
        "n_repeat_words",
        F.when(F.size(F.array_distinct(h)) < F.size(h), _covered_by_repeats(h)).otherwise(0).cast("long"),
    ).drop("_h")
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    fails = {
        "few_words": n < 50,
        "repeat_half": 100 * rep > 50 * n,
        "repeat_most": 100 * rep > 70 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 4 * F.col("n_lines"),
        "exclamations": 2 * F.col("n_exclamations") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }
    bits = sum((F.when(fails[r], F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)), F.lit(0))
    measured = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines", "n_repeat_words")
    # Generated, not projected: a filter on the ledger is not pushed below it, where it would measure all again.
    ledger = F.explode(F.array(F.struct(*measured, bits.cast("long").alias("bits"))))
    return base.select("_row", ledger.alias("_ledger")).select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != out], F.col("_ledger").alias(out))


def passes(policy: str, bits: Column) -> Column:
    """Whether a ledger's bits pass a policy."""
    return bits.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledger: DataFrame, policy: str, bits: str = "bits") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects (kept once it is dropped).

    One pass of counts over the bits; no text is read. Returns policy, rule, n_docs, n_failed, n_only.
    """
    m, b = mask(policy), F.col(bits)
    counts = [F.count(F.lit(1)).alias("n_docs")]
    for r in POLICIES[policy]:
        bit = 1 << RULES.index(r)
        counts += [
            F.count_if(b.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{r}"),
            F.count_if(b.bitwiseAND(F.lit(m)) == bit).alias(f"o_{r}"),
        ]
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in POLICIES[policy]]))
    return ledger.agg(*counts).select("n_docs", rows.alias("r")).select(F.lit(policy).alias("policy"), "r.rule", "n_docs", "r.n_failed", "r.n_only")
