"""Token counts: the pieces of each distinct pre-token are counted once, then joined to the documents' frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm import dictionary
from kinetra.llm.shared import written
from kinetra.llm.text import vocabulary


def piece_counts(terms: DataFrame, tokenizer: str) -> DataFrame:
    """(term, n, pieces): how many tokens the library's model makes of each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model, vocab = Tokenizer.from_file(tokenizer).model, vocabulary(tokenizer)
        for batch in batches:
            pieces = [
                1 if t in vocab.special else len(model.tokenize(t.encode().decode("latin-1").translate(vocab.shown)))
                for t in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], ["term", "n", "pieces"])

    return terms.select("term", "n").mapInArrow(run, "term string, n long, pieces long")


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", head: int = dictionary.HEAD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_pre_tokens, n_tokens, without ids being made.

    A null or empty text has 0 of each; repeated rows are counted each; a null doc_id stays null; an empty table gives
    an empty result; columns other than the two are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"), F.col(f"`{text}`").alias("text"))

    def split(value: object) -> list:
        return vocabulary(tokenizer).pre_tokens(value)

    terms = dictionary.term_counts(rows.select("text", F.lit(0).alias("label")), split)
    table = written(piece_counts(terms, tokenizer))
    return dictionary.sums(rows, table, split, ["pieces"], ["doc_id", "n_bytes"], head=head).select(
        "doc_id", "n_bytes", F.col("n_terms").alias("n_pre_tokens"), F.round("pieces").cast("long").alias("n_tokens")
    )
