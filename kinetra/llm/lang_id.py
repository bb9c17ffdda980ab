"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are the runs of one to four bytes of the lower-cased text; each is hashed to one of ``BUCKETS`` embeddings,
whose average over the whole text goes through a linear softmax. Both layers are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled documents (see ``train``). A part of the sample held back sets
the softmax's temperature and the score under which a prediction is rejected.
"""

from __future__ import annotations

import re
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, DIM = 1 << 13, 16
#: Rows to learn from in all, for each language at least, and the longest text among them in bytes; languages that are broadcast at most.
SAMPLE, LEAST, SAMPLE_BYTES, BROADCAST_LANGS = 2000, 50, 1 << 16, 10_000
EPOCHS, BATCH, RATE, MOMENTUM = 30, 32, 2.0, 0.9
#: Share of the held-back documents that rejection may cost, and the score above which nothing is rejected.
COST, SURE = 0.001, 0.5
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters count as a space.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
SPACES = re.compile(rb" +")


def features(text: str) -> np.ndarray:
    """Share of each bucket among the text's subwords."""
    data = SPACES.sub(b" ", b" " + text.lower().encode().translate(FOLD) + b" ")
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS)
    h = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        mixed = h * np.uint32(0x9E3779B1)
        counts += np.bincount((mixed >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
    return counts / max(1.0, counts.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Embeddings, softmax, temperature and the score of rejection."""

    def __init__(self, texts: list[str], labels: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.labels = sorted(set(labels))
        x = np.stack([features(t) for t in texts]).astype(np.float32)
        y = np.array([self.labels.index(v) for v in labels])
        self.scale = float(1 / max(1e-9, x.std(axis=0).mean() * np.sqrt(BUCKETS)))
        order = rng.permutation(len(x))
        held, fit = order[: len(x) // 5], order[len(x) // 5 :]
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (DIM, len(self.labels))).astype(np.float32)
        self.bias = np.zeros(len(self.labels), np.float32)
        self.heat = 1.0
        steps = [np.zeros_like(p) for p in (self.embed, self.out, self.bias)]
        x *= np.float32(self.scale)
        for epoch in range(EPOCHS):
            rate = RATE * 0.1 * (1 - epoch / EPOCHS)
            for at in range(0, len(fit), BATCH):
                rows = rng.choice(fit, BATCH) if at == 0 and len(fit) < BATCH else fit[at : at + BATCH]
                h = x[rows] @ self.embed
                g = _softmax(h @ self.out + self.bias)
                g[np.arange(len(rows)), y[rows]] -= 1
                g /= len(rows)
                grads = (x[rows].T @ (g @ self.out.T), h.T @ g, g.sum(axis=0))
                for p, s, d in zip((self.embed, self.out, self.bias), steps, grads, strict=True):
                    s *= MOMENTUM
                    s -= rate * d
                    p += s
            rng.shuffle(fit)
        held = held if len(held) else fit
        z = (x[held] @ self.embed) @ self.out + self.bias
        heats = np.geomspace(0.25, 8, 41)
        loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in heats]
        self.heat = float(heats[int(np.argmin(loss))])
        p = _softmax(z / self.heat)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[held]])
        self.least = float(min(SURE, right[int(COST * len(right))])) if len(right) else 0.0
        self.map = (self.embed @ self.out).astype(np.float64) * self.scale

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); ``und`` with score 0 for a null text or one without a letter."""
        if text is None or not LETTER.search(text):
            return "und", 0.0, False
        p = _softmax(((features(text) @ self.map + self.bias) / self.heat)[None])[0]
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] >= self.least)


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from a sample of the rows with a text and a language; None if there are none.

    Every language gets its part of ``sample`` rows (``LEAST`` at least, all that it has if they are fewer), those with the
    smallest hash of their id, so that rare ones are learned, too. Texts of more than ``SAMPLE_BYTES`` are not learned from.
    """
    h = F.xxhash64(F.col(f"`{doc_id}`"), F.lit("sample"))
    rows = labelled.select(h.alias("h"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = sizes.count()
    if not n_langs:
        return None
    part = max(LEAST, sample // n_langs)
    # Twice the part by chance first, so that few rows are ranked; small languages whole.
    share = F.least(F.lit(1.0), (2.0 * part + 100) / F.col("n"))
    drawn = rows.join(F.broadcast(sizes) if n_langs <= BROADCAST_LANGS else sizes, "lang").where(F.col("h") / float(1 << 63) <= 2 * share - 1)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    picked = drawn.withColumn("place", place).where(F.col("place") <= part).select("h", "text", "lang").orderBy("h", "lang", "text").toArrow()
    return Model(picked.column("text").to_pylist(), picked.column("lang").to_pylist())


def with_language(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang_pred, score, accepted.

    Without a model every text is ``und`` and rejected. Repeated rows are predicted each; other columns are carried, an
    input column of the name ``out`` is replaced; an empty table stays empty; whole texts are read, however long.
    """
    predict = model.predict if model else (lambda _: ("und", 0.0, False))

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return docs.withColumn(out, language(F.col(f"`{text}`")))


def held_out(doc_id: Column) -> Column:
    """Documents whose id's crc32 is divisible by 5: not learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
