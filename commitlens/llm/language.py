"""Operator 8 - language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

Subwords are the byte 1- to 4-grams of the text with A-Z in lower case and white space runs as one
space (so a space marks word edges), hashed into ``BUCKETS`` rows.  Embeddings and softmax weights are
trained by stochastic gradient descent in numpy on a bounded sample; scores are calibrated by a
temperature fitted on sample documents that training has not seen, and a text is flagged as
rejected below the score that keeps ``KEEP`` of the correctly predicted ones.  Since the model averages,
embeddings times weights fold into one table, and prediction is a sum of table rows over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
DIM = 16
EPOCHS = 5
SAMPLE = 2000        # documents in the training sample at most (bounded: the fit is done on the driver)
SAMPLE_BYTES = 16 << 20  # text bytes of the sample at most
KEEP = 0.995
UNKNOWN = "und"


def normal_bytes(text: str) -> bytes:
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) + b" "


def subwords(data: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, per order; the last n - 1 are cut off."""
    h = np.zeros(len(data), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            if n > 1:
                h = h[:-1]
            h = (h * np.uint32(0x01000193)) ^ data[n - 1:] if len(data) >= n else h[:0]
            if n in ORDERS:
                m = (h ^ np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                yield (m ^ (m >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray        # BUCKETS x labels: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        data = np.frombuffer(normal_bytes(text), np.uint8)
        total, n = np.zeros(len(self.labels)), 0
        for at in range(0, len(data), 1 << 20):   # blocks bound the memory; they overlap so that no n-gram is lost
            for k, h in zip(ORDERS, subwords(data[at:at + (1 << 20) + max(ORDERS) - 1])):
                h = h[:1 << 20]
                total += np.bincount(h, minlength=BUCKETS).astype(np.float32) @ self.table if len(h) > 30_000 \
                    else self.table[h].sum(axis=0, dtype=np.float64)
                n += len(h)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(label, calibrated score, rejected); ``und`` with score 0 without a letter or without a model."""
        if text is None or not self.labels or not has_letter(text):
            return UNKNOWN, 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(min(1.0, p[k])), bool(p[k] < self.reject_below)


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Train on four fifths of the sample, calibrate on the rest."""
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    W = np.zeros((DIM, len(labels)), np.float32)
    b = np.zeros(len(labels), np.float32)
    held = np.arange(len(texts)) % 5 == 4
    feats = []
    for t in texts:
        h, c = np.unique(np.concatenate(list(subwords(np.frombuffer(normal_bytes(t), np.uint8)))), return_counts=True)
        feats.append((h, (c / c.sum()).astype(np.float32)))
    y = np.array([labels.index(x) for x in langs])
    order = np.flatnonzero(~held)
    steps = max(1, epochs * len(order))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(order):
            h, c = feats[i]
            rate = 2.0 * (1 - done / steps)
            v = c @ E[h]
            z = v @ W + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            gv = W @ p
            W -= rate * np.outer(v, p)
            b -= 0.05 * rate * p
            E[h] -= rate * 20 * np.outer(c, gv)
            done += 1
    model = Model(labels, (E @ W).astype(np.float32), b.astype(np.float64))
    check = np.flatnonzero(held) if held.any() else order
    Z = np.array([feats[i][1] @ model.table[feats[i][0]] + b for i in check], np.float64)

    def loss(t: float) -> float:
        z = Z / t
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(check)), y[check]] - np.log(np.exp(z).sum(axis=1))).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    z = Z / model.temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    model.reject_below = float(np.quantile(right, 1 - KEEP)) if len(right) else 0.0
    return model


def training_sample(docs: DataFrame, text_col: str, lang_col: str, usable: Column, sample: int) -> tuple[list[str], list[str]]:
    """At most ``sample`` whole labelled texts in a fixed pseudo-random order, up to ``SAMPLE_BYTES`` of them."""
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    rows = docs.where(usable & text.isNotNull() & lang.isNotNull()).select(
        text.alias("t"), lang.alias("l"), F.xxhash64(text, F.lit(11)).alias("h"), F.octet_length(text).alias("n"))
    n = rows.count()
    part = rows if n <= sample else rows.where(F.pmod(F.col("h"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * sample / n)))
    small = part.where(F.col("n") <= SAMPLE_BYTES // 64)    # no single text may fill the sample
    got, total, out = small.orderBy("h", "l").limit(sample).select("t", "l", "n").toLocalIterator(), 0, []
    for r in got:
        total += r.n
        if total > SAMPLE_BYTES:
            break
        out.append((r.t, r.l))
    return [t for t, _ in out], [x for _, x in out]


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus lang_pred, score, rejected; one row per input row, whole texts, no shuffle."""
    plain = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_x_text"))
    # BUCKETS x labels floats, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.table, model.bias, model.temperature, model.reject_below))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(keep))], pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                [*keep, "lang_pred", "score", "rejected"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{types}, lang_pred string, score double, rejected boolean")


def train_and_identify(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", sample: int = SAMPLE) -> tuple[DataFrame, Model]:
    """Fit on usable labelled rows, predict every row.

    Defined results: null texts and texts without a letter are ``und`` with score 0; without a labelled
    row every text is ``und``; ids, sources and labels are never inputs of a prediction; repeated
    rows repeat; extra columns are ignored.
    """
    model = fit(*training_sample(docs, text_col, lang_col, usable, sample))
    return identify(docs, model, text_col, (id_col,)), model
