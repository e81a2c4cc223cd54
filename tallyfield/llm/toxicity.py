"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, their stems of four and six letters, pairs of neighbours and pairs with one or two words between,
hashed to 2**FEATURE_BITS; each counts once in a document.  FTRL-proximal gives every coordinate its own learning rate and, by its L1 term, leaves most weights
at zero, so the model is a short list of (feature, weight) that is broadcast to score all documents.

The model is fitted in one task on labelled documents drawn by a hash of their ids: about ``TRAIN_ROWS`` of them and
``TRAIN_BYTES`` of text at most, half of either for each label.  Both bounds keep that task's memory and time fixed at any
input.  All features of these documents are learned from, and the model keeps all weights that are not zero.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.common import save, text_of

FEATURE_BITS = 26
TRAIN_ROWS, TRAIN_BYTES = 12_000, 64 << 20
EPOCHS = 4
#: The learning rate's numerator and offset, the L1 and L2 terms.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1
#: A row of label 1 counts as so many.
RARE = 1.5
STEMS = (4, 6)
REMEMBERED = 500_000
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¡¿“”„’"
GAPS = (1, 2, 3)
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Hashes of words without case and without symbols at their ends, and those of their stems, 0 for shorter words; as
    many as the bound are remembered."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        x = word.lower().strip(EDGES) or word
        h = (xxhash.xxh3_64_intdigest(x), *(xxhash.xxh3_64_intdigest(x[:k], seed=k) if len(x) > k else 0 for k in STEMS))
        if len(self) < REMEMBERED:
            self[word] = h
        return h


@lru_cache(1)
def _words() -> _Words:
    return _Words()


def features(text: str | None) -> np.ndarray:
    """The hashed features of a text, with repeats.  Null and empty texts have none."""
    words = (text or "").split()
    h = np.fromiter(chain.from_iterable(map(_words().__getitem__, words)), np.uint64, len(words) * (1 + len(STEMS))).reshape(-1, 1 + len(STEMS))
    w = h[:, 0]
    shift = np.uint64(64 - FEATURE_BITS)
    stems = h[:, 1:].ravel()
    out = [(w * A) >> shift, (stems[stems > 0] * A) >> shift]
    for g in GAPS:
        if len(w) > g:
            x = (w[:-g] * A + np.uint64(g)) ^ (w[g:] * B)
            x ^= x >> np.uint64(31)
            out.append((x * A) >> shift)
    return np.concatenate(out).astype(np.int32)


def fit(docs: list[np.ndarray], labels: list[int], seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(features with a weight, weights, bias) from documents' distinct features and 0/1 labels."""
    has = np.zeros(1 << FEATURE_BITS, bool)
    for d in docs:
        has[d] = True
    used = np.flatnonzero(has).astype(np.int32)
    del has
    rows = [np.searchsorted(used, d).astype(np.int32) + 1 for d in docs]
    y = np.asarray(labels, float)
    z, n = np.zeros(len(used) + 1), np.zeros(len(used) + 1)  # 0 is the bias, which has no L1 term
    # the share of label 1 is given, so that common features need not take it up
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))

    def weights(k):
        pull = np.where(k == 0, 0.0, L1)
        return np.where(np.abs(z[k]) <= pull, 0.0, (np.sign(z[k]) * pull - z[k]) / ((BETA + np.sqrt(n[k])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            k = np.r_[np.int32(0), rows[i]]
            w = weights(k)
            g = (1 / (1 + np.exp(-np.clip(base + w.sum(), -35, 35))) - y[i]) * (RARE if y[i] else 1.0)
            grown = np.sqrt(n[k] + g * g)
            z[k] += g - (grown - np.sqrt(n[k])) / ALPHA * w
            n[k] += g * g
    w = weights(np.arange(len(z)))
    keep = np.flatnonzero(w[1:])
    return used[keep], w[1:][keep], base + float(w[0])


class Scorer:
    """A model's weights behind a bit map of the features that have one."""

    def __init__(self, used: np.ndarray, weights: np.ndarray, bias: float):
        self.used, self.weights, self.bias = used, weights, bias
        self.has = np.zeros(1 << (FEATURE_BITS - 3), np.uint8)
        np.bitwise_or.at(self.has, used >> 3, (1 << (used & 7)).astype(np.uint8))

    def __call__(self, text: str | None) -> float:
        f = features(text)
        f = np.unique(f[(self.has[f >> 3] >> (f & 7).astype(np.uint8)) & 1 == 1])
        s = self.bias + self.weights[np.searchsorted(self.used, f)].sum()
        return float(1 / (1 + np.exp(-np.clip(s, -35, 35))))


def held_out(id_col: str = "doc_id"):
    """Is a row kept from all learning?  A fifth, by the CRC of the id as text; a null id's text is empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, label) of labelled rows, none of them held out, drawn by a hash of the id: of each label about half of
    ``rows`` and, in their texts, half of ``size`` bytes at most; a written table.  Null ids and labels are left out; of
    several labels for an id the largest counts, and labels but 0 and 1 don't."""
    own = labels.select(labels[id_col].alias("doc_id"), labels[label].cast("int").alias("label")).filter("doc_id is not null and label is not null")
    own = own.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label")).filter("label in (0, 1)")
    lengths = docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.octet_length(docs[text].cast("string")), F.lit(0)).cast("bigint").alias("n"))
    seen = lengths.join(own, "doc_id").groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).collect()  # a row for each label
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    share = {r["label"]: min(1.0, rows / 2 / r["rows"], size / 2 / max(1, r["bytes"])) for r in seen}
    keep = F.coalesce(*(F.when(F.col("label") == k, drawn < int(s * (1 << 32))) for k, s in share.items()), F.lit(False))
    return save(own.filter(keep), "training-rows")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """A model from the labelled rows that are not held out.  Without any the model has no weights and a zero bias."""
    rows = training_rows(docs, labels, label, id_col, text)
    src = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text).alias("text")).join(F.broadcast(rows), "doc_id")

    def extract(batches):
        for b in batches:
            f = [np.unique(features(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(f), pa.int32()), b.column(1), b.column(2), pa.array(f, pa.list_(pa.int32()))], ["model", "doc_id", "label", "f"])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        f = [x.values.to_numpy() for x in t.column("f")]
        used, w, bias = fit(f, t.column("label").to_pylist())
        return pa.table({"feature": pa.array([-1, *used], pa.int32()), "weight": pa.array([bias, *w], pa.float64())})

    schema = T.StructType([T.StructField("model", T.IntegerType()), src.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType()))])
    rows = src.select("text", "doc_id", "label").mapInArrow(extract, schema)
    model = rows.groupBy("model").applyInArrow(run, "feature int, weight double").toPandas().sort_values("feature")
    if not len(model):
        return np.zeros(0, np.int32), np.zeros(0), 0.0
    return model["feature"].to_numpy(np.int32)[1:], model["weight"].to_numpy()[1:], float(model["weight"].iloc[0])


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.  Null and empty texts get the bias's score, repeated
    rows equal ones.  Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches):
        score = Scorer(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    out = src.mapInArrow(run, T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs``."""
    return scored(docs, train(docs, labels))
