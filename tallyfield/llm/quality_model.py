"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the document has a label.  Each passage is encoded by a small
network; gated attention (a tanh branch times a sigmoid branch) gives each passage a weight, learned from document labels
alone, and the weighted sum of the encodings is what is scored.  So a document may be junk for a few of its passages.

A passage's inputs are shares of character classes and of pairs of neighbouring classes, and how much its words repeat
each other, the passage or earlier parts of the document; all are counted over whole texts, as arrays.

The model is fitted in one task on labelled documents drawn by a hash of their ids: about ``TRAIN_ROWS`` of them and
``TRAIN_BYTES`` of text at most, half of either for each label, with all passages of each.  Both bounds keep that task's
memory and time fixed at any input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.common import text_of
from tallyfield.llm.toxicity import held_out, training_rows
from tallyfield.llm.words import Words, blocks, ngrams

PASSAGE = 50
TRAIN_ROWS, TRAIN_BYTES = 8_000, 64 << 20
HIDDEN, GATE = 24, 16
EPOCHS, BATCH, RATE, DECAY = 20, 64, 3e-3, 1e-4
#: Character classes: each of these symbols, then the rest by kind.
SYMBOLS = b"!#$%&*<>|.,?:;-_/\\()[]{}\"'=+@~^`"
UPPER, LOWER, DIGIT, BLANK, BREAK, OTHER, CONTROL = range(len(SYMBOLS), len(SYMBOLS) + 7)
N_CLASSES = len(SYMBOLS) + 7
#: Kinds, of which pairs of neighbours are counted: letters, digits, blanks, sentence signs, other signs ...
KINDS = 9
EXTRAS = 7
INPUTS = N_CLASSES + KINDS * KINDS + EXTRAS


def _tables() -> tuple[np.ndarray, np.ndarray]:
    cls = np.full(256, CONTROL, np.int64)
    cls[128:] = OTHER
    cls[65:91], cls[97:123], cls[48:58] = UPPER, LOWER, DIGIT
    cls[[9, 32]], cls[[10, 13]] = BLANK, BREAK
    for k, b in enumerate(SYMBOLS):
        cls[b] = k
    kind = np.full(N_CLASSES, 8, np.int64)
    kind[[UPPER, LOWER, DIGIT, BLANK, BREAK, OTHER]] = range(6)
    for k, b in enumerate(SYMBOLS):
        kind[k] = 6 if b in b".,?!:;'\"-()" else 7
    return cls, kind


CLASS, KIND = _tables()


def _seen_before(h: np.ndarray) -> np.ndarray:
    """For each hash: is it equal to an earlier one?"""
    order = np.argsort(h, kind="stable")
    out = np.zeros(len(h), bool)
    out[order[1:]] = h[order[1:]] == h[order[:-1]]
    return out


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(inputs of each passage, number of passages of each text).  A text without words is one passage of its own
    characters."""
    n_words = np.diff(w.first)
    count = np.maximum(1, -(-n_words // PASSAGE))
    total = int(count.sum())
    text = np.repeat(np.arange(len(count)), count)
    nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(w.first[text] + nth * PASSAGE, w.first[text + 1])  # of its words
    after = np.minimum(first + PASSAGE, w.first[text + 1])
    begin = np.where(nth == 0, w.text_start[text], w.start[np.minimum(first, len(w.start) - 1)] if len(w.start) else w.text_start[text])
    out = np.zeros((total, INPUTS), np.float32)
    # passages lie one behind the other, each up to the next one's begin
    where = np.zeros(len(w.buf), np.int64)
    np.add.at(where, begin[1:], 1)
    where = np.cumsum(where)
    cls = CLASS[w.buf]
    chars = np.bincount(where * N_CLASSES + cls, minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    kind = KIND[cls]
    own = where[1:] == where[:-1]
    pairs = np.bincount(((where[1:] * KINDS + kind[:-1]) * KINDS + kind[1:])[own], minlength=total * KINDS * KINDS).reshape(total, -1)
    size = np.maximum(1, chars.sum(1))[:, None]
    out[:, :N_CLASSES] = np.sqrt(chars / size)
    out[:, N_CLASSES : N_CLASSES + KINDS * KINDS] = np.sqrt(pairs / size)
    owner = np.repeat(np.arange(total), after - first)  # of each word
    n = np.maximum(1, after - first)
    per = lambda x: np.bincount(owner, x, total) / n
    h = w.hash
    same = np.r_[False, h[1:] == h[:-1]][: len(h)]
    same[w.first[:-1][n_words > 0]] = False
    again3, again1 = np.zeros(len(h), bool), np.zeros(len(h), bool)
    for i, j in zip(w.first, w.first[1:]):
        if j - i > 1:
            again1[i:j] = _seen_before(h[i:j])
            again3[i : i + max(0, j - i - 2)] = _seen_before(ngrams(h[i:j], 3))[: max(0, j - i - 2)]
    inside = _seen_before(h ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if len(h) else same
    lens = (w.end - w.start).astype(float)
    extra = [per(same), per(again3), per(again1), per(inside), per(lens) / 10, np.sqrt(per(lens * lens)) / 10, np.log1p(after - first) / 4]
    out[:, -EXTRAS:] = np.stack(extra, 1)
    return out, count


class Model:
    """The network's parameters; ``x`` are inputs of passages, ``count`` how many of them each document has."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, x: np.ndarray, share: float, seed: int = 3) -> Model:
        r = np.random.default_rng(seed)
        g = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        return cls({
            "mean": x.mean(0).astype(float), "scale": 1 / (x.std(0).astype(float) + 0.02), "W": g(INPUTS, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE),
            "w": g(GATE, 1)[:, 0], "c": g(HIDDEN, 1)[:, 0], "d": np.array([np.log(share / (1 - share))]),
        })

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        s = {"x": np.clip((x - p["mean"]) * p["scale"], -6, 6)}
        s["h"] = np.tanh(s["x"] @ p["W"] + p["b"])
        s["t"] = np.tanh(s["h"] @ p["V"])
        s["g"] = 1 / (1 + np.exp(-(s["h"] @ p["U"])))
        e = (s["t"] * s["g"]) @ p["w"]
        s["at"] = at = np.cumsum(count) - count
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), count))
        s["a"] = e / np.repeat(np.add.reduceat(e, at), count)
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], at, axis=0)
        s["p"] = 1 / (1 + np.exp(-np.clip(s["z"] @ p["c"] + p["d"], -35, 35)))
        return s

    def gradient(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, s = self.p, self.forward(x, count)
        ds = (s["p"] - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"], count, axis=0)
        da = (dz * s["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(s["a"] * da, s["at"]), count)
        de = s["a"] * (da - mean)
        gate = s["t"] * s["g"]
        dgate = de[:, None] * p["w"]
        dt, dg = dgate * s["g"] * (1 - s["t"] ** 2), dgate * s["t"] * s["g"] * (1 - s["g"])
        dh = dz * s["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T
        dw = dh * (1 - s["h"] ** 2)
        return {"W": s["x"].T @ dw, "b": dw.sum(0), "V": s["h"].T @ dt, "U": s["h"].T @ dg, "w": gate.T @ de, "c": s["z"].T @ ds, "d": np.array([ds.sum()])}


def fit(bags: list[np.ndarray], labels: list[int], seed: int = 5) -> Model:
    """A model of bags (passages' inputs) and 0/1 labels, by Adam on batches of documents."""
    y = np.asarray(labels, float)
    m = Model.start(np.concatenate(bags), (y.sum() + 1) / (len(y) + 2))
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in m.p.items() if k not in ("mean", "scale")}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            g = m.gradient(np.concatenate([bags[i] for i in part]), np.array([len(bags[i]) for i in part]), y[part])
            step += 1
            for name, d in g.items():
                d = d + DECAY * m.p[name] * (name not in ("b", "d"))
                first[name] += 0.1 * (d - first[name])
                second[name] += 0.01 * (d * d - second[name])
                m.p[name] = m.p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return m


def training_bags(src: DataFrame) -> DataFrame:
    """model (0), doc_id, label, x (all passages of the text) for each row (text, doc_id, label)."""

    def extract(batches):
        for b in batches:
            for i, j, w in blocks(b.column(0)):
                x, count = passages(w)
                at = np.r_[0, np.cumsum(count)]
                bags = [x[k:m].astype("<f4").tobytes() for k, m in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([0] * (j - i), pa.int32()), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(bags, pa.binary())], ["model", "doc_id", "label", "x"])

    schema = T.StructType([T.StructField("model", T.IntegerType()), src.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])
    return src.select("text", "doc_id", "label").mapInArrow(extract, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """A model from the labelled rows that are not held out; None without any."""
    rows = training_rows(docs, labels, label, id_col, text, TRAIN_ROWS, TRAIN_BYTES)
    src = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text).alias("text")).join(F.broadcast(rows), "doc_id")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        bags = [np.frombuffer(x.as_py(), "<f4").reshape(-1, INPUTS) for x in t.column("x")]
        m = fit(bags, t.column("label").to_pylist())
        return pa.table({"name": list(m.p), "rows": pa.array([len(np.atleast_2d(v)) for v in m.p.values()], pa.int32()), "v": [v.astype("<f8").tobytes() for v in m.p.values()]})

    got = training_bags(src).groupBy("model").applyInArrow(run, "name string, rows int, v binary").collect()  # the parameters
    params = {r["name"]: np.frombuffer(r["v"], "<f8") for r in got}
    shape = {"W": (INPUTS, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE)}
    return Model({k: v.reshape(shape.get(k, (-1,))) for k, v in params.items()}) if params else None


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null and empty texts are one passage without characters, scored like any other.  Without a model all scores are 0.5.
    Repeated rows get equal scores.  Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.p if model else None)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches):
        m = Model(shared.value) if shared.value else None
        for b in batches:
            score = np.full(b.num_rows, 0.5)
            for i, j, w in blocks(b.column(1)) if m else ():
                score[i:j] = np.round(m.forward(*passages(w))["p"], 9)  # the sums' order depends on what is scored together
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    out = src.mapInArrow(run, T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs``."""
    return scored(docs, train(docs, labels))
