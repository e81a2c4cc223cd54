"""The feature model: a multinomial logistic model fitted by full gradient steps, and what each feature adds to a forecast.

Rows with equal features add the same to a gradient but for their labels, so they are summed into cells first: the features
and the weight of each label.  Cells go into packets of numbers once.  A step needs one sum over all packets, the gradient of
each class.  Several models that learn from the same rows up to different times are fitted together: each packet adds to
the gradients of those that may see it.  Packets that are small in all (a size that is checked) are sent to every task
instead, and each model is fitted by a task of its own; both ways take the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.scratch import save

c = F.col
#: Cells of a packet, and bytes of all packets up to which they are sent to the tasks.
PACKET, SENT = 4096, 64 << 20
#: A spread up to this share of the mean is rounding: the feature is constant.
FLAT = 1e-9
SCHEMA = "upto long, n long, mean array<double>, sd array<double>, weights array<array<double>>"


def _cells(rows: DataFrame, n_features: int, classes: int) -> DataFrame:
    """Rows of equal time and features as one: at, the sum of weights of each class, the features.  Rows of no class add nothing
    to a gradient and are left out."""
    x = [f"__x{i}" for i in range(n_features)]
    sums = (F.sum(F.when(c("__y") == k, c("__w")).otherwise(0.0)).alias(f"__c{k}") for k in range(classes))
    return rows.filter("__y >= 0").groupBy("__at", *x).agg(*sums).select("__at", *(f"__c{k}" for k in range(classes)), *x)


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to so many cells each, column by column, as doubles; missing features are NaN."""
    for b in batches:
        x = np.stack([col.cast(pa.float64()).to_numpy(zero_copy_only=False) for col in b.columns])
        parts = [x[:, k : k + PACKET].astype("<f8").tobytes() for k in range(0, len(b), PACKET)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["rows"])


def _unpacked(raw: bytes, n_features: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, weights by class and features; a column is a cell."""
    x = np.frombuffer(raw, "<f8").reshape(1 + classes + n_features, -1)
    return x[0], x[1 : 1 + classes], x[1 + classes :]


def standardised(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Features less their mean over their spread, and a one; missing ones are at the mean, constant ones 0."""
    d = np.where(np.isnan(x), 0.0, x - mean[:, None])
    return np.concatenate([np.divide(d, sd[:, None], out=np.zeros_like(d), where=sd[:, None] > 0), np.ones((1, x.shape[1]))])


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By class, of standardised cells and their weights by class."""
    p = weights @ x
    p -= p.max(0)
    np.exp(p, out=p)
    p *= y.sum(0) / p.sum(0)
    p -= y
    return p @ x.T


def step(weights: np.ndarray, grad: np.ndarray, total: float, l2: float, rate: float) -> np.ndarray:
    """One step against the gradient; the constant is not drawn to 0."""
    drawn = l2 * weights
    drawn[..., -1] = 0.0
    return weights - rate / max(1.0, total) * (grad + drawn)


def _moments(rows: DataFrame, features: list[str], uptos: list[int]) -> dict[int, tuple[int, float, np.ndarray, np.ndarray]]:
    """n, sum of weights, means and spreads of the rows before each time; missing features count as 0 here.  Rows are summed
    between the times, so each is looked at once."""
    edges = sorted(uptos)
    part = sum(((c("__at") >= e).cast("int") for e in edges), F.lit(0))
    names = [f"__x{i}" for i in range(len(features))]
    v = [F.coalesce(F.when(F.isnan(x), F.lit(0.0)).otherwise(c(x)), F.lit(0.0)) for x in names]
    # sums are of what differs from the first row, so that a feature that never changed has no spread at all
    zero = np.array([x or 0.0 for x in rows.agg(*(F.min_by(x, "__at") for x in v)).first()], float)
    v = [x - float(z) for x, z in zip(v, zero)]
    many = c("__n")
    sums = rows.groupBy(part.alias("part")).agg(F.sum(many).alias("n"), F.sum("__w").alias("w"), *(F.sum(many * x).alias(f"a{i}") for i, x in enumerate(v)), *(F.sum(many * x * x).alias(f"b{i}") for i, x in enumerate(v)))
    k = len(features)
    by = {r["part"]: np.array(r[1:], float) for r in sums.collect()}  # a row for each time
    out, run = {}, np.zeros(2 + 2 * k)
    for i, e in enumerate(edges):
        run = run + by.get(i, 0.0)
        n = max(1.0, run[0])
        gap = run[2 : 2 + k] / n
        mean, sd = (zero + gap if run[0] else gap), np.sqrt(np.maximum(0.0, run[2 + k :] / n - gap * gap))
        out[e] = int(run[0]), float(run[1]), mean, np.where(sd > FLAT * np.maximum(1.0, np.abs(mean)), sd, 0.0)
    return out


def fit(
    rows: DataFrame,
    features: list[str],
    classes: int = 3,
    label: str = "outcome",
    at: str | None = None,
    uptos: list[int] | None = None,
    weight: str | None = None,
    count: str | None = None,
    l2: float = 0.5,
    iterations: int = 600,
    rate: float = 0.15,
    sent: int = SENT,
) -> DataFrame:
    """A row for each of ``uptos``: a model of the rows with ``at`` before it (one of all rows, upto null, if none are given):
    n, mean, sd and weights by class, the constant last.

    count: a column with the number of equal rows that a row stands for.  Means and spreads take missing features as 0, and a missing feature of a row is at the mean.  Labels outside the classes
    add nothing to a gradient.  Without rows all weights are 0."""
    spark, k = rows.sparkSession, len(features)
    every = uptos is None
    uptos = [0] if every else sorted(set(uptos))
    many = (F.lit(1.0) if count is None else c(count)).cast("double")
    x = rows.select(
        many.alias("__n"), (F.lit(-1) if every else c(at)).cast("double").alias("__at"), F.when(c(label).between(0, classes - 1), c(label)).otherwise(-1).cast("double").alias("__y"),
        (many if weight is None else many * c(weight).cast("double")).alias("__w"), *(c(v).cast("double").alias(f"__x{i}") for i, v in enumerate(features)),
    )
    moments = _moments(x, features, uptos)
    packets = save(_cells(x, k, classes).mapInArrow(_packets, "rows binary"), "packets")
    bytes_ = packets.agg(F.sum(F.octet_length("rows"))).first()[0] or 0
    shape = (classes, k + 1)

    def one(upto: int, blocks: list[bytes]) -> np.ndarray:
        _, total, mean, sd = moments[upto]
        use = [(a < upto, y, v) for a, y, v in (_unpacked(b, k, classes) for b in blocks)]
        xs = np.concatenate([standardised(v[:, m], mean, sd) for m, _, v in use], 1) if use else np.zeros((k + 1, 0))
        ys = np.concatenate([y[:, m] for m, y, _ in use], 1) if use else np.zeros((classes, 0))
        # cut again, as few of a packet's cells may be early enough
        cut = [(np.ascontiguousarray(xs[:, i : i + PACKET]), np.ascontiguousarray(ys[:, i : i + PACKET])) for i in range(0, xs.shape[1], PACKET)]
        del xs, ys, use
        weights = np.zeros(shape)
        for _ in range(iterations):
            weights = step(weights, sum((gradient(x, y, weights) for x, y in cut), np.zeros(shape)), total, l2, rate)
        return weights

    if bytes_ <= sent:
        blocks = spark.sparkContext.broadcast([bytes(r.rows) for r in packets.select("rows").collect()])  # within the checked size

        def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pd.DataFrame({"upto": pdf.upto, "weights": [one(int(u), blocks.value).tolist() for u in pdf.upto]})

        todo = spark.createDataFrame([(u,) for u in uptos], "upto long").repartition(len(uptos))
        got = {r.upto: r.weights for r in todo.mapInPandas(fitted, "upto long, weights array<array<double>>").collect()}  # a row for each time
    else:
        packets = save(packets.repartition(spark.sparkContext.defaultParallelism), "packets")  # read in each step
        got = {u: w.tolist() for u, w in zip(uptos, _passes(packets, uptos, moments, shape, iterations, l2, rate))}
    out = [(None if every else u, moments[u][0], moments[u][2].tolist(), moments[u][3].tolist(), got[u]) for u in uptos]
    return spark.createDataFrame(out, SCHEMA)


def _passes(packets: DataFrame, uptos: list[int], moments: dict, shape: tuple[int, int], iterations: int, l2: float, rate: float) -> np.ndarray:
    """The weights of all models by one aggregation over the packets a step.  Gradients are summed within a task, so what moves
    is a number for each place and task, and the driver adds them up."""
    classes, k = shape[0], shape[1] - 1
    weights = np.zeros((len(uptos), *shape))
    mean, sd = (np.stack([moments[u][i] for u in uptos]) for i in (2, 3))

    def task(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad = np.zeros_like(now)
            for b in batches:
                for raw in b.column(0):
                    a, y, v = _unpacked(raw.as_buffer(), k, classes)
                    for i, u in enumerate(uptos):
                        m = a < u
                        if m.all():
                            grad[i] += gradient(standardised(v, mean[i], sd[i]), y, now[i])
                        elif m.any():
                            grad[i] += gradient(standardised(v[:, m], mean[i], sd[i]), y[:, m], now[i])
            yield pa.RecordBatch.from_arrays([pa.array([grad.astype("<f8").tobytes()], pa.binary())], ["g"])

        return run

    for _ in range(iterations):
        parts = packets.mapInArrow(task(weights), "g binary").collect()  # a row for each task
        grad = sum((np.frombuffer(r.g, "<f8").reshape(weights.shape) for r in parts), np.zeros(weights.shape))
        weights = np.stack([step(weights[i], grad[i], moments[u][1], l2, rate) for i, u in enumerate(uptos)])
    return weights


def _standard(x: Column, mean: Column, sd: Column) -> Column:
    """An array of features as ``standardised`` has it, without the one."""
    gaps = F.zip_with(x, mean, lambda v, m: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v - m))
    return F.zip_with(gaps, sd, lambda d, s: F.when(s > 0, d / s).otherwise(0.0))


def probs(x: Column, mean: Column, sd: Column, weights: Column) -> Column:
    """The classes' shares of an array of features."""
    dot = lambda w, z: F.aggregate(F.zip_with(w, z, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return f.let(F.concat(_standard(x, mean, sd), F.array(F.lit(1.0))), lambda z: f.softmax(F.transform(weights, lambda w: dot(w, z))))


def contributions(x: Column, mean: Column, sd: Column, weights: Column, home: int = 0, away: int = 2) -> Column:
    """What each feature adds to the log odds of home against away."""
    gap = F.zip_with(F.get(weights, F.lit(home)), F.get(weights, F.lit(away)), lambda a, b: a - b)
    return F.zip_with(_standard(x, mean, sd), F.slice(gap, 1, F.size(x)), lambda v, g: v * g)


def factors(parts: Column, names: list[str], p_home: Column, most: int = 7, least: float = 0.3) -> Column:
    """The ``most`` largest contributions as points on the home share, one digit, by size, then in the order of names: an array
    of (key, effect).  A log odds moves a share p by p (1 - p)."""
    keys = F.array(*(F.lit(n) for n in names))
    each = F.transform(parts, lambda v, i: F.struct(F.get(keys, i).alias("key"), f.half_up(v * p_home * (1.0 - p_home) * 100.0, 1).alias("effect"), i.alias("i")))
    kept = F.transform(F.filter(each, lambda e: F.abs(e.effect) >= least), lambda e: F.struct((-F.abs(e.effect)).alias("size"), e.i.alias("i"), e.key.alias("key"), e.effect.alias("effect")))
    return F.transform(F.slice(F.array_sort(kept), 1, most), lambda e: F.struct(e.key.alias("key"), e.effect.alias("effect")))
