"""Equal rows are worked out once: what a fit or a column costs does not grow with their copies, and results are the same."""

import numpy as np
from pyspark.sql import functions as F

from tallyfield.operators import scorelines as sl
from tallyfield.plans import logistic


def test_logistic_cells_do_not_grow_with_copies(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(float(a), None if a == 2 else float(b), int(y), int(t)) for a, b, y, t in zip(*(rng.integers(0, n, 300) for n in (4, 5, 4, 3)))]
    df = spark.createDataFrame(rows, "a double, b double, outcome int, at int")
    copies = df.crossJoin(spark.range(20)).drop("id").repartition(5)
    sizes, save = [], logistic.save

    def seen(x, name):
        out = save(x, name)
        sizes.append(out.agg(F.sum(F.octet_length("rows"))).first()[0])
        return out

    monkeypatch.setattr(logistic, "save", seen)
    fits = [logistic.fit(x, ["a", "b"], at="at", uptos=[2, 9], l2=0.0, iterations=30, sent=sent).orderBy("upto").collect() for x in (df, copies) for sent in (logistic.SENT, 0)]
    assert len(set(sizes)) == 1
    for got in fits:
        for one, want in zip(got, fits[0]):
            assert np.abs(np.array(one.weights) - np.array(want.weights)).max() < 1e-9 and np.allclose(one.mean, want.mean, atol=1e-9)
    assert [r.n for r in fits[2]] == [20 * r.n for r in fits[0]]


def test_grids_are_worked_out_once_for_each_pair_of_rates(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        seen.add(1)
        return x

    rates = [(i, [0.5, 1.5, None][i % 3], [1.0, 2.0][i % 2]) for i in range(600)]
    rows = spark.createDataFrame(rates, "id int, lam double, mu double")
    x = F.col("lam") + F.col("mu")
    got = sl.by_rates(rows, a=costly(x), b=x).collect()
    assert sorted((r.id, r.lam, r.mu) for r in got) == sorted(rates)
    assert all(r.a == r.b == (None if r.lam is None else r.lam + r.mu) for r in got) and seen.value == 6
