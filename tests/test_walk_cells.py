"""The walk-forward run makes a forecast once for all matches of the same sides and day, and counts them."""

import pytest
from pyspark.sql import functions as F

from tallyfield.operators.tables import shares_with_prior, trailing_baseline
from tallyfield.plans import accuracy, walk
from tallyfield.sources import projections as p

c = F.col


@pytest.mark.parametrize("n", [1, 5, 380])
def test_baselines_are_the_last_matches_before_each_week(spark, sf, n):
    m = p.matches(spark, sf)
    first = trailing_baseline(m, n, days=True).groupBy("comp", "chunk").agg(F.min_by(F.struct("home", "draw", "away"), F.struct("day", "event_id")).alias("b"))
    want = first.select("comp", "chunk", shares_with_prior(c("b.home"), c("b.draw"), c("b.away")).alias("baseline"))
    got = walk._baselines(m, n)
    assert got.count() == want.count() > 100 and got.exceptAll(want).count() == 0


def test_cells_do_not_grow_with_copies(spark, sf):
    m = p.matches(spark, sf).filter("comp = 1")
    copies = m.crossJoin(spark.range(4)).withColumn("event_id", c("event_id") + c("id") * 1_000_000).drop("id")
    one, many = (walk.member_rows(x, least=60, iterations=5) for x in (m, copies))
    assert many.events.count() == 4 * one.events.count()
    assert many.cells.count() == one.cells.count()
    assert many.cells.agg(F.sum("n")).first()[0] == many.events.count()


def test_summaries_of_counted_rows_are_those_of_all_rows(spark):
    rows = [(k % 2, "ab"[k % 3 > 0], k % 3, 1 + k % 4, *[x / 10 for x in ((5, 3, 2), (4, 4, 2), (1, 2, 7))[k % 3]]) for k in range(24)]
    few = accuracy.score(spark.createDataFrame(rows, "comp int, model string, outcome int, n int, p0 double, p1 double, p2 double"))
    all_ = few.withColumn("i", F.explode(F.sequence(F.lit(1), c("n")))).drop("i")
    key = lambda d: {(r.comp, r.model): r for r in d.collect()}
    got, want = key(accuracy.summaries(few, "n")), key(accuracy.summaries(all_))
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k].n, got[k].ties) == (r.n, r.ties)
        assert all(abs(got[k][x] - r[x]) < 1e-12 for x in ("brier", "log_loss", "rps", "accuracy"))
