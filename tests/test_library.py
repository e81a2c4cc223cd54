"""Golden values and invariants of the library; its queries against their SQL are in test_oracle.py."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.operators import probability as o
from tallyfield.operators import scorelines as sl
from tallyfield.operators import records as r
from tallyfield.operators import tables as t
from tallyfield.plans import accuracy, fits


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_league_table_of_four(spark):
    rows = [(1, 0, 1, "a", "b", 2, 0, "FINISHED"), (2, 0, 1, "c", "d", 1, 1, "FINISHED"), (3, 1, 1, "b", "c", 0, 3, "FINISHED"), (4, 1, 1, "d", "a", 1, 1, "FINISHED"), (5, 2, 1, "a", "e", 0, 0, "SCHEDULED")]
    m = spark.createDataFrame(rows, "event_id int, day int, season int, home string, away string, hs int, aws int, status string").withColumn("comp", F.lit(1))
    table = {x.team: x for x in t.league_table(m).collect()}
    assert sorted(table, key=lambda k: table[k].position) == ["c", "a", "d", "e", "b"]
    assert (table["a"].points, table["a"].scored - table["a"].conceded, table["a"].form) == (4, 2, "WD")
    assert (table["e"].played, table["e"].form) == (0, "")


def test_scores_of_forecasts(spark):
    rows = [(1, "m", 1 / 3, 1 / 3, 1 / 3, 1), (2, "m", 0.0, 0.0, 1.0, 0), (3, "m", 0.6, 0.3, 0.1, 0), (4, "m", 0.2, 0.2, 0.6, 7)]
    s = {x.id: x for x in accuracy.score(spark.createDataFrame(rows, "id int, model string, p0 double, p1 double, p2 double, outcome int")).collect()}
    assert set(s) == {1, 2, 3}
    assert math.isclose(s[1].brier, 2 / 3) and math.isclose(s[1].rps, 1 / 9) and s[1].tied and not s[1].correct
    assert math.isclose(s[2].rps, 1) and math.isclose(s[2].log_loss, -math.log(1e-6))
    assert s[3].correct


def test_probabilities(spark):
    x = one(spark, o.elo_probs(F.lit(60.0)).alias("e"), o.match_of_set(F.lit(0.6634948023), F.lit(3)).alias("m3"), o.match_of_set(F.lit(0.6634948023), F.lit(5)).alias("m5"),
            o.set_of_match(F.lit(0.7365), F.lit(3)).alias("s"), o.game_win(F.lit(0.6)).alias("g"), o.rank_prob(F.lit(1), F.lit(100)).alias("r"),
            o.blend([(F.array(F.lit(0.6), F.lit(0.2), F.lit(0.2)), F.lit(1.0)), (F.array(F.lit(0.4), F.lit(0.3), F.lit(0.3)), F.lit(1.0))]).alias("b"),
            o.shift_home(F.array(F.lit(0.4), F.lit(0.3), F.lit(0.3)), F.lit(6.0)).alias("h"), f.token_cost(F.lit(1_000_000), F.lit(0), F.lit(100_000), F.lit(100_000), 1.0, 4.0).alias("c"))
    assert np.allclose(x.e, [0.44959229, 0.23212074, 0.31828697])
    assert math.isclose(x.m3, 0.7365015914, abs_tol=1e-9) and math.isclose(x.m5, 0.7854021481, abs_tol=1e-9) and math.isclose(x.s, 0.6634936144, abs_tol=1e-9)
    assert math.isclose(x.g, 0.735729, abs_tol=1e-6) and math.isclose(x.r, 0.8633, abs_tol=5e-4)
    assert np.allclose(x.b, [0.5, 0.25, 0.25]) and np.allclose(x.h, [0.46, 0.27, 0.27]) and math.isclose(x.c, 1.8)


@pytest.mark.parametrize(("lam", "mu", "rho", "want"), [(2.0, 0.8, 0.0, (0.654427, 0.204683, 0.140889)), (1.4, 1.1, -0.13, (0.421609, 0.299212, 0.279179))])
def test_score_grid(spark, lam, mu, rho, want):
    rates = F.lit(lam), F.lit(mu), F.lit(rho)
    row = spark.range(1).select(sl.score_sums(*rates).alias("s"), sl.score_cells(*rates).alias("c"), sl.score_forecast(*rates).alias("f")).first()
    g, p = row.s, {(x.h, x.a): x.p for x in row.c}
    assert np.allclose((g.home, g.draw, g.away), want, atol=2e-6)
    total = sum(p.values())
    part = lambda keep: sum(v for k, v in p.items() if keep(*k)) / total
    assert math.isclose(g.total, total) and len(p) == 121
    for name, keep in {"over15": lambda h, a: h + a > 1, "over25": lambda h, a: h + a > 2, "over35": lambda h, a: h + a > 3, "both": lambda h, a: h * a > 0, "clean_home": lambda h, a: a == 0, "clean_away": lambda h, a: h == 0}.items():
        assert math.isclose(g[name], part(keep), abs_tol=1e-12), name
    assert math.isclose(g.exp_home, sum(h * v for (h, _), v in p.items()) / total) and math.isclose(g.exp_away, sum(a * v for (_, a), v in p.items()) / total)
    f4 = lambda v: math.floor(v * 1e4 + 0.5) / 1e4
    best = sorted(p, key=lambda k: (-math.floor(p[k] * 1e12), k))[:8]
    assert [tuple(x) for x in row.f.top] == [(*k, f4(p[k] / total)) for k in best] and tuple(row.f.likeliest)[:2] == best[0]
    assert row.f.grid == [[f4(p[h, a] / total) for a in range(6)] for h in range(6)] and row.f.lines.over25 == f4(g.over25)


def test_names(spark):
    x = one(spark, *(f.normalise_name(F.lit(n)).alias(f"n{k}") for k, n in enumerate(("Brighton & Hove Albion", "Atlético de Madrid", "The Club"))))
    assert tuple(x) == ("brighton", "atletico madrid", "the club")
    assert one(spark, f.compact_date(F.lit("20240230")).alias("a"), f.compact_date(F.lit("2024")).alias("b")) == (None, None)
    assert one(spark, f.redact(F.lit("bad key=abc&x sk-ant-0123456789abc")).alias("a"))[0] == "bad key=***&x ***"


def test_elo_steps():
    rating, season = {}, {}
    fits.elo_step(rating, season, "A", "B", 3, 0, 1)
    assert math.isclose(rating["A"], 1511.1873084757065) and math.isclose(rating["B"], 1488.8126915242935)
    fits.elo_step(rating, season, "B", "A", 0, 1, 1)
    assert math.isclose(rating["A"], 1519.000118388908) and math.isclose(rating["B"], 1480.999881611092)


def test_sets_by_recursion_and_simulation():
    p, q = np.array([0.65, 0.6, 0.7]), np.array([0.60, 0.6, 0.55])
    s = fits.set_win(p, q)
    assert math.isclose(s[0], 0.6634948023, abs_tol=1e-9) and math.isclose(s[1], 0.5, abs_tol=1e-12)
    assert np.allclose(s + fits.set_win(q, p), 1)
    assert np.allclose(fits.hold(np.array([0.65, 0.7])), [0.829645, 0.900789], atol=1e-6)


def test_dixon_coles_recovers_strength():
    rng = np.random.default_rng(4)
    strength = np.linspace(-0.4, 0.4, 8)
    rows = []
    for _ in range(6):
        for i in range(8):
            for j in range(8):
                if i != j:
                    rows.append((i, j, rng.poisson(np.exp(0.1 + strength[i] - strength[j] / 2 + 0.25)), rng.poisson(np.exp(0.1 + strength[j] - strength[i] / 2))))
    cells = pd.DataFrame(rows, columns=["home", "away", "hs", "aws"]).groupby(["home", "away", "hs", "aws"]).size().rename("n").reset_index()
    m = fits.fit_dixon_coles(cells.assign(w=cells.n.astype(float)))
    assert np.corrcoef(m.attack, strength)[0, 1] > 0.9 and 0.1 <= m.home[0] <= 0.4
    small = fits.fit_dixon_coles(cells.head(3).assign(w=1.0, n=1))
    assert (small.attack == 0).all()


def test_rank_beta_and_temperature(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(4000):
        a, b = rnd.randint(1, 200), rnd.randint(1, 200)
        rows.append((a, b, rnd.random() < 1 / (1 + math.exp(-0.55 * (math.log(b) - math.log(a))))))
    df = spark.createDataFrame(rows, "rank_home int, rank_away int, home_won boolean")
    assert abs(fits.rank_beta(df) - 0.55) < 0.08
    assert fits.rank_beta(df.limit(100)) == 0.4
    # forecasts that are too sure are tempered
    probs = [[0.9, 0.05, 0.05], [0.1, 0.8, 0.1]]
    data = [(*(p := probs[k % 2]), rnd.choices(range(3), [x**0.5 for x in p])[0]) for k in range(1500)]
    temp = fits.fit_temperature(spark.createDataFrame(data, "p0 double, p1 double, p2 double, outcome int"))
    assert 1.5 < temp < 3
    assert fits.fit_temperature(spark.createDataFrame(data[:10], "p0 double, p1 double, p2 double, outcome int")) == 1.0


def test_similarity():
    assert fits.similarity("abc", "abc") == 1 and fits.similarity("", "x") == 0
    assert math.isclose(fits.similarity("martha", "marhta"), 0.9611111, abs_tol=1e-6)
    assert math.isclose(fits.similarity("dixon", "dicksonx"), 0.8133333, abs_tol=1e-6)


def test_as_of_and_nearest_against_brute_force(spark):
    rnd = random.Random(6)
    left = [(i, rnd.randint(0, 3), rnd.randint(0, 100)) for i in range(80)]
    right = [(i, rnd.randint(0, 3), rnd.randint(0, 100)) for i in range(60)]
    ldf, rdf = spark.createDataFrame(left, "id int, k int, at int"), spark.createDataFrame(right, "rid int, k int, rat int")
    got = {x.id: x.rid for x in r.as_of(ldf, rdf, ["k"], "at", "rat", "rid", 10).select("id", "r.rid").collect()}
    for i, k, at in left:
        best = max(((rat, rid) for rid, rk, rat in right if rk == k and rat <= at), default=None)
        assert got[i] == (best[1] if best and best[0] >= at - 10 else None)
    got = {x.id: x.match for x in r.nearest(ldf, rdf, ["k"], "at", "rat", "rid", 5).collect()}
    for i, k, at in left:
        assert got[i] == min(((abs(rat - at), rid) for rid, rk, rat in right if rk == k and abs(rat - at) <= 5), default=(0, None))[1]


def test_simulation_shares(spark):
    played = spark.createDataFrame([(1, k, 0) for k in range(4)], "comp int, team int, points long")
    fx = spark.createDataFrame([(1, 4 * i + j, i, j, 0.9 if i < j else 0.1, 0.05, 0.0) for i in range(4) for j in range(4) if i != j], "comp int, event_id int, home int, away int, p0 double, p1 double, p2 double")
    share = {(x.team, x.position): x.share for x in fits.simulate_season(played, fx, 400).collect()}
    assert all(math.isclose(sum(v for (a, _), v in share.items() if a == k), 1) for k in range(4))
    assert share[0, 1] > 0.6 > share.get((3, 1), 0)
    field = spark.createDataFrame([(1, k, 20.0 - 4 * k, 0.1, None) for k in range(5)], "event int, team int, pace double, dnf double, grid int")
    race = {x.team: x for x in fits.simulate_race(field, 500).collect()}
    assert math.isclose(sum(x.win for x in race.values()), 1) and race[0].win > race[4].win


def test_stream_ratings_are_those_of_the_batch(spark, tmp_path, sf):
    from tallyfield.sources import projections as p
    from tallyfield.streaming import results

    m = p.matches(spark, sf).filter("status = 'FINISHED'")
    m.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = results.run_to_end(results.ratings(results.stream(spark, f"{tmp_path}/in", "*.parquet")), str(tmp_path), "update")
    stream = {(x.comp, x.team): x.rating for x in out.collect()}
    last = {}
    for comp in {x.comp for x in m.collect()}:
        rating, season = {}, {}
        for x in m.filter(F.col("comp") == comp).orderBy("day", "event_id").collect():
            fits.elo_step(rating, season, x.home, x.away, x.hs, x.aws, x.season)
        last |= {(comp, k): v for k, v in rating.items()}
    assert stream.keys() == last.keys() and all(math.isclose(stream[k], last[k]) for k in last)
