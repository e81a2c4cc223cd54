"""The walk-forward run and the feature model against plain loops."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import features as fe
from tallyfield.plans import fits, logistic, walk
from tallyfield.sources import projections as p


def logistic_loop(x, y, w, classes=3, l2=0.5, iterations=600, rate=0.15):
    """The feature model row by row: standardise, then full steps."""
    x = np.array(x, float)
    filled = np.nan_to_num(x)
    mean = filled.mean(0)
    sd = np.sqrt(((filled - mean) ** 2).mean(0))
    sd[sd < 1e-9] = 0.0
    z = np.where(np.isnan(x), 0.0, x - mean)
    z = np.where(sd > 0, z / np.where(sd > 0, sd, 1.0), 0.0)
    z = np.c_[z, np.ones(len(z))]
    weights = np.zeros((classes, z.shape[1]))
    for _ in range(iterations):
        grad = np.zeros_like(weights)
        e = np.exp(z @ weights.T)
        e /= e.sum(1, keepdims=True)
        for k in range(classes):
            grad[k] = (((e[:, k] - (y == k)) * w * ((y >= 0) & (y < classes)))[:, None] * z).sum(0)
        decay = l2 * weights
        decay[:, -1] = 0
        weights = weights - rate / max(1.0, w.sum()) * (grad + decay)
    return mean, sd, weights


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 500
    x = rng.normal(size=(n, 3)) * [1, 5, 0] + [0, 10, 2]
    y = (x[:, 0] + rng.normal(size=n) > 0) + (x[:, 1] > 12).astype(int)
    x[::17, 1] = np.nan
    y[::50] = 7
    frame = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "outcome": y, "at": np.arange(n) // 10, "wt": rng.uniform(0.5, 2, n)})
    schema = "a double, b double, c double, outcome int, at int, wt double"
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame.itertuples(index=False, name=None)], schema)
    return frame, df.repartition(3)


@pytest.mark.parametrize("sent", [logistic.SENT, 0])
def test_logistic_equals_a_loop(rows, sent):
    frame, df = rows
    its = 60 if sent else 12
    got = logistic.fit(df, ["a", "b", "c"], weight="wt", iterations=its, sent=sent).first()
    mean, sd, weights = logistic_loop(frame[["a", "b", "c"]], frame.outcome.to_numpy(), frame.wt.to_numpy(), iterations=its)
    assert got.n == len(frame) and got.upto is None
    assert np.allclose(got.mean, mean, atol=1e-9) and np.allclose(got.sd, sd, atol=1e-9)
    assert np.abs(np.array(got.weights) - weights).max() < 1e-9


@pytest.mark.parametrize("sent", [logistic.SENT, 0])
def test_logistic_models_see_earlier_rows_only(rows, sent):
    frame, df = rows
    got = {r.upto: r for r in logistic.fit(df, ["a", "b", "c"], at="at", uptos=[0, 9, 30, 99], iterations=8, sent=sent).collect()}
    assert set(got) == {0, 9, 30, 99}
    assert got[0].n == 0 and not np.any(got[0].weights)
    for u in (9, 30, 99):
        part = frame[frame["at"] < u]
        weights = logistic_loop(part[["a", "b", "c"]], part.outcome.to_numpy(), np.ones(len(part)), iterations=8)[2]
        assert np.abs(np.array(got[u].weights) - weights).max() < 1e-9


def test_logistic_shares_and_contributions(rows, spark):
    frame, df = rows
    m = logistic.fit(df, ["a", "b", "c"], iterations=40)
    mean, sd, weights = logistic_loop(frame[["a", "b", "c"]], frame.outcome.to_numpy(), np.ones(len(frame)), iterations=40)
    x = F.array("a", "b", "c")
    model = (F.col("mean"), F.col("sd"), F.col("weights"))
    parts = logistic.contributions(x, *model)
    out = df.crossJoin(F.broadcast(m)).select("a", "b", "c", logistic.probs(x, *model).alias("p"), parts.alias("parts"), logistic.factors(parts, ["a", "b", "c"], F.lit(0.4)).alias("f"))
    for r in out.collect():
        v = np.array([math.nan if t is None else t for t in (r.a, r.b, r.c)])
        z = np.where(np.isnan(v) | (sd == 0), 0.0, (v - mean) / np.where(sd == 0, 1, sd))
        e = np.exp(weights @ np.r_[z, 1])
        assert np.allclose(r.p, e / e.sum(), atol=1e-9)
        want = (weights[0, :3] - weights[2, :3]) * z
        assert np.allclose(r.parts, want, atol=1e-9)
        points = [(k, math.floor(t * 24 * 10 + 0.5) / 10) for k, t in zip("abc", want)]
        assert [tuple(f) for f in r.f] == sorted((f for f in points if abs(f[1]) >= 0.3), key=lambda f: -abs(f[1]))


def pool(members, weights):
    use = [(np.array(q), w) for q, w in zip(members, weights) if w > 0 and q is not None and min(q) > 0]
    if not use:
        return np.full(3, 1 / 3)
    z = np.exp(sum(w * np.log(q) for q, w in use) / sum(w for _, w in use))
    q = np.clip(z / z.sum(), 0.02, 0.96)
    return q / q.sum()


def grid(lam, mu, rho):
    pm = lambda r: np.array([math.exp(k * math.log(r) - r - math.lgamma(k + 1)) for k in range(11)])
    g = np.outer(pm(lam), pm(mu))
    for k, v in {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}.items():
        g[k] *= max(0.0, v)
    g /= g.sum()
    return np.array([np.tril(g, -1).sum(), np.trace(g), np.triu(g, 1).sum()])


def walk_loop(m, retrain, least, iterations):
    """Week by week over two competitions: refit, forecast the week, learn from it."""
    m = m[m.status == "FINISHED"].sort_values(["day", "event_id"])
    m = m.assign(chunk=m.day // 7, outcome=np.select([m.hs > m.aws, m.hs == m.aws], [0, 1], 2))
    base = {}
    for comp, own in m.groupby("comp"):
        rating, season, even, drawn = {}, {}, 0.0, 0
        for x in own.itertuples():
            e = 1 / (1 + 10 ** (-(rating.get(x.home, 1500.0) + 60 - rating.get(x.away, 1500.0)) / 400))
            even, drawn = even + 1 - abs(2 * e - 1), drawn + (x.hs == x.aws)
            fits.elo_step(rating, season, x.home, x.away, x.hs, x.aws, x.season)
        base[comp] = 0.28 if len(own) < 30 or even <= 0 else min(0.45, max(0.05, drawn / even))
    elo = defaultdict(lambda: ({}, {}))
    fit_at, model, seen, out, ml, rows = {}, {}, [], [], None, []
    for i, (chunk, week) in enumerate(m.groupby("chunk")):
        past = pd.DataFrame(seen, columns=m.columns) if seen else m.iloc[:0]
        for comp in week.comp.unique():
            if comp not in fit_at or chunk - fit_at[comp] >= 4:
                prior = past[past.comp == comp]
                fit_at[comp], model[comp] = chunk, None
                if len(prior) >= 30:
                    age = chunk * 7 - prior.day
                    prior = prior[age <= 1200]
                    cells = prior.assign(w=np.exp(-0.0018 * (chunk * 7 - prior.day)), n=1).groupby(["home", "away", "hs", "aws"], as_index=False)[["w", "n"]].sum()
                    model[comp] = fits.fit_dixon_coles(cells, 300).set_index("team")
        if i % retrain == 0 and len(rows) >= least:
            ml = logistic_loop([r[0] for r in rows], np.array([r[1] for r in rows]), np.ones(len(rows)), iterations=iterations)
        fresh = []
        for x in week.itertuples():
            own = past[past.comp == x.comp].tail(380)
            n = len(own) + 40
            q = {"baseline": [((own.outcome == k).sum() + 40 * s) / n for k, s in enumerate((0.45, 0.26, 0.29))]}
            rating = elo[x.comp][0]
            rh, ra = rating.get(x.home, 1500.0), rating.get(x.away, 1500.0)
            e = 1 / (1 + 10 ** (-(rh + 60 - ra) / 400))
            d = base[x.comp] * (1 - abs(2 * e - 1))
            q["elo"] = [(1 - d) * e, d, (1 - d) * (1 - e)]
            q["dixon_coles"] = None
            if model[x.comp] is not None:
                t = model[x.comp]
                get = lambda team, k: t[k].get(team, 0.0)  # noqa: B023, E731
                one = t.iloc[0]
                q["dixon_coles"] = grid(math.exp(one.base + get(x.home, "attack") + get(x.away, "defence") + one.home), math.exp(one.base + get(x.away, "attack") + get(x.home, "defence")), one.rho)

            def last(team, k, venue=None):
                own = past[(past.home == team) if venue == "H" else (past.away == team) if venue == "A" else (past.home == team) | (past.away == team)].iloc[::-1][:k]
                mine, theirs = np.where(own.home == team, own.hs, own.aws), np.where(own.home == team, own.aws, own.hs)
                pts = np.where(mine > theirs, 3, mine == theirs)
                return (pts.mean(), (mine - theirs).mean(), len(own), own.day.iloc[0]) if len(own) else (1.3, 0.0, 0, None)

            (hp, hg, hn, hd), (ap, ag, an, ad) = last(x.home, 5), last(x.away, 5)
            rest = lambda day: 7 if day is None else min(14, max(1, x.day - day))  # noqa: B023, E731
            met = past[((past.home == x.home) & (past.away == x.away)) | ((past.home == x.away) & (past.away == x.home))].iloc[::-1][:6]
            edge = float((np.sign(met.hs - met.aws) * np.where(met.home == x.home, 1, -1)).mean()) if len(met) else 0.0
            s = q["dixon_coles"]
            v = [(rh - ra) / 400, 0.45 if s is None else s[0], 0.29 if s is None else s[2], hp - ap, hg - ag, last(x.home, 5, "H")[0], last(x.away, 5, "A")[0], rest(hd) - rest(ad), edge, 0.0, 0.0, min(hn, an) / 5]
            q["ml"] = None
            if ml is not None:
                mean, sd, weights = ml
                z = np.exp(weights @ np.r_[np.where(sd > 0, (np.array(v) - mean) / np.where(sd > 0, sd, 1), 0), 1])
                q["ml"] = z / z.sum()
            fresh.append((v, x.outcome))
            out.append((x.event_id, x.chunk, x.outcome, [q[k] for k in walk.MEMBERS]))
        rows += fresh
        for x in week.itertuples():
            fits.elo_step(*elo[x.comp], x.home, x.away, x.hs, x.aws, x.season)
        seen += week.values.tolist()
    return out


def test_walk_forward_equals_a_loop(spark, sf):
    m = p.matches(spark, sf).filter("comp < 2").cache()
    frame = m.toPandas()
    want = walk_loop(frame, retrain=8, least=60, iterations=25)
    rows = walk.member_rows(m, retrain=8, least=60, iterations=25)
    got = {r.event_id: r for r in walk.walk_forward(rows).collect()}
    assert len(got) == len(want) > 80
    assert sum(q[3] is not None for *_, q in want) > 10 and sum(q[2] is not None for *_, q in want) > 10
    for event, chunk, _, q in want:
        r = got[event]
        assert r.chunk == chunk
        for k, name in enumerate(walk.MEMBERS):
            assert (r[name] is None) == (q[k] is None), (event, name)
            assert q[k] is None or np.abs(np.array(r[name]) - q[k]).max() < 1e-6, (event, name, r[name], q[k])
        assert np.abs(np.array(r.ensemble) - pool(q, [walk.WEIGHTS[n] for n in walk.MEMBERS])).max() < 1e-6
    combos = [w for w in itertools.product(range(11), repeat=4) if sum(w) == 10]
    chunks = sorted({x[1] for x in want})
    for chunk in (chunks[1], chunks[len(chunks) // 2], chunks[-1]):
        losses = []
        for w in combos:
            total = [-math.log(max(1e-9, pool(q, w)[o])) for _, k, o, q in want if k < chunk and any(a > 0 and b is not None for a, b in zip(w, q))]
            losses.append(sum(total) / len(total) if total else math.inf)
        best = combos[min(range(len(combos)), key=lambda i: (math.floor(losses[i] * 1e9 + 0.5) if losses[i] < math.inf else math.inf, i))]
        for event, k, _, q in want:
            if k == chunk:
                assert np.abs(np.array(got[event].chosen) - pool(q, best)).max() < 1e-6


def test_panel_is_the_rescanned_history(spark, sf):
    m = p.matches(spark, sf).filter("comp = 1").cache()
    fitted = walk.weeks(m)
    got = {(r.fit, r.home, r.away, r.hs, r.aws): (r.n, r.w) for r in walk.panel(m, fitted, max_age=200).collect()}
    frame = m.filter("status = 'FINISHED'").toPandas()
    want = {}
    for fit in sorted({r.fit for r in fitted.collect()}):
        age = fit * 7 - frame.day
        own = frame[(age > 0) & (age <= 200)]
        for x in own.itertuples():
            n, w = want.get((fit, x.home, x.away, x.hs, x.aws), (0, 0.0))
            want[fit, x.home, x.away, x.hs, x.aws] = (n + 1, w + math.exp(-0.0018 * (fit * 7 - x.day)))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_weeks_and_empty_history(spark, sf):
    m = p.matches(spark, sf)
    last = {}
    for r in sorted(walk.weeks(m).collect()):
        if r.comp not in last or r.chunk - last[r.comp] >= 4:
            last[r.comp] = r.chunk
        assert r.fit == last[r.comp]
    assert walk.walk_forward(walk.member_rows(m.limit(0))).count() == 0


def test_draw_base_by_hand(spark):
    rows = [(1, k, 2000 + (k > 40), 100 + k, "FINISHED", k % 3, (k + 1) % 3, k % 2, (k // 2) % 2) for k in range(60)]
    m = spark.createDataFrame(rows, "comp int, event_id long, season int, day int, status string, home int, away int, hs int, aws int")
    rating, season, even = {}, {}, 0.0
    for _, _, year, _, _, h, a, hs, aws in rows:
        e = 1 / (1 + 10 ** (-(rating.get(h, 1500.0) + 60 - rating.get(a, 1500.0)) / 400))
        even += (1 - abs(2 * e - 1)) ** 1.3
        fits.elo_step(rating, season, h, a, hs, aws, year)
    drawn = sum(r[-1] == r[-2] for r in rows)
    got = fits.draw_base(m, fits.elo_history(m), slope=1.3).first()
    assert got.n == 60 and abs(got.draw_base - min(0.45, max(0.05, drawn / even))) < 1e-9
    assert fits.draw_base(m.limit(20), fits.elo_history(m.limit(20))).first().draw_base == 0.28


def test_features_by_period_equal_features_by_day(spark, sf):
    m = p.matches(spark, sf).withColumn("same", F.col("day"))
    given = m.select("event_id", F.lit(1500.0).alias("r_home"), F.lit(1400.0).alias("r_away"), F.lit(None).cast("double").alias("p_home"), F.lit(None).cast("double").alias("p_away"), F.lit(0).alias("out_home"), F.lit(1).alias("out_away"))
    a, b = fe.features(m, given), fe.features(m, given, period="same")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
