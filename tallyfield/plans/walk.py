"""The walk-forward run: each week's matches forecast by models that have seen earlier weeks only.

Models of scores are refitted every four weeks.  What a refit sees is a sum of decayed counts by teams and score; with
s(t) the sum of n * exp(xi * day) over the days before t, the counts of a refit at t of matches not older than ``max_age`` are
exp(-xi * t) * (s(t) - s(t - max_age)).  So each day's counts enter once and leave once, whatever number of refits see them,
and a window carries the sums from refit to refit.  A refit's table is bounded by teams and scores; all refits of all
competitions are fitted in parallel and joined to the weeks they hold for.

All that a week's forecasts are made from is known at its start but for the days of rest, so matches of the same sides on the same
day have the same forecasts.  These are made once for each such fixture, counted by outcome (``Walk.cells``), and are joined to
the matches at the end; cells are bounded by pairs of teams and days.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.operators import features as fe
from tallyfield.operators.probability import blend, elo_probs
from tallyfield.operators.scorelines import score_sums
from tallyfield.operators.records import as_of
from tallyfield.operators.tables import outcome, shares_with_prior
from tallyfield.plans import fits, logistic
from tallyfield.plans.accuracy import simplex
from tallyfield.scratch import save

c = F.col
WEEK = 7
MEMBERS = ("baseline", "elo", "dixon_coles", "ml")
#: Weights of the pool that is not learned.
WEIGHTS = {"baseline": 0.4, "elo": 1.0, "dixon_coles": 1.4, "ml": 1.2}


def weeks(matches: DataFrame, every: int = 4) -> DataFrame:
    """comp, chunk, fit: each week with finished matches, counted from day 0, and the last refit up to it.  The first week is
    one, then the first week at least ``every`` weeks after the last refit.  Weeks are bounded by time, so a competition's
    are one small array."""
    done = matches.filter("status = 'FINISHED'").select("comp", F.floor(c("day") / WEEK).cast("int").alias("chunk")).distinct()
    lists = done.groupBy("comp").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))
    start = F.struct(F.get(c("chunks"), F.lit(0)).alias("fit"), F.array().cast("array<struct<chunk:int,fit:int>>").alias("out"))

    def add(s, chunk):
        fit = F.when(chunk - s.fit >= every, chunk).otherwise(s.fit)
        return F.struct(fit.alias("fit"), F.array_append(s.out, F.struct(chunk.alias("chunk"), fit.alias("fit"))).alias("out"))

    return lists.select("comp", F.inline(F.aggregate("chunks", start, add, lambda s: s.out)))


def panel(matches: DataFrame, fits_: DataFrame, xi: float = 0.0018, max_age: int = 1200) -> DataFrame:
    """comp, fit, home, away, hs, aws, n, w: the decayed counts that each refit (comp, fit, in weeks) sees, of matches before
    its first day and at most ``max_age`` days old."""
    cell = ["comp", "home", "away", "hs", "aws"]
    daily = matches.filter("status = 'FINISHED'").groupBy(*cell, "day").agg(F.count("*").alias("n"))
    lists = fits_.select("comp", "fit").distinct().groupBy("comp").agg(F.array_sort(F.collect_list(c("fit") * WEEK)).alias("fits"))
    x = daily.join(lists, "comp")
    first = lambda late: F.size(F.filter("fits", lambda r: r <= late))
    w = c("n") * F.exp(xi * (c("day") - F.get("fits", F.lit(0))))
    both = F.array(F.struct(first(c("day")).alias("k"), c("n").alias("n"), w.alias("w")), F.struct(first(c("day") + max_age).alias("k"), (-c("n")).alias("n"), (-w).alias("w")))
    moves = x.select(*cell, "fits", F.inline(both)).filter(c("k") < F.size("fits"))
    sums = moves.groupBy(*cell, "k").agg(F.any_value("fits").alias("fits"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    by = W.partitionBy(*cell).orderBy("k")
    carried = by.rowsBetween(W.unboundedPreceding, 0)
    held = sums.select(*cell, "k", "fits", F.lead("k").over(by).alias("next"), F.sum("n").over(carried).alias("n"), F.sum("w").over(carried).alias("w"))
    held = held.filter("n > 0").withColumn("k", F.explode(F.sequence(c("k"), F.coalesce(c("next"), F.size("fits")) - 1)))
    at = F.get("fits", c("k"))
    return held.select("comp", (at / WEEK).cast("int").alias("fit"), "home", "away", "hs", "aws", "n", (c("w") * F.exp(-xi * (at - F.get("fits", F.lit(0))))).alias("w"))


def fitted_panel(matches: DataFrame, fits_: DataFrame, least: int = 30, iterations: int = 300) -> DataFrame:
    """comp, fit, team, attack, defence, base, home, rho: the score model of each refit with ``least`` matches before it."""
    days = matches.filter("status = 'FINISHED'").groupBy("comp", "day").agg(F.count("*").alias("n"))
    known = days.unionByName(fits_.select("comp", (c("fit") * WEEK).alias("day"), F.lit(0).cast("long").alias("n"), "fit").distinct(), allowMissingColumns=True)
    before = W.partitionBy("comp").orderBy("day").rangeBetween(W.unboundedPreceding, -1)
    enough = known.withColumn("seen", F.sum("n").over(before)).filter(c("fit").isNotNull() & (c("seen") >= least)).select("comp", "fit")

    def fit(key, pdf):
        out = fits.fit_dixon_coles(pdf, iterations)
        out.insert(0, "fit", key[1])
        out.insert(0, "comp", key[0])
        return out

    # dealt out to many tasks, as few small groups would be fitted in one
    cells = panel(matches, fits_).join(enough, ["comp", "fit"], "left_semi").repartition(8 * matches.sparkSession.sparkContext.defaultParallelism, "comp", "fit")
    return cells.groupBy("comp", "fit").applyInPandas(fit, "comp int, fit int, team int, attack double, defence double, base double, home double, rho double")


def score_shares(fixtures: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """``fixtures`` with ``dixon_coles``, the shares of their score model: null where there is none.  A team that a model lacks
    has no effects."""
    h = models.select(*keys, c("team").alias("home"), c("attack").alias("ah"), c("defence").alias("dh"))
    a = models.select(*keys, c("team").alias("away"), c("attack").alias("aa"), c("defence").alias("da"))
    league = models.groupBy(*keys).agg(*(F.first(x).alias(f"m_{x}") for x in ("base", "home", "rho")))
    x = fixtures.join(league, keys, "left").join(h, [*keys, "home"], "left").join(a, [*keys, "away"], "left").fillna(0.0, ["ah", "dh", "aa", "da"])
    lam, mu = F.exp(c("m_base") + c("ah") + c("da") + c("m_home")), F.exp(c("m_base") + c("aa") + c("dh"))
    p = f.let(score_sums(lam, mu, c("m_rho")), lambda s: F.array(s.home, s.draw, s.away))
    return x.withColumns({"lam": lam, "mu": mu, "rho": c("m_rho"), "dixon_coles": F.when(c("m_base").isNotNull(), p)}).drop("ah", "dh", "aa", "da", "m_base", "m_home", "m_rho")


def _baselines(matches: DataFrame, n: int = 380) -> DataFrame:
    """comp, chunk, baseline: shares of the competition's last ``n`` matches before each week.

    Counts before a week and before the day on which the last ``n`` begin come from sums by day; only that day's matches are put in
    order, those of them that are too old are taken off."""
    done = matches.filter("status = 'FINISHED'").select("comp", "day", "event_id", *((outcome() == k).cast("long").alias(v) for k, v in (("HOME", "h"), ("DRAW", "d"), ("AWAY", "a"))))
    names = ["h", "d", "a", "place"]
    daily = done.groupBy("comp", "day").agg(*(F.sum(k).alias(k) for k in names[:3]), F.count("*").alias("place"))
    before = W.partitionBy("comp").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    daily = save(daily.select("comp", "day", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in names)), "days")
    first = daily.groupBy("comp", F.floor(c("day") / WEEK).cast("int").alias("chunk")).agg(F.min_by(F.struct(*names), "day").alias("b"))
    first = as_of(first.withColumn("from", c("b.place") - n), daily.withColumn("tie", c("day")), ["comp"], "from", "place", "tie")
    first = first.select("comp", "chunk", "b", "r", c("r.day").alias("day"), (c("from") - c("r.place")).alias("over"))
    cut = save(first.filter("over > 0").select("comp", "day", "over", "chunk"), "cut")
    days = done.join(F.broadcast(cut.select("comp", "day").distinct()), ["comp", "day"])  # a row for each week at most
    run = W.partitionBy("comp", "day").orderBy("event_id")
    old = days.select("comp", "day", F.row_number().over(run).alias("over"), *(F.sum(k).over(run.rowsBetween(W.unboundedPreceding, 0)).alias(f"{k}_over") for k in names[:3]))
    x = first.join(cut.join(old, ["comp", "day", "over"]).drop("day", "over"), ["comp", "chunk"], "left")
    counts = (c(f"b.{k}") - F.coalesce(f"r.{k}", F.lit(0)) - F.coalesce(f"{k}_over", F.lit(0)) for k in names[:3])
    return x.select("comp", "chunk", shares_with_prior(*counts).alias("baseline"))


class Walk(NamedTuple):
    """events: comp, event_id, day, chunk, outcome, home, away of the finished matches.  cells: a row for each comp, day, home, away and
    outcome of theirs, with chunk, ``n``, the number of matches, and the shares of MEMBERS."""

    events: DataFrame
    cells: DataFrame


def _retrains(rows: DataFrame, every: int, least: int) -> tuple[list[int], dict[int, int]]:
    """The weeks at which the feature model is trained anew: each ``every``-th week of those with matches, once ``least`` rows
    lie before it; and the last such week of each week."""
    counts = sorted((r.chunk, r["count"]) for r in rows.groupBy("chunk").agg(F.sum("n").alias("count")).collect())  # a row for each week
    uptos, holds, seen = [], {}, 0
    for i, (chunk, n) in enumerate(counts):
        if i % every == 0 and seen >= least:
            uptos.append(chunk)
        if uptos:
            holds[chunk] = uptos[-1]
        seen += n
    return uptos, holds


def member_rows(matches: DataFrame, retrain: int = 8, least: int = 200, iterations: int = 500) -> Walk:
    """The finished matches and, as a written table, the shares of MEMBERS ([home, draw, away], null where there is no model yet)
    of each of their cells."""
    done = matches.filter("status = 'FINISHED'").withColumn("chunk", F.floor(c("day") / WEEK).cast("int")).withColumn("start", c("chunk") * WEEK)
    done = done.withColumn("outcome", F.when(c("hs") > c("aws"), 0).when(c("hs") == c("aws"), 1).otherwise(2))
    keys = ["comp", "chunk", "home", "away"]
    cells = save(done.groupBy(*keys, "day", "outcome").agg(F.count("*").alias("n")), "cells")
    history = save(fits.elo_days(matches), "elo")
    base = fits.draw_base(matches, history).select("comp", "draw_base")
    fitted = weeks(matches)
    models = save(fitted_panel(matches, fitted), "panel")
    x = cells.select(*keys, (c("chunk") * WEEK).alias("start")).distinct()
    x = fits.ratings_before(x, history).join(base, "comp").join(fitted, ["comp", "chunk"]).join(_baselines(matches), ["comp", "chunk"])
    x = x.withColumn("elo", elo_probs(c("r_home") + fits.ELO["home"] - c("r_away"), c("draw_base")))
    x = save(score_shares(x.repartition(8 * x.sparkSession.sparkContext.defaultParallelism, *keys), models, ["comp", "fit"]), "members")
    given = x.select(*keys, "baseline", "elo", "dixon_coles", "r_home", "r_away", F.get("dixon_coles", F.lit(0)).alias("p_home"), F.get("dixon_coles", F.lit(2)).alias("p_away"), F.lit(0).alias("out_home"), F.lit(0).alias("out_away"))
    rows = fe.period_features(cells.join(given, keys), done, "chunk")
    rows = save(rows.select("comp", "chunk", "day", "home", "away", "outcome", "n", "baseline", "elo", "dixon_coles", *fe.FEATURES), "rows")
    events = done.select("comp", "event_id", "day", "chunk", "outcome", "home", "away")
    uptos, holds = _retrains(rows, retrain, least)
    kept = [k for k in rows.columns if k not in fe.FEATURES]
    if not uptos:
        return Walk(events, rows.select(*kept, F.lit(None).cast("array<double>").alias("ml")))
    spark = rows.sparkSession
    ml = logistic.fit(rows, fe.FEATURES, at="chunk", uptos=uptos, iterations=iterations, count="n")
    held = spark.createDataFrame(list(holds.items()), "chunk int, upto long").join(ml.drop("n"), "upto")
    both = _dealt(rows).join(F.broadcast(held), "chunk", "left")  # a row for each week
    p = logistic.probs(F.array(*fe.FEATURES), c("mean"), c("sd"), c("weights"))
    return Walk(events, save(both.select(*kept, F.when(c("weights").isNotNull(), p).alias("ml")), "forecasts"))


def _dealt(cells: DataFrame) -> DataFrame:
    """Cells in many parts: each costs far more than its few bytes."""
    return cells.repartition(4 * cells.sparkSession.sparkContext.defaultParallelism)


def _losses(members: tuple[str, ...], combos: np.ndarray):
    """By week, the sums of log losses of each combination of weights and the rows each could forecast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, outcome = np.asarray(b.column(0)), np.asarray(b.column(1))
            many = np.asarray(b.column(2), float)
            ps = [np.array([p if p is not None else (0.0,) * 3 for p in b.column(3 + i).to_pylist()], float).reshape(-1, 3) for i in range(len(members))]
            use = np.stack([(p > 0).all(1) for p in ps])  # members by rows
            logs = np.stack([np.log(np.where(u[:, None], p, 1.0)) for p, u in zip(ps, use)])
            for k in np.unique(chunk):
                at = chunk == k
                total = combos @ use[:, at]  # combinations, rows
                z = (combos @ logs[:, at].reshape(len(members), -1)).reshape(len(combos), -1, 3) / np.where(total > 0, total, 1.0)[:, :, None]
                p = np.exp(z)
                p = np.clip(p / p.sum(2, keepdims=True), 0.02, 0.96)
                p /= p.sum(2, keepdims=True)
                won = np.take_along_axis(p, np.broadcast_to(outcome[at][None, :, None], (*p.shape[:2], 1)), 2)[:, :, 0]
                loss = np.where(total > 0, -np.log(np.maximum(1e-9, won)), 0.0)
                sums[int(k)] = sums.get(int(k), 0.0) + np.stack([loss @ many[at], (total > 0) @ many[at]])
        for k, v in sums.items():
            n = len(combos)
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(v[0]), pa.array(v[1])], ["chunk", "combo", "loss", "n"])

    return run


def chosen_weights(cells: DataFrame, members: tuple[str, ...] = MEMBERS, steps: int = 10) -> DataFrame:
    """chunk and weights (by member): those that would have done best in all weeks before, null in the first.

    Each cell adds to a loss for each of the C(steps + k - 1, k - 1) combinations; tasks add them up by week, and a window over
    the weeks carries the sums on."""
    combos = np.array(simplex(len(members), steps), float) / steps
    parts = _dealt(cells.select("chunk", "outcome", "n", *members)).mapInArrow(_losses(members, combos), "chunk int, combo int, loss double, n double")
    sums = parts.groupBy("chunk", "combo").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    past = W.partitionBy("combo").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    mean = sums.withColumns({"l": F.sum("loss").over(past), "k": F.sum("n").over(past)})
    best = mean.groupBy("chunk").agg(F.min_by("combo", F.when(c("k") > 0, F.struct(F.floor(c("l") / c("k") * 1e9 + 0.5), "combo"))).alias("combo"))
    table = F.array(*(F.array(*(F.lit(float(w)) for w in ws)) for ws in combos))
    return best.select("chunk", F.get(table, c("combo")).alias("weights"))


def pooled(cells: DataFrame, members: tuple[str, ...] = MEMBERS, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``cells`` of ``member_rows`` with ``ensemble``, the pool with given weights, and ``chosen``, the pool with the weights that did
    best in the weeks before (the given ones in the first week); a written table."""
    learned = chosen_weights(cells, members)
    x = _dealt(cells).join(F.broadcast(learned), "chunk", "left")  # a row for each week
    w = F.coalesce(c("weights"), F.array(*(F.lit(weights[m]) for m in members)))
    x = x.select(
        "comp", "day", "chunk", "outcome", "home", "away", "n", *members,
        f.clip_probs(blend([(c(m), F.lit(weights[m])) for m in members])).alias("ensemble"),
        f.clip_probs(blend([(c(m), F.get(w, F.lit(i))) for i, m in enumerate(members)])).alias("chosen"),
    )
    return save(x, "pooled")


def walk_forward(rows: Walk, members: tuple[str, ...] = MEMBERS, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Each finished match with the shares of the members and both pools of ``pooled``."""
    x = rows.events.join(pooled(rows.cells, members, weights).drop("n", "chunk"), ["comp", "day", "home", "away", "outcome"])
    return x.select("comp", "event_id", "day", "chunk", "outcome", *members, "ensemble", "chosen")


def scored(walk: DataFrame, members: tuple[str, ...] = (*MEMBERS, "ensemble", "chosen")) -> DataFrame:
    """A row for each forecast of each model of matches or of ``pooled`` cells: model, comp, id (of matches) or n (of cells), day, outcome,
    p0, p1, p2 and its scores."""
    from tallyfield.plans.accuracy import score

    each = F.array(*(F.struct(F.lit(m).alias("model"), c(m).alias("p")) for m in members))
    own = c("n") if "n" in walk.columns else c("event_id").alias("id")
    x = walk.select("comp", own, "day", "outcome", F.inline(each)).filter(c("p").isNotNull())
    return score(x.select(*(k for k in x.columns if k not in ("model", "p")), "model", *(F.get("p", F.lit(k)).alias(f"p{k}") for k in range(3))))
