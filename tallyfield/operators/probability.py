"""Outcome probabilities as column arithmetic: ratings, scorelines, margins, sets, pools and odds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.functions import scalars as f

c = F.col


def elo_expected(diff: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -diff / 400.0))


def margin_multiplier(margin: Column, winner_diff: Column) -> Column:
    return F.log1p(margin) * 2.2 / (winner_diff * 0.001 + 2.2)


def elo_probs(diff: Column, draw_base: float | Column = 0.28, draw_slope: float = 1.0, has_draws: bool = True) -> Column:
    """[home, draw, away] of a rating difference; the draw is likeliest between equals."""
    e = elo_expected(diff)
    draw = draw_base * F.pow(1.0 - F.abs(2.0 * e - 1.0), F.lit(draw_slope)) if has_draws else F.lit(0.0)
    return F.array((1.0 - draw) * e, draw, (1.0 - draw) * (1.0 - e))


def seeded_rating(elo: Column, seed: Column, games: Column, blend: float = 10.0) -> Column:
    """A rating drawn towards a seed while there are few games; unknown games count as ``blend`` of them."""
    w = F.coalesce(games, F.lit(blend)) / (F.coalesce(games, F.lit(blend)) + blend)
    return w * elo + (1.0 - w) * F.coalesce(seed, elo)


def rank_prob(home: Column, away: Column, beta: float = 0.4, unranked: float = 500.0) -> Column:
    """The home side's chance by published ranks.  With one side unranked it is drawn to a half; without both null."""
    p = f.sigmoid(beta * (F.log(F.coalesce(away, F.lit(unranked))) - F.log(F.coalesce(home, F.lit(unranked)))))
    one = home.isNull() | away.isNull()
    p = F.when(one, 0.5 + 0.6 * (p - 0.5)).otherwise(p)
    return F.when(home.isNull() & away.isNull(), F.lit(None)).otherwise(f.clamp(p, 0.05, 0.95))


def rating_of_rank(rank: Column, beta: float = 0.4) -> Column:
    return 1500.0 + 400.0 * beta / math.log(10) * F.log(100.0 / rank)


def match_of_set(s: Column, best_of: Column) -> Column:
    q = 1.0 - s
    three = s * s * (1.0 + 2.0 * q)
    five = s * s * s * (1.0 + 3.0 * q + 6.0 * q * q)
    return F.when(best_of == 5, five).otherwise(three)


def set_of_match(m: Column, best_of: Column, steps: int = 60) -> Column:
    """The set probability that gives a match probability, by bisection inside the plan."""
    def half(x, _):
        mid = (x.lo + x.hi) / 2
        up = match_of_set(mid, best_of) < m
        return F.struct(F.when(up, mid).otherwise(x.lo).alias("lo"), F.when(up, x.hi).otherwise(mid).alias("hi"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), half)
    return (ends.lo + ends.hi) / 2


def deuce_win(p: Column) -> Column:
    return p * p / (p * p + (1.0 - p) * (1.0 - p))


def game_win(p: Column) -> Column:
    """The server's chance to hold, from the chance to win a point."""
    q = 1.0 - p
    four = p * p * p * p
    return four * (1.0 + 4.0 * q + 10.0 * q * q) + 20.0 * p * p * p * q * q * q * deuce_win(p)


def blend(members: list[tuple[Column, Column]], n: int = 3) -> Column:
    """The log-linear pool of (array of ``n`` probabilities, weight).  A member without weight or with a zero or missing
    probability is left out; without any member all outcomes are equal."""
    use = [F.when((w > 0) & F.forall(p, lambda x: F.coalesce(x > 0, F.lit(False))), w).otherwise(0.0) for p, w in members]
    total = sum(use, F.lit(0.0))
    logs = [sum((F.when(u > 0, u * F.log(F.when(u > 0, F.get(p, F.lit(k))).otherwise(1.0))).otherwise(0.0) for (p, _), u in zip(members, use)), F.lit(0.0)) / total for k in range(n)]
    return F.when(total > 0, f.normalise(F.array(*(F.exp(x) for x in logs)))).otherwise(F.array(*(F.lit(1.0 / n),) * n))


def shift_home(probs: Column, points: Column) -> Column:
    """[home, draw, away] with the home share moved by percentage points, kept within 0.03 and 0.95; the others share the
    rest as before, evenly if they had nothing."""
    home, draw, away = (F.get(probs, F.lit(k)) for k in range(3))
    to = f.clamp(home + points / 100.0, 0.03, 0.95)
    part = lambda x: F.when(draw + away > 0, x / (draw + away)).otherwise(0.5) * (1.0 - to)
    return F.array(to, part(draw), part(away))


def capped_effects(factors: DataFrame, key: str, effect: str, each: float = 8.0, total: float = 10.0) -> DataFrame:
    """Effects clamped and rounded to one digit, then, if their sum goes beyond the total, scaled to it and rounded again.
    Sums are of whole tenths, so their order does not matter."""
    tenths = F.floor(f.clamp(c(effect), -each, each) * 10 + 0.5)
    s = F.abs(F.sum(tenths).over(W.partitionBy(key)))
    return factors.withColumn("capped", F.when(s > total * 10, F.floor(tenths * (total * 10) / s + 0.5)).otherwise(tenths) / 10.0)


def consensus(odds: DataFrame) -> DataFrame:
    """Mean of the books' probabilities without their margin, four digits: event_id, outcome, p.  Prices of 1 or less
    don't count, nor do books without a home or an away price."""
    outcomes = ("HOME", "DRAW", "AWAY")
    each = (F.sum(F.when(c("outcome") == o, 1.0 / c("price"))).alias(o) for o in outcomes)
    ok = odds.filter(c("price") > 1).groupBy("event_id", "book").agg(F.sum(1.0 / c("price")).alias("total"), *each).filter(c("HOME").isNotNull() & c("AWAY").isNotNull())
    mean = ok.groupBy("event_id").agg(*(F.avg(F.coalesce(c(o), F.lit(0.0)) / c("total")).alias(o) for o in outcomes))
    s = sum((c(o) for o in outcomes), F.lit(0.0))
    return mean.select("event_id", F.explode(F.array(*(F.struct(F.lit(o).alias("outcome"), f.half_up(c(o) / s, 4).alias("p")) for o in outcomes))).alias("x")).select("event_id", "x.*")


def margin_fit(rows: DataFrame, key: str, slope_floor: float = 0.005, least: int = 20, flat: float = 0.04, home_edge: float = 0.35, mean_score: float = 1.35, score_sd: float = 1.6) -> DataFrame:
    """Least squares of margins on rating gaps (columns gap, margin, total): slope, edge, sigma and mean total.

    The slope's floor comes before the intercept, and a slope of ``flat`` stands for gaps that are all equal; sigma
    divides by n - 2, at least 1, and is 1 at least.  Under ``least`` rows the sport's own edge, score and spread are
    given, with a slope of ``flat``."""
    m = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("gap").alias("mg"), F.avg("margin").alias("mm"), F.covar_pop("gap", "margin").alias("cov"), F.var_pop("gap").alias("var"), F.var_pop("margin").alias("vm"), F.avg("total").alias("total"))
    slope = F.when(c("var") > 0, F.greatest(F.lit(slope_floor), F.try_divide(c("cov"), c("var")))).otherwise(flat)
    m = m.withColumn("slope", slope).withColumn("edge", c("mm") - c("slope") * c("mg"))
    rest = c("n") * (c("vm") - 2 * c("slope") * c("cov") + c("slope") * c("slope") * c("var"))
    m = m.withColumn("sigma", F.greatest(F.lit(1.0), F.sqrt(F.greatest(rest, F.lit(0.0)) / F.greatest(c("n") - 2, F.lit(1)))))
    given = {"slope": flat, "edge": home_edge, "sigma": score_sd, "total": 2 * mean_score}
    return m.select(key, "n", *(F.when(c("n") < least, v).otherwise(c(k)).alias(k) for k, v in given.items()))


def margin_scores(mean: Column, total: Column) -> Column:
    """Expected scores of both sides, one digit, and the likeliest, whole, of a margin and a total."""
    home, away = (total + mean) / 2, (total - mean) / 2
    return F.struct(f.half_up(home, 1).alias("home"), f.half_up(away, 1).alias("away"), f.half_up(home, 0).cast("int").alias("likely_home"), f.half_up(away, 0).cast("int").alias("likely_away"))


def margin_probs(mean: Column, sigma: Column, has_draws: bool = True) -> Column:
    """[home, draw, away] of a normal margin; a draw is within half a point of nothing."""
    if not has_draws:
        away = f.normal_cdf(F.lit(0.0), mean, sigma)
        return F.array(1.0 - away, F.lit(0.0), away)
    low, high = f.normal_cdf(F.lit(-0.5), mean, sigma), f.normal_cdf(F.lit(0.5), mean, sigma)
    return F.array(1.0 - high, high - low, low)


def decayed_rates(rows: DataFrame, key: list[str], value: str, age: str, xi: float = 0.003, shrink: float = 4.0) -> DataFrame:
    """Time-decayed means of a value by key, drawn to the mean of all as if by ``shrink`` more rows, over that mean."""
    w = f.decay(c(age), xi)
    sums = rows.groupBy(*key).agg(F.sum(w * c(value)).alias("wv"), F.sum(w).alias("w"))
    league = rows.agg((F.sum(w * c(value)) / F.sum(w)).alias("league"))
    return sums.crossJoin(F.broadcast(league)).select(*key, ((c("wv") + shrink * c("league")) / (c("w") + shrink) / c("league")).alias("rate"), "w")  # one row


def pace(races: DataFrame, now: Column, xi: float = 0.006) -> DataFrame:
    """Decayed pace and chance to retire of each team (columns team, position, race): places beyond 20 are retirements."""
    w = f.decay(now - c("race"), xi)
    out = c("position") > 20
    s = races.groupBy("team").agg(
        F.sum(F.when(~out, w * F.greatest(F.lit(1.0), 21.0 - c("position"))).otherwise(0.0)).alias("ws"),
        F.sum(F.when(~out, w).otherwise(0.0)).alias("wf"), F.sum(w).alias("wa"), F.sum(F.when(out, w).otherwise(0.0)).alias("wd"),
    )
    return s.select("team", ((c("ws") + 16) / (c("wf") + 2)).alias("pace"), F.least(F.lit(0.5), (c("wd") + 0.24) / (c("wa") + 2)).alias("dnf"))


def confidence(probs: Column, evidence: Column, n: int = 3) -> Column:
    most = F.array_max(probs)
    return f.half_up((most - 1.0 / n) / (1.0 - 1.0 / n) * evidence, 2)


def grid_baseline(entrants: DataFrame, event: str, slope: float = 0.35) -> DataFrame:
    """``entrants`` with ``share``: chances to win by starting place alone, exp(-slope * (grid - 1)), made to sum to 1 in an
    event; without a place an entrant has none."""
    up = F.coalesce(F.exp(-slope * (c("grid") - 1)), F.lit(0.0))
    total = F.sum(up).over(W.partitionBy(event))
    return entrants.withColumn("share", F.when(total > 0, up / total).otherwise(0.0))
