"""Scores of forecasts and reports on them: Brier, log loss, ranked probability, calibration, timelines."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col
P = ("p0", "p1", "p2")
#: A probability is taken as this at least in log loss; forecasts closer than the second are equal.
EPS, TIE = 1e-6, 1e-9


def _p(k: Column) -> Column:
    return F.get(F.array(*(c(p) for p in P)), k)


def score(forecasts: DataFrame) -> DataFrame:
    """brier, log_loss, rps, tied and correct of each three-way forecast.  An outcome that is none of the three has no
    score: such rows are left out.  A tie of the two largest is never correct."""
    hit = [F.when(c("outcome") == k, 1.0).otherwise(0.0) for k in range(3)]
    most = F.greatest(*P)
    ties = sum((F.when(most - c(p) < TIE, 1).otherwise(0) for p in P), F.lit(0))
    return forecasts.filter(c("outcome").between(0, 2)).withColumns({
        "brier": sum(((c(p) - h) * (c(p) - h) for p, h in zip(P, hit)), F.lit(0.0)),
        "log_loss": -F.log(F.greatest(F.lit(EPS), _p(c("outcome")))),
        "rps": (F.pow(c("p0") - hit[0], 2) + F.pow(c("p0") + c("p1") - hit[0] - hit[1], 2)) / 2,
        "tied": ties > 1,
        "correct": (ties == 1) & (_p(c("outcome")) == most),
    })


def summaries(scored: DataFrame, count: str | None = None) -> DataFrame:
    """Means by model, and by competition and model, in one pass; accuracy leaves ties out.  count: a column with the number of
    equal rows that a row stands for."""
    n = F.count("*")
    if count is not None:
        many = lambda x: F.sum(F.when(x, c(count)).otherwise(0))
        mean = lambda x: (F.sum(c(x) * c(count)) / F.sum(count)).alias(x)
        return scored.groupingSets([["model"], ["comp", "model"]], "comp", "model").agg(
            F.sum(count).alias("n"), many(c("tied")).alias("ties"), mean("brier"), mean("log_loss"), mean("rps"),
            F.coalesce(F.try_divide(many(c("correct")), many(~c("tied"))), F.lit(0.0)).alias("accuracy"),
        )
    return scored.groupingSets([["model"], ["comp", "model"]], "comp", "model").agg(
        n.alias("n"),
        F.count_if("tied").alias("ties"),
        F.avg("brier").alias("brier"),
        F.avg("log_loss").alias("log_loss"),
        F.avg("rps").alias("rps"),
        F.coalesce(F.try_divide(F.count_if("correct"), F.count_if(~c("tied"))), F.lit(0.0)).alias("accuracy"),
    )


def pairs(scored: DataFrame) -> DataFrame:
    """(model, p, hit) for each outcome of each forecast."""
    each = F.array(*(F.struct(c(p).alias("p"), (c("outcome") == k).cast("int").alias("hit")) for k, p in enumerate(P)))
    return scored.select("model", F.explode(each).alias("x")).select("model", "x.p", "x.hit")


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Forecasts against what happened, in equal bins by model; empty bins are rows with n = 0."""
    width = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(c("p") * bins))).cast("int")
    sums = pairs(scored).groupBy("model", width.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.avg(c("hit").cast("double")).alias("rate"))
    grid = scored.select("model").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(sums, ["model", "bin"], "left").fillna(0, ["n"])


def calibration_slope(bins: DataFrame, least: int = 5) -> DataFrame:
    """The weighted slope of what happened on what was forecast, over bins of ``least`` or more; null under three bins."""
    used = bins.filter(c("n") >= least)
    w, x, y = F.sum("n"), F.sum(c("n") * c("mean")), F.sum(c("n") * c("rate"))
    xx, xy = F.sum(c("n") * c("mean") * c("mean")), F.sum(c("n") * c("mean") * c("rate"))
    slope = F.try_divide(xy - x * y / w, xx - x * x / w)
    return used.groupBy("model").agg(F.count("*").alias("bins"), F.when(F.count("*") >= 3, slope).alias("slope"))


def weekly(scored: DataFrame, models: list[str]) -> DataFrame:
    """Mean log loss by week, which begins on Sunday, and model; the models are given, so no pass is needed to list them."""
    week = c("day") - (c("day") + 4) % 7  # day 0 was a Thursday
    return scored.groupBy(week.alias("week")).pivot("model", models).agg(F.floor(F.avg("log_loss") * 1000 + 0.5) / 1000)


def upsets(scored: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` clearest favourites (0.55 or more) that lost to an outcome of at most 0.2."""
    won, most = _p(c("outcome")), F.greatest(*P)
    return scored.select("id", "model", most.alias("favourite"), won.alias("winner")).filter((c("favourite") >= 0.55) & (c("winner") <= 0.2)).orderBy(F.desc("favourite"), "winner", "id").limit(n)


def report(scored: DataFrame, since: int, most: int | None = None) -> DataFrame:
    """The summary by model of all scores since a day, or of the ``most`` newest ones; ties count as misses here, as stored scores do not
    know them."""
    newest = scored.filter(c("day") >= since)
    newest = newest if most is None else newest.orderBy(F.desc("day"), F.desc("id")).limit(most)
    return newest.groupBy("model").agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss"), F.avg(c("correct").cast("double")).alias("accuracy"))


def simplex(k: int, steps: int) -> list[tuple[int, ...]]:
    """All weights of ``k`` members in ``steps`` parts, in lexicographic order."""
    out = []
    for bars in combinations(range(steps + k - 1), k - 1):
        edges = (-1, *bars, steps + k - 1)
        out.append(tuple(b - a - 1 for a, b in zip(edges, edges[1:])))
    return sorted(out)


def best_weights(spark: SparkSession, rows: DataFrame, members: list[str], steps: int = 10) -> DataFrame:
    """The weights of a log-linear pool with the least mean log loss; the first of equals.

    rows: outcome and, for each member, an array of three logs of probabilities (``l_<member>``).  The combinations,
    C(steps + k - 1, k - 1) of them, are exploded within each row and averaged on the map side.
    """
    combos = simplex(len(members), steps)
    lit = F.array(*(F.struct(F.lit(i).alias("combo"), *(F.lit(w / steps).alias(m) for m, w in zip(members, ws))) for i, ws in enumerate(combos)))
    x = rows.withColumn("w", F.explode(lit))
    pool = [sum((c(f"w.{m}") * F.get(c(f"l_{m}"), F.lit(k)) for m in members), F.lit(0.0)) for k in range(3)]
    top = F.greatest(*pool)
    norm = top + F.log(sum((F.exp(v - top) for v in pool), F.lit(0.0)))
    won = F.when(c("outcome") == 0, pool[0]).when(c("outcome") == 1, pool[1]).otherwise(pool[2])
    means = x.groupBy("w.combo", *(c(f"w.{m}").alias(m) for m in members)).agg(F.avg(F.least(-F.log(F.lit(EPS)), norm - won)).alias("log_loss"))
    return means.withColumn("key", F.floor(c("log_loss") * 1e9 + 0.5)).orderBy("key", "combo").limit(1).drop("key")


def final_version(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """Of each event's versions the last one made before kickoff, else the last of all; with the version to come next."""
    w = W.partitionBy("event_id").orderBy(F.desc((c("created") <= c("starts")).cast("int")), F.desc("version"))
    both = predictions.join(events, "event_id").withColumn("k", F.row_number().over(w)).withColumn("next", F.max("version").over(W.partitionBy("event_id")) + 1)
    return both.filter("k = 1").drop("k")
