"""Queries on the walk-forward run and the feature model; SQL cannot express the fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import features as fe
from tallyfield.plans import accuracy, fits, logistic, walk
from tallyfield.scratch import save
from tallyfield.sources import projections as p

c = F.col


def _rows(s, d):
    return walk.member_rows(save(p.matches(s, d), "matches"))


def _members(s, d):
    return walk.walk_forward(_rows(s, d))


def _report(s, d):
    """Means by model, and by competition and model, of every member and of both pools."""
    return accuracy.summaries(walk.scored(walk.pooled(_rows(s, d).cells)), "n")


def feature_rows(matches):
    """The features of each finished match from ratings before its day, the table before it, form and meetings; outcome."""
    done = matches.filter("status = 'FINISHED'")
    given = fits.ratings_before(done, fits.elo_history(matches), "day").select(
        "event_id", "r_home", "r_away", F.lit(None).cast("double").alias("p_home"), F.lit(None).cast("double").alias("p_away"), F.lit(0).alias("out_home"), F.lit(0).alias("out_away")
    )
    label = F.when(c("hs") > c("aws"), 0).when(c("hs") == c("aws"), 1).otherwise(2).alias("outcome")
    return fe.features(matches, given).join(done.select("event_id", label), "event_id")


def _feature_model(s, d):
    """The coefficients: a row for each class and feature, the constant last (feature null)."""
    m = logistic.fit(save(feature_rows(save(p.matches(s, d), "matches")), "features"), fe.FEATURES)
    names = F.array(*(F.lit(x) for x in fe.FEATURES))
    x = m.select("n", "mean", "sd", F.posexplode("weights").alias("class", "w")).select("n", "mean", "sd", "class", F.posexplode("w").alias("i", "weight"))
    return x.select("n", "class", F.get(names, c("i")).alias("feature"), F.get("mean", c("i")).alias("mean"), F.get("sd", c("i")).alias("sd"), "weight")


def _feature_factors(s, d):
    """Each finished match's shares by the feature model and the largest contributions to them."""
    rows = save(feature_rows(save(p.matches(s, d), "matches")), "features")
    m = logistic.fit(rows, fe.FEATURES)
    x, model = F.array(*fe.FEATURES), (c("mean"), c("sd"), c("weights"))
    both = rows.crossJoin(F.broadcast(m))  # one row
    both = both.select("event_id", logistic.probs(x, *model).alias("p"), logistic.contributions(x, *model).alias("parts"))
    return both.select("event_id", "p", logistic.factors(c("parts"), fe.FEATURES, F.get("p", F.lit(0))).alias("factors"))


def _logistic(s, d):
    """What a model of three features says most, by what happened."""
    rows = p.forecasts(s, d).withColumn("day7", (c("day") % 7).cast("double"))
    x = ["p0", "p1", "day7"]
    both = rows.crossJoin(F.broadcast(logistic.fit(rows, x)))  # one row
    share = logistic.probs(F.array(*x), c("mean"), c("sd"), c("weights"))
    best = both.select("outcome", share.alias("p")).select("outcome", (F.array_position("p", F.array_max("p")) - 1).cast("double").alias("prediction"))
    return best.groupBy("outcome", "prediction").count()


QUERIES = {"walk_forward_members": _members, "walk_forward_report": _report, "feature_model": _feature_model, "feature_factors": _feature_factors, "logistic": _logistic}
ORACLE_SQL: dict[str, str] = {}
