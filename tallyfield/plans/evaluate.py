"""Scoring finished events: the version of each model that counts, its scores, the exact score and the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.plans.accuracy import score

c = F.col


def evaluate(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row for each finished event and model that has no evaluation yet: event_id, model, version, brier, log_loss, rps,
    correct, exact.

    events: event_id, starts, status, hs, aws.  predictions: event_id, model, version, created, p0, p1, p2, evaluated, and
    likely_h, likely_a, the likeliest score of the model that gives one.  Of a model's versions the last one made before
    the start counts, else the last of all; a model with an evaluated version is done.  Shares that are missing or sum to
    nothing are not scored.  exact is null without a likeliest score."""
    done = events.filter("status = 'FINISHED' and hs is not null and aws is not null")
    both = predictions.join(done, "event_id")
    each = W.partitionBy("event_id", "model")
    order = each.orderBy(F.desc((c("created") <= c("starts")).cast("int")), F.desc("version"))
    both = both.withColumn("__done", F.max(c("evaluated").cast("int")).over(each)).withColumn("__k", F.row_number().over(order))
    final = both.filter((c("__k") == 1) & (F.coalesce("__done", F.lit(0)) == 0))
    shares = c("p0") + c("p1") + c("p2")
    usable = final.filter(shares.isNotNull() & ~F.isnan(shares) & (shares > 0))
    outcome = F.when(c("hs") > c("aws"), 0).when(c("hs") == c("aws"), 1).otherwise(2)
    exact = (c("likely_h") == c("hs")) & (c("likely_a") == c("aws"))
    return score(usable.withColumn("outcome", outcome)).select("event_id", "model", "version", "brier", "log_loss", "rps", "correct", exact.alias("exact"))


def exact_rate(evaluations: DataFrame) -> DataFrame:
    """model, n, rate: how often the likeliest score was the score, of those that gave one."""
    return evaluations.filter("exact is not null").groupBy("model").agg(F.count("*").alias("n"), F.avg(c("exact").cast("double")).alias("rate"))
