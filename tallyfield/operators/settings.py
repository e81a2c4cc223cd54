"""Settings laid over each other: defaults, then those of a sport, then those of one competition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
LEVELS = ("default", "sport", "competition")


def overlay(defaults: DataFrame, rows: DataFrame, competitions: DataFrame) -> DataFrame:
    """The settings of each model for each competition: sport, comp, model, enabled, weight, params (map), sources (map: the
    level that each parameter came from), state, fitted_at, specific (does the competition have a row of its own).

    defaults: sport, model, enabled, weight, params; rows: sport, comp (null or empty: the whole sport), model, enabled, weight,
    params, state, fitted_at; competitions: sport, comp.  enabled and weight come from the last level that has a row, state and
    fitted_at from the last that has them, each parameter from the last that names it; one that a level names as null is
    null.  Rows on models without defaults are left out.  Of several rows for a scope the one fitted last counts.

    Defaults and sport rows meet their sport's competitions by an equi-join; what is grouped is a row for each level."""
    scope = F.coalesce(c("comp").cast("string"), F.lit(""))
    newest = F.max_by(F.struct("enabled", "weight", "params", "state", "fitted_at"), F.struct(F.coalesce("fitted_at", F.lit(0)), "weight"))
    own = rows.withColumn("comp", scope).groupBy("sport", "comp", "model").agg(newest.alias("x")).select("sport", "comp", "model", "x.*")
    each = competitions.select("sport", c("comp").cast("string").alias("comp")).distinct()
    parts = [
        defaults.select("sport", "model", "enabled", "weight", "params", F.lit(None).cast("string").alias("state"), F.lit(None).cast("long").alias("fitted_at")).join(each, "sport"),
        own.filter("comp = ''").drop("comp").join(each, "sport"),
        own.filter("comp <> ''").join(each, ["sport", "comp"], "left_semi"),
    ]
    cols = ["sport", "comp", "model", "enabled", "weight", "params", "state", "fitted_at"]
    levels = None
    for k, p in enumerate(parts):
        p = p.select(*cols, F.lit(k).alias("level"))
        levels = p if levels is None else levels.unionByName(p)
    last = lambda x: F.max_by(x, F.when(c(x).isNotNull(), c("level")))
    out = levels.groupBy("sport", "comp", "model").agg(
        F.min("level").alias("lowest"), F.max_by("enabled", "level").alias("enabled"), F.max_by("weight", "level").alias("weight"), last("state").alias("state"), last("fitted_at").alias("fitted_at"),
        (F.max("level") == 2).alias("specific"), F.array(*(F.struct(F.lit(k).alias("level"), F.max_by("params", F.when(c("level") == k, 1)).alias("params")) for k in range(len(LEVELS)))).alias("layers"),
    ).filter("lowest = 0")
    names = F.array(*(F.lit(x) for x in LEVELS))
    over = lambda base, top: F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    layer = lambda x: F.coalesce(x.params, empty)
    params = F.aggregate("layers", empty, lambda m, x: over(m, layer(x)))
    sources = F.aggregate("layers", empty, lambda m, x: over(m, F.transform_values(layer(x), lambda k, v: F.get(names, x.level))))
    return out.select("sport", "comp", "model", "enabled", "weight", params.alias("params"), sources.alias("sources"), "state", "fitted_at", "specific")
