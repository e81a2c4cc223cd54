"""Serve and return: tallies with decay, two levels of shrinkage, rates for a pairing, and what follows for a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.operators.probability import game_win, match_of_set

c = F.col
#: The surface that stands for all of them.
ALL = ""


def serve_samples(matches: DataFrame, least: float = 30) -> DataFrame:
    """Two rows for each match (event_id, day, surface, home, away and both sides' serve points and points won): player,
    opponent, day, surface, serve, serve_won, ret, ret_won.  A match in which a count is missing or a side served fewer than
    ``least`` points has none."""
    ok = matches.filter((c("home_points") >= least) & (c("away_points") >= least) & c("home_won").isNotNull() & c("away_won").isNotNull())

    def side(me, other):
        return F.struct(
            c(me).alias("player"), c(other).alias("opponent"), c(f"{me}_points").cast("double").alias("serve"), c(f"{me}_won").cast("double").alias("serve_won"),
            c(f"{other}_points").cast("double").alias("ret"), (c(f"{other}_points") - c(f"{other}_won")).cast("double").alias("ret_won"),
        )

    return ok.select("event_id", "day", "surface", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("event_id", "day", "surface", "s.*")


def serve_rates(samples: DataFrame, as_of: int, xi: float = 0.0025, max_age: int = 900, shrink: float = 400, surface_shrink: float = 700, prior: float = 0.62, prior_points: float = 2000) -> DataFrame:
    """player, surface (ALL for all of them), serve, ret, points (decayed serve points on all surfaces), tour (the tour's
    serve rate there): rates of points won.

    The tour is drawn to ``prior``, a player to the tour, and a player on a surface to the player's own level as the tour
    plays there; a surface that a player has not played on has that level.  Tallies of all three levels come from one
    pass of grouping sets; the tour's are one row for each surface."""
    age = F.lit(as_of) - c("day")
    used = samples.filter((age >= 0) & (age <= max_age)).withColumn("w", f.decay(age, xi))
    tally = [F.sum(c("w") * c(k)).alias(k) for k in ("serve", "serve_won", "ret", "ret_won")]
    sums = used.groupingSets([["player", "surface"], ["player"]], "player", "surface").agg(F.grouping("surface").alias("all"), *tally)
    own = sums.filter("all = 1").drop("surface", "all")
    there = sums.filter("all = 0").drop("all")
    pooled = used.agg(((F.sum(c("w") * c("serve_won")) + prior * prior_points) / (F.sum(c("w") * c("serve")) + prior_points)).alias("base"))
    by_surface = used.groupBy("surface").agg(F.sum(c("w") * c("serve_won")).alias("won"), F.sum(c("w") * c("serve")).alias("n")).crossJoin(F.broadcast(pooled))  # one row
    at = by_surface.select("base", F.struct("surface", ((c("won") + c("base") * prior_points) / (c("n") + prior_points)).alias("tour")).alias("s"))
    tour = at.groupBy("base").agg(F.collect_list("s").alias("tours"))  # one row, an element for each surface
    level = own.crossJoin(F.broadcast(tour)).select(
        "player", c("serve").alias("points"), "base", "tours",
        ((c("serve_won") + shrink * c("base")) / (c("serve") + shrink)).alias("serve0"), ((c("ret_won") + shrink * (1 - c("base"))) / (c("ret") + shrink)).alias("ret0"),
    )
    overall = level.select("player", F.lit(ALL).alias("surface"), c("serve0").alias("serve"), c("ret0").alias("ret"), "points", c("base").alias("tour"))
    each = level.select("player", "points", "base", "serve0", "ret0", F.explode("tours").alias("t")).select("*", "t.*").drop("t")
    n = lambda k: F.coalesce(c(k), F.lit(0.0))
    known = each.join(there, ["player", "surface"], "left").select(
        "player", "surface",
        ((n("serve_won") + surface_shrink * c("serve0") * c("tour") / c("base")) / (n("serve") + surface_shrink)).alias("serve"),
        ((n("ret_won") + surface_shrink * c("ret0") * (1 - c("tour")) / (1 - c("base"))) / (n("ret") + surface_shrink)).alias("ret"),
        "points", "tour",
    )
    return overall.unionByName(known)


def pairing_rates(fixtures: DataFrame, rates: DataFrame, least: float = 250) -> DataFrame:
    """``fixtures`` (home, away, surface) with p_home and p_away, the serve points that either is to win: own serve less
    the other's return, from the tour's level.  Null if one of them has fewer than ``least`` points; a surface that the
    tour has not seen counts as all."""
    seen = rates.select(c("surface").alias("__s"), F.lit(True).alias("__seen")).distinct()  # a row for each surface
    x = fixtures.join(F.broadcast(seen), c("surface") == c("__s"), "left").withColumn("__on", F.when(c("__seen"), c("surface")).otherwise(ALL)).drop("__s", "__seen")
    for side in ("home", "away"):
        r = rates.select(c("player").alias(side), c("surface").alias("__on"), *(c(k).alias(f"__{side}_{k}") for k in ("serve", "ret", "points", "tour")))
        x = x.join(r, [side, "__on"], "left")
    ok = (c("__home_points") >= least) & (c("__away_points") >= least)
    p = lambda me, other: F.when(ok, f.clamp(c(f"__{me}_serve") - c(f"__{other}_ret") + 1 - c("__home_tour"), 0.35, 0.9))
    return x.select(*fixtures.columns, p("home", "away").alias("p_home"), p("away", "home").alias("p_away"))


def match_forecast(s: Column, p_home: Column, p_away: Column, best_of: Column) -> Column:
    """What a set probability and both serve rates say of a match: home, away, expected sets of both, the likeliest score,
    holds, straight and decider."""
    t = 1.0 - s
    three = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(a).alias("a"), p.alias("p")) for h, a, p in ((2, 0, s * s), (2, 1, 2.0 * s * s * t), (1, 2, 2.0 * t * t * s), (0, 2, t * t))))
    s3, t3 = s * s * s, t * t * t
    five = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(a).alias("a"), p.alias("p")) for h, a, p in ((3, 0, s3), (3, 1, 3.0 * s3 * t), (3, 2, 6.0 * s3 * t * t), (2, 3, 6.0 * t3 * s * s), (1, 3, 3.0 * t3 * s), (0, 3, t3))))
    scores = F.when(best_of == 5, five).otherwise(three)
    mean = lambda pick: F.aggregate(scores, F.lit(0.0), lambda z, x: z + x.p * pick(x))
    last = F.when(best_of == 5, 2).otherwise(1)
    decider = F.aggregate(F.filter(scores, lambda x: F.least(x.h, x.a) == last), F.lit(0.0), lambda z, x: z + x.p)
    likely = F.aggregate(scores, F.get(scores, F.lit(0)), lambda z, x: F.when(x.p > z.p, x).otherwise(z))
    win = match_of_set(s, best_of)
    return F.struct(
        win.alias("home"), (1.0 - win).alias("away"), f.half_up(mean(lambda x: x.h), 2).alias("sets_home"), f.half_up(mean(lambda x: x.a), 2).alias("sets_away"),
        F.concat(likely.h.cast("string"), F.lit("-"), likely.a.cast("string")).alias("likely"), f.half_up(game_win(p_home), 4).alias("hold_home"), f.half_up(game_win(p_away), 4).alias("hold_away"),
        f.half_up(1.0 - decider, 4).alias("straight"), f.half_up(decider, 4).alias("decider"),
    )
