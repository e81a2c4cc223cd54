"""Forecasts of matches to come: fitted parameters, every model's shares, the pool, and what is said about it.

Parameters are tables by competition.  ``fit_or_load`` keeps them as versions in a store: what is fresh is read, only the
competitions without fresh parameters are fitted, and what is fitted is added as the next version.  History is reduced to a
row for each team or pair, and what models say of two sides is worked out and written once for each competition, season and
pair, however many fixtures the pair has; fixtures themselves only meet that table and their prices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.operators import evidence as ev
from tallyfield.operators import features as fe
from tallyfield.operators import probability as pr
from tallyfield.operators import tables as t
from tallyfield.plans import fits, logistic, walk
from tallyfield.scratch import save

c = F.col
INITIAL = fits.ELO["initial"]
HOME_POINTS = fits.ELO["home"]
#: Hours for which parameters stay fresh.
FRESH = {"elo": 6.0, "draw_base": 24.0, "margin": 24.0, "dixon_coles": 24.0}
#: Weights of the members of a pool.
LEAGUE = {"baseline": 0.4, "elo": 1.0, "dixon_coles": 1.4, "margin": 1.0, "market": 1.0, "ml": 1.2}
DUEL = {"elo": 1.0, "rank": 0.6, "margin": 0.5}
#: What a forecast depends on, but for the day and the prices.
MATCHUP = ["comp", "season", "home", "away"]


def stored(spark: SparkSession, store: str, model: str) -> DataFrame | None:
    """All versions of a model's parameters; None before the first."""
    try:
        return spark.read.parquet(f"{store}/{model}")
    except AnalysisException:
        return None


def newest(versions: DataFrame) -> DataFrame:
    """Each competition's newest version."""
    return versions.withColumn("__v", F.max("version").over(W.partitionBy("comp"))).filter("version = __v").drop("__v")


def fit_or_load(store: str, model: str, comps: DataFrame, now: float, fit: Callable[[DataFrame], DataFrame], hours: float | None = None) -> DataFrame:
    """The parameters of each competition of ``comps`` (comp): those stored less than ``hours`` before ``now`` (in days), the
    others fitted by ``fit(comps to be fitted)`` and stored as their next version.  Competitions that ``fit`` gives nothing
    for have no parameters and are tried again the next time.  Columns ``fitted_at`` and ``version`` are added."""
    spark, hours = comps.sparkSession, FRESH[model] if hours is None else hours
    old = stored(spark, store, model)
    fresh = None if old is None else newest(old).filter((F.lit(float(now)) - c("fitted_at")) * 24.0 < hours)
    stale = comps.select("comp").distinct() if fresh is None else comps.select("comp").distinct().join(fresh, "comp", "left_anti")
    stale = spark.createDataFrame(stale.collect(), comps.select("comp").schema)  # a row for each competition
    if not stale.isEmpty():
        last = None if old is None else old.groupBy("comp").agg(F.max("version").alias("last"))
        new = fit(stale).withColumn("fitted_at", F.lit(float(now)))
        new = new.withColumn("version", F.lit(1).cast("long")) if last is None else new.join(last, "comp", "left").withColumn("version", F.coalesce("last", F.lit(0)) + 1).drop("last")
        new.write.mode("append").parquet(f"{store}/{model}")
        old = stored(spark, store, model)
    return newest(old).join(comps.select("comp").distinct(), "comp", "left_semi").filter((F.lit(float(now)) - c("fitted_at")) * 24.0 < hours)


def ratings_at(matches: DataFrame, now: int, history: DataFrame | None = None) -> DataFrame:
    """comp, team, rating, games: after all finished matches before a day.  history: ``elo_days`` of them, if it is there already."""
    h = fits.elo_days(matches.filter((c("status") == "FINISHED") & (c("day") < now))) if history is None else history
    sides = F.array(F.struct(c("home").alias("team"), c("r_home").alias("rating")), F.struct(c("away").alias("team"), c("r_away").alias("rating")))
    rows = h.select("comp", "day", "event_id", F.inline(sides))
    return rows.groupBy("comp", "team").agg(F.max_by("rating", F.struct("day", "event_id")).alias("rating"), F.count("*").alias("games"))


def margin_at(matches: DataFrame, ratings: DataFrame, now: int, has_draws: bool = True) -> DataFrame:
    """comp, slope, edge, sigma, total: margins of all finished matches before a day on the ratings of that day.  Without draws
    level matches are no history."""
    done = matches.filter((c("status") == "FINISHED") & (c("day") < now) & (F.lit(has_draws) | (c("hs") != c("aws"))))
    side = lambda s: ratings.select("comp", c("team").alias(s), c("rating").alias(f"r_{s}"))
    rows = done.join(side("home"), ["comp", "home"], "left").join(side("away"), ["comp", "away"], "left").fillna(INITIAL, ["r_home", "r_away"])
    rows = rows.select("comp", (c("r_home") - c("r_away")).alias("gap"), (c("hs") - c("aws")).cast("double").alias("margin"), (c("hs") + c("aws")).cast("double").alias("total"))
    return pr.margin_fit(rows, "comp")


def baseline_at(matches: DataFrame, now: int, has_draws: bool = True, n: int = 380) -> DataFrame:
    """comp, baseline: shares of outcomes of each competition's last ``n`` finished matches before a day."""
    done = matches.filter((c("status") == "FINISHED") & (c("day") < now) & (F.lit(has_draws) | (c("hs") != c("aws")))).withColumn("o", t.outcome())
    last = done.withColumn("__k", F.row_number().over(W.partitionBy("comp").orderBy(F.desc("day"), F.desc("event_id")))).filter(c("__k") <= n)
    counts = last.groupBy("comp").agg(*(F.count_if(c("o") == o).alias(o.lower()) for o in ("HOME", "DRAW", "AWAY")))
    return counts.select("comp", t.shares_with_prior(c("home"), c("draw"), c("away"), has_draws).alias("baseline"))


def dixon_coles_at(matches: DataFrame, now: int, least: int = 30) -> DataFrame:
    """The score models of competitions with ``least`` matches before a day."""
    done = matches.filter((c("status") == "FINISHED") & (c("day") < now))
    enough = done.groupBy("comp").count().filter(c("count") >= least).select("comp")
    return fits.dixon_coles(done.join(enough, "comp", "left_semi"), now)


def _sides(x: DataFrame, table: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``x`` with columns of a table by team for its home and its away side."""
    for side in ("home", "away"):
        x = x.join(table.select(*keys, c("team").alias(side), *(c(k).alias(f"{k}_{side}") for k in cols)), [*keys, side], "left")
    return x


def matchups(fixtures: DataFrame) -> DataFrame:
    """The pairs of sides of fixtures, once for each competition and season."""
    return fixtures.select(*MATCHUP).distinct()


def with_features(pairs: DataFrame, matches: DataFrame, now: int) -> DataFrame:
    """``pairs`` (MATCHUP, r_home and r_away, and ``score``, a score model's [home, draw, away] or null) with FEATURES as of a day,
    but for the days of rest, and with the days of both sides' last matches: what the rows of finished matches have, seen from now."""
    x = _sides(pairs, t.form_at(matches, now), [], ["k", "ppg", "gdpg", "last_day"])
    for side, v in (("home", "H"), ("away", "A")):
        venue = t.form_at(matches, now, venue=v).select(c("team").alias(side), c("ppg").alias(f"venue_{side}"))
        x = x.join(venue, side, "left")
    tables = t.league_table(matches.filter((c("day") < now) | (c("status") != "FINISHED"))).select("comp", "season", "team", "position")
    tables = tables.withColumn("teams", F.count("*").over(W.partitionBy("comp", "season")))
    x = _sides(x, tables, ["comp", "season"], ["position", "teams"])
    x = x.withColumns({"one": F.least("home", "away"), "two": F.greatest("home", "away")}).join(t.meetings_at(matches, now), ["one", "two"], "left")
    ppg = lambda k: F.coalesce(c(k), F.lit(1.3))
    zero = lambda k: F.coalesce(c(k).cast("double"), F.lit(0.0))
    place = F.when(c("position_home").isNotNull() & c("position_away").isNotNull() & (c("teams_home") > 1), (c("position_away") - c("position_home")) / (c("teams_home") - 1)).otherwise(0.0)
    out = {
        "elo_diff": (c("r_home") - c("r_away")) / 400, "dc_home": F.coalesce(F.get("score", F.lit(0)), F.lit(0.45)), "dc_away": F.coalesce(F.get("score", F.lit(2)), F.lit(0.29)),
        "form_diff": ppg("ppg_home") - ppg("ppg_away"), "goals_diff": zero("gdpg_home") - zero("gdpg_away"), "home_venue": ppg("venue_home"), "away_venue": ppg("venue_away"),
        "edge": F.when(c("home") == c("one"), zero("edge")).otherwise(-zero("edge")), "place_diff": place,
        "absence_diff": zero("out_away") - zero("out_home"), "experience": F.least(zero("k_home"), zero("k_away")) / 5,
    }
    return x.withColumns(out).select(*pairs.columns, *out, "last_day_home", "last_day_away")


def absences(injuries: DataFrame) -> DataFrame:
    """team, out: players out or suspended whose injury is open (columns team, status, resolved)."""
    return injuries.filter(c("status").isin("OUT", "SUSPENDED") & c("resolved").isNull()).groupBy("team").agg(F.count("*").alias("out"))


def league_members(
    pairs: DataFrame,
    matches: DataFrame,
    now: int,
    ratings: DataFrame,
    draw_bases: DataFrame,
    score_models: DataFrame | None = None,
    margins: DataFrame | None = None,
    out: DataFrame | None = None,
) -> DataFrame:
    """What models say of each of ``pairs`` (MATCHUP) as of a day: the shares of the members that look at sides alone, expected
    scores, and ``with_features``."""
    x = _sides(pairs, ratings, ["comp"], ["rating"]).fillna(INITIAL, ["rating_home", "rating_away"]).withColumnsRenamed({"rating_home": "r_home", "rating_away": "r_away"})
    x = x.join(draw_bases.select("comp", "draw_base"), "comp", "left").join(baseline_at(matches, now), "comp", "left")
    x = x.withColumn("baseline", F.coalesce("baseline", t.shares_with_prior(F.lit(0), F.lit(0), F.lit(0))))
    x = x.withColumn("elo", pr.elo_probs(c("r_home") + HOME_POINTS - c("r_away"), F.coalesce("draw_base", F.lit(0.28))))
    null = F.lit(None).cast("array<double>")
    if score_models is not None:
        x = walk.score_shares(x, score_models, ["comp"])
    else:
        x = x.withColumns({"dixon_coles": null, "lam": F.lit(None).cast("double"), "mu": F.lit(None).cast("double")})
    if margins is not None:
        x = x.join(margins.select("comp", "slope", "edge", "sigma", "total"), "comp", "left")
        mean = c("edge") + c("slope") * (c("r_home") - c("r_away"))
        shares = F.when(c("dixon_coles").isNull() & c("sigma").isNotNull(), pr.margin_probs(mean, c("sigma")))
        x = x.withColumns({"margin": shares, "exp_home": F.coalesce("lam", (c("total") + mean) / 2), "exp_away": F.coalesce("mu", (c("total") - mean) / 2)}).drop("slope", "edge", "sigma", "total")
    else:
        x = x.withColumns({"margin": null, "exp_home": c("lam"), "exp_away": c("mu")})
    x = _sides(x, out, [], ["out"]) if out is not None else x.withColumns({"out_home": F.lit(0), "out_away": F.lit(0)})
    x = with_features(x.withColumn("score", F.coalesce("dixon_coles", "margin")), matches, now)
    return x.select(*MATCHUP, "baseline", "elo", "dixon_coles", "margin", "exp_home", "exp_away", *(k for k in fe.FEATURES if k != "rest_diff"), "last_day_home", "last_day_away")


def pooled(fixtures: DataFrame, members: DataFrame, market: DataFrame | None = None, model: DataFrame | None = None, weights: dict[str, float] = LEAGUE, temperature: float = 1.0) -> DataFrame:
    """Each fixture (event_id, day and MATCHUP) with its pair's row of ``members``, a written table of ``league_members`` and columns of
    any more, and with ``rest_diff``, market, ml, ensemble, confidence and factors, as ``league_forecasts`` has them."""
    null = F.lit(None).cast("array<double>")
    x = fixtures.select("event_id", "day", *MATCHUP)
    x = x.join(market.select("event_id", "market"), "event_id", "left") if market is not None else x.withColumn("market", null)
    own = members.withColumnsRenamed({k: f"__{k}" for k in MATCHUP})
    same = [c(k).eqNullSafe(c(f"__{k}")) for k in MATCHUP]
    x = x.join(own, same[0] & same[1] & same[2] & same[3], "left").drop(*(f"__{k}" for k in MATCHUP))
    rest = lambda s: F.when(c(f"last_day_{s}").isNull(), 7.0).otherwise(f.clamp((c("day") - c(f"last_day_{s}")).cast("double"), 1.0, 14.0))
    x = x.withColumn("rest_diff", rest("home") - rest("away"))
    if model is not None:
        x = x.crossJoin(F.broadcast(model.select("mean", "sd", "weights")))  # one row
        x = x.withColumns({"ml": logistic.probs(F.array(*fe.FEATURES), c("mean"), c("sd"), c("weights")), "parts": logistic.contributions(F.array(*fe.FEATURES), c("mean"), c("sd"), c("weights"))})
    else:
        x = x.withColumn("ml", null)
    x = x.withColumn("ensemble", f.clip_probs(f.temper(pr.blend([(c(m), F.lit(w)) for m, w in weights.items()]), F.lit(temperature))))
    factors = logistic.factors(c("parts"), fe.FEATURES, F.get("ensemble", F.lit(0))) if model is not None else fe.top_factors(HOME_POINTS)
    return x.withColumns({"confidence": pr.confidence(c("ensemble"), F.lit(1.0)), "factors": factors})


def league_forecasts(
    fixtures: DataFrame,
    matches: DataFrame,
    now: int,
    ratings: DataFrame,
    draw_bases: DataFrame,
    score_models: DataFrame | None = None,
    margins: DataFrame | None = None,
    market: DataFrame | None = None,
    out: DataFrame | None = None,
    model: DataFrame | None = None,
    weights: dict[str, float] = LEAGUE,
    temperature: float = 1.0,
) -> DataFrame:
    """A row for each fixture (event_id, comp, season, day, home, away): the shares of all members ([home, draw, away], null where
    a member has nothing to say), their pool after temperature and clip (``ensemble``), its confidence, expected scores, and
    the largest factors.

    ratings: comp, team, rating; draw_bases: comp, draw_base; score_models: as ``fits.dixon_coles``; margins: as ``margin_at``, for
    competitions without a score model; market: event_id, market; out: team, out; model: one row of ``logistic.fit`` over
    FEATURES, whose contributions then stand in for the factors of given sizes."""
    members = save(league_members(matchups(fixtures), matches, now, ratings, draw_bases, score_models, margins, out), "members")
    return pooled(fixtures, members, market, model, weights, temperature).select("event_id", "comp", *weights, "ensemble", "confidence", "exp_home", "exp_away", "factors")


def duel_forecasts(fixtures: DataFrame, matches: DataFrame, now: int, ratings: DataFrame, ranks: DataFrame, margins: DataFrame, served: DataFrame, beta: float = 0.4, weights: dict[str, float] = DUEL, temperature: float = 1.0) -> DataFrame:
    """A row for each fixture of a sport of players without draws: the members' [home, away], the pool after temperature, clip and
    tie-break, the favourite and why, the evidence and the confidence.

    Ratings are drawn towards the rating a published rank stands for, the more the fewer games there are; ranks: team, rank.
    served: players with serve statistics."""
    history = matches.filter((c("status") == "FINISHED") & (c("day") < now) & (c("hs") != c("aws")))
    x = fixtures.select("event_id", "comp", "season", "day", "home", "away")
    x = _sides(_sides(x, ratings, ["comp"], ["rating", "games"]), ranks, [], ["rank"])
    x = _sides(x, t.team_rows(history).groupBy("team").agg(F.count("*").alias("seen")), [], ["seen"]).fillna(0, ["seen_home", "seen_away"])
    x = _sides(x, served.select("team", F.lit(True).alias("serve")).distinct(), [], ["serve"]).fillna(False, ["serve_home", "serve_away"])
    seed = lambda s: pr.rating_of_rank(c(f"rank_{s}"), beta)
    seeded = lambda s: F.when(c(f"rating_{s}").isNull(), F.coalesce(seed(s), F.lit(INITIAL))).otherwise(pr.seeded_rating(c(f"rating_{s}"), seed(s), c(f"games_{s}")))
    two = lambda p: F.array(p, 1.0 - p)
    gap = F.coalesce("rating_home", F.lit(INITIAL)) - F.coalesce("rating_away", F.lit(INITIAL))
    x = x.join(margins.select("comp", "slope", "edge", "sigma"), "comp", "left")
    rank = pr.rank_prob(c("rank_home"), c("rank_away"), beta)
    margin = F.get(pr.margin_probs(c("edge") + c("slope") * gap, c("sigma"), False), F.lit(0))
    x = x.withColumns({
        "elo": two(pr.elo_expected(seeded("home") + HOME_POINTS - seeded("away"))), "rank": F.when(rank.isNotNull(), two(rank)), "margin": F.when(c("sigma").isNotNull(), two(margin)),
    }).drop("slope", "edge", "sigma")
    x = x.withColumn("pool", f.clip_probs(f.temper(pr.blend([(c(m), F.lit(w)) for m, w in weights.items()], 2), F.lit(temperature))))
    x = _sides(x, t.form_at(history, now, 10), [], ["ppg"])
    x = x.withColumns({"one": F.least("home", "away"), "two": F.greatest("home", "away")}).join(t.meetings_at(history, now), ["one", "two"], "left")
    edge = F.coalesce(F.when(c("home") == c("one"), c("edge")).otherwise(-c("edge")), F.lit(0.0))
    form = lambda s: F.coalesce(c(f"ppg_{s}"), F.lit(1.3)) / 3
    p = lambda k: F.get("pool", F.lit(k))
    tie = ev.break_tie(p(0), p(1), (c("home"), c("away")), (c("rank_home"), c("rank_away")), (form("home"), form("away")), edge, (c("seen_home"), c("seen_away")))
    proof = ev.evidence(c("seen_home"), c("seen_away"), c("rank_home").isNotNull(), c("rank_away").isNotNull(), c("serve_home"), c("serve_away"))
    x = x.withColumns({"tie": tie, "proof": proof}).withColumn("ensemble", F.array("tie.home", "tie.away"))
    return x.select("event_id", "comp", *weights, "ensemble", "tie.favourite", "tie.reason", c("proof.level").alias("evidence"), pr.confidence(c("ensemble"), c("proof.factor"), 2).alias("confidence"))


def due(fixtures: DataFrame, versions: DataFrame, now: Column, horizon: int = 14 * 1440, lineup: int = 60) -> DataFrame:
    """The fixtures that a pass forecasts: scheduled, of a followed competition, from an hour ago (minutes before the start:
    ``starts - now``) to the horizon, without a version yet or with a newest one from before the stage they are in: a day,
    or the line-ups.  fixtures: event_id, starts (minutes), status, followed; versions: event_id, version, minutes_before."""
    last = versions.groupBy("event_id").agg(F.max_by("minutes_before", "version").alias("before"), F.max("version").alias("version"))
    left = c("starts") - now
    x = fixtures.filter((c("status") == "SCHEDULED") & c("followed") & left.between(-60, horizon)).join(last, "event_id", "left")
    stage = F.when(left <= lineup, 2).when(left <= 1440, 1).otherwise(0)
    limit = F.when(stage == 2, lineup).when(stage == 1, 1440)
    again = (stage > 0) & (c("before").isNull() | (c("before") > limit))
    return x.filter(c("version").isNull() | again).select("event_id", stage.alias("stage"), (F.coalesce("version", F.lit(0)) + 1).alias("version"), left.alias("minutes_before"))
