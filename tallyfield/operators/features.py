"""What the feature model learns from: form, rest, meetings, table positions and ratings before each match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.operators.tables import form_before, head_to_head, recent_form, rest_days, team_rows, with_meetings

c = F.col
#: The features, in order.
FEATURES = ["elo_diff", "dc_home", "dc_away", "form_diff", "goals_diff", "home_venue", "away_venue", "rest_diff", "edge", "place_diff", "absence_diff", "experience"]


def positions_before(matches: DataFrame) -> DataFrame:
    """comp, season, day, team, position, teams: the table before each day that has matches.

    Points and goals are summed by team and day, then carried forward over the season's days, so the grid has a row for
    each team and day, however many matches there are."""
    rows = team_rows(matches).withColumn("done", c("status") == "FINISHED")
    won = F.when(c("scored") > c("conceded"), 3).when(c("scored") == c("conceded"), 1).otherwise(0)
    on = lambda x: F.coalesce(F.sum(F.when(c("done"), x)), F.lit(0))
    daily = rows.groupBy("comp", "season", "day", "team").agg(on(won).alias("points"), on(c("scored") - c("conceded")).alias("diff"), on(c("scored")).alias("scored"))
    grid = daily.select("comp", "season", "day").distinct().join(daily.select("comp", "season", "team").distinct(), ["comp", "season"])
    before = W.partitionBy("comp", "season", "team").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    cols = ["points", "diff", "scored"]
    run = grid.join(daily, ["comp", "season", "day", "team"], "left").select("comp", "season", "day", "team", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in cols))
    day = W.partitionBy("comp", "season", "day")
    place = F.row_number().over(day.orderBy(*(F.desc(x) for x in cols), "team"))
    return run.select("comp", "season", "day", "team", place.alias("position"), F.count("*").over(day).alias("teams"))


def venue_form(matches: DataFrame, n: int = 5, period: str = "day") -> DataFrame:
    """event_id, team, venue, vppg: points per game over the last ``n`` matches at the same venue."""
    return recent_form(matches, n, by_venue=True, period=period).select("event_id", "team", "venue", c("ppg").alias("vppg"))


def features(matches: DataFrame, given: DataFrame, period: str = "day", table: bool = True) -> DataFrame:
    """event_id and FEATURES for each finished match of ``matches``.

    given: event_id, r_home, r_away (ratings before the match), p_home, p_away (a score model's shares, 0.45 and 0.29 where
    null), out_home, out_away (players out).  period: a column that stands for the day when only matches of earlier periods
    are to be seen; without the table all places are unknown."""
    form, venue = recent_form(matches, period=period), venue_form(matches, period=period)
    places = positions_before(matches) if table else None
    x = matches.filter("status = 'FINISHED'").select("event_id", "comp", "season", "day", "home", "away").join(given, "event_id")
    for side, v in (("home", "H"), ("away", "A")):
        fo = form.filter(c("venue") == v).select("event_id", *(c(k).alias(f"{k}_{side}") for k in ("k", "ppg", "gdpg", "rest")))
        ve = venue.filter(c("venue") == v).select("event_id", c("vppg").alias(f"vppg_{side}"))
        x = x.join(fo, "event_id").join(ve, "event_id")
        if places is None:
            x = x.withColumn(f"position_{side}", F.lit(None).cast("int"))
        else:
            pl = places.select("comp", "season", "day", c("team").alias(side), c("position").alias(f"position_{side}"), "teams")
            x = x.join(pl if side == "home" else pl.drop("teams"), ["comp", "season", "day", side])
    x = x if table else x.withColumn("teams", F.lit(0))
    return x.join(head_to_head(matches, period=period), "event_id").select("event_id", *_columns())


def period_features(rows: DataFrame, matches: DataFrame, period: str) -> DataFrame:
    """``rows`` with FEATURES, all places unknown: what ``features`` says of finished matches, looked up by team or pair and period.

    rows: home, away, day, the period and what ``given`` has there, for any number of matches each; what is joined is
    bounded by teams, pairs and periods."""
    form, venue = form_before(matches, period=period), form_before(matches, by_venue=True, period=period)
    x = with_meetings(rows, matches, period=period)
    for side, v in (("home", "H"), ("away", "A")):
        x = x.join(form.select(period, c("team").alias(side), *(c(k).alias(f"{k}_{side}") for k in ("k", "ppg", "gdpg", "prev"))), [period, side])
        x = x.withColumn(f"rest_{side}", rest_days(c("day"), c(f"prev_{side}")))
        x = x.join(venue.filter(c("venue") == v).select(period, c("team").alias(side), c("ppg").alias(f"vppg_{side}")), [period, side])
    x = x.withColumns({"position_home": F.lit(None).cast("int"), "position_away": F.lit(None).cast("int"), "teams": F.lit(0)})
    return x.select(*rows.columns, *_columns())


def _columns() -> list[Column]:
    return [
        ((c("r_home") - c("r_away")) / 400).alias("elo_diff"), F.coalesce("p_home", F.lit(0.45)).alias("dc_home"), F.coalesce("p_away", F.lit(0.29)).alias("dc_away"),
        (c("ppg_home") - c("ppg_away")).alias("form_diff"), (c("gdpg_home") - c("gdpg_away")).alias("goals_diff"), c("vppg_home").alias("home_venue"), c("vppg_away").alias("away_venue"),
        (c("rest_home") - c("rest_away")).cast("double").alias("rest_diff"), "edge",
        F.when(c("teams") > 1, (c("position_away") - c("position_home")) / (c("teams") - 1)).otherwise(0.0).alias("place_diff"),
        (c("out_away") - c("out_home")).cast("double").alias("absence_diff"), (F.least("k_home", "k_away") / 5).alias("experience"),
    ]


def top_factors(home_advantage: float, n: int = 7, least: float = 0.3) -> Column:
    """The ``n`` largest effects of a row of features on the home side, in points with one digit: an array of (key, effect),
    by size, then in the order given here.  Effects under ``least`` don't count."""
    # fixed values: points for each unit of a feature
    sizes = [
        ("rating", c("elo_diff") * 400 * 0.09), ("home", F.lit(home_advantage * 0.09)), ("form", c("form_diff") * 2.5), ("venue", (c("home_venue") - c("away_venue")) * 1.2),
        ("rest", c("rest_diff") * 0.4), ("h2h", c("edge") * 2.0), ("absences", c("absence_diff") * 1.5), ("table", c("place_diff") * 3.0),
    ]
    each = F.array(*(F.struct((-F.abs(f.half_up(x, 1))).alias("size"), F.lit(k).alias("at"), F.lit(key).alias("key"), f.half_up(x, 1).alias("effect"), x.alias("raw")) for k, (key, x) in enumerate(sizes)))
    kept = F.slice(F.array_sort(F.filter(each, lambda x: F.abs(x.raw) >= least)), 1, n)
    return F.transform(kept, lambda x: F.struct(x.key.alias("key"), x.effect.alias("effect")))
