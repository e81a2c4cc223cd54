"""League tables, championship and ranking tables, and what is read from finished matches in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def team_rows(matches: DataFrame) -> DataFrame:
    """A row for each side of a match, in one pass: team, opponent, venue, scored, conceded, and the match's columns."""
    sides = F.array(
        F.struct(c("home").alias("team"), c("away").alias("opponent"), F.lit("H").alias("venue"), c("hs").alias("scored"), c("aws").alias("conceded")),
        F.struct(c("away").alias("team"), c("home").alias("opponent"), F.lit("A").alias("venue"), c("aws").alias("scored"), c("hs").alias("conceded")),
    )
    keep = [x for x in matches.columns if x not in ("home", "away", "hs", "aws")]
    return matches.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.*")


def letter() -> Column:
    return F.when(c("scored") > c("conceded"), "W").when(c("scored") < c("conceded"), "L").otherwise("D")


def league_table(matches: DataFrame, win: int = 3, draw: int = 1, loss: int = 0) -> DataFrame:
    """A table for each competition and season: played, won, drawn, lost, scored, conceded, points, position and the last
    five results, oldest first.  Teams that only have matches to come are listed with zeros; order: points, goal
    difference, goals, team."""
    rows = team_rows(matches).withColumn("done", c("status") == "FINISHED").withColumn("r", letter())
    n = lambda x: F.count_if(c("done") & x)
    sums = rows.groupBy("comp", "season", "team").agg(
        n(F.lit(True)).alias("played"),
        n(c("r") == "W").alias("won"),
        n(c("r") == "D").alias("drawn"),
        n(c("r") == "L").alias("lost"),
        F.coalesce(F.sum(F.when(c("done"), c("scored"))), F.lit(0)).alias("scored"),
        F.coalesce(F.sum(F.when(c("done"), c("conceded"))), F.lit(0)).alias("conceded"),
    )
    last = W.partitionBy("comp", "season", "team").orderBy(F.desc("day"), F.desc("event_id"))
    recent = rows.filter("done").withColumn("k", F.row_number().over(last)).filter("k <= 5")
    form = recent.groupBy("comp", "season", "team").agg(F.array_sort(F.collect_list(F.struct((-c("k")).alias("k"), "r"))).alias("rs"))
    form = form.select("comp", "season", "team", F.array_join(c("rs.r"), "").alias("form"))
    out = sums.join(form, ["comp", "season", "team"], "left").fillna("", ["form"])
    out = out.withColumn("points", c("won") * win + c("drawn") * draw + c("lost") * loss)
    place = W.partitionBy("comp", "season").orderBy(F.desc("points"), F.desc(c("scored") - c("conceded")), F.desc("scored"), "team")
    return out.withColumn("position", F.row_number().over(place))


def table_as_of(matches: DataFrame, day: int) -> DataFrame:
    """The tables of matches strictly before a day."""
    return league_table(matches.filter(c("day") < day))


def zones(tables: DataFrame) -> DataFrame:
    """The zone of each row of a table of ten teams or more: top 4, 3 or 2, bottom 3 or 2."""
    n = F.count("*").over(W.partitionBy("comp", "season"))
    top = F.when(n >= 16, 4).when(n >= 12, 3).otherwise(2)
    bottom = F.when(n >= 18, 3).otherwise(2)
    zone = F.when(n < 10, F.lit(None)).when(c("position") <= top, "TOP").when(c("position") > n - bottom, "BOTTOM")
    return tables.withColumn("zone", zone)


def championship_table(races: DataFrame, points: list[int]) -> DataFrame:
    """Points by finishing place (``points[0]`` for the first), wins, podiums and retirements of each season.  Places
    beyond 20 count as retirements."""
    scored = F.coalesce(F.get(F.array(*(F.lit(x) for x in points)), c("position") - 1), F.lit(0))
    sums = races.groupBy("season", "team").agg(
        F.sum(scored).cast("long").alias("points"),
        F.count_if(c("position") == 1).alias("wins"),
        F.count_if(c("position") <= 3).alias("podiums"),
        F.count_if(c("position") > 20).alias("retired"),
        F.count("*").alias("starts"),
    )
    w = W.partitionBy("season").orderBy(F.desc("points"), F.desc("wins"), F.desc("podiums"), "team")
    return sums.withColumn("position", F.row_number().over(w))


def latest_ranks(ratings: DataFrame, day: int | None = None, lookback: int | None = None) -> DataFrame:
    """The newest value of each team, of those up to a day and not older than ``lookback`` days."""
    if day is not None:
        ratings = ratings.filter((c("as_of") <= day) & (c("as_of") >= day - lookback if lookback is not None else F.lit(True)))
    return ratings.groupBy("team").agg(F.max_by("value", F.struct("as_of", "id")).alias("rank"), F.max("as_of").alias("as_of"))


def ranking_table(matches: DataFrame, ratings: DataFrame) -> DataFrame:
    """Each season's players: played and won, with the newest rank; no rank comes last, then more wins first."""
    rows = team_rows(matches.filter("status = 'FINISHED'"))
    sums = rows.groupBy("season", "team").agg(F.count("*").alias("played"), F.count_if(c("scored") > c("conceded")).alias("won"))
    out = sums.join(latest_ranks(ratings).select("team", "rank"), "team", "left")
    w = W.partitionBy("season").orderBy(F.asc_nulls_last("rank"), F.desc("won"), "team")
    return out.withColumn("position", F.row_number().over(w))


def outcome(home: str = "hs", away: str = "aws") -> Column:
    return F.when(c(home) > c(away), "HOME").when(c(home) < c(away), "AWAY").otherwise("DRAW")


def shares_with_prior(home: Column, draw: Column, away: Column, has_draws: bool = True, prior: float = 40.0) -> Column:
    """[home, draw, away] of counts, drawn towards a prior that counts as so many matches; without draws level matches count
    towards the number of matches only, and both sides' shares sum to 1."""
    n = home + draw + away + prior
    # fixed values: the shares of the prior
    if has_draws:
        return F.array((home + prior * 0.45) / n, (draw + prior * 0.26) / n, (away + prior * 0.29) / n)
    h, a = (home + prior * 0.57) / n, (away + prior * 0.43) / n
    return F.array(h / (h + a), F.lit(0.0), a / (h + a))


def outcome_frequencies(matches: DataFrame, prior: float = 40.0, share: tuple[float, float, float] = (0.45, 0.26, 0.29)) -> DataFrame:
    """The shares of outcomes of each competition, drawn towards a prior that counts as so many matches."""
    done = matches.filter("status = 'FINISHED'").withColumn("o", outcome())
    n = F.count("*")
    each = [((F.count_if(c("o") == o) + prior * s) / (n + prior)).alias(o.lower()) for o, s in zip(("HOME", "DRAW", "AWAY"), share)]
    return done.groupBy("comp").agg(n.alias("n"), *each)


def history(matches: DataFrame, stats: DataFrame, before: int) -> DataFrame:
    """Finished matches before a day, with both sides' statistics where there are any."""
    side = lambda s, p: stats.filter(c("side") == s).select("event_id", c("shots").alias(f"{p}_shots"), c("lines").alias(f"{p}_lines"))
    done = matches.filter((c("status") == "FINISHED") & (c("day") < before))
    return done.join(side("HOME", "home"), "event_id", "left").join(side("AWAY", "away"), "event_id", "left")


def _last_before(rows: DataFrame, keys: list[str], cols: list[str], n: int, period: str = "day") -> DataFrame:
    """For each period of the keys: ``last``, the last ``n`` rows of the periods before, newest first, and ``prev``, the day of
    the last such row.  No more than ``n`` rows of a period are carried, so a row costs what it uses, however long the
    history is."""
    newest = W.partitionBy(*keys, period).orderBy(F.desc("day"), F.desc("event_id"))
    few = rows.withColumn("__k", F.row_number().over(newest)).filter(c("__k") <= n)
    of_period = few.groupBy(*keys, period).agg(F.array_sort(F.collect_list(F.struct("__k", *cols))).alias("__rows"), F.max("day").alias("__end"))
    periods = W.partitionBy(*keys).orderBy(period)
    past = F.slice(F.flatten(F.reverse(F.collect_list("__rows").over(periods.rowsBetween(-n, -1)))), 1, n)
    return of_period.select(*keys, period, past.alias("last"), F.lag("__end").over(periods).alias("prev"))


def _points(last: Column) -> Column:
    return F.aggregate(last, F.lit(0), lambda s, x: s + F.when(x.scored > x.conceded, 3).when(x.scored == x.conceded, 1).otherwise(0))


def _difference(last: Column) -> Column:
    return F.aggregate(last, F.lit(0), lambda s, x: s + (x.scored - x.conceded))


def recent_form(matches: DataFrame, n: int = 5, by_venue: bool = False, period: str = "day") -> DataFrame:
    """Of each side of each match: points per game and goal difference per game over its last ``n`` matches before that
    day (1.3 and 0 without any), days of rest (1 to 14, 7 without a match before); on request only of those at the same
    venue.  period: a column that stands for the day when only matches of earlier periods are to be seen."""
    rows = team_rows(matches.filter("status = 'FINISHED'"))
    past = form_before(matches, n, by_venue, period)
    return rows.join(past, ["team", *(["venue"] if by_venue else []), period]).select("event_id", "team", "venue", "k", "ppg", "gdpg", rest_days(c("day"), c("prev")).alias("rest"))


def form_before(matches: DataFrame, n: int = 5, by_venue: bool = False, period: str = "day") -> DataFrame:
    """What ``recent_form`` says of each team (and venue) and period with matches, and ``prev``, the day of its last match before."""
    keys = ["team", "venue"] if by_venue else ["team"]
    past = _last_before(team_rows(matches.filter("status = 'FINISHED'")), keys, ["scored", "conceded"], n, period)
    past = past.select(*keys, period, "prev", F.size("last").alias("k"), _points(c("last")).alias("p"), _difference(c("last")).alias("d"))
    return past.select(
        *keys, period, "prev", "k",
        F.when(c("k") > 0, c("p") / c("k")).otherwise(1.3).alias("ppg"),
        F.when(c("k") > 0, c("d") / c("k")).otherwise(0.0).alias("gdpg"),
    )


def rest_days(day: Column, prev: Column) -> Column:
    return F.when(prev.isNull(), 7).otherwise(F.least(F.greatest(day - prev, F.lit(1)), F.lit(14)))


def form_at(matches: DataFrame, now: int, n: int = 5, venue: str | None = None) -> DataFrame:
    """team, k, ppg, gdpg, last_day: the form of each team that has played before a day; its last match's day."""
    rows = team_rows(matches.filter((c("status") == "FINISHED") & (c("day") < now)))
    rows = rows if venue is None else rows.filter(c("venue") == venue)
    newest = W.partitionBy("team").orderBy(F.desc("day"), F.desc("event_id"))
    few = rows.withColumn("__k", F.row_number().over(newest)).filter(c("__k") <= n)
    past = few.groupBy("team").agg(F.collect_list(F.struct("scored", "conceded")).alias("last"), F.max("day").alias("last_day"))
    k = F.size("last")
    return past.select("team", k.alias("k"), (_points(c("last")) / k).alias("ppg"), (_difference(c("last")) / k).alias("gdpg"), "last_day")


def _sides_in_order(matches: DataFrame) -> DataFrame:
    return matches.withColumns({"one": F.least("home", "away"), "two": F.greatest("home", "away")})


def _won_by_one() -> Column:
    return F.signum((c("hs") - c("aws")).cast("double")) * F.when(c("home") == c("one"), 1.0).otherwise(-1.0)


def head_to_head(matches: DataFrame, n: int = 6, period: str = "day") -> DataFrame:
    """Of each match the balance of the last ``n`` meetings of the two sides before that day (or period), seen from the home
    side."""
    done = matches.filter("status = 'FINISHED'")
    return with_meetings(done, done, n, period).select("event_id", "met", "edge")


def with_meetings(rows: DataFrame, matches: DataFrame, n: int = 6, period: str = "day") -> DataFrame:
    """``rows`` (home, away and the period, of matches that are finished) with ``met`` and ``edge`` of ``head_to_head``."""
    done = _sides_in_order(matches.filter("status = 'FINISHED'"))
    past = _last_before(done.withColumn("won", _won_by_one()), ["one", "two"], ["won"], n, period)
    past = past.select("one", "two", period, F.size("last").alias("k"), F.aggregate("last", F.lit(0.0), lambda s, x: s + x.won).alias("total"))
    edge = c("total") * F.when(c("home") == c("one"), 1.0).otherwise(-1.0) / c("k")
    both = _sides_in_order(rows).join(past, ["one", "two", period])
    return both.select(*rows.columns, c("k").alias("met"), F.when(c("k") > 0, edge).otherwise(0.0).alias("edge"))


def meetings_at(matches: DataFrame, now: int, n: int = 6) -> DataFrame:
    """one, two, met, edge: the balance of the last ``n`` meetings of two sides before a day, seen from the smaller id."""
    done = _sides_in_order(matches.filter((c("status") == "FINISHED") & (c("day") < now)))
    newest = W.partitionBy("one", "two").orderBy(F.desc("day"), F.desc("event_id"))
    few = done.withColumn("won", _won_by_one()).withColumn("__k", F.row_number().over(newest)).filter(c("__k") <= n)
    return few.groupBy("one", "two").agg(F.count("*").alias("met"), F.avg("won").alias("edge"))


def trailing_baseline(matches: DataFrame, n: int = 380, days: bool = False) -> DataFrame:
    """Counts of outcomes over the ``n`` matches of the competition before each match, in order.

    Each match gets its place in the competition and the counts of all before it, from sums by day and an order within
    the day; the counts ``n`` places earlier are joined by place and taken off.  No task has a whole competition."""
    done = matches.filter("status = 'FINISHED'").withColumn("o", outcome())
    names = {"HOME": "home", "DRAW": "draw", "AWAY": "away"}
    one = {v: (c("o") == k).cast("long") for k, v in names.items()} | {"place": F.lit(1).cast("long")}
    daily = done.groupBy("comp", "day").agg(*(F.sum(x).alias(k) for k, x in one.items()))
    before = W.partitionBy("comp").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    daily = daily.select("comp", "day", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}0") for k in one))
    earlier = W.partitionBy("comp", "day").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    upto = [(c(f"{k}0") + F.coalesce(F.sum(x).over(earlier), F.lit(0))).alias(k) for k, x in one.items()]
    rows = done.join(daily, ["comp", "day"]).select("event_id", "comp", "day", *upto)
    old = rows.select("comp", (c("place") + n).alias("place"), *(c(v).alias(f"{v}0") for v in names.values()))
    counts = [(c(v) - F.coalesce(f"{v}0", F.lit(0))).alias(v) for v in names.values()]
    out = rows.join(old, ["comp", "place"], "left")
    return out.select("event_id", "comp", *(["day"] if days else []), F.floor(c("day") / 7).cast("int").alias("chunk"), *counts)
