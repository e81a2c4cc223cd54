"""Nested documents of race seasons, scoreboards and cricket series as tables.

Documents are read with an explicit schema and taken apart inside Catalyst.  What a document says in several places (pages,
days) is one row: parts of a race are put together, a match that stands on several boards counts where it came first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col
DRIVER = "struct<driverId: string, givenName: string, familyName: string>"
RACES_JSON = (
    "MRData struct<RaceTable: struct<Races: array<struct<season: string, round: string, raceName: string, date: string, time: string, Circuit: struct<circuitName: string>, "
    f"Results: array<struct<grid: string, position: string, points: string, status: string, Driver: {DRIVER}>>, QualifyingResults: array<struct<position: string, Driver: {DRIVER}>>>>>>"
)
DRIVERS_JSON = f"MRData struct<DriverTable: struct<season: string, Drivers: array<{DRIVER}>>>"
HOUR = 3600


def races(pages: DataFrame, col: str = "json", page: str = "page") -> DataFrame:
    """season, round and what the pages of a listing say of each race: name, starts, venue, results and qualifying, put together
    in the order of pages where a race is split over several."""
    r = pages.select(c(page).alias("page"), F.posexplode(F.from_json(c(col), RACES_JSON).MRData.RaceTable.Races).alias("at", "r"))
    many = lambda k: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "at", c(f"r.{k}").alias("x")))), lambda s: F.coalesce(s.x, F.array().cast(r.select(f"r.{k}").schema[0].dataType))))
    first = lambda x: F.min_by(x, F.struct("page", "at"))
    starts = F.try_to_timestamp(F.concat(c("r.date"), F.lit("T"), F.coalesce("r.time", F.lit("14:00:00Z"))))
    return r.filter("r.season is not null and r.round is not null").groupBy(c("r.season").alias("season"), F.expr("try_cast(r.round as int)").alias("round")).agg(
        first(c("r.raceName")).alias("name"), first(starts).alias("starts"), first(c("r.Circuit.circuitName")).alias("venue"), many("Results").alias("results"), many("QualifyingResults").alias("qualifying")
    )


def race_entrants(schedule: DataFrame, results: DataFrame, qualifying: DataFrame, drivers: DataFrame, now: Column) -> DataFrame:
    """A row for each entrant of each race on the schedule: season, round, name, starts, status, driver, grid, position, points,
    note.

    The first three are pages (page, json), drivers are documents (json).  A race with results has these; else its grid as
    qualified; else those who started in the season's latest race with results, for the season's list has substitutes too;
    else that list.  Rounds that the schedule lacks are left out.  A grid place of 0 is none.  A race is finished with
    results, live up to three hours after its start without."""
    said = races(results).select("season", "round", "results").filter(F.size("results") > 0)
    ranked = races(qualifying).select("season", "round", "qualifying")
    d = F.from_json(c("json"), DRIVERS_JSON).MRData.DriverTable
    listed = drivers.select(d.season.alias("season"), d.Drivers.driverId.alias("listed")).filter("season is not null").groupBy("season").agg(F.flatten(F.collect_list("listed")).alias("listed"))
    latest = said.groupBy("season").agg(F.max_by(F.transform("results", lambda r: r.Driver.driverId), "round").alias("started"))
    x = races(schedule).drop("results", "qualifying").join(said, ["season", "round"], "left").join(ranked, ["season", "round"], "left").join(latest, "season", "left").join(listed, "season", "left")
    n = lambda v, kind: v.try_cast(kind)
    positive = lambda v: F.when(v > 0, v)
    row = lambda driver, grid, place, points, note: F.struct(driver.alias("driver"), grid.cast("int").alias("grid"), place.cast("int").alias("position"), points.cast("double").alias("points"), note.cast("string").alias("note"))
    none = F.lit(None)
    finished = F.transform("results", lambda r: row(r.Driver.driverId, positive(n(r.grid, "int")), n(r.position, "int"), n(r.points, "double"), r.status))
    grid = F.transform("qualifying", lambda q: row(q.Driver.driverId, n(q.position, "int"), none, none, none))
    entry = F.transform(F.coalesce("started", "listed"), lambda who: row(who, none, none, none, none))
    age = F.unix_seconds(now) - F.unix_seconds("starts")
    status = F.when(c("results").isNotNull(), "FINISHED").when((age >= 0) & (age <= 3 * HOUR), "LIVE").otherwise("SCHEDULED")
    entrants = F.when(c("results").isNotNull(), finished).when(F.size(F.coalesce("qualifying", F.array())) > 0, grid).otherwise(entry)
    return x.select("season", "round", "name", "starts", status.alias("status"), F.inline(entrants))


BOARD_JSON = (
    "events array<struct<id: string, name: string, season: struct<year: int>, groupings: array<struct<grouping: struct<slug: string, displayName: string>, competitions: array<struct<id: string, date: string, "
    "status: struct<type: struct<state: string, completed: boolean, name: string>>, format: struct<regulation: struct<periods: int>>, "
    "competitors: array<struct<id: string, winner: boolean, athlete: struct<displayName: string, fullName: string>, linescores: array<struct<value: int, winner: boolean>>>>>>>>>>"
)


def board_matches(days: DataFrame, col: str = "json", day: str = "day") -> DataFrame:
    """Singles matches of daily boards (day, json): id, season, round, starts, status, home, away, best_of, hs, aws (sets),
    games_home, games_away, winner.

    A match that several days show is the one that came first.  Sides stand in the order of names.  Doubles and matches
    without two named players are left out.  A finished match is won by who is marked so, else by sets; without a winner
    it has no scores, nor has one that has not begun."""
    e = days.select(c(day).alias("day"), F.posexplode(F.from_json(c(col), BOARD_JSON).events).alias("i", "e"))
    g = e.select("day", "i", "e", F.posexplode("e.groupings").alias("j", "g")).filter(c("g.grouping.slug").contains("singles"))
    m = g.select("day", "i", "j", c("e.name").alias("name"), c("e.season.year").alias("year"), c("g.grouping.displayName").alias("label"), F.posexplode("g.competitions").alias("k", "m"))
    player = lambda x: F.coalesce(x.athlete.displayName, x.athlete.fullName)
    both = F.transform("m.competitors", lambda x: F.struct(player(x).alias("name"), F.coalesce(x.winner, F.lit(False)).alias("won"), F.size(F.filter(F.coalesce(x.linescores, F.array()), lambda s: F.coalesce(s.winner, F.lit(False)))).alias("sets"), F.aggregate(F.coalesce(x.linescores, F.array()), F.lit(0), lambda t, s: t + F.coalesce(s.value, F.lit(0))).alias("games")))
    ok = m.filter(F.size("m.competitors") == 2).withColumn("b", both).filter(F.forall("b", lambda x: x.getField("name").isNotNull() & (x.getField("name") != "")))
    ok = ok.withColumn("__k", F.row_number().over(W.partitionBy("m.id").orderBy("day", "i", "j", "k"))).filter("__k = 1")
    one, two = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    first = F.collate(one.getField("name"), "UNICODE") <= F.collate(two.getField("name"), "UNICODE")
    t = c("m.status.type")
    status = (
        F.when(F.coalesce(t.completed, F.lit(False)) | F.coalesce(t.state == "post", F.lit(False)), "FINISHED").when(t.state == "in", "LIVE")
        .when(F.lower(t.getField("name")).contains("postpone"), "POSTPONED").when(F.lower(t.getField("name")).contains("cancel"), "CANCELLED").otherwise("SCHEDULED")
    )
    x = ok.select("*", F.when(first, one).otherwise(two).alias("h"), F.when(first, two).otherwise(one).alias("a"), status.alias("status"))
    winner = F.when(c("h.won"), "HOME").when(c("a.won"), "AWAY").when(c("h.sets") > c("a.sets"), "HOME").when(c("a.sets") > c("h.sets"), "AWAY")
    winner = F.when(c("status") == "FINISHED", winner)
    scored = winner.isNotNull() | (c("status") == "LIVE")
    return x.select(
        c("m.id").alias("id"), F.coalesce("year", F.year(F.try_to_timestamp("m.date"))).cast("string").alias("season"), F.trim(F.concat_ws(" ", "name", "label")).alias("round"), F.try_to_timestamp("m.date").alias("starts"), "status",
        c("h.name").alias("home"), c("a.name").alias("away"), F.coalesce("m.format.regulation.periods", F.lit(3)).alias("best_of"),
        *(F.when(scored, v).alias(k) for k, v in (("hs", c("h.sets")), ("aws", c("a.sets")), ("games_home", c("h.games")), ("games_away", c("a.games")))), winner.alias("winner"),
    )


SERIES_JSON = (
    "data struct<matchList: array<struct<id: string, name: string, matchType: string, status: string, dateTimeGMT: string, teams: array<string>, teamInfo: array<struct<name: string, shortname: string>>, "
    "score: array<struct<r: int, inning: string>>, matchStarted: boolean, matchEnded: boolean>>>"
)


def cricket_matches(series: DataFrame, now: Column, col: str = "json") -> DataFrame:
    """Matches of series documents: id, round, starts, status, home, away, format, hs, aws (runs over all innings), winner.

    The winner is read from the text on the result: drawn, tied, no result or abandoned is level; else whose name it begins
    with, else whose short name it says has won; null if it says neither.  An innings is the side's whose name its label
    begins with.  A match that was to begin two days ago and has not counts as called off."""
    m = series.select(F.explode(F.from_json(c(col), SERIES_JSON).data.matchList).alias("m")).filter((F.size("m.teams") == 2) & c("m.dateTimeGMT").isNotNull())
    x = m.select("m", F.get("m.teams", F.lit(0)).alias("home"), F.get("m.teams", F.lit(1)).alias("away"), F.try_to_timestamp(F.concat("m.dateTimeGMT", F.lit("Z"))).alias("starts"), F.lower(F.coalesce("m.status", F.lit(""))).alias("says"))
    yes = lambda k: F.coalesce(c(f"m.{k}"), F.lit(False))
    old = F.coalesce(F.unix_seconds("starts") < F.unix_seconds(now) - 48 * HOUR, F.lit(False))
    status = (
        F.when(yes("matchEnded"), "FINISHED").when(yes("matchStarted"), "LIVE").when(c("says").rlike("abandon|cancel|no result"), "CANCELLED")
        .when(c("says").contains("postpone"), "POSTPONED").when(old, "CANCELLED").otherwise("SCHEDULED")
    )
    short = lambda k: F.lower(F.get(F.filter(F.coalesce("m.teamInfo", F.array()), lambda t: t.getField("name") == c(k)), F.lit(0)).shortname)
    begins = lambda k: c("says").startswith(F.lower(c(k)))
    won = lambda k: F.coalesce((short(k) != "") & c("says").contains(F.concat(short(k), F.lit(" won"))), F.lit(False))
    winner = F.when(c("says").rlike("drawn|tied|no result|abandon"), "DRAW").when(begins("home"), "HOME").when(begins("away"), "AWAY").when(won("home"), "HOME").when(won("away"), "AWAY")
    x = x.withColumn("status", status)
    own = lambda k: F.filter(F.coalesce("m.score", F.array()), lambda s: F.coalesce((s.inning != "") & F.lower(s.inning).startswith(F.lower(c(k))), F.lit(False)))
    runs = lambda k: F.when(c("status").isin("FINISHED", "LIVE") & (F.size(own(k)) > 0), F.aggregate(own(k), F.lit(0), lambda t, s: t + F.coalesce(s.r, F.lit(0))))
    name = F.regexp_replace("m.name", r"^.*?,\s*", "")
    return x.select(
        c("m.id").alias("id"), F.when(name != "", name).alias("round"), "starts", "status", "home", "away", F.when(c("m.matchType") != "", F.upper("m.matchType")).alias("format"),
        runs("home").alias("hs"), runs("away").alias("aws"), F.when((c("status") == "FINISHED") & (c("says") != ""), winner).alias("winner"),
    )
