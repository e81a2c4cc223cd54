"""Providers' files as tables: league and rating CSV, player archives, nested JSON, hourly weather, feeds and odds.

Every parser takes a DataFrame of raw strings or of a reader's rows with an explicit schema, and stays inside Catalyst.
Rows that lack what identifies them are left out; values that cannot be read are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
#: The statistics of the league files, by column for the home and the away side.
LEAGUE_STATS = {"goals": ("FTHG", "FTAG"), "shots": ("HS", "AS"), "shots_on_target": ("HST", "AST"), "corners": ("HC", "AC"), "fouls": ("HF", "AF"), "yellow_cards": ("HY", "AY"), "red_cards": ("HR", "AR")}
#: Days after a tournament's start by round.
ROUND_DAY = {"R128": 0, "R64": 1, "R32": 2, "R16": 3, "QF": 4, "SF": 5, "F": 6, "RR": 1, "BR": 6, "ER": 0, "Q1": -3, "Q2": -2, "Q3": -1}
#: How providers call the states of an event.
STATUS = {
    "FINISHED": ("FINISHED", "AWARDED", "FT", "AET", "PEN", "Match Finished", "POST"),
    "LIVE": ("IN_PLAY", "PAUSED", "LIVE", "1H", "HT", "2H", "ET", "IN"),
    "POSTPONED": ("POSTPONED", "SUSPENDED", "PST", "Postponed"),
    "CANCELLED": ("CANCELLED", "CANC", "ABD", "Cancelled"),
}


def csv(spark: SparkSession, path: str, columns: list[str], null: str = "") -> DataFrame:
    """A CSV file with a header, all columns as strings; blank lines are skipped."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{x}` string" for x in columns), nullValue=null, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)


def number(x: Column) -> Column:
    return F.try_to_number(F.replace(F.trim(x), F.lit("%"), F.lit("")), F.lit("S999999999D999999")).cast("double")


def status(x: Column) -> Column:
    out = F
    for name, words in STATUS.items():
        out = out.when(x.isin(*words), name)
    return out.otherwise("SCHEDULED")


def league_date(day: Column, time: Column) -> Column:
    """dd/mm/yy or dd/mm/yyyy with a time, three in the afternoon without one."""
    parts = F.split(F.when(F.trim(day).rlike(r"^\d{1,2}/\d{1,2}/\d{2}(\d{2})?$"), F.trim(day)), "/")
    year = F.get(parts, F.lit(2)).cast("int")
    hours = F.split(F.coalesce(F.when(time.rlike(r"^\d{1,2}:\d{2}"), time), F.lit("15:00")), ":")
    number_of = lambda x, k: F.get(x, F.lit(k)).cast("int")
    return F.try_make_timestamp(F.when(F.length(F.get(parts, F.lit(2))) == 2, year + 2000).otherwise(year), number_of(parts, 1), number_of(parts, 0), number_of(hours, 0), F.substring(F.get(hours, F.lit(1)), 1, 2).cast("int"), F.lit(0.0))


def winner(hs: Column, aws: Column) -> Column:
    return F.when(hs > aws, "HOME").when(hs < aws, "AWAY").when(hs == aws, "DRAW")


def league_events(rows: DataFrame) -> DataFrame:
    """Events of a league file: finished if both scores are numbers."""
    hs, aws = F.expr("try_cast(FTHG as int)"), F.expr("try_cast(FTAG as int)")
    ok = rows.filter("HomeTeam <> '' and AwayTeam <> '' and Date <> ''").withColumn("starts", league_date(c("Date"), c("Time")))
    done = hs.isNotNull() & aws.isNotNull()
    return ok.filter("starts is not null").select("starts", c("HomeTeam").alias("home"), c("AwayTeam").alias("away"), hs.alias("hs"), aws.alias("aws"), F.when(done, "FINISHED").otherwise("SCHEDULED").alias("status"), F.when(done, winner(hs, aws)).alias("winner"))


def league_stats(rows: DataFrame) -> DataFrame:
    """A row for each side with a map of statistics, goals among them; neither for a match whose home side has one statistic
    or less."""
    def side(team, k):
        m = F.map_filter(F.create_map(*(x for name, cols in LEAGUE_STATS.items() for x in (F.lit(name), F.expr(f"try_cast({cols[k]} as double)")))), lambda _, v: v.isNotNull())
        return F.struct(c(team).alias("team"), m.alias("stats"))

    both = rows.select("Date", F.array(side("HomeTeam", 0), side("AwayTeam", 1)).alias("both"))
    known = both.filter(F.size(F.get("both", F.lit(0))["stats"]) > 1)
    return known.select("Date", F.explode("both").alias("s")).select("Date", "s.*")


def club_ratings(rows: DataFrame) -> DataFrame:
    """A rating file: Rank may be "None"; rows without a finite rating are left out."""
    elo = F.expr("try_cast(Elo as double)")
    return rows.select(F.expr("try_cast(Rank as int)").alias("rank"), c("Club").alias("club"), c("Country").alias("country"), elo.alias("elo")).filter(c("elo").isNotNull() & ~F.isnan("elo"))


def archive_events(rows: DataFrame) -> DataFrame:
    """Matches of a player archive: dated by round after the tournament's start; sides stand in the order of names."""
    days = F.coalesce(F.create_map(*(F.lit(x) for kv in ROUND_DAY.items() for x in kv))[c("round")], F.lit(2))
    first = F.collate(c("winner_name"), "UNICODE") <= F.collate(c("loser_name"), "UNICODE")
    start = F.when(c("tourney_date").rlike(r"^\d{8}$"), F.to_date("tourney_date", "yyyyMMdd"))
    x = rows.filter("winner_name <> '' and loser_name <> ''").withColumn("s", sets_of(c("score")))
    flip = lambda a, b: F.when(first, a).otherwise(b)
    return x.select(
        F.date_add(start, days).alias("day"), flip(c("winner_name"), c("loser_name")).alias("home"), flip(c("loser_name"), c("winner_name")).alias("away"),
        flip(c("s.won"), c("s.lost")).alias("hs"), flip(c("s.lost"), c("s.won")).alias("aws"), flip(F.lit("HOME"), F.lit("AWAY")).alias("winner"), c("s.retired").alias("retired"),
    ).filter("day is not null")


def sets_of(score: Column) -> Column:
    """won, lost (sets), games_won, games_lost and retired of a score like "6-3 3-6 7-6(4)".  Games are those at the start of
    each word; a set counts once a side has six games and two more than the other, or seven."""
    parts = F.transform(
        F.filter(F.split(F.trim(score), r"\s+"), lambda p: p.rlike(r"^\d+-\d+")),
        lambda p: F.struct(F.regexp_extract(p, r"^(\d+)-", 1).cast("int").alias("a"), F.regexp_extract(p, r"^\d+-(\d+)", 1).cast("int").alias("b")),
    )
    over = lambda x, y: (x > y) & (x >= 6) & ((x - y >= 2) | (x >= 7))
    count = lambda cond: F.size(F.filter(parts, cond))
    total = lambda pick: F.aggregate(parts, F.lit(0), lambda s, p: s + pick(p))
    # a level set of seven games or more is not over in any score there is; it counts for the other side as in the source
    lost = lambda p: over(p.b, p.a) | ((p.a == p.b) & (p.a >= 7))
    return F.struct(
        count(lambda p: over(p.a, p.b)).alias("won"), count(lost).alias("lost"), total(lambda p: p.a).alias("games_won"), total(lambda p: p.b).alias("games_lost"),
        F.coalesce(score.rlike(r"(?i)(RET|W/O|DEF|Walkover)"), F.lit(False)).alias("retired"),
    )


ARCHIVE_COUNTS = ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced")


def archive_statistics(rows: DataFrame) -> DataFrame:
    """id (of the match), player, stats for both players of an archive's match: sets and games won; aces, double faults, first
    serves in (per cent, one digit), serve points played and won, service games, break points faced, saved and won; the rank
    and seed held on the day.  A count that is no number is left out with all that is made from it, as are a first-serve
    share and serve points without serve points played, and ranks and seeds that are not positive."""
    x = rows.filter("winner_name <> '' and loser_name <> '' and length(tourney_date) = 8").withColumn("s", sets_of(F.coalesce("score", F.lit(""))))
    num = lambda k: F.expr(f"try_cast(nullif(`{k}`, '') as double)")

    def side(p, other, who, sets, games):
        n = {k: num(f"{p}_{k}") for k in ARCHIVE_COUNTS}
        faced, saved = num(f"{other}_bpFaced"), num(f"{other}_bpSaved")
        played = F.when(n["svpt"] > 0, n["svpt"])
        positive = lambda v: F.when(v > 0, v)
        stats = {
            "sets": c(f"s.{sets}").cast("double"), "games": c(f"s.{games}").cast("double"), "aces": n["ace"], "double_faults": n["df"], "first_in": F.floor(n["1stIn"] / played * 1000 + 0.5) / 10,
            "break_points_won": faced - saved, "serve_points": played, "serve_points_won": n["1stWon"] + n["2ndWon"], "serve_games": n["SvGms"], "break_points_faced": n["bpFaced"], "break_points_saved": n["bpSaved"],
            "rank": positive(num(f"{who}_rank")), "seed": positive(num(f"{who}_seed")),
        }
        known = F.map_filter(F.create_map(*(v for kv in stats.items() for v in (F.lit(kv[0]), kv[1]))), lambda _, v: v.isNotNull())
        return F.struct(F.coalesce(F.expr(f"nullif({who}_id, '')"), c(f"{who}_name")).alias("player"), known.alias("stats"))

    both = F.array(side("w", "l", "winner", "won", "games_won"), side("l", "w", "loser", "lost", "games_lost"))
    return x.select(F.concat_ws(":", "tourney_id", "match_num").alias("id"), F.inline(both))


def latest_rankings(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The list of the newest date with players' names; rank, player and points are text there, players without a name are
    left out.  The newest date is one row."""
    last = rows.agg(F.max("ranking_date").alias("ranking_date"))
    x = rows.join(F.broadcast(last), "ranking_date").withColumn("rank", F.expr("try_cast(rank as int)")).filter("rank is not null")
    return x.join(names, "player").select("rank", "player", "name", F.expr("try_cast(points as int)").alias("points")).orderBy("rank")


MATCH_JSON = "matches array<struct<id: bigint, utcDate: string, status: string, homeTeam: struct<name: string>, awayTeam: struct<name: string>, score: struct<winner: string, fullTime: struct<home: int, away: int>>>>"
STATISTICS_JSON = "array<struct<type: string, value: string>>"
ODDS_JSON = "array<struct<id: string, home_team: string, away_team: string, bookmakers: array<struct<key: string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: double>>>>>>>>"
HOURLY_JSON = "hourly struct<time: array<string>, temperature_2m: array<double>, precipitation_probability: array<double>, wind_speed_10m: array<double>, weather_code: array<int>>"


def api_matches(raw: DataFrame, col: str = "json") -> DataFrame:
    """Events of a matches document; malformed JSON has none.  Scores count once a match has begun and both are known, a winner
    once it is over: level without another one named."""
    m = raw.select(F.explode(F.from_json(c(col), MATCH_JSON).matches).alias("m"))
    state, goals = status(c("m.status")), (c("m.score.fullTime.home"), c("m.score.fullTime.away"))
    begun = (state != "SCHEDULED") & goals[0].isNotNull() & goals[1].isNotNull()
    won = F.when(c("m.score.winner") == "HOME_TEAM", "HOME").when(c("m.score.winner") == "AWAY_TEAM", "AWAY").otherwise("DRAW")
    return m.select(
        c("m.id").alias("id"), F.try_to_timestamp("m.utcDate").alias("starts"), state.alias("status"), c("m.homeTeam.name").alias("home"), c("m.awayTeam.name").alias("away"),
        F.when(begun, goals[0]).alias("hs"), F.when(begun, goals[1]).alias("aws"), F.when(begun & (state == "FINISHED"), won).alias("winner"),
    )


def api_statistics(raw: DataFrame, names: dict[str, str], col: str = "json") -> DataFrame:
    """A statistics list as a map, by a dictionary of labels; percent signs go, values that are no numbers too."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    rows = F.transform(F.from_json(c(col), STATISTICS_JSON), lambda x: F.struct(known[x.type].alias("k"), number(x.value).alias("v")))
    return raw.withColumn("stats", F.map_from_entries(F.filter(rows, lambda x: x.k.isNotNull() & x.v.isNotNull())))


def odds_prices(raw: DataFrame, col: str = "json") -> DataFrame:
    """event_id, book, outcome, price of an odds document's head-to-head markets; names that are neither a side's nor speak of a
    draw are left out."""
    e = raw.select(F.explode(F.from_json(c(col), ODDS_JSON)).alias("e"))
    b = e.select("e", F.explode("e.bookmakers").alias("b")).select("e", "b", F.explode("b.markets").alias("m")).filter("m.key = 'h2h'")
    o = b.select(c("e.id").alias("event_id"), c("b.key").alias("book"), "e", F.explode("m.outcomes").alias("o"))
    outcome = F.when(c("o.name") == c("e.home_team"), "HOME").when(c("o.name") == c("e.away_team"), "AWAY").when(F.lower("o.name").contains("draw"), "DRAW")
    return o.select("event_id", "book", outcome.alias("outcome"), c("o.price").alias("price")).filter("outcome is not null")


def weather_at(raw: DataFrame, at: str, col: str = "json", within_hours: int = 3) -> DataFrame:
    """The forecast's hour that is nearest to a time, at most so far from it: ``weather``, or null."""
    h = F.from_json(c(col), HOURLY_JSON).hourly
    hours = F.transform(F.arrays_zip(h.time.alias("time"), h.temperature_2m.alias("temperature"), h.precipitation_probability.alias("rain"), h.wind_speed_10m.alias("wind"), h.weather_code.alias("code")), lambda x: F.struct(
        F.abs(F.unix_timestamp(F.try_to_timestamp(x.time, F.lit("yyyy-MM-dd'T'HH:mm"))) - F.unix_timestamp(c(at))).alias("off"), x.temperature.alias("temperature"), x.rain.alias("rain"), x.wind.alias("wind"), x.code.alias("code")))
    near = F.array_min(F.filter(hours, lambda x: x.off <= within_hours * 3600))
    return raw.withColumn("weather", near)


def headlines(raw: DataFrame, col: str = "xml", limit: int = 10) -> DataFrame:
    """The first items of a feed: title without its source, link and time; an unreadable time is null."""
    items = F.regexp_extract_all(c(col), F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))
    x = raw.select(F.posexplode(F.slice(items, 1, limit)).alias("k", "i"))
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))
    text = F.regexp_replace(tag("title"), r"\s+-\s+[^-]+$", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    when = F.try_to_timestamp(F.regexp_extract(tag("pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return x.select("k", text.alias("title"), tag("link").alias("url"), when.alias("published")).filter("title <> ''")


def merged_rounds(pages: DataFrame) -> DataFrame:
    """Races whose rows are split over pages, one row for each round: round, results (array, in order of place)."""
    return pages.groupBy("round").agg(F.array_sort(F.flatten(F.collect_list("results"))).alias("results"))


def archive_serves(rows: DataFrame) -> DataFrame:
    """What ``serve_samples`` takes, of an archive's matches: event_id (the match's id), day, surface, home, away (the winner and the
    loser) and both sides' serve points and points won; null where the archive lacks them."""
    own = lambda who: F.coalesce(F.expr(f"nullif({who}_id, '')"), c(f"{who}_name"))
    start = F.when(c("tourney_date").rlike(r"^\d{8}$"), F.to_date("tourney_date", "yyyyMMdd"))
    days = F.coalesce(F.create_map(*(F.lit(x) for kv in ROUND_DAY.items() for x in kv))[c("round")], F.lit(2))
    m = rows.select(F.concat_ws(":", "tourney_id", "match_num").alias("id"), F.unix_date(F.date_add(start, days)).alias("day"), F.coalesce(F.expr("nullif(surface, '')"), F.lit("Hard")).alias("surface"), own("winner").alias("home"), own("loser").alias("away"))
    s = archive_statistics(rows).select("id", "player", c("stats")["serve_points"].alias("points"), c("stats")["serve_points_won"].alias("won"))
    both = s.groupBy("id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("player", F.struct("points", "won"))))).alias("s"))
    x = m.join(both, "id").filter("day is not null")
    return x.select(c("id").alias("event_id"), "day", "surface", "home", "away", *(c("s")[c(side)][k].alias(f"{side}_{k}") for side in ("home", "away") for k in ("points", "won")))
