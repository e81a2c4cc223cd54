import json

from pyspark.sql import functions as F

from tallyfield.sources import parsers as p

LEAGUE = "Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,Referee,HS,AS,HST,AST,HC,AC,HF,AF,HY,AY,HR,AR".split(",")


def frame(spark, col, *values):
    return spark.createDataFrame([(v,) for v in values], f"{col} string")


def test_league_file(spark, tmp_path):
    (tmp_path / "l.csv").write_text(",".join(LEAGUE) + "\nE0,16/08/24,20:00,Man United,Fulham,1,0,H,R,14,10,5,2,7,8,12,10,2,3,0,0\n\nE0,17/08/2024,,Ipswich, Liverpool ,,,,,,,,,,,,,,,,\nE0,,,x,y,1,1,D,,,,,,,,,,,,,\n")
    rows = p.csv(spark, str(tmp_path / "l.csv"), LEAGUE)
    e = p.league_events(rows).orderBy("starts").collect()
    assert [(str(x.starts), x.home, x.away, x.hs, x.status, x.winner) for x in e] == [("2024-08-16 20:00:00", "Man United", "Fulham", 1, "FINISHED", "HOME"), ("2024-08-17 15:00:00", "Ipswich", "Liverpool", None, "SCHEDULED", None)]
    s = {x.team: x.stats for x in p.league_stats(rows).collect()}
    assert set(s) == {"Man United", "Fulham"} and s["Fulham"]["corners"] == 8 and s["Man United"]["goals"] == 1 and len(s["Fulham"]) == 7


def test_ratings_and_rankings(spark):
    rows = spark.createDataFrame([("1", "City", "ENG", "2050.5"), ("None", "Low", "ENG", "1200"), ("3", "Bad", "ENG", "x")], "Rank string, Club string, Country string, Elo string")
    assert [(x.rank, x.club, x.elo) for x in p.club_ratings(rows).orderBy("club").collect()] == [(1, "City", 2050.5), (None, "Low", 1200.0)]
    lists = spark.createDataFrame([("20240101", "1", "9", "100"), ("20240108", "2", "8", "90"), ("20240108", "1", "9", "110"), ("20240108", "3", "7", "80")], "ranking_date string, rank string, player string, points string")
    names = spark.createDataFrame([("9", "A"), ("8", "B")], "player string, name string")
    assert [tuple(x) for x in p.latest_rankings(lists, names).collect()] == [(1, "9", "A", 110), (2, "8", "B", 90)]


def test_scores_of_sets(spark):
    got = [tuple(x.s) for x in frame(spark, "score", "6-3 3-6 7-6(4)", "6-4 2-1 RET", "W/O").select(p.sets_of(F.col("score")).alias("s")).collect()]
    assert got == [(2, 1, 16, 15, False), (1, 0, 8, 5, True), (0, 0, 0, 0, True)]
    rows = spark.createDataFrame([("20240101", "QF", "Zed", "Ann", "6-3 6-2"), ("bad", "F", "A", "B", "6-0 6-0")], "tourney_date string, round string, winner_name string, loser_name string, score string")
    assert [(str(x.day), x.home, x.away, x.hs, x.aws, x.winner) for x in p.archive_events(rows).collect()] == [("2024-01-05", "Ann", "Zed", 0, 2, "AWAY")]


def test_json_sources(spark):
    doc = {"matches": [{"id": 5, "utcDate": "2024-08-16T19:00:00Z", "status": "FINISHED", "homeTeam": {"name": "A"}, "awayTeam": {"name": "B"}, "score": {"winner": "AWAY_TEAM", "fullTime": {"home": 0, "away": 2}}}]}
    x = p.api_matches(frame(spark, "json", json.dumps(doc), "{broken")).collect()
    assert [(m.id, m.status, m.home, m.hs, m.aws, m.winner) for m in x] == [(5, "FINISHED", "A", 0, 2, "AWAY")]
    stats = p.api_statistics(frame(spark, "json", json.dumps([{"type": "Ball Possession", "value": "61%"}, {"type": "Shots", "value": None}, {"type": "?", "value": "1"}])), {"Ball Possession": "possession", "Shots": "shots"})
    assert stats.first().stats == {"possession": 61.0}
    odds = [{"id": "e", "home_team": "A", "away_team": "B", "bookmakers": [{"key": "k", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 2.0}, {"name": "B", "price": 3.5}, {"name": "Draw", "price": 3.2}]}, {"key": "totals", "outcomes": []}]}]}]
    assert sorted((x.outcome, x.price) for x in p.odds_prices(frame(spark, "json", json.dumps(odds))).collect()) == [("AWAY", 3.5), ("DRAW", 3.2), ("HOME", 2.0)]
    hours = {"hourly": {"time": ["2024-08-16T18:00", "2024-08-16T19:00"], "temperature_2m": [20.0, 18.5], "precipitation_probability": [5.0, 40.0], "wind_speed_10m": [1.0, 2.0], "weather_code": [1, 61]}}
    at = frame(spark, "json", json.dumps(hours)).select("json", F.explode(F.array(F.lit("2024-08-16 19:20:00").cast("timestamp"), F.lit("2024-08-17 12:00:00").cast("timestamp"))).alias("at"))
    assert [w.weather and (w.weather.temperature, w.weather.code) for w in p.weather_at(at, "at").orderBy("at").collect()] == [(18.5, 61), None]


def test_feed_and_rounds(spark):
    xml = "<rss><channel><item><title>Big &amp; small - The Paper</title><link>http://a</link><pubDate>Fri, 16 Aug 2024 10:00:00 GMT</pubDate></item><item><title><![CDATA[Other]]></title><link>http://b</link><pubDate>never</pubDate></item></channel></rss>"
    assert [(x.title, x.url, str(x.published)) for x in p.headlines(frame(spark, "xml", xml)).orderBy("k").collect()] == [("Big & small", "http://a", "2024-08-16 10:00:00"), ("Other", "http://b", "None")]
    pages = spark.createDataFrame([(1, [(2, "b")]), (1, [(1, "a")]), (2, [(1, "c")])], "round int, results array<struct<position: int, driver: string>>")
    assert {x.round: [r.driver for r in x.results] for x in p.merged_rounds(pages).collect()} == {1: ["a", "b"], 2: ["c"]}
