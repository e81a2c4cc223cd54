import json

from pyspark.sql import functions as F

from tallyfield.operators.settings import overlay
from tallyfield.sources import boards as b
from tallyfield.sources import parsers as p


def pages(spark, *docs):
    return spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "page int, json string")


def race(n, results=None, qualifying=None, date="2024-03-0{}"):
    r = {"season": "2024", "round": str(n), "raceName": f"R{n}", "date": date.format(n), "time": "15:00:00Z", "Circuit": {"circuitName": "C"}}
    d = lambda x: {"driverId": x, "givenName": x, "familyName": x}
    if results:
        r["Results"] = [{"grid": str(g), "position": str(i), "points": str(pt), "status": s, "Driver": d(w)} for w, g, i, pt, s in results]
    if qualifying:
        r["QualifyingResults"] = [{"position": str(i), "Driver": d(w)} for w, i in qualifying]
    return r


def doc(*races):
    return {"MRData": {"RaceTable": {"Races": list(races)}}}


def test_race_season(spark):
    schedule = pages(spark, doc(race(1), race(2)), doc(race(3), race(4)))
    results = pages(spark, doc(race(1, [("a", 1, 1, 25, "Finished")]), race(9, [("x", 1, 1, 25, "Finished")])), doc(race(1, [("b", 0, 2, 18, "+1 Lap")]), race(2, [("b", 2, 1, 25, "Finished"), ("c", 1, 2, 18, "Engine")])))
    qualifying = pages(spark, doc(race(2, qualifying=[("c", 1)]), race(3, qualifying=[("c", 1), ("a", 2)])))
    drivers = pages(spark, {"MRData": {"DriverTable": {"season": "2024", "Drivers": [{"driverId": x} for x in "abcz"]}}})
    now = F.lit("2024-03-04 16:00:00").cast("timestamp")
    got = sorted(tuple(r)[1:2] + tuple(r)[4:] for r in b.race_entrants(schedule, results, qualifying, drivers, now).collect())
    key = lambda r: tuple((v is None, v) for v in r)
    want = [
        (1, "FINISHED", "a", 1, 1, 25.0, "Finished"), (1, "FINISHED", "b", None, 2, 18.0, "+1 Lap"), (2, "FINISHED", "b", 2, 1, 25.0, "Finished"), (2, "FINISHED", "c", 1, 2, 18.0, "Engine"),
        (3, "SCHEDULED", "c", 1, None, None, None), (3, "SCHEDULED", "a", 2, None, None, None), (4, "LIVE", "x", None, None, None, None),
    ]
    assert sorted(got, key=key) == sorted(want, key=key)
    first = b.race_entrants(schedule, pages(spark, doc()), pages(spark, doc()), drivers, now).filter("round = 1").collect()
    assert sorted(r.driver for r in first) == list("abcz") and first[0].status == "SCHEDULED"


def test_boards(spark):
    def match(i, a, c, state, sets=(), won=None, **kw):
        who = lambda k, name: {"id": f"{i}{k}", "winner": won == k, "athlete": None if name is None else {"displayName": name}, "linescores": [{"value": s[k], "winner": s[k] > s[1 - k]} for s in sets]}
        return {"id": i, "date": "2024-05-01T10:00Z", "status": {"type": {"state": state, "completed": state == "post", "name": kw.get("name", "x")}}, "competitors": [who(0, a), who(1, c)]}

    def board(slug, *ms):
        return {"events": [{"id": "t", "name": "Open", "season": {"year": 2024}, "groupings": [{"grouping": {"slug": slug, "displayName": "Men"}, "competitions": list(ms)}]}]}

    days = spark.createDataFrame(
        [
            (2, json.dumps(board("mens-singles", match("1", "Zed", "Ann", "pre"), match("2", "Bo", "Cy", "in", [(6, 4), (1, 2)])))),
            (1, json.dumps(board("mens-singles", match("1", "Zed", "Ann", "post", [(6, 3), (3, 6), (7, 6)], 0), match("3", "A", None, "pre"), match("4", "A", "B", "pre", name="STATUS_POSTPONED")))),
            (1, json.dumps(board("mens-doubles", match("9", "A", "B", "post")))), (3, "{broken"),
        ],
        "day int, json string",
    )
    got = {r.id: r for r in b.board_matches(days).collect()}
    assert set(got) == {"1", "2", "4"}
    r = got["1"]
    assert (r.status, r.home, r.away, r.hs, r.aws, r.games_home, r.games_away, r.winner, r.season, r.round, r.best_of) == ("FINISHED", "Ann", "Zed", 1, 2, 15, 16, "AWAY", "2024", "Open Men", 3)
    r = got["2"]
    assert (r.status, r.home, r.hs, r.aws, r.games_home, r.winner) == ("LIVE", "Bo", 1, 1, 7, None)
    assert (got["4"].status, got["4"].hs) == ("POSTPONED", None)


def test_cricket(spark):
    def m(i, status, teams=("India", "New Zealand"), start="2024-01-01T09:00:00", **kw):
        return {"id": i, "name": "Ind vs NZ, 1st Test", "matchType": "test", "status": status, "dateTimeGMT": start, "teams": list(teams), "teamInfo": [{"name": "India", "shortname": "IND"}, {"name": "New Zealand", "shortname": "NZ"}], **kw}

    score = [{"r": 200, "inning": "India Inning 1"}, {"r": 150, "inning": "new zealand inning 1"}, {"r": 101, "inning": "India Inning 2"}, {"r": None, "inning": "New Zealand Inning 2"}]
    ended = {"matchStarted": True, "matchEnded": True, "score": score}
    docs = [m("a", "India won by 5 wkts", **ended), m("b", "NZ won by 1 run", **ended), m("c", "Match drawn", **ended), m("d", "", matchStarted=True), m("e", "Postponed"), m("f", "No result"), m("g", ""), m("h", "", start="2030-01-01T00:00:00"), m("i", "won", ("India",)), m("j", "who knows", matchEnded=True)]
    x = {r.id: r for r in b.cricket_matches(pages(spark, {"data": {"matchList": docs}}), F.lit("2024-06-01").cast("timestamp")).collect()}
    assert {k: (r.status, r.winner) for k, r in x.items()} == {
        "a": ("FINISHED", "HOME"), "b": ("FINISHED", "AWAY"), "c": ("FINISHED", "DRAW"), "d": ("LIVE", None), "e": ("POSTPONED", None), "f": ("CANCELLED", None), "g": ("CANCELLED", None), "h": ("SCHEDULED", None), "j": ("FINISHED", None),
    }
    assert (x["a"].hs, x["a"].aws, x["a"].format, x["a"].round, x["d"].hs) == (301, 150, "TEST", "1st Test", None)


def test_overlay(spark):
    defaults = spark.createDataFrame([("f", "elo", True, 1.0, {"k": "20", "home": "60"}), ("f", "dc", True, 1.4, {}), ("t", "elo", False, 2.0, None)], "sport string, model string, enabled boolean, weight double, params map<string,string>")
    rows = [("f", None, "elo", True, 0.5, {"k": "25"}, "s1", 5), ("f", "", "elo", True, 0.1, {"k": "1"}, "s0", 4), ("f", "9", "elo", False, 0.7, {"home": "70", "new": None}, None, None), ("f", "9", "nobody", True, 1.0, {}, None, 1), ("f", "77", "elo", True, 9.0, {}, None, 1)]
    rows = spark.createDataFrame(rows, "sport string, comp string, model string, enabled boolean, weight double, params map<string,string>, state string, fitted_at long")
    comps = spark.createDataFrame([("f", "8"), ("f", "9"), ("t", "3")], "sport string, comp string")
    got = {(r.sport, r.comp, r.model): r for r in overlay(defaults, rows, comps).collect()}
    assert set(got) == {("f", "8", "elo"), ("f", "9", "elo"), ("f", "8", "dc"), ("f", "9", "dc"), ("t", "3", "elo")}
    r = got["f", "8", "elo"]
    assert (r.enabled, r.weight, r.params, r.sources, r.state, r.fitted_at, r.specific) == (True, 0.5, {"k": "25", "home": "60"}, {"k": "sport", "home": "default"}, "s1", 5, False)
    r = got["f", "9", "elo"]
    assert (r.enabled, r.weight, r.params, r.state, r.specific) == (False, 0.7, {"k": "25", "home": "70", "new": None}, "s1", True)
    assert r.sources == {"k": "sport", "home": "competition", "new": "competition"}
    assert got["t", "3", "elo"].params == {}


ARCHIVE = {
    "tourney_id": "2024-1", "match_num": "7", "tourney_date": "20240101", "round": "Q1", "winner_name": "Stan", "winner_id": "5", "winner_rank": "12", "winner_seed": "", "loser_name": "Hub", "loser_id": "", "loser_rank": "0", "loser_seed": "x", "score": "6-3 7-6(4)RET",
    "w_ace": "9", "w_df": "", "w_svpt": "80", "w_1stIn": "53", "w_1stWon": "40", "w_2ndWon": "15", "w_SvGms": "12", "w_bpSaved": "4", "w_bpFaced": "5", "l_ace": "10", "l_df": "1", "l_svpt": "0", "l_1stIn": "49", "l_1stWon": "", "l_2ndWon": "3", "l_SvGms": "", "l_bpSaved": "5", "l_bpFaced": "7",
}


def test_archive_statistics(spark):
    rows = spark.createDataFrame([tuple(ARCHIVE.values())], ", ".join(f"`{k}` string" for k in ARCHIVE))
    got = {r.player: r.stats for r in p.archive_statistics(rows).collect()}
    assert got == {
        "5": {"sets": 2.0, "games": 13.0, "aces": 9.0, "first_in": 66.3, "break_points_won": 2.0, "serve_points": 80.0, "serve_points_won": 55.0, "serve_games": 12.0, "break_points_faced": 5.0, "break_points_saved": 4.0, "rank": 12.0},
        "Hub": {"sets": 0.0, "games": 9.0, "aces": 10.0, "double_faults": 1.0, "break_points_won": 1.0, "break_points_faced": 7.0, "break_points_saved": 5.0},
    }
    assert [str(r.day) for r in p.archive_events(rows).collect()] == ["2023-12-29"]
    scores = spark.createDataFrame([("7-6(4)RET",), ("9-8 1-6",), ("Walkover",), ("6-5 ABN",)], "s string").select(p.sets_of(F.col("s")).alias("s")).collect()
    assert [tuple(r.s) for r in scores] == [(1, 0, 7, 6, True), (1, 1, 10, 14, False), (0, 0, 0, 0, True), (0, 0, 6, 5, False)]


def test_winners_and_odds_names(spark):
    def match(i, status, winner, home, away):
        return {"id": i, "utcDate": "2024-08-16T19:00:00Z", "status": status, "homeTeam": {"name": "A"}, "awayTeam": {"name": "B"}, "score": {"winner": winner, "fullTime": {"home": home, "away": away}}}

    x = p.api_matches(pages(spark, {"matches": [match(1, "FINISHED", None, 1, 1), match(2, "IN_PLAY", "HOME_TEAM", 1, 0), match(3, "TIMED", None, 1, 0), match(4, "FINISHED", "AWAY_TEAM", None, None)]}))
    assert sorted((m.id, m.hs, m.winner) for m in x.collect()) == [(1, 1, "DRAW"), (2, 1, None), (3, None, None), (4, None, None)]
    odds = [{"id": "e", "home_team": "A", "away_team": "B", "bookmakers": [{"key": "k", "markets": [{"key": "h2h", "outcomes": [{"name": n, "price": 2.0} for n in ("A", "B", "The Draw", "Other")]}]}]}]
    assert sorted(r.outcome for r in p.odds_prices(pages(spark, odds)).collect()) == ["AWAY", "DRAW", "HOME"]


def test_zones_twice_a_year(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    from tallyfield.functions import scalars as f

    zone = "America/New_York"
    local = ["2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-07-01 12:00:00", "2024-03-10 03:00:00", "2024-03-10 01:59:00", "2024-11-03 02:00:00"]
    got = [str(r.t) for r in spark.createDataFrame([(x,) for x in local], "s string").select(f.wall_to_utc(F.col("s").cast("timestamp"), zone).alias("t")).collect()]
    assert got == ["2024-03-10 06:30:00", "2024-11-03 05:30:00", "2024-07-01 16:00:00", "2024-03-10 07:00:00", "2024-03-10 06:59:00", "2024-11-03 07:00:00"]
    a, b_ = "2024-03-09 12:00:00", "2024-03-11 12:00:00"
    due = spark.range(1).select(f.instants_between(F.lit(a).cast("timestamp"), F.lit(b_).cast("timestamp"), f.run_times(F.lit("07:00,19:00 7:00;x")), zone).alias("d")).first().d
    want = [datetime(2024, 3, d, h, tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None) for d, h in ((9, 7), (9, 19), (10, 7), (10, 19), (11, 7))]
    assert due == [t for t in want if datetime.fromisoformat(a) < t <= datetime.fromisoformat(b_)]
    assert spark.range(1).select(f.run_times_text(f.run_times(F.lit("7:05;23:59, 24:00"))).alias("t")).first().t == "07:05,23:59"


def test_quantile_reach(spark):
    from tallyfield.functions import scalars as f

    def plain(q, rate):
        import math

        term = total = math.exp(-rate)
        for k in range(1, 501):
            if total >= q:
                return k - 1
            term *= rate / k
            total += term
        return 500

    cases = [(q, r) for q in (0.0, 0.1, 0.5, 0.9, 0.999999, 1.0) for r in (0.0, 0.3, 2.3, 40.0, 120.0, 450.0)]
    got = spark.createDataFrame(cases, "q double, r double").select("q", "r", f.poisson_quantile(F.col("q"), F.col("r")).alias("k")).collect()
    assert [(x.q, x.r, x.k) for x in got if x.q < 1] == [(q, r, plain(q, r)) for q, r in cases if q < 1]
