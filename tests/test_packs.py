"""Documents of events in parts: the parts make the whole, and lists that many events show are written once for each team."""

import math

from pyspark.sql import functions as F

from tallyfield.operators import probability as pr
from tallyfield.operators import tables as t
from tallyfield.plans import forecast as fc
from tallyfield.plans import packs
from tallyfield.queries import upcoming
from tallyfield.sources import projections as p

c = F.col
NOW = 10_000
MODEL = "comp int, team int, attack double, defence double, base double, home double, rho double"


def _team_packs(spark, sf, models):
    m = p.matches(spark, sf)
    ratings = spark.createDataFrame([(comp, team, 1400.0 + team) for comp in range(5) for team in range(20)], "comp int, team int, rating double")
    names = ['a "home":{"team":1} \\ b', "ü\n", "c"]
    injuries = spark.createDataFrame([(k % 7, f"{names[k % 3]}{k}", "OUT", None if k % 4 else 5) for k in range(40)], "team int, player string, status string, resolved int")
    news = spark.createDataFrame([(k % 5, f'"away":{{"rest_days":{k}', float(k)) for k in range(60)], "team int, title string, published double")
    return m, packs.team_packs(m, NOW, ratings, models, injuries, news)


def test_parts_make_the_whole_document(spark, sf):
    models = spark.createDataFrame([(1, 3, 0.25, -0.5, 0.1, 0.2, -0.05)], MODEL)
    m, own = _team_packs(spark, sf, models)
    own = own.cache()
    said = {"ensemble": F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), "exp_home": F.lit(1.234), "exp_away": F.lit(None).cast("double"), "factors": F.array(F.struct(F.lit("home").alias("key"), F.lit(5.4).alias("effect")))}
    x = m.filter(f"status = 'SCHEDULED' and day >= {NOW}").withColumns(said).withColumns({"one": F.least("home", "away"), "two": F.greatest("home", "away")}).join(packs.meeting_lists(m, NOW), ["one", "two"], "left")
    parts = packs.team_parts(own)
    for side in ("home", "away"):
        x = x.join(own.select("comp", "season", c("team").alias(side), c("pack").alias(f"pack_{side}"), c("pack.last_day").alias(f"last_day_{side}")), ["comp", "season", side], "left")
        x = x.join(parts.select("comp", "season", c("team").alias(side), c("text").alias(f"text_{side}"), c("same").alias(f"same_{side}")), ["comp", "season", side], "left")
    rested = lambda s: c(f"pack_{s}").withField("rest_days", t.rest_days(c("day"), c(f"last_day_{s}"))).dropFields("last_day").alias(s)
    algorithm = F.struct(c("ensemble").alias("probabilities"), F.lit(1.23).alias("expected_home"), c("exp_away").alias("expected_away"), "factors").alias("algorithm")
    nested = F.struct("comp", "season", packs.day_text(c("day")).alias("kickoff"), rested("home"), rested("away"), F.coalesce("meetings", F.array().cast("array<string>")).alias("meetings"), algorithm)
    x = x.withColumn("want", F.to_json(nested))
    got = packs.event_parts(x, ["event_id", "want", "text_home", "text_away", "same_home", "same_away"])
    rows = got.withColumn("whole", packs.whole(c("text"), c("text_home"), c("text_away"))).collect()
    assert len(rows) > 20 and all(r.whole == r.want and r.same and r.same_home and r.same_away for r in rows)
    assert any("rest_days" in r.text_home + r.text_away for r in rows)  # of a headline that looks like a part


def test_lists_are_written_once_for_each_team(spark, sf, monkeypatch):
    sizes, written = {}, packs.written

    def seen(rows, keys, doc):
        sizes[doc] = rows.count()
        return written(rows, keys, doc)

    monkeypatch.setattr(packs, "written", seen)
    got = upcoming.QUERIES["stat_packs"](spark, sf)
    fixtures = upcoming._fixtures(p.matches(spark, sf))
    teams = fixtures.select("comp", "season", F.explode(F.array("home", "away")).alias("team")).distinct()
    assert sizes == {"pack": teams.count(), "part": fixtures.count()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan and "c_name" not in plan and got.count() == sizes["part"]


def test_consensus_counts_all_prices_of_a_book(spark):
    rows = [(1, 1, "HOME", 2.0), (1, 1, "DRAW", 4.0), (1, 1, "AWAY", 4.0), (1, 2, "HOME", 1.0), (1, 2, "DRAW", 4.0), (1, 2, "AWAY", 4.0), (1, 3, "HOME", 4.0), (1, 3, "AWAY", 4.0), (2, 1, "HOME", 1.0), (2, 1, "AWAY", 2.0)]
    got = {(r.event_id, r.outcome): r.p for r in pr.consensus(spark.createDataFrame(rows, "event_id long, book int, outcome string, price double")).collect()}
    assert got == {(1, "HOME"): 0.5, (1, "DRAW"): 0.125, (1, "AWAY"): 0.375}


def test_odds_of_some_events_are_those_of_all(spark, sf):
    some = upcoming._fixtures(p.matches(spark, sf))
    want = p.odds(spark, sf).join(some, "event_id", "left_semi")
    got = p.odds(spark, sf, some)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 9 * some.count()


def test_packs_have_profiles_of_the_score_model(spark, sf):
    models = spark.createDataFrame([(1, 3, 0.25, -0.5, 0.1, 0.2, -0.05)], MODEL)
    own = _team_packs(spark, sf, models)[1].select("comp", "team", "pack.attack", "pack.defence").distinct().collect()
    assert {r.comp for r in own} == set(range(5))
    for r in own:
        want = (None, None) if r.comp != 1 else (math.exp(0.25), math.exp(-0.5)) if r.team == 3 else (1.0, 1.0)
        assert (r.attack, r.defence) == want


def test_documents_are_of_fitted_score_models(spark, sf):
    m = p.matches(spark, sf)
    models = fc.dixon_coles_at(m, NOW)
    team = {(r.comp, r.team): r for r in models.collect()}
    fitted = {comp for comp, _ in team}
    assert 0 < len(fitted) < 5
    known = {r.event_id: r for r in upcoming._fixtures(m).collect()}
    for r in upcoming.QUERIES["stat_packs"](spark, sf).collect():
        x = known[r.event_id]
        assert (r.attack is not None) == (r.defence is not None) == (x.comp in fitted)
        if x.comp in fitted:
            effect = lambda side, k: getattr(team[x.comp, side], k) if (x.comp, side) in team else 0.0  # noqa: B023, E731
            assert math.isclose(r.attack, math.exp(effect(x.home, "attack")), abs_tol=1e-6) and math.isclose(r.defence, math.exp(effect(x.away, "defence")), abs_tol=1e-6)
