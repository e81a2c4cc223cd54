"""Steps that cost much are taken once, and only for rows that need them."""

from tallyfield.plans import fits
from tallyfield.queries import upcoming


def test_parameters_fold_the_matches_once(spark, sf, monkeypatch):
    calls, fold = [], fits.elo_days
    monkeypatch.setattr(fits, "elo_days", lambda m: calls.append(1) or fold(m))
    m, ratings, bases, _ = upcoming._parameters(spark, sf)
    assert len(calls) == 1 and ratings.count() > 0 and bases.count() == m.select("comp").distinct().count()


def test_market_is_worked_out_for_fixtures_alone(spark, sf):
    fixtures = upcoming._fixtures(upcoming._matches(spark, sf))
    got = upcoming._market(spark, sf, fixtures)
    assert 0 < got.count() == fixtures.count() and got.join(fixtures, "event_id", "left_anti").count() == 0
