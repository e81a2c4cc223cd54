def test_season_simulation_takes_all_seasons_and_runs(spark, sf):
    from tallyfield.queries.models import QUERIES
    from tallyfield.sources.projections import matches

    m = matches(spark, sf)
    want = {tuple(r) for r in m.filter("status = 'SCHEDULED'").select("comp", "season").distinct().collect()}
    got = QUERIES["season_simulation"](spark, sf).collect()
    assert {(r.comp, r.season) for r in got} == want and len({s for _, s in want}) > 1
    total = {}
    for r in got:
        total[r.comp, r.season, r.team] = total.get((r.comp, r.season, r.team), 0) + r.share
        assert abs(r.share * 3000 - round(r.share * 3000)) < 1e-6
    assert all(abs(x - 1) < 1e-9 for x in total.values())
    assert any(abs(r.share * 100 - round(r.share * 100)) > 1e-6 for r in got)
    teams = {(r.comp, r.season, x) for r in m.filter("status = 'SCHEDULED'").collect() for x in (r.home, r.away)}
    assert teams <= total.keys()


def test_race_simulation_takes_all_runs(spark, sf):
    from tallyfield.queries.models import QUERIES

    got = [x for r in QUERIES["race_simulation"](spark, sf).collect() for x in (r.win, r.podium, r.top10)]
    assert all(abs(x * 5000 - round(x * 5000)) < 1e-6 for x in got)
    assert any(abs(x * 1000 - round(x * 1000)) > 1e-6 for x in got)
