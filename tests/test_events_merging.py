"""Reports onto stored events and merges of entities, against plain loops."""

import random

from pyspark.sql import functions as F

from tallyfield.operators import events as e
from tallyfield.operators import merging as m
from tallyfield.plans.fits import similarity

STORED = "event_id long, comp int, home int, away int, starts double, status string, result string, round string, minute int, referee string, venue string, format string, ids map<string,string>"
REPORT = "ref long, provider string, ext string, comp int, home int, away int, starts double, status string, result string, round string, minute int, referee string, venue string, format string"


def greedy(reports, stored, window=36.0):
    """Named ids first, then the nearest pair of all, again and again."""
    out, claims = {}, {}
    for r in reports:
        own = [(abs(r[6] - s[4]), s[0]) for s in stored if s[1:4] == r[3:6] and s[12].get(r[1]) == r[2] and abs(r[6] - s[4]) <= window]
        if own:
            claims.setdefault(min(own)[1], []).append(r[0])
    for event, refs in claims.items():
        out[min(refs)] = event
    pairs = sorted((abs(r[6] - s[4]), s[0], r[0]) for r in reports for s in stored if s[1:4] == r[3:6] and abs(r[6] - s[4]) <= window)
    for _, event, ref in pairs:
        if ref not in out and event not in out.values():
            out[ref] = event
    return out


def test_assignment_with_rivals(spark):
    rng = random.Random(2)
    for trial in range(3):
        stored = [(k, 1, rng.randrange(2), 2 + rng.randrange(2), float(rng.randrange(400)), "SCHEDULED", None, None, None, None, None, None, {"a": f"x{k}"} if k % 3 else {}) for k in range(40)]
        starts = rng.sample(range(4000), 60)
        reports = [(k, "ab"[k % 2], f"x{rng.randrange(45)}", 1, rng.randrange(2), 2 + rng.randrange(2), starts[k] / 10 + 0.00137 * k + 0.01 * trial, "FINISHED", None, None, None, None, None, None) for k in range(60)]
        got = {r.ref: r.event_id for r in e.assigned(spark.createDataFrame(reports, REPORT), spark.createDataFrame(stored, STORED)).collect()}
        assert len(set(got.values())) == len(got)
        assert got == greedy(reports, stored), trial


def test_upsert_patches(spark):
    stored = [
        (1, 1, 1, 2, 100.0, "FINISHED", "2-1", "R1", 90, None, "old", None, {"a": "1"}), (2, 1, 1, 3, 100.0, "SCHEDULED", None, "R1", None, "ref", None, None, {"b": "9"}),
        (5, 1, 4, 3, 100.0, "LIVE", "0-0", None, 10, None, None, None, {}),
    ]
    reports = [
        (10, "a", "1", 1, 1, 2, 110.0, "SCHEDULED", "9-9", "R2", None, "new", "v", "f"), (11, "a", "7", 1, 1, 3, 100.01, "LIVE", "1-0", None, 5, "x", "v", None),
        (12, "a", "8", 1, 4, 3, 130.0, "FINISHED", "0-2", None, 90, None, None, None), (13, "a", "9", 1, 4, 3, 500.0, "SCHEDULED", None, None, None, None, None, None), (14, "a", "10", 1, 4, 4, 100.0, "LIVE", None, None, None, None, None, None),
    ]
    got = {r.event_id: r for r in e.upsert_events(spark.createDataFrame(stored, STORED), spark.createDataFrame(reports, REPORT)).collect()}
    assert set(got) == {1, 2, 5, 6}
    assert (got[1].status, got[1].starts, got[1].result, got[1].round, got[1].minute, got[1].referee, got[1].venue, got[1].action) == ("FINISHED", 100.0, "2-1", "R2", 90, "new", "old", "updated")
    assert (got[2].status, got[2].starts, got[2].result, got[2].referee, got[2].venue, got[2].ids) == ("LIVE", 100.0, "1-0", "ref", "v", {"a": "7", "b": "9"})
    assert (got[5].status, got[5].starts, got[5].result, got[5].minute, got[5].ids) == ("FINISHED", 130.0, "0-2", 90, {"a": "8"})
    assert (got[6].action, got[6].starts, got[6].ids) == ("inserted", 500.0, {"a": "9"})
    empty = spark.createDataFrame([], STORED), spark.createDataFrame([], REPORT)
    assert e.upsert_events(*empty).count() == 0
    assert e.upsert_events(empty[0], spark.createDataFrame(reports, REPORT)).filter("action = 'inserted'").count() == 4


def test_sides_by_alias(spark):
    cur = spark.createDataFrame([(1, 7, "old", "a"), (2, 7, "stays", "a")], "event_id long, team int, stats string, source string")
    reports = spark.createDataFrame([(1, "a", "t7", 1, "first"), (1, "a", "t7", 2, "second"), (3, "b", "t8", 1, "new"), (3, "b", "nobody", 9, "gone")], "event_id long, provider string, ext string, at int, stats string")
    aliases = spark.createDataFrame([("a", "t7", 7), ("b", "t8", 8)], "provider string, ext string, team int")
    got = sorted(map(tuple, e.upsert_sides(cur, reports, aliases, ["stats"]).collect()))
    assert got == [(1, 7, "second", "a"), (2, 7, "stays", "a"), (3, 8, "new", "b")]


def test_chains_and_cycles(spark):
    rng = random.Random(6)
    for n, edges in ((1, []), (60, [(k, k + 1) for k in range(50)]), (12, [(k, (k + 1) % 9) for k in range(9)] + [(20, 3), (21, 20)]), (200, [(k, rng.randrange(200)) for k in range(200)])):
        nxt = {}
        for a, b in edges:
            nxt[a] = min(nxt.get(a, b), b)
        want = {}
        for a in nxt:
            seen, x = [], a
            while x in nxt and x not in seen:
                seen.append(x)
                x = nxt[x]
            end = x if x not in nxt else min(seen[seen.index(x) :])
            if end != a:
                want[a] = end
        got = m.final_ids(spark.createDataFrame(edges, "from long, into long"))
        assert {r["from"]: r["into"] for r in got.collect()} == want, n


def test_merged_tables(spark):
    merges = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "from long, into long")
    ratings = spark.createDataFrame([(1, 10, 1500.0, 5), (3, 10, 1600.0, 4), (2, 11, 1.0, 1), (3, 11, 2.0, 1), (4, 10, 7.0, 1)], "team long, as_of int, value double, at int")
    events = spark.createDataFrame([(100, 1, 4), (101, 2, 3)], "event_id long, home long, away long")
    teams = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "team long")
    out = m.merge_entities(merges, {"ratings": (ratings, ["team"], ["team", "as_of"], ["at"]), "events": (events, ["home", "away"], None, None)}, teams)
    assert sorted(map(tuple, out["ratings"].collect())) == [(3, 10, 1500.0, 5), (3, 11, 2.0, 1), (4, 10, 7.0, 1)]
    assert sorted(map(tuple, out["events"].collect())) == [(100, 3, 4), (101, 3, 3)]
    assert sorted(r.team for r in out["team"].collect()) == [3, 4]


def test_unmatched_teams(spark):
    names = ["Arsenal", "Arsenal FC", "Arsenall", "Chelsea", "Chelsae", "Everton", "Everton", "Leeds", "Burnley"]
    teams = [(k, n, "football" if k != 6 else "rugby") for k, n in enumerate(names)]
    aliases = [(0, "a"), (0, "b"), (1, "a"), (2, "a"), (2, "a"), (3, "a"), (3, "c"), (4, "b"), (5, "a"), (6, "a"), (7, "a")]
    got = {r.team: (r.match, round(r.sim, 9)) for r in m.unmatched(spark.createDataFrame(teams, "team long, name string, sport string"), spark.createDataFrame(aliases, "team long, provider string")).collect()}
    plain = [n.lower().replace(" fc", "") for n in names]
    want = {}
    for k, (_, _, sport) in enumerate(teams):
        if len({p for t, p in aliases if t == k}) > 1:
            continue
        best = sorted((-similarity(plain[k], plain[j]), j) for j in range(len(names)) if j != k and teams[j][2] == sport and similarity(plain[k], plain[j]) >= 0.86)
        if best:
            want[k] = (best[0][1], round(-best[0][0], 9))
    assert got == want and len(want) >= 3
