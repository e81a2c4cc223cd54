"""Queries on forecasts of matches to come, with the ratings' fold in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.operators import evidence as ev
from tallyfield.operators import features as fe
from tallyfield.operators import probability as pr
from tallyfield.operators import tables as t
from tallyfield.plans import evaluate, fits, logistic, walk
from tallyfield.plans import forecast as fc
from tallyfield.queries.tables import _ROWS
from tallyfield.queries.walk import feature_rows
from tallyfield.scratch import folder, save
from tallyfield.sources import projections as p
from tallyfield.sources.projections import rounded, rsql, with_sql

c = F.col
AS_OF = 10_000


def _matches(s, d):
    """The matches as a table of their own, since a forecast looks at them from many sides."""
    return save(p.matches(s, d), "matches")


def _fixtures(m):
    return m.filter((c("status") == "SCHEDULED") & (c("day") >= AS_OF))


def _market(s, d, fixtures):
    """Implied shares of the books' prices of the fixtures, where there are all three."""
    x = pr.consensus(p.odds(s, d, fixtures)).groupBy("event_id").agg(*(F.max(F.when(c("outcome") == o, c("p"))).alias(o) for o in ("HOME", "DRAW", "AWAY")))
    return x.select("event_id", F.array("HOME", "DRAW", "AWAY").alias("market"))


def _out(s, d):
    """Players out, of the tables' own injuries: customers with less than nothing on their account are out of their nation's team."""
    x = p.table(s, d, "customer").select(c("c_nationkey").cast("int").alias("team"), F.when(c("c_acctbal") < -500, "OUT").when(c("c_acctbal") < 0, "DOUBTFUL").otherwise("FIT").alias("status"), F.lit(None).cast("int").alias("resolved"))
    return fc.absences(x)


def _ratings(s, d):
    h = fits.elo_history(p.matches(s, d))
    return h.select("comp", "event_id", *(rounded(c(k)).alias(k) for k in ("r_home", "r_away", "expected", "foreseen")))


def _parameters(s, d):
    """Ratings, draw shares and margins of all competitions, from a store that has none yet: the first pass fits, the second reads."""
    m, store = _matches(s, d), folder(s, "parameters")
    comps = m.select("comp").distinct()
    done = m.filter(c("day") < AS_OF)
    own = lambda x, comps: x.join(comps, "comp", "left_semi")
    history = save(fits.elo_days(done), "elo")  # the fold of all matches, which both fits read
    elo = lambda now: fc.fit_or_load(store, "elo", comps, now, lambda todo: fc.ratings_at(own(done, todo), AS_OF, own(history, todo)))
    base = lambda now: fc.fit_or_load(store, "draw_base", comps, now, lambda todo: fits.draw_base(own(done, todo), own(history, todo)))
    elo(AS_OF), base(AS_OF)
    ratings, bases = elo(AS_OF + 0.2), base(AS_OF + 0.2)
    margins = fc.fit_or_load(store, "margin", comps, AS_OF, lambda todo: fc.margin_at(own(done, todo), ratings, AS_OF))
    return m, ratings, bases, margins


def _score_models(s, m):
    """The fitted score models of all competitions with enough matches, likewise from a store that has none yet."""
    done = m.filter(c("day") < AS_OF)
    return fc.fit_or_load(folder(s, "parameters"), "dixon_coles", m.select("comp").distinct(), AS_OF, lambda todo: fc.dixon_coles_at(done.join(todo, "comp", "left_semi"), AS_OF))


def _shares(df, *names, n=3):
    return df.withColumns({f"{m}{k}": rounded(F.get(m, F.lit(k))) for m in names for k in range(n)}).drop(*names)


def _event_forecasts(s, d):
    m, ratings, bases, margins = _parameters(s, d)
    x = fc.league_forecasts(_fixtures(m), m, AS_OF, ratings, bases, margins=margins, market=_market(s, d, _fixtures(m)), out=_out(s, d), temperature=1.1)
    text = F.array_join(F.transform("factors", lambda z: F.concat(z.key, F.lit(" "), F.printf(F.lit("%.1f"), z.effect))), ", ")
    x = x.select("event_id", "baseline", "elo", "margin", "market", "ensemble", "confidence", rounded(c("exp_home")).alias("exp_home"), rounded(c("exp_away")).alias("exp_away"), text.alias("factors"))
    return _shares(x, "baseline", "elo", "margin", "market", "ensemble")


def _duel_forecasts(s, d):
    m = _matches(s, d)
    ratings = fc.ratings_at(m.filter("hs <> aws"), AS_OF)
    margins = fc.margin_at(m, ratings, AS_OF, has_draws=False)
    served = p.table(s, d, "supplier").filter("s_acctbal > 9000").select(c("s_nationkey").cast("int").alias("team"))
    x = fc.duel_forecasts(_fixtures(m), m, AS_OF, ratings, t.latest_ranks(p.ratings(s, d), AS_OF, 120), margins, served)
    x = x.select("event_id", "elo", "rank", "margin", "ensemble", "favourite", "reason", "evidence", "confidence")
    return _shares(x, "elo", "rank", "margin", "ensemble", n=2)


def _league_forecasts(s, d):
    """All members, with a fitted score model and the feature model."""
    m, ratings, bases, margins = _parameters(s, d)
    rows = save(feature_rows(m.filter(c("day") < AS_OF)), "features")
    return fc.league_forecasts(_fixtures(m), m, AS_OF, ratings, bases, _score_models(s, m), margins, _market(s, d, _fixtures(m)), _out(s, d), logistic.fit(rows, fe.FEATURES))


def _walk_evaluations(s, d):
    """Finished matches scored by what the walk-forward run said of them before: each model's forecast is a version made at the
    start of its week."""
    m = _matches(s, d)
    w = walk.walk_forward(walk.member_rows(m))
    each = F.array(*(F.struct(F.lit(k).alias("model"), c(k).alias("p")) for k in (*walk.MEMBERS, "ensemble", "chosen")))
    x = w.select("event_id", (c("chunk") * walk.WEEK).alias("created"), F.inline(each)).filter(c("p").isNotNull())
    none = F.lit(None).cast("int")
    x = x.select("event_id", "model", F.lit(1).alias("version"), "created", *(F.get("p", F.lit(k)).alias(f"p{k}") for k in range(3)), F.lit(False).alias("evaluated"), none.alias("likely_h"), none.alias("likely_a"))
    return evaluate.evaluate(m.select("event_id", c("day").alias("starts"), "status", "hs", "aws"), x)


def _ties_of_history(s, d):
    """Tie-breaks of two-way forecasts by ratings, from published ranks, form, meetings and matches on record, for each match to
    come whose shares lie within two points."""
    m = _matches(s, d)
    ratings = fc.ratings_at(m.filter("hs <> aws"), AS_OF)
    margins = fc.margin_at(m, ratings, AS_OF, has_draws=False)
    none = p.table(s, d, "supplier").filter("s_suppkey < 0").select(c("s_nationkey").cast("int").alias("team"))
    x = fc.duel_forecasts(_fixtures(m), m, AS_OF, ratings, t.latest_ranks(p.ratings(s, d), AS_OF, 120), margins, none, weights={"elo": 1.0})
    return x.filter(c("reason").isNotNull()).groupBy("comp", "favourite", "reason").agg(F.count("*").alias("n"))


def _due(s, d):
    """What a pass at a day forecasts: versions are line items, each made so many minutes before the start."""
    o = p.table(s, d, "orders")
    at = F.datediff(c("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")) * 1440 + c("o_custkey") % 1440
    status = F.when(c("o_orderstatus") == "O", "SCHEDULED").otherwise("FINISHED").alias("status")
    fixtures = o.select(c("o_orderkey").alias("event_id"), at.alias("starts"), status, (c("o_orderpriority") != "5-LOW").alias("followed"))
    v = p.table(s, d, "lineitem").filter(c("l_returnflag") != "N").select(c("l_orderkey").alias("event_id"), c("l_linenumber").alias("version"), (2880 - c("l_linenumber") * 420).alias("minutes_before"))
    v = v.groupBy("event_id", "version").agg(F.max("minutes_before").alias("minutes_before"))
    now = F.lit(AS_OF * 1440)
    return fc.due(fixtures, v, now, horizon=60 * 1440)


def _packs(s, d):
    """Statistics documents of all matches to come, written as JSON and read back: teams' packs once for each table that matches to
    come belong to, then what each match adds to its sides' packs."""
    from tallyfield.plans import packs

    m, ratings, bases, margins = _parameters(s, d)
    fx = _fixtures(m)
    pairs = fc.matchups(fx)
    injured = p.table(s, d, "customer").filter("c_acctbal < -900").select(c("c_nationkey").cast("int").alias("team"), c("c_name").alias("player"), F.lit("OUT").alias("status"), F.lit(None).cast("int").alias("resolved"))
    news = p.table(s, d, "supplier").select(c("s_nationkey").cast("int").alias("team"), c("s_name").alias("title"), c("s_acctbal").alias("published"))
    models = _score_models(s, m)
    teams = pairs.select("comp", "season", F.explode(F.array("home", "away")).alias("team")).distinct()
    own = packs.team_packs(m, AS_OF, ratings, models, injured, news).join(teams, packs.TABLE, "left_semi")
    one = lambda a: F.coalesce(F.get(c(a), F.lit(0)), F.lit("none"))
    shown = F.struct(
        c("q.position").alias("position"), c("q.points").alias("points"), c("q.form").alias("form"), rounded(c("q.elo")).alias("elo"), rounded(c("q.attack")).alias("attack"), rounded(c("q.defence")).alias("defence"), F.size("q.recent").alias("n_recent"), one("q.recent").alias("recent"),
        F.size("q.injuries").alias("n_injuries"), one("q.headlines").alias("headline"), F.size("q.headlines").alias("n_headlines"), c("same").alias("same"),
    )
    sides = save(packs.team_parts(own).select(*packs.TABLE, shown.alias("pack")), "packs")
    members = fc.league_members(pairs, m, AS_OF, ratings, bases, models, margins, _out(s, d))
    for side in ("home", "away"):
        members = members.join(sides.select("comp", "season", c("team").alias(side), c("pack").alias(f"pack_{side}")), ["comp", "season", side], "left")
    members = members.withColumns({"one": F.least("home", "away"), "two": F.greatest("home", "away")}).join(packs.meeting_lists(m, AS_OF), ["one", "two"], "left").drop("one", "two")
    x = fc.pooled(fx, save(members, "members"), _market(s, d, fx), temperature=1.1)
    back = packs.event_parts(x, ["event_id", "pack_home", "pack_away"])
    home, away = (lambda k: c(f"pack_home.{k}").alias(k)), (lambda k: c(f"pack_away.{k}").alias(k))
    return back.select(
        "event_id", c("q.kickoff").alias("kickoff"), home("position"), away("points"), home("form"), away("elo"), home("attack"), away("defence"), c("q.home.rest_days").alias("rest"),
        home("n_recent"), home("recent"), home("n_injuries"), away("headline"), away("n_headlines"), F.array_join("q.meetings", "; ").alias("meetings"),
        rounded(F.get("q.algorithm.probabilities", F.lit(0))).alias("p_home"), F.size("q.algorithm.factors").alias("n_factors"), (c("same") & c("pack_home.same") & c("pack_away.same")).alias("same"),
    )


QUERIES = {
    "stat_packs": _packs,
    "elo_ratings": _ratings, "event_forecasts": _event_forecasts, "duel_forecasts": _duel_forecasts, "league_forecasts": _league_forecasts,
    "walk_evaluations": _walk_evaluations, "ties_of_history": _ties_of_history, "due_forecasts": _due,
}


def _fold(where: str) -> str:
    """The ratings' fold as a recursion over each competition's matches in order: lists of rating, last season and games by team."""
    at = lambda x, i: f"{x}[{i} + 1]"
    drawn = lambda side: f"CASE WHEN {at('q', f'o.{side}')} IS NOT NULL AND {at('q', f'o.{side}')} <> o.season THEN {at('r', f'o.{side}')} + (1500 - {at('r', f'o.{side}')}) / 3.0::DOUBLE ELSE {at('r', f'o.{side}')} END"
    k = "20 * CASE WHEN hs = aws THEN 1 ELSE 2.2::DOUBLE * ln(abs(hs - aws) + 1) / (2.2::DOUBLE + 0.001::DOUBLE * CASE WHEN hs > aws THEN d ELSE -d END) END"
    return f"""
      ord AS (SELECT comp, event_id, day, season, home, away, hs, aws, row_number() OVER (PARTITION BY comp ORDER BY day, event_id) AS n FROM matches WHERE status = 'FINISHED' AND {where}),
      elo AS (
        SELECT DISTINCT comp, 0::BIGINT AS n, 0::BIGINT AS event_id, [1500.0::DOUBLE FOR i IN range(25)] AS r, [NULL::INT FOR i IN range(25)] AS q, [0::BIGINT FOR i IN range(25)] AS g, 0.0::DOUBLE AS e, 0.0::DOUBLE AS e0 FROM ord
        UNION ALL
        SELECT comp, n, event_id, [CASE i WHEN home THEN rh + m WHEN away THEN ra - m ELSE r[i + 1] END FOR i IN range(25)], [CASE WHEN i IN (home, away) THEN season ELSE q[i + 1] END FOR i IN range(25)],
               [CASE WHEN i IN (home, away) THEN g[i + 1] + 1 ELSE g[i + 1] END FOR i IN range(25)], e, e0
        FROM (SELECT *, {k} * (CASE WHEN hs > aws THEN 1 WHEN hs = aws THEN 0.5::DOUBLE ELSE 0 END - e) AS m FROM (
          SELECT *, 1 / (1 + pow(10.0::DOUBLE, -d / 400)) AS e FROM (
            SELECT *, rh + 60 - ra AS d FROM (
              SELECT o.*, r, q, g, {drawn("home")} AS rh, {drawn("away")} AS ra, 1 / (1 + pow(10.0::DOUBLE, -({at("r", "o.home")} + 60 - {at("r", "o.away")}) / 400)) AS e0
              FROM elo JOIN ord o ON o.comp = elo.comp AND o.n = elo.n + 1))))),
      state AS (SELECT comp, arg_max(r, n) AS r, arg_max(g, n) AS g FROM elo GROUP BY comp)"""


def _recursive(names: str, query: str) -> str:
    return with_sql(names, query).replace("WITH ", "WITH RECURSIVE ", 1)


_FX = f"fx AS (SELECT * FROM matches WHERE status = 'SCHEDULED' AND day >= {AS_OF})"


def _last_form(n: int, where: str, name: str) -> str:
    return f"""{name} AS (SELECT team, count(*) AS k, avg(CASE WHEN scored > conceded THEN 3.0::DOUBLE WHEN scored = conceded THEN 1 ELSE 0 END) AS ppg, avg((scored - conceded)::DOUBLE) AS gdpg, max(day) AS last_day
        FROM (SELECT * FROM sides WHERE status = 'FINISHED' AND day < {AS_OF} AND {where} QUALIFY row_number() OVER (PARTITION BY team ORDER BY day DESC, event_id DESC) <= {n}) GROUP BY team)"""


def _meetings(where: str) -> str:
    return f"""mt AS (SELECT one, two, avg(won) AS edge FROM (
        SELECT least(home, away) AS one, greatest(home, away) AS two, (sign(hs - aws) * CASE WHEN home < away THEN 1 ELSE -1 END)::DOUBLE AS won FROM matches WHERE status = 'FINISHED' AND day < {AS_OF} AND {where}
        QUALIFY row_number() OVER (PARTITION BY least(home, away), greatest(home, away) ORDER BY day DESC, event_id DESC) <= 6) GROUP BY ALL)"""


def _margin_sql(where: str) -> str:
    return f"""
      hg AS (SELECT m.comp, coalesce(r[home + 1], 1500) - coalesce(r[away + 1], 1500) AS gap, (hs - aws)::DOUBLE AS margin, (hs + aws)::DOUBLE AS total FROM matches m JOIN state ON state.comp = m.comp WHERE status = 'FINISHED' AND day < {AS_OF} AND {where}),
      mo AS (SELECT comp, count(*) AS n, avg(gap) AS mg, avg(margin) AS mm, covar_pop(gap, margin) AS cov, var_pop(gap) AS var, var_pop(margin) AS vm, avg(total) AS total FROM hg GROUP BY comp),
      ms AS (SELECT *, CASE WHEN var > 0 THEN greatest(0.005::DOUBLE, cov / var) ELSE 0.04::DOUBLE END AS slope0 FROM mo),
      mp AS (SELECT comp, CASE WHEN n < 20 THEN 0.04::DOUBLE ELSE slope0 END AS slope, CASE WHEN n < 20 THEN 0.35::DOUBLE ELSE mm - slope0 * mg END AS edge, CASE WHEN n < 20 THEN 2.7::DOUBLE ELSE total END AS total,
          CASE WHEN n < 20 THEN 1.6::DOUBLE ELSE greatest(1, sqrt(greatest(0, n * (vm - 2 * slope0 * cov + slope0 * slope0 * var)) / greatest(n - 2, 1))) END AS sigma FROM ms)"""


_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _cdf(x: str) -> str:
    """Normal distribution at x, with a mean and sigma of these names."""
    z = f"(mean - ({x})) / (sigma * sqrt(2.0::DOUBLE))"
    u = f"(1 / (1 + 0.5::DOUBLE * abs({z})))"
    poly = f"{_ERFC[-1]!r}::DOUBLE"
    for a in _ERFC[-2::-1]:
        poly = f"({poly}) * {u} + {a!r}::DOUBLE"
    y = f"{u} * exp(({poly}) - ({z}) * ({z}))"
    return f"0.5::DOUBLE * CASE WHEN {z} >= 0 THEN {y} ELSE 2 - {y} END"


def _pool(members: dict[str, float], n: int, temperature: float) -> str:
    """From columns of lists by member: the pool after temperature and clip."""
    use = {m: f"CASE WHEN {m} IS NOT NULL AND list_min({m}) > 0 THEN {w}::DOUBLE ELSE 0 END" for m, w in members.items()}
    total = " + ".join(f"({x})" for x in use.values())
    logs = [" + ".join(f"CASE WHEN {m} IS NOT NULL AND list_min({m}) > 0 THEN {w}::DOUBLE * ln({m}[{k}]) ELSE 0 END" for m, w in members.items()) for k in range(1, n + 1)]
    powered = f"[pow(greatest(x, 1e-9::DOUBLE), 1 / {temperature}::DOUBLE) FOR x IN b]" if abs(temperature - 1) > 1e-6 else "b"
    return f"""
      po1 AS (SELECT *, CASE WHEN {total} > 0 THEN [{", ".join(f"exp(({x}) / ({total}))" for x in logs)}] ELSE [1.0::DOUBLE / {n} FOR i IN range({n})] END AS a FROM mem),
      po2 AS (SELECT * EXCLUDE (a), [x / list_sum(a) FOR x IN a] AS b FROM po1),
      po3 AS (SELECT * EXCLUDE (b), {powered} AS b FROM po2),
      po4 AS (SELECT * EXCLUDE (b), [least(greatest(x / list_sum(b), 0.02::DOUBLE), 0.96::DOUBLE) FOR x IN b] AS b FROM po3),
      pool AS (SELECT * EXCLUDE (b), [x / list_sum(b) FOR x IN b] AS pool FROM po4)"""


_R2 = "floor(({}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"
_EFFECTS = (
    ("rating", "elo_diff * 400 * 0.09::DOUBLE"), ("home", "60 * 0.09::DOUBLE"), ("form", "(hp - ap) * 2.5::DOUBLE"), ("venue", "(hv - av) * 1.2::DOUBLE"), ("rest", "(hr - ar) * 0.4::DOUBLE"),
    ("h2h", "edge * 2.0::DOUBLE"), ("absences", "(oa - oh) * 1.5::DOUBLE"), ("table", "place * 3.0::DOUBLE"),
)
_BASE = f"""
      bc AS (SELECT comp, count(*) FILTER (hs > aws) AS h, count(*) FILTER (hs = aws) AS dr, count(*) FILTER (hs < aws) AS a, count(*) + 40 AS n FROM (
        SELECT * FROM matches WHERE status = 'FINISHED' AND day < {AS_OF} QUALIFY row_number() OVER (PARTITION BY comp ORDER BY day DESC, event_id DESC) <= 380) GROUP BY comp),
      db AS (SELECT elo.comp, CASE WHEN count(*) < 30 OR sum(1 - abs(2 * e0 - 1)) <= 0 THEN 0.28::DOUBLE ELSE least(greatest(count(*) FILTER (hs = aws) / sum(1 - abs(2 * e0 - 1)), 0.05::DOUBLE), 0.45::DOUBLE) END AS base
        FROM elo JOIN ord ON ord.comp = elo.comp AND ord.n = elo.n GROUP BY elo.comp),
      tb AS (SELECT comp, season, team, row_number() OVER (PARTITION BY comp, season ORDER BY points DESC, diff DESC, goals DESC, team) AS position, count(*) OVER (PARTITION BY comp, season) AS teams FROM (
        SELECT comp, season, team, coalesce(sum(CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END) FILTER (status = 'FINISHED'), 0) AS points, coalesce(sum(scored - conceded) FILTER (status = 'FINISHED'), 0) AS diff,
          coalesce(sum(scored) FILTER (status = 'FINISHED'), 0) AS goals FROM sides WHERE day < {AS_OF} OR status <> 'FINISHED' GROUP BY ALL)),
      ou AS (SELECT c_nationkey AS team, count(*) AS n FROM customer WHERE c_acctbal < -500 GROUP BY 1),
      mk0 AS (SELECT *, 1 / price / sum(1 / price) OVER (PARTITION BY event_id, book) AS q FROM odds WHERE price > 1),
      mk1 AS (SELECT event_id, outcome, avg(q) AS q FROM mk0 GROUP BY ALL),
      mk2 AS (SELECT event_id, outcome, floor(q / sum(q) OVER (PARTITION BY event_id) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS q FROM mk1),
      mk AS (SELECT event_id, [max(q) FILTER (outcome = 'HOME'), max(q) FILTER (outcome = 'DRAW'), max(q) FILTER (outcome = 'AWAY')] AS market FROM mk2 GROUP BY event_id)"""


def _score_sql() -> str:
    """The score models' fit as a recursion over each competition's steps, and ``dcs``: what it says of the pairs of ``fx``.  A step
    looks at sums by pair, on which the rates depend; teams without matches keep no effects and have no part in the means."""
    each = lambda x, over="range(25)", z="i": f"[{x} FOR {z} IN {over}]"
    team = lambda home, away: each(f"coalesce(list_sum([z.{home} FOR z IN u IF z.i = t]), 0) + coalesce(list_sum([z.{away} FOR z IN u IF z.j = t]), 0)", z="t")
    zeros = each("0.0::DOUBLE")
    good = "new > ll"
    return f"""
      ds AS (SELECT comp, home, away, sum(w) AS w, sum(w * hs) AS x, sum(w * aws) AS y, sum(CASE WHEN hs = 0 AND aws = 0 THEN w ELSE 0 END) AS n0, sum(CASE WHEN hs = 0 AND aws = 1 THEN w ELSE 0 END) AS n1,
          sum(CASE WHEN hs = 1 AND aws = 0 THEN w ELSE 0 END) AS n2, sum(CASE WHEN hs = 1 AND aws = 1 THEN w ELSE 0 END) AS n3, count(*) AS n
        FROM (SELECT *, exp(-0.0018::DOUBLE * ({AS_OF} - day)) AS w FROM matches WHERE status = 'FINISHED' AND day < {AS_OF} AND {AS_OF} - day <= 1200) GROUP BY ALL),
      dp AS (SELECT *, greatest(sw, 1) AS total, list_sum([CASE WHEN h THEN 1 ELSE 0 END FOR h IN has]) AS k FROM (
        SELECT *, {each("len([z FOR z IN p IF z.i = t OR z.j = t]) > 0", z="t")} AS has FROM (
          SELECT comp, list({{'i': home, 'j': away, 'w': w, 'x': x, 'y': y, 'n0': n0, 'n1': n1, 'n2': n2, 'n3': n3}} ORDER BY home, away) AS p, sum(n) AS n, sum(w) AS sw, sum(x + y) AS goals FROM ds
          WHERE comp IN (SELECT comp FROM matches WHERE status = 'FINISHED' AND day < {AS_OF} GROUP BY comp HAVING count(*) >= 30) GROUP BY comp))),
      fit AS (
        SELECT comp, 0 AS turn, -1 AS step_no, 0 AS tries, 0.5::DOUBLE AS step, -1e300::DOUBLE AS ll, {zeros} AS a, {zeros} AS d, ln(greatest(0.2::DOUBLE, goals / greatest(2 * sw, 1e-12::DOUBLE))) AS b, 0.2::DOUBLE AS h, -0.05::DOUBLE AS r,
          {zeros} AS ga, {zeros} AS gd, 0.0::DOUBLE AS gb, 0.0::DOUBLE AS gh, 0.0::DOUBLE AS gr, n < 10 OR k < 2 AS ended FROM dp
        UNION ALL
        SELECT comp, turn + 1, CASE WHEN {good} THEN step_no + 1 ELSE step_no END, CASE WHEN {good} THEN 0 ELSE tries + 1 END, CASE WHEN NOT {good} THEN step * 0.5::DOUBLE WHEN step_no < 0 THEN step ELSE least(2.0::DOUBLE, step * 1.2::DOUBLE) END,
          CASE WHEN {good} THEN new ELSE ll END, CASE WHEN {good} THEN a2 ELSE a END, CASE WHEN {good} THEN d2 ELSE d END, CASE WHEN {good} THEN b2 ELSE b END, CASE WHEN {good} THEN h1 ELSE h END, CASE WHEN {good} THEN r1 ELSE r END,
          CASE WHEN {good} THEN {each("na[i + 1] / total - 0.02::DOUBLE * a2[i + 1]")} ELSE ga END, CASE WHEN {good} THEN {each("nd[i + 1] / total - 0.02::DOUBLE * d2[i + 1]")} ELSE gd END,
          CASE WHEN {good} THEN list_sum([z.l + z.m FOR z IN u]) / total ELSE gb END, CASE WHEN {good} THEN list_sum([z.l FOR z IN u]) / total ELSE gh END, CASE WHEN {good} THEN 0.1::DOUBLE * list_sum([z.r FOR z IN u]) / total ELSE gr END,
          CASE WHEN {good} THEN step_no >= 0 AND (new - ll < 1e-7::DOUBLE * greatest(1, abs(new)) OR step_no >= 399) ELSE tries >= 11 END
        FROM (SELECT *, {team("l", "m")} AS na, {team("m", "l")} AS nd FROM (
          SELECT *, list_sum([z.x * z.l + z.y * z.m - z.w * (z.lam + z.mu) + z.n0 * ln(z.t0) + z.n1 * ln(z.t1) + z.n2 * ln(z.t2) + z.n3 * ln(z.t3) FOR z IN q2]) - 0.02::DOUBLE * total / 2 * (list_sum([v * v FOR v IN a2]) + list_sum([v * v FOR v IN d2])) AS new,
            [{{'i': z.i, 'j': z.j, 'l': z.x - z.w * z.lam - z.n0 * z.lam * z.mu * r1 / z.t0 + z.n1 * z.lam * r1 / z.t1, 'm': z.y - z.w * z.mu - z.n0 * z.lam * z.mu * r1 / z.t0 + z.n2 * z.mu * r1 / z.t2,
              'r': z.n1 * z.lam / z.t1 + z.n2 * z.mu / z.t2 - z.n0 * z.lam * z.mu / z.t0 - z.n3 / z.t3}} FOR z IN q2] AS u
          FROM (SELECT *, [{{'i': z.i, 'j': z.j, 'w': z.w, 'x': z.x, 'y': z.y, 'n0': z.n0, 'n1': z.n1, 'n2': z.n2, 'n3': z.n3, 'l': z.l, 'm': z.m, 'lam': exp(z.l), 'mu': exp(z.m), 't0': greatest(1 - exp(z.l) * exp(z.m) * r1, 1e-6::DOUBLE),
              't1': greatest(1 + exp(z.l) * r1, 1e-6::DOUBLE), 't2': greatest(1 + exp(z.m) * r1, 1e-6::DOUBLE), 't3': greatest(1 - r1, 1e-6::DOUBLE)}} FOR z IN q1] AS q2
            FROM (SELECT *, [{{'i': z.i, 'j': z.j, 'w': z.w, 'x': z.x, 'y': z.y, 'n0': z.n0, 'n1': z.n1, 'n2': z.n2, 'n3': z.n3, 'l': b2 + a2[z.i + 1] + d2[z.j + 1] + h1, 'm': b2 + a2[z.j + 1] + d2[z.i + 1]}} FOR z IN p] AS q1
              FROM (SELECT *, {each("CASE WHEN has[i + 1] THEN a1[i + 1] - ma ELSE 0 END")} AS a2, {each("CASE WHEN has[i + 1] THEN d1[i + 1] - md ELSE 0 END")} AS d2, b + step * gb + ma + md AS b2
                FROM (SELECT *, list_sum(a1) / k AS ma, list_sum(d1) / k AS md
                  FROM (SELECT fit.*, p, has, k, total, {each("a[i + 1] + step * ga[i + 1]")} AS a1, {each("d[i + 1] + step * gd[i + 1]")} AS d1, h + step * gh AS h1, least(greatest(r + step * gr, -0.25::DOUBLE), 0.25::DOUBLE) AS r1
                    FROM fit JOIN dp ON dp.comp = fit.comp WHERE NOT ended)))))))),
      sm AS (SELECT comp, arg_max(a, turn) AS a, arg_max(d, turn) AS d, arg_max(b, turn) AS b, arg_max(h, turn) AS h, arg_max(r, turn) AS r FROM fit GROUP BY comp),
      dg AS (SELECT dc, dh, da, lam, mu, attack, defence, i, j, exp(-lam - mu) * pow(lam, i) * pow(mu, j) / factorial(i::INT)::DOUBLE / factorial(j::INT)::DOUBLE
            * greatest(0, CASE WHEN i = 0 AND j = 0 THEN 1 - lam * mu * r WHEN i = 0 AND j = 1 THEN 1 + lam * r WHEN i = 1 AND j = 0 THEN 1 + mu * r WHEN i = 1 AND j = 1 THEN 1 - r ELSE 1 END) AS q
        FROM (SELECT sm.comp AS dc, home AS dh, away AS da, r, exp(b + a[home + 1] + d[away + 1] + h) AS lam, exp(b + a[away + 1] + d[home + 1]) AS mu, exp(a[home + 1]) AS attack, exp(d[away + 1]) AS defence
          FROM (SELECT DISTINCT comp, home, away FROM fx) f JOIN sm ON sm.comp = f.comp), range(11) gi(i), range(11) gj(j)),
      dcs AS (SELECT dc, dh, da, any_value(lam) AS lam, any_value(mu) AS mu, any_value(attack) AS attack, any_value(defence) AS defence,
          [sum(CASE WHEN i > j THEN q ELSE 0 END) / sum(q), sum(CASE WHEN i = j THEN q ELSE 0 END) / sum(q), sum(CASE WHEN i < j THEN q ELSE 0 END) / sum(q)] AS dixon_coles FROM dg GROUP BY dc, dh, da)"""


def _event_sql(scores: bool = False) -> str:
    """scores: with the score models' member and profiles, in whose competitions margins have nothing to say."""
    away, home = _cdf("-0.5::DOUBLE"), f"1 - ({_cdf('0.5::DOUBLE')})"
    effects = ", ".join(f"{{'key': '{k}', 'i': {i}, 'x': {x}, 'e': floor(({x}) * 10 + 0.5::DOUBLE) / 10}}" for i, (k, x) in enumerate(_EFFECTS))
    cols = ", ".join(f"{rsql(f'{m}[{k + 1}]')} AS {m}{k}" for m in ("baseline", "elo", "margin", "market") for k in range(3))
    margin, exp, own, join, profiles = "[ph, 1 - ph - pa, pa]", "(total {} mean) / 2", "", "", ""
    if scores:
        margin, exp, own, join = f"CASE WHEN dixon_coles IS NULL THEN {margin} END", "coalesce({{}}, (total {} mean) / 2)", "dixon_coles, attack, defence,", "LEFT JOIN dcs ON dc = x2.comp AND dh = home AND da = away"
        profiles = f', {rsql("attack")} AS attack, {rsql("defence")} AS defence'
    exp_home, exp_away = (exp.format(sign).format(rate) for sign, rate in (("+", "lam"), ("-", "mu")))
    return _recursive("matches odds", f""", {_fold(f"day < {AS_OF}")}, {_FX}, {_ROWS}, {_margin_sql("true")}, {_BASE},{_score_sql() + "," if scores else ""}
      {_last_form(5, "true", "fo")}, {_last_form(5, "venue = 'H'", "vh")}, {_last_form(5, "venue = 'A'", "va")}, {_meetings("true")},
      x0 AS (SELECT fx.*, coalesce(r[home + 1], 1500) AS rh, coalesce(r[away + 1], 1500) AS ra, coalesce(base, 0.28::DOUBLE) AS base FROM fx LEFT JOIN state ON state.comp = fx.comp LEFT JOIN db ON db.comp = fx.comp),
      x1 AS (SELECT x0.*, edge + slope * (rh - ra) AS mean, sigma, total, 1 / (1 + pow(10.0::DOUBLE, -(rh + 60 - ra) / 400)) AS ex FROM x0 LEFT JOIN mp ON mp.comp = x0.comp),
      x2 AS (SELECT *, base * (1 - abs(2 * ex - 1)) AS dw, {home} AS ph, {away} AS pa FROM x1),
      mem AS (SELECT x2.event_id, x2.day, (rh - ra) / 400 AS elo_diff, {exp_home} AS exp_home, {exp_away} AS exp_away,{own and f" {own}"}
          [(coalesce(bc.h, 0) + 40 * 0.45::DOUBLE) / coalesce(bc.n, 40), (coalesce(bc.dr, 0) + 40 * 0.26::DOUBLE) / coalesce(bc.n, 40), (coalesce(bc.a, 0) + 40 * 0.29::DOUBLE) / coalesce(bc.n, 40)] AS baseline,
          [(1 - dw) * ex, dw, (1 - dw) * (1 - ex)] AS elo, {margin} AS margin, market,
          coalesce(f1.ppg, 1.3::DOUBLE) AS hp, coalesce(f2.ppg, 1.3::DOUBLE) AS ap, coalesce(vh.ppg, 1.3::DOUBLE) AS hv, coalesce(va.ppg, 1.3::DOUBLE) AS av,
          CASE WHEN f1.last_day IS NULL THEN 7 ELSE least(greatest(x2.day - f1.last_day, 1), 14) END AS hr, CASE WHEN f2.last_day IS NULL THEN 7 ELSE least(greatest(x2.day - f2.last_day, 1), 14) END AS ar,
          coalesce(CASE WHEN home < away THEN edge ELSE -edge END, 0) AS edge, coalesce(o1.n, 0) AS oh, coalesce(o2.n, 0) AS oa,
          CASE WHEN t1.position IS NOT NULL AND t2.position IS NOT NULL AND t1.teams > 1 THEN (t2.position - t1.position)::DOUBLE / (t1.teams - 1) ELSE 0 END AS place
        FROM x2 LEFT JOIN bc ON bc.comp = x2.comp LEFT JOIN mk ON mk.event_id = x2.event_id LEFT JOIN fo f1 ON f1.team = home LEFT JOIN fo f2 ON f2.team = away LEFT JOIN vh ON vh.team = home LEFT JOIN va ON va.team = away
          LEFT JOIN mt ON one = least(home, away) AND two = greatest(home, away) LEFT JOIN ou o1 ON o1.team = home LEFT JOIN ou o2 ON o2.team = away
          LEFT JOIN tb t1 ON t1.comp = x2.comp AND t1.season = x2.season AND t1.team = home LEFT JOIN tb t2 ON t2.comp = x2.comp AND t2.season = x2.season AND t2.team = away{join and f" {join}"}),
      {_pool({k: v for k, v in fc.LEAGUE.items() if k in ("baseline", "elo", "margin", "market") or scores and k == "dixon_coles"}, 3, 1.1)},
      fa AS (SELECT event_id, coalesce(string_agg(f.key || ' ' || printf('%.1f', f.e), ', ' ORDER BY -abs(f.e), f.i), '') AS factors FROM (
        SELECT event_id, f FROM (SELECT event_id, unnest([{effects}]) AS f FROM pool) WHERE abs(f.x) >= 0.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY -abs(f.e), f.i) <= 7) GROUP BY event_id)
    SELECT pool.event_id, {cols}, {", ".join(f"{rsql(f'pool[{k + 1}]')} AS ensemble{k}" for k in range(3))}, {_R2.format("(list_max(pool) - 1 / 3.0::DOUBLE) / (1 - 1 / 3.0::DOUBLE)")} AS confidence,
           {rsql("exp_home")} AS exp_home, {rsql("exp_away")} AS exp_away, coalesce(factors, '') AS factors{profiles}
    FROM pool LEFT JOIN fa ON fa.event_id = pool.event_id""")


def _duel_ctes(weights: dict[str, float], served: str) -> str:
    away = _cdf("0.0::DOUBLE")
    seed = lambda s: f"1500 + 400 * 0.4::DOUBLE / ln(10.0::DOUBLE) * ln(100.0::DOUBLE / k{s}.rank)"
    w = lambda s: f"(g[{s} + 1]::DOUBLE / (g[{s} + 1] + 10))"
    seeded = lambda s, k: f"CASE WHEN coalesce(g[{s} + 1], 0) = 0 THEN coalesce({seed(k)}, 1500) ELSE {w(s)} * r[{s} + 1] + (1 - {w(s)}) * coalesce({seed(k)}, r[{s} + 1]) END"
    form = lambda a: f"coalesce({a}.ppg, 1.3::DOUBLE) / 3"
    return f""", {_fold(f"day < {AS_OF} AND hs <> aws")}, {_FX}, {_ROWS}, {_margin_sql("hs <> aws")},
      {_last_form(10, "scored <> conceded", "fo")}, {_meetings("hs <> aws")},
      se AS (SELECT team, count(*) AS n FROM sides WHERE status = 'FINISHED' AND day < {AS_OF} AND scored <> conceded GROUP BY team),
      rk AS (SELECT team, arg_max(value, (as_of, id)) AS rank FROM ratings WHERE as_of <= {AS_OF} AND as_of >= {AS_OF} - 120 GROUP BY team),
      sv AS (SELECT DISTINCT s_nationkey AS team FROM supplier WHERE {served}),
      x1 AS (SELECT fx.event_id, fx.comp, home, away, kh.rank AS kh, ka.rank AS ka, {seeded("home", "h")} AS sh, {seeded("away", "a")} AS sa, edge + slope * (coalesce(r[home + 1], 1500) - coalesce(r[away + 1], 1500)) AS mean, sigma
        FROM fx LEFT JOIN state ON state.comp = fx.comp LEFT JOIN rk kh ON kh.team = home LEFT JOIN rk ka ON ka.team = away LEFT JOIN mp ON mp.comp = fx.comp),
      x2 AS (SELECT *, 1 / (1 + pow(10.0::DOUBLE, -(sh + 60 - sa) / 400)) AS ex, 1 / (1 + exp(-0.4::DOUBLE * (ln(coalesce(ka, 500)::DOUBLE) - ln(coalesce(kh, 500)::DOUBLE)))) AS p0, 1 - ({away}) AS pm FROM x1),
      x3 AS (SELECT *, CASE WHEN kh IS NULL AND ka IS NULL THEN NULL ELSE least(greatest(CASE WHEN kh IS NULL OR ka IS NULL THEN 0.5::DOUBLE + 0.6::DOUBLE * (p0 - 0.5::DOUBLE) ELSE p0 END, 0.05::DOUBLE), 0.95::DOUBLE) END AS pk FROM x2),
      mem AS (SELECT event_id, comp, home, away, kh, ka, [ex, 1 - ex] AS elo, CASE WHEN pk IS NOT NULL THEN [pk, 1 - pk] END AS rank, CASE WHEN sigma IS NOT NULL THEN [pm, 1 - pm] END AS margin FROM x3),
      {_pool(weights, 2, 1.0)},
      y AS (SELECT pool.*, {form("f1")} AS fh, {form("f2")} AS fa, coalesce(CASE WHEN home < away THEN edge ELSE -edge END, 0) AS edge, coalesce(s1.n, 0) AS nh, coalesce(s2.n, 0) AS na, v1.team IS NOT NULL AS vh, v2.team IS NOT NULL AS va
        FROM pool LEFT JOIN fo f1 ON f1.team = home LEFT JOIN fo f2 ON f2.team = away LEFT JOIN mt ON one = least(home, away) AND two = greatest(home, away)
          LEFT JOIN se s1 ON s1.team = home LEFT JOIN se s2 ON s2.team = away LEFT JOIN sv v1 ON v1.team = home LEFT JOIN sv v2 ON v2.team = away),
      z0 AS (SELECT *, abs(pool[1] - pool[2]) >= 0.01::DOUBLE AS clear FROM y),
      z1 AS (SELECT *, CASE WHEN clear THEN pool[1] >= pool[2] WHEN kh <> ka THEN kh < ka WHEN abs(fh - fa) >= 0.02::DOUBLE THEN fh > fa WHEN edge <> 0 THEN edge > 0 WHEN nh <> na THEN nh > na
            ELSE md5(home::VARCHAR) > md5(away::VARCHAR) OR (md5(home::VARCHAR) = md5(away::VARCHAR) AND home <= away) END AS first,
          CASE WHEN clear THEN NULL WHEN kh <> ka THEN 'rank' WHEN abs(fh - fa) >= 0.02::DOUBLE THEN 'form' WHEN edge <> 0 THEN 'meetings' WHEN nh <> na THEN 'matches' ELSE 'nothing' END AS reason,
          CASE WHEN kh IS NOT NULL AND ka IS NOT NULL AND vh AND va AND least(nh, na) >= 20 THEN 'strong' WHEN (kh IS NOT NULL OR ka IS NOT NULL) AND least(nh, na) >= 8 THEN 'moderate' WHEN least(nh, na) >= 3 THEN 'thin' ELSE 'none' END AS evidence FROM z0),
      z2 AS (SELECT *, CASE WHEN first THEN 'HOME' ELSE 'AWAY' END AS favourite, CASE WHEN clear THEN pool WHEN first THEN [0.505::DOUBLE, 1 - 0.505::DOUBLE] ELSE [0.495::DOUBLE, 1 - 0.495::DOUBLE] END AS ensemble FROM z1)"""


def _duel_sql() -> str:
    cols = ", ".join(f"{rsql(f'{m}[{k + 1}]')} AS {m}{k}" for m in ("elo", "rank", "margin", "ensemble") for k in range(2))
    factor = "CASE evidence WHEN 'strong' THEN 1.0::DOUBLE WHEN 'moderate' THEN 0.85::DOUBLE WHEN 'thin' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END"
    confidence = _R2.format(f"(list_max(ensemble) - 0.5::DOUBLE) / 0.5::DOUBLE * {factor}")
    return _recursive("matches ratings", f"""{_duel_ctes(fc.DUEL, "s_acctbal > 9000")}
    SELECT event_id, {cols}, favourite, reason, evidence, {confidence} AS confidence FROM z2""")


def _pack_sql() -> str:
    at = lambda x: f"CAST(CAST(DATE '1970-01-01' + CAST({x} AS INT) AS DATE) AS VARCHAR)"
    base = _event_sql(scores=True).replace("WITH RECURSIVE", "WITH RECURSIVE ev AS (WITH RECURSIVE", 1) + ")"
    return f"""{base}, {with_sql("matches", "").removeprefix("WITH ")}, {_ROWS},
      {_fold(f"day < {AS_OF}").strip()}, {_FX},
      tb AS (SELECT comp, season, team, count(*) FILTER (status = 'FINISHED') AS played, coalesce(sum(CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END) FILTER (status = 'FINISHED'), 0) AS points,
          coalesce(sum(scored - conceded) FILTER (status = 'FINISHED'), 0) AS diff, coalesce(sum(scored) FILTER (status = 'FINISHED'), 0) AS goals FROM sides WHERE day < {AS_OF} OR status <> 'FINISHED' GROUP BY ALL),
      tp AS (SELECT *, row_number() OVER (PARTITION BY comp, season ORDER BY points DESC, diff DESC, goals DESC, team) AS position FROM tb),
      fm AS (SELECT comp, season, team, string_agg(CASE WHEN scored > conceded THEN 'W' WHEN scored < conceded THEN 'L' ELSE 'D' END, '' ORDER BY day, event_id) AS form FROM (
        SELECT * FROM sides WHERE status = 'FINISHED' AND day < {AS_OF} QUALIFY row_number() OVER (PARTITION BY comp, season, team ORDER BY day DESC, event_id DESC) <= 5) GROUP BY ALL),
      rc AS (SELECT team, count(*) AS n, max(day) AS last_day, arg_max(concat(CASE WHEN venue = 'H' THEN 'home to ' ELSE 'away at ' END, opponent, ' ', scored, '-', conceded, ' (', {at("day")}, ')'), (day, event_id)) AS recent FROM (
        SELECT * FROM sides WHERE status = 'FINISHED' AND day < {AS_OF} QUALIFY row_number() OVER (PARTITION BY team ORDER BY day DESC, event_id DESC) <= 5) GROUP BY team),
      mt AS (SELECT least(home, away) AS one, greatest(home, away) AS two, string_agg(concat(home, ' ', hs, '-', aws, ' ', away, ' (', {at("day")}, ')'), '; ' ORDER BY day DESC, event_id DESC) AS meetings FROM (
        SELECT * FROM matches WHERE status = 'FINISHED' AND day < {AS_OF} QUALIFY row_number() OVER (PARTITION BY least(home, away), greatest(home, away) ORDER BY day DESC, event_id DESC) <= 5) GROUP BY ALL),
      ij AS (SELECT c_nationkey AS team, count(*) AS n FROM customer WHERE c_acctbal < -900 GROUP BY 1), hl AS (SELECT s_nationkey AS team, least(count(*), 8) AS n, arg_max(s_name, s_acctbal) AS title FROM supplier GROUP BY 1)
    SELECT fx.event_id, {at("fx.day")} AS kickoff, h.position, a.points, coalesce(fm.form, '') AS form, {rsql("CASE WHEN g[away + 1] > 0 THEN r[away + 1] END")} AS elo, ev.attack, ev.defence, CASE WHEN rc.last_day IS NULL THEN 7 ELSE least(greatest(fx.day - rc.last_day, 1), 14) END AS rest,
      coalesce(rc.n, 0) AS n_recent, coalesce(recent, 'none') AS recent, coalesce(ij.n, 0) AS n_injuries, coalesce(hl.title, 'none') AS headline, coalesce(hl.n, 0) AS n_headlines, coalesce(meetings, '') AS meetings, ev.ensemble0 AS p_home,
      CASE WHEN ev.factors = '' THEN 0 ELSE len(string_split(ev.factors, ', ')) END AS n_factors, true AS same
    FROM fx JOIN ev ON ev.event_id = fx.event_id LEFT JOIN tp h ON h.comp = fx.comp AND h.season = fx.season AND h.team = home LEFT JOIN tp a ON a.comp = fx.comp AND a.season = fx.season AND a.team = away
      LEFT JOIN fm ON fm.comp = fx.comp AND fm.season = fx.season AND fm.team = home LEFT JOIN state ON state.comp = fx.comp LEFT JOIN rc ON rc.team = home LEFT JOIN mt ON one = least(home, away) AND two = greatest(home, away)
      LEFT JOIN ij ON ij.team = home LEFT JOIN hl ON hl.team = away"""


ORACLE_SQL = {
    "stat_packs": _pack_sql(),
    "elo_ratings": _recursive("matches", f""", {_fold("true")}
      SELECT ord.comp, ord.event_id, {rsql("r[home + 1]")} AS r_home, {rsql("r[away + 1]")} AS r_away, {rsql("e")} AS expected, {rsql("e0")} AS foreseen FROM elo JOIN ord ON ord.comp = elo.comp AND ord.n = elo.n"""),
    "event_forecasts": _event_sql(),
    "duel_forecasts": _duel_sql(),
    "ties_of_history": _recursive("matches ratings", f"""{_duel_ctes({"elo": 1.0}, "false")}
      SELECT comp, favourite, reason, count(*) AS n FROM z2 WHERE reason IS NOT NULL GROUP BY ALL"""),
    "due_forecasts": f"""
      WITH f AS (SELECT o_orderkey AS event_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 1440 + o_custkey % 1440 - {AS_OF * 1440} AS left_ FROM orders
          WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'),
        v AS (SELECT l_orderkey AS event_id, max(l_linenumber) AS version, arg_max(2880 - l_linenumber * 420, l_linenumber) AS before FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
        x AS (SELECT f.*, version, before, CASE WHEN left_ <= 60 THEN 2 WHEN left_ <= 1440 THEN 1 ELSE 0 END AS stage FROM f LEFT JOIN v ON v.event_id = f.event_id WHERE left_ BETWEEN -60 AND {60 * 1440})
      SELECT event_id, stage, coalesce(version, 0)::INT + 1 AS version, left_ AS minutes_before FROM x
      WHERE version IS NULL OR (stage > 0 AND before > CASE stage WHEN 2 THEN 60 ELSE 1440 END)""",
}
