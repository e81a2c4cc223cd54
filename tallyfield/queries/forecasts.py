"""Queries on serve rates, match statistics, features, evidence, evaluation and on rows as providers write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.operators import evidence as ev
from tallyfield.operators import features as fe
from tallyfield.operators import serve as sv
from tallyfield.operators import statistics as st
from tallyfield.plans import evaluate as e
from tallyfield.plans import fits
from tallyfield.queries.tables import _ROWS
from tallyfield.sources import parsers
from tallyfield.sources import projections as p
from tallyfield.sources.projections import rounded, rsql, with_sql

c = F.col
AS_OF = 10_000
SURFACES = ("Hard", "Clay", "Grass")
KINDS = {"shots": ("normal", 1), "lines": ("count", 0), "possession": ("percent", 0)}
#: Names with letters that decompose in several ways.
NAMES = ("Beşiktaş", "Škoda Plzeň", "Atlético Ñandú", "Ümraniyespor & Club", "FC Łódź", "Élan Çhalon", "Việt Nam", "Ångström IF")


def _r(df, *names):
    return df.withColumns({n: rounded(c(n)) for n in names})


def _pair(s, d):
    """A row for each match with both sides' statistics."""
    w = p.match_stats(s, d).groupBy("event_id").agg(*(F.max(F.when(c("side") == x, c(k))).alias(f"{k}_{x.lower()}") for x in ("HOME", "AWAY") for k in ("shots", "lines")))
    return p.matches(s, d).join(w, "event_id")


def _serve_matches(s, d):
    surface = F.element_at(F.array(*(F.lit(x) for x in SURFACES)), (c("event_id") % 3 + 1).cast("int"))
    won = lambda side, k: F.floor(c(f"shots_{side}") * (50 + (c("event_id") + k) % 20) / 100.0)
    return _pair(s, d).withColumn("surface", surface).withColumns({"home_points": c("shots_home"), "away_points": c("shots_away"), "home_won": won("home", 0), "away_won": won("away", 7)})


def _rates(s, d):
    return sv.serve_rates(sv.serve_samples(_serve_matches(s, d).filter("status = 'FINISHED'")), AS_OF)


def _pairings(s, d):
    fx = _serve_matches(s, d).filter("status = 'SCHEDULED'").select("event_id", "home", "away", "surface")
    return _r(sv.pairing_rates(fx, _rates(s, d)), "p_home", "p_away")


def _forecast(s, d):
    x = p.table(s, d, "part").select(c("p_partkey").alias("id"), ((2 + c("p_partkey") % 97) / 100).alias("s"), (0.5 + c("p_partkey") % 29 / 100).alias("ph"), (0.5 + c("p_partkey") % 23 / 100).alias("pa"), F.when(c("p_partkey") % 2 == 0, 5).otherwise(3).alias("best"))
    return _r(x.select("id", sv.match_forecast(c("s"), c("ph"), c("pa"), c("best")).alias("m")).select("id", "m.*"), "home", "away", "sets_home", "sets_away", "hold_home", "hold_away", "straight", "decider")


def _samples(s, d):
    possession = 45 + c("event_id") % 11
    m = _pair(s, d).filter("status = 'FINISHED'").withColumns({"possession_home": possession, "possession_away": 100 - possession})
    one = lambda team, other, side, k: F.struct(c(team).alias("team"), c(other).alias("opponent"), F.lit(side).alias("side"), F.lit(k).alias("stat"), c(f"{k}_{team}").cast("double").alias("value"))
    rows = F.array(*(one(a, b, a.upper(), k) for a, b in (("home", "away"), ("away", "home")) for k in KINDS))
    return m.select((F.lit(AS_OF) - c("day")).alias("age"), F.explode(rows).alias("x")).select("age", "x.*")


def _stat_league(s, d):
    return _r(st.fit_statistics(_samples(s, d))[0], "home", "away", "sd")


def _stat_teams(s, d):
    return _r(st.fit_statistics(_samples(s, d))[1], "made", "allowed")


def _stat_forecasts(s, d):
    fx = p.matches(s, d).filter((c("status") == "LIVE") & (c("day") >= AS_OF)).select("event_id", "home", "away")
    return st.forecast_statistics(fx, *st.fit_statistics(_samples(s, d)), KINDS)


def _stat_coverage(s, d):
    m = _pair(s, d).filter("day >= 10000")
    actual = m.select("event_id", F.explode(F.array(*(F.struct(F.lit(k).alias("stat"), c(f"{k}_home").cast("double").alias("home"), c(f"{k}_away").cast("double").alias("away")) for k in ("shots", "lines")))).alias("x")).select("event_id", "x.*")
    return _r(st.coverage(st.statistics_error(_stat_forecasts(s, d), actual)), "within", "error")


def _given(s, d):
    return p.matches(s, d).select(
        "event_id", (1500.0 + c("home") * 13).alias("r_home"), (1500.0 + c("away") * 7).alias("r_away"), F.when(c("event_id") % 4 > 0, (c("event_id") % 40 + 20) / 100).alias("p_home"),
        F.when(c("event_id") % 5 > 0, (c("event_id") % 30 + 10) / 100).alias("p_away"), (c("event_id") % 3).alias("out_home"), (c("event_id") % 5).alias("out_away"),
    )


def _features(s, d):
    x = fe.features(p.matches(s, d), _given(s, d))
    return x.select("event_id", *(f.half_up(c(k), 4).alias(k) for k in fe.FEATURES))


def _factors(s, d):
    x = p.table(s, d, "events").select("event_id", *(((c("event_id") * k + c("user_id")) % 41 / 20.0 - 1).alias(n) for k, n in enumerate(("elo_diff", "form_diff", "home_venue", "away_venue", "rest_diff", "edge", "absence_diff", "place_diff"), 1)))
    out = F.transform(fe.top_factors(60.0), lambda z: F.concat(z.key, F.lit(" "), F.printf(F.lit("%.1f"), z.effect)))
    return x.select("event_id", F.array_join(out, ", ").alias("factors"))


def _evidence(s, d):
    m = p.matches(s, d)
    x = ev.evidence(c("event_id") % 31, c("event_id") % 29, c("event_id") % 3 > 0, c("event_id") % 4 > 0, c("event_id") % 5 > 0, c("event_id") % 7 > 0)
    return m.select("event_id", x.alias("x")).select("event_id", "x.*")


def _ties(s, d):
    i = c("event_id")
    home = F.when(i % 3 == 0, 0.6).otherwise(0.5 + (i % 5) / 1000.0)
    null = lambda x, k: F.when(i % k > 0, x)
    x = ev.break_tie(home, 1 - home, (c("home"), c("away")), (null(i % 7, 4), null(i % 5, 2)), ((i % 9) / 100.0, (i % 6) / 100.0), (i % 2).cast("double") * (1 - i % 4), (i % 3, i % 2))
    return _r(p.matches(s, d).select("event_id", x.alias("x")).select("event_id", "x.*"), "home", "away")


def _predictions(s, d):
    x = p.matches(s, d).select("event_id", "day", "hs", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(v).alias("version")) for m in "ab" for v in (1, 2, 3)))).alias("x")).select("event_id", "day", "hs", "x.*")
    a, b, k = 1 + c("event_id") % 7 + c("version"), 1 + c("event_id") % 5, (1 + c("event_id") % 3).cast("double")
    total = a + b + k
    likely = lambda v: F.when(c("model") == "a", v)
    return x.select(
        "event_id", "model", "version", (c("day") - 3 + c("version") + c("event_id") % 3).alias("created"), (a / total).alias("p0"), F.when(c("event_id") % 50 > 0, b / total).alias("p1"), (k / total).alias("p2"),
        ((c("event_id") % 10 == 0) & (c("model") == "a") & (c("version") == 1)).alias("evaluated"), likely(c("hs")).alias("likely_h"), likely((c("event_id") % 4).cast("int")).alias("likely_a"),
    )


def _evaluated(s, d):
    return e.evaluate(p.matches(s, d).select("event_id", c("day").alias("starts"), "status", "hs", "aws"), _predictions(s, d))


def _accents(s, d):
    n = F.concat(F.element_at(F.array(*(F.lit(x) for x in NAMES)), (c("s_suppkey") % len(NAMES) + 1).cast("int")), F.lit(" "), c("s_name"))
    return p.table(s, d, "supplier").select(c("s_suppkey").alias("id"), f.normalise_name(n).alias("name"), f.slug(n).alias("slug"))


def _quantiles(s, d):
    x = p.table(s, d, "part").select(c("p_partkey").alias("id"), ((1 + c("p_partkey") % 98) / 100).alias("q"), (c("p_partkey") % 57 / 4).alias("rate"), (c("p_partkey") % 7 - 3.0).alias("z"))
    return x.select("id", f.poisson_quantile(c("q"), c("rate")).alias("k"), rounded(f.normal_cdf(f.normal_quantile(c("q")), F.lit(0.0), F.lit(1.0))).alias("back"), rounded(F.get(f.softmax(F.array(c("z"), F.lit(0.0), -c("z"))), F.lit(0))).alias("soft"))


def _league_rows(s, d):
    """Matches as a league file has them, with dates in both forms and gaps."""
    at = F.date_add(F.lit("1970-01-01").cast("date"), c("day"))
    i = c("event_id")
    day = F.concat_ws("/", F.when(i % 2 == 0, F.date_format(at, "d")).otherwise(F.date_format(at, "dd")), F.when(i % 3 == 0, F.date_format(at, "M")).otherwise(F.date_format(at, "MM")), F.when(i % 5 == 0, F.concat(F.lit("20"), F.date_format(at, "yy"))).otherwise(F.date_format(at, "yy")))
    text = lambda x, k: F.when(i % k > 0, x.cast("string")).otherwise("")
    return p.matches(s, d).select(
        "event_id", F.when(i % 11 > 0, day).otherwise("").alias("Date"), F.when(i % 7 == 0, "9:05").when(i % 7 == 1, "20:45").alias("Time"), F.concat(F.lit("T"), c("home")).alias("HomeTeam"), F.concat(F.lit("T"), c("away")).alias("AwayTeam"),
        text(c("hs"), 4).alias("FTHG"), text(c("aws"), 6).alias("FTAG"), text(i % 13, 3).alias("HS"), text(i % 12, 2).alias("AS"), *(F.lit("").alias(k) for k in ("HST", "AST", "HC", "AC", "HF", "AF", "HY", "AY", "HR", "AR")),
    )


def _league_file(s, d):
    x = parsers.league_events(_league_rows(s, d))
    return x.groupBy(F.date_format("starts", "yyyy-MM-dd HH:mm").alias("starts"), "home", "away", "hs", "aws", "status", "winner").agg(F.count("*").alias("n"))


def _league_file_stats(s, d):
    x = parsers.league_stats(_league_rows(s, d))
    return x.groupBy("team", *(c("stats")[k].alias(k) for k in ("goals", "shots"))).agg(F.count("*").alias("n"))


def _draw_base(s, d):
    m = p.matches(s, d)
    return fits.draw_base(m, fits.elo_history(m))


QUERIES = {
    "serve_rates": lambda s, d: _r(_rates(s, d), "serve", "ret", "points", "tour"), "pairing_rates": _pairings, "match_forecast": _forecast,
    "stat_league": _stat_league, "stat_teams": _stat_teams, "stat_forecasts": _stat_forecasts, "stat_coverage": _stat_coverage,
    "positions_before": lambda s, d: fe.positions_before(p.matches(s, d)), "features": _features, "top_factors": _factors, "evidence": _evidence, "tie_breaks": _ties,
    "evaluations": lambda s, d: _r(_evaluated(s, d), "brier", "log_loss", "rps"), "exact_rates": lambda s, d: _r(e.exact_rate(_evaluated(s, d)), "rate"),
    "accents": _accents, "quantiles": _quantiles, "league_file": _league_file, "league_file_stats": _league_file_stats, "draw_base": _draw_base,
}

_PAIR = """w AS (SELECT event_id, max(shots) FILTER (side = 'HOME') AS sh, max(shots) FILTER (side = 'AWAY') AS sa, max(lines) FILTER (side = 'HOME') AS lh, max(lines) FILTER (side = 'AWAY') AS la FROM match_stats GROUP BY event_id),
      pair AS (SELECT m.*, sh, sa, lh, la, ['Hard', 'Clay', 'Grass'][m.event_id % 3 + 1] AS surface FROM matches m JOIN w ON w.event_id = m.event_id)"""
_SERVE = f"""{_PAIR},
      b AS (SELECT *, floor(sh * (50 + event_id % 20) / 100.0::DOUBLE) AS wh, floor(sa * (50 + (event_id + 7) % 20) / 100.0::DOUBLE) AS wa FROM pair WHERE status = 'FINISHED' AND sh >= 30 AND sa >= 30 AND {AS_OF} - day BETWEEN 0 AND 900),
      s AS (SELECT home AS player, surface, sh AS serve, wh AS serve_won, sa AS ret, sa - wa AS ret_won, exp(-0.0025::DOUBLE * ({AS_OF} - day)) AS w FROM b
        UNION ALL SELECT away, surface, sa, wa, sh, sh - wh, exp(-0.0025::DOUBLE * ({AS_OF} - day)) FROM b),
      z AS (SELECT (sum(w * serve_won) + 0.62::DOUBLE * 2000) / (sum(w * serve) + 2000) AS base FROM s),
      t AS (SELECT surface, (sum(w * serve_won) + any_value(base) * 2000) / (sum(w * serve) + 2000) AS tour FROM s, z GROUP BY surface),
      o AS (SELECT player, sum(w * serve) AS points, (sum(w * serve_won) + 400 * any_value(base)) / (sum(w * serve) + 400) AS s0, (sum(w * ret_won) + 400 * (1 - any_value(base))) / (sum(w * ret) + 400) AS r0 FROM s, z GROUP BY player),
      h AS (SELECT player, surface, sum(w * serve) AS n, sum(w * serve_won) AS k, sum(w * ret) AS rn, sum(w * ret_won) AS rk FROM s GROUP BY ALL),
      rates AS (SELECT player, '' AS surface, s0 AS serve, r0 AS ret, points, base AS tour FROM o, z
        UNION ALL SELECT o.player, t.surface, (coalesce(k, 0) + 700 * s0 * tour / base) / (coalesce(n, 0) + 700), (coalesce(rk, 0) + 700 * r0 * (1 - tour) / (1 - base)) / (coalesce(rn, 0) + 700), points, tour
          FROM o CROSS JOIN t CROSS JOIN z LEFT JOIN h ON h.player = o.player AND h.surface = t.surface)"""
_CLAMP = "least(greatest({}, 0.35::DOUBLE), 0.9::DOUBLE)"
_R4 = "floor(({}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"
_R2 = "floor(({}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"
_GAME = "{0}*{0}*{0}*{0} * (1 + 4 * (1-{0}) + 10 * (1-{0}) * (1-{0})) + 20 * {0}*{0}*{0} * (1-{0})*(1-{0})*(1-{0}) * ({0}*{0} / ({0}*{0} + (1-{0})*(1-{0})))"
_STATS = f"""{_PAIR},
      q AS (SELECT *, CAST(45 + event_id % 11 AS DOUBLE) AS ph FROM pair WHERE status = 'FINISHED' AND {AS_OF} - day BETWEEN 1 AND 730),
      x AS (SELECT home AS team, away AS opponent, 'HOME' AS side, day, unnest(['shots', 'lines', 'possession']) AS stat, unnest([sh, CAST(lh AS DOUBLE), ph]) AS value FROM q
        UNION ALL SELECT away, home, 'AWAY', day, unnest(['shots', 'lines', 'possession']), unnest([sa, CAST(la AS DOUBLE), 100 - ph]) FROM q),
      u AS (SELECT *, exp(-0.003::DOUBLE * ({AS_OF} - day)) AS w FROM x WHERE value IS NOT NULL),
      lg AS (SELECT stat, sum(w * value) FILTER (side = 'HOME') / sum(w) FILTER (side = 'HOME') AS home, sum(w * value) FILTER (side = 'AWAY') / sum(w) FILTER (side = 'AWAY') AS away,
        sqrt(greatest(0, sum(w * value * value) / sum(w) - pow(sum(w * value) / sum(w), 2))) AS sd FROM u GROUP BY stat),
      fo AS (SELECT team, stat, sum(w * value) AS v, sum(w) AS w FROM u GROUP BY ALL), ag AS (SELECT opponent AS team, stat, sum(w * value) AS v, sum(w) AS w FROM u GROUP BY ALL),
      tm AS (SELECT team, stat, (fo.v + 4 * (home + away) / 2) / (fo.w + 4) / ((home + away) / 2) AS made, (ag.v + 4 * (home + away) / 2) / (ag.w + 4) / ((home + away) / 2) AS allowed
        FROM fo JOIN ag USING (team, stat) JOIN lg USING (stat))"""
_Z = "1.2815515655446004::DOUBLE"
_FC = f"""{_STATS},
      g AS (SELECT m.event_id, lg.stat, CASE WHEN lg.stat = 'possession' THEN least(greatest(50 + ((coalesce(h.made, 1) - 1) * lg.home - (coalesce(a.made, 1) - 1) * lg.away) / 2 + (lg.home - 50), 25.0::DOUBLE), 75.0::DOUBLE)
          ELSE lg.home * coalesce(h.made, 1) * coalesce(a.allowed, 1) END AS mh, lg.away * coalesce(a.made, 1) * coalesce(h.allowed, 1) AS ma, sd
        FROM (SELECT * FROM matches WHERE status = 'LIVE' AND day >= {AS_OF}) m CROSS JOIN lg LEFT JOIN tm h ON h.team = m.home AND h.stat = lg.stat LEFT JOIN tm a ON a.team = m.away AND a.stat = lg.stat),
      g2 AS (SELECT event_id, stat, mh, CASE WHEN stat = 'possession' THEN 100 - mh ELSE ma END AS ma, sd FROM g),
      g3 AS (SELECT event_id, stat, 'home' AS who, mh AS m, sd FROM g2 UNION ALL SELECT event_id, stat, 'away', ma, sd FROM g2),
      po AS (SELECT event_id, stat, who, k, sum(exp(k * ln(greatest(m, 0.01::DOUBLE)) - greatest(m, 0.01::DOUBLE) - lgamma(k + 1.0::DOUBLE))) OVER (PARTITION BY event_id, stat, who ORDER BY k) AS cum FROM g3, range(60) r(k) WHERE stat = 'lines'),
      qu AS (SELECT event_id, stat, who, min(k) FILTER (cum >= 0.1::DOUBLE) AS lo, min(k) FILTER (cum >= 0.9::DOUBLE) AS hi FROM po GROUP BY ALL),
      g4 AS (SELECT g3.*, CASE stat WHEN 'shots' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS tens,
          CASE stat WHEN 'lines' THEN lo WHEN 'possession' THEN greatest(0, m - greatest(3, least(12, CASE WHEN sd > 0 THEN sd * 1.28::DOUBLE ELSE 8 END))) ELSE greatest(0, m - {_Z} * sd) END::DOUBLE AS low,
          CASE stat WHEN 'lines' THEN hi WHEN 'possession' THEN least(100, m + greatest(3, least(12, CASE WHEN sd > 0 THEN sd * 1.28::DOUBLE ELSE 8 END))) ELSE m + {_Z} * sd END::DOUBLE AS high
        FROM g3 LEFT JOIN qu USING (event_id, stat, who)),
      g5 AS (SELECT event_id, stat, who, floor(m * tens + 0.5::DOUBLE) / tens AS m, floor(low * tens + 0.5::DOUBLE) / tens AS low, floor(high * tens + 0.5::DOUBLE) / tens AS high FROM g4),
      fc AS (SELECT event_id, stat, {", ".join(f"max({k}) FILTER (who = '{w}') AS {w}_{n}" for w in ("home", "away") for k, n in (("m", "mean"), ("low", "low"), ("high", "high")))} FROM g5 GROUP BY ALL)"""
_PLACES = f"""{_ROWS},
      dl AS (SELECT comp, season, day, team, sum(CASE WHEN status <> 'FINISHED' THEN 0 WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END) AS points,
        sum(CASE WHEN status = 'FINISHED' THEN scored - conceded ELSE 0 END) AS diff, sum(CASE WHEN status = 'FINISHED' THEN scored ELSE 0 END) AS scored FROM sides GROUP BY ALL),
      gr AS (SELECT * FROM (SELECT DISTINCT comp, season, day FROM dl) JOIN (SELECT DISTINCT comp, season, team FROM dl) USING (comp, season)),
      rn AS (SELECT gr.*, coalesce(sum(points) OVER w, 0) AS points, coalesce(sum(diff) OVER w, 0) AS diff, coalesce(sum(scored) OVER w, 0) AS scored FROM gr LEFT JOIN dl USING (comp, season, day, team)
        WINDOW w AS (PARTITION BY gr.comp, gr.season, gr.team ORDER BY gr.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      places AS (SELECT comp, season, day, team, CAST(row_number() OVER (PARTITION BY comp, season, day ORDER BY points DESC, diff DESC, scored DESC, team) AS INT) AS position, count(*) OVER (PARTITION BY comp, season, day) AS teams FROM rn)"""


def _before(source: str, keys: str, cols: str, n: int) -> str:
    """By keys and day: ``l``, the last ``n`` rows of earlier days, newest first, from at most ``n`` rows of each of ``n`` days, and the
    last such day."""
    return f"""(SELECT {keys}, day, lag(day) OVER w AS prev, coalesce(flatten(list_reverse(list(own) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))), [])[1:{n}] AS l FROM (
        SELECT {keys}, day, list({{{cols}}} ORDER BY event_id DESC)[1:{n}] AS own FROM {source} WHERE status = 'FINISHED' GROUP BY {keys}, day) WINDOW w AS (PARTITION BY {keys} ORDER BY day))"""


def _past(keys: str, n: int = 5) -> str:
    same = " AND ".join(f"b.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    return f"""(SELECT event_id, s.team, s.venue, len(l) AS k, CASE WHEN len(l) > 0 THEN CAST(list_sum([CASE WHEN x.scored > x.conceded THEN 3 WHEN x.scored = x.conceded THEN 1 ELSE 0 END FOR x IN l]) AS DOUBLE) / len(l) ELSE 1.3::DOUBLE END AS ppg,
        CASE WHEN len(l) > 0 THEN CAST(list_sum([x.scored - x.conceded FOR x IN l]) AS DOUBLE) / len(l) ELSE 0.0::DOUBLE END AS gdpg, CASE WHEN prev IS NULL THEN 7 ELSE least(greatest(s.day - prev, 1), 14) END AS rest
        FROM (SELECT * FROM sides WHERE status = 'FINISHED') s JOIN {_before("sides", keys, "'scored': scored, 'conceded': conceded", n)} b ON {same} AND b.day = s.day)"""


_ONE = [("rating", "a * 36.0::DOUBLE"), ("home", "5.4::DOUBLE"), ("form", "b * 2.5::DOUBLE"), ("venue", "(v - y) * 1.2::DOUBLE"), ("rest", "r * 0.4::DOUBLE"), ("h2h", "g * 2.0::DOUBLE"), ("absences", "o * 1.5::DOUBLE"), ("table", "l * 3.0::DOUBLE")]
_R1 = "floor(({}) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"
_STOP = ", ".join(f"'{w}'" for w in f.STOP_WORDS)
ORACLE_SQL = {
    "serve_rates": with_sql("matches match_stats", f""", {_SERVE} SELECT player, surface, {", ".join(f"{rsql(k)} AS {k}" for k in ("serve", "ret", "points", "tour"))} FROM rates"""),
    "pairing_rates": with_sql("matches match_stats", f""", {_SERVE},
      fx AS (SELECT event_id, home, away, surface FROM pair WHERE status = 'SCHEDULED')
      SELECT fx.event_id, fx.home, fx.away, fx.surface, {rsql("CASE WHEN h.points >= 250 AND a.points >= 250 THEN " + _CLAMP.format("h.serve - a.ret + 1 - h.tour") + " END")} AS p_home,
        {rsql("CASE WHEN h.points >= 250 AND a.points >= 250 THEN " + _CLAMP.format("a.serve - h.ret + 1 - h.tour") + " END")} AS p_away
      FROM fx LEFT JOIN rates h ON h.player = fx.home AND h.surface = fx.surface LEFT JOIN rates a ON a.player = fx.away AND a.surface = fx.surface"""),
    "match_forecast": f"""WITH x AS (SELECT p_partkey AS id, CAST(2 + p_partkey % 97 AS DOUBLE) / 100 AS s, 0.5::DOUBLE + CAST(p_partkey % 29 AS DOUBLE) / 100 AS ph, 0.5::DOUBLE + CAST(p_partkey % 23 AS DOUBLE) / 100 AS pa, p_partkey % 2 = 0 AS five FROM part),
      y AS (SELECT *, 1 - s AS t FROM x),
      z AS (SELECT *, CASE WHEN five THEN [(s*s*s, 3, 0), (3*s*s*s*t, 3, 1), (6*s*s*s*t*t, 3, 2), (6*t*t*t*s*s, 2, 3), (3*t*t*t*s, 1, 3), (t*t*t, 0, 3)] ELSE [(s*s, 2, 0), (2*s*s*t, 2, 1), (2*t*t*s, 1, 2), (t*t, 0, 2)] END AS d FROM y),
      q AS (SELECT *, list_sum([CASE WHEN e[2] > e[3] THEN e[1] ELSE 0 END FOR e IN d]) AS win, list_sum([CASE WHEN least(e[2], e[3]) = CASE WHEN five THEN 2 ELSE 1 END THEN e[1] ELSE 0 END FOR e IN d]) AS dec,
        list_sum([e[1] * e[2] FOR e IN d]) AS eh, list_sum([e[1] * e[3] FOR e IN d]) AS ea, list_filter(d, lambda e: e[1] >= list_max([g[1] FOR g IN d]))[1] AS top FROM z)
      SELECT id, {rsql("win")} AS home, {rsql("1 - win")} AS away, {rsql(_R2.format("eh"))} AS sets_home, {rsql(_R2.format("ea"))} AS sets_away, concat(top[2], '-', top[3]) AS likely,
        {rsql(_R4.format(_GAME.format("ph")))} AS hold_home, {rsql(_R4.format(_GAME.format("pa")))} AS hold_away, {rsql(_R4.format("1 - dec"))} AS straight, {rsql(_R4.format("dec"))} AS decider FROM q""",
    "stat_league": with_sql("matches match_stats", f", {_STATS} SELECT stat, {rsql('home')} AS home, {rsql('away')} AS away, {rsql('sd')} AS sd FROM lg"),
    "stat_teams": with_sql("matches match_stats", f", {_STATS} SELECT team, stat, {rsql('made')} AS made, {rsql('allowed')} AS allowed FROM tm"),
    "stat_forecasts": with_sql("matches match_stats", f", {_FC} SELECT * FROM fc"),
    "stat_coverage": with_sql("matches match_stats", f""", {_FC},
      ac AS (SELECT event_id, 'shots' AS stat, sh AS home, sa AS away FROM pair WHERE day >= 10000 UNION ALL SELECT event_id, 'lines', lh, la FROM pair WHERE day >= 10000),
      er AS (SELECT stat, {_R2.format("home - home_mean")} AS h, {_R2.format("away - away_mean")} AS a, home BETWEEN home_low AND home_high AND away BETWEEN away_low AND away_high AS inside FROM fc JOIN ac USING (event_id, stat) WHERE home IS NOT NULL AND away IS NOT NULL)
      SELECT stat, count(*) AS n, {rsql("avg(CAST(inside AS INT)::DOUBLE)")} AS within, {rsql("avg((abs(h) + abs(a)) / 2)")} AS error FROM er GROUP BY stat"""),
    "positions_before": with_sql("matches", f", {_PLACES} SELECT comp, season, day, team, position, teams FROM places"),
    "features": with_sql("matches", f""", {_PLACES}, fo AS MATERIALIZED {_past("team")}, ve AS MATERIALIZED {_past("team, venue")},
      pairs AS (SELECT *, least(home, away) AS one, greatest(home, away) AS two FROM matches),
      meet AS (SELECT event_id, m.home, l FROM (SELECT * FROM pairs WHERE status = 'FINISHED') m JOIN {_before("pairs", "one, two", "'home': home, 'hs': hs, 'aws': aws", 6)} b ON b.one = m.one AND b.two = m.two AND b.day = m.day),
      h2h AS (SELECT event_id, CASE WHEN len(l) > 0 THEN CAST(list_sum([sign(x.hs - x.aws) * CASE WHEN x.home = meet.home THEN 1 ELSE -1 END FOR x IN l]) AS DOUBLE) / len(l) ELSE 0.0::DOUBLE END AS edge FROM meet),
      j AS (SELECT m.event_id AS i, m.home, m.away, fh.ppg AS fhp, fa.ppg AS fap, fh.gdpg AS fhg, fa.gdpg AS fag, vh.ppg AS vhp, va.ppg AS vap, fh.rest AS rh, fa.rest AS ra, fh.k AS kh, fa.k AS ka, h2h.edge AS edge, ph.position AS pph, pa.position AS ppa, ph.teams AS teams
        FROM matches m JOIN fo fh ON fh.event_id = m.event_id AND fh.venue = 'H' JOIN fo fa ON fa.event_id = m.event_id AND fa.venue = 'A' JOIN ve vh ON vh.event_id = m.event_id AND vh.venue = 'H' JOIN ve va ON va.event_id = m.event_id AND va.venue = 'A'
        JOIN h2h ON h2h.event_id = m.event_id JOIN places ph ON (ph.comp, ph.season, ph.day, ph.team) = (m.comp, m.season, m.day, m.home) JOIN places pa ON (pa.comp, pa.season, pa.day, pa.team) = (m.comp, m.season, m.day, m.away) WHERE m.status = 'FINISHED')
      SELECT i AS event_id, {_R4.format("CAST(home * 13 - away * 7 AS DOUBLE) / 400")} AS elo_diff, {_R4.format("CASE WHEN i % 4 > 0 THEN CAST(i % 40 + 20 AS DOUBLE) / 100 ELSE 0.45::DOUBLE END")} AS dc_home,
        {_R4.format("CASE WHEN i % 5 > 0 THEN CAST(i % 30 + 10 AS DOUBLE) / 100 ELSE 0.29::DOUBLE END")} AS dc_away, {_R4.format("fhp - fap")} AS form_diff, {_R4.format("fhg - fag")} AS goals_diff, {_R4.format("vhp")} AS home_venue, {_R4.format("vap")} AS away_venue,
        {_R4.format("CAST(rh - ra AS DOUBLE)")} AS rest_diff, {_R4.format("edge")} AS edge, {_R4.format("CASE WHEN teams > 1 THEN CAST(ppa - pph AS DOUBLE) / (teams - 1) ELSE 0 END")} AS place_diff,
        {_R4.format("CAST(i % 5 - i % 3 AS DOUBLE)")} AS absence_diff, {_R4.format("CAST(least(kh, ka) AS DOUBLE) / 5")} AS experience FROM j"""),
    "top_factors": f"""WITH x AS (SELECT event_id, {", ".join(f"CAST((event_id * {k} + user_id) % 41 AS DOUBLE) / 20 - 1 AS {n}" for k, n in enumerate("abvyrgol", 1))} FROM events),
      e AS (SELECT event_id, unnest([{", ".join(f"({k}, '{n}', {s}, {_R1.format(s)})" for k, (n, s) in enumerate(_ONE))}]) AS e FROM x),
      r AS (SELECT event_id, e, row_number() OVER (PARTITION BY event_id ORDER BY abs(e[4]) DESC, e[1]) AS k FROM e WHERE abs(e[3]) >= 0.3::DOUBLE)
      SELECT event_id, string_agg(concat(e[2], ' ', printf('%.1f', e[4])), ', ' ORDER BY k) AS factors FROM r WHERE k <= 7 GROUP BY event_id""",
    "evidence": with_sql("matches", """, x AS (SELECT event_id AS i, least(event_id % 31, event_id % 29) AS n, event_id % 3 > 0 AS rh, event_id % 4 > 0 AS ra, event_id % 5 > 0 AND event_id % 7 > 0 AS s FROM matches),
      y AS (SELECT i, CASE WHEN rh AND ra AND s AND n >= 20 THEN 'strong' WHEN n >= 8 AND (rh OR ra) THEN 'moderate' WHEN n >= 3 THEN 'thin' ELSE 'none' END AS level FROM x)
      SELECT i AS event_id, level, CASE level WHEN 'strong' THEN 1.0::DOUBLE WHEN 'moderate' THEN 0.85::DOUBLE WHEN 'thin' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS factor FROM y"""),
    "tie_breaks": with_sql("matches", f""", x AS (SELECT event_id AS i, home AS h, away AS a, CASE WHEN event_id % 3 = 0 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE + CAST(event_id % 5 AS DOUBLE) / 1000 END AS p FROM matches),
      y AS (SELECT *, abs(2 * p - 1) >= 0.01::DOUBLE AS clear, CASE WHEN i % 4 > 0 THEN i % 7 END AS rh, CASE WHEN i % 2 > 0 THEN i % 5 END AS ra, CAST(i % 9 AS DOUBLE) / 100 AS fh, CAST(i % 6 AS DOUBLE) / 100 AS fa, (i % 2) * (1 - i % 4) AS e FROM x),
      z AS (SELECT *, CASE WHEN clear THEN NULL WHEN coalesce(rh <> ra, false) THEN 'rank' WHEN abs(fh - fa) >= 0.02::DOUBLE THEN 'form' WHEN e <> 0 THEN 'meetings' WHEN i % 3 <> i % 2 THEN 'matches' ELSE 'nothing' END AS reason FROM y),
      f AS (SELECT *, CASE WHEN CASE WHEN clear THEN p >= 1 - p WHEN reason = 'rank' THEN rh < ra WHEN reason = 'form' THEN fh > fa WHEN reason = 'meetings' THEN e > 0 WHEN reason = 'matches' THEN i % 3 > i % 2
        ELSE md5(CAST(h AS VARCHAR)) > md5(CAST(a AS VARCHAR)) OR (md5(CAST(h AS VARCHAR)) = md5(CAST(a AS VARCHAR)) AND h <= a) END THEN 'HOME' ELSE 'AWAY' END AS favourite FROM z)
      SELECT i AS event_id, favourite, reason, {rsql("CASE WHEN clear THEN p WHEN favourite = 'HOME' THEN 0.505::DOUBLE ELSE 0.495::DOUBLE END")} AS home, {rsql("CASE WHEN clear THEN 1 - p WHEN favourite = 'HOME' THEN 0.495::DOUBLE ELSE 0.505::DOUBLE END")} AS away FROM f"""),
    "accents": f"""WITH x AS (SELECT s_suppkey AS id, concat([{", ".join(f"'{n}'" for n in NAMES)}][s_suppkey % {len(NAMES)} + 1], ' ', s_name) AS n FROM supplier),
      z AS (SELECT id, n, trim(regexp_replace(replace(strip_accents(lower(n)), '&', ' and '), '[^a-z0-9'']+', ' ', 'g')) AS b FROM x),
      k AS (SELECT *, list_filter(string_split(b, ' '), lambda w: w NOT IN ('', {_STOP})) AS kept FROM z)
      SELECT id, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE b END AS name, regexp_replace(regexp_replace(strip_accents(lower(n)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM k""",
    "quantiles": f"""WITH x AS (SELECT p_partkey AS id, CAST(1 + p_partkey % 98 AS DOUBLE) / 100 AS q, CAST(p_partkey % 57 AS DOUBLE) / 4 AS rate, CAST(p_partkey % 7 - 3 AS DOUBLE) AS z FROM part),
      y AS (SELECT id, q, k, sum(CASE WHEN rate <= 0 THEN CAST(k = 0 AS INT) ELSE exp(k * ln(rate) - rate - lgamma(k + 1.0::DOUBLE)) END) OVER (PARTITION BY id ORDER BY k) AS cum FROM x, range(80) r(k)),
      m AS (SELECT id, CAST(min(k) FILTER (cum >= q) AS INT) AS k FROM y GROUP BY id)
      SELECT x.id, m.k, {rsql("q")} AS back, {rsql("exp(z) / (exp(z) + 1 + exp(-z))")} AS soft FROM x JOIN m USING (id)""",
}

_PRED = """pr AS (SELECT event_id, status, day, hs, aws, model, version, day - 3 + version + event_id % 3 AS created, CAST(1 + event_id % 7 + version AS DOUBLE) AS a, CAST(1 + event_id % 5 AS DOUBLE) AS b, CAST(1 + event_id % 3 AS DOUBLE) AS k,
        event_id % 10 = 0 AND model = 'a' AS done FROM matches, (VALUES ('a'), ('b')) m(model), (VALUES (1), (2), (3)) v(version)),
      fi AS (SELECT *, row_number() OVER (PARTITION BY event_id, model ORDER BY CAST(created <= day AS INT) DESC, version DESC) AS r, CASE WHEN hs > aws THEN 0 WHEN hs = aws THEN 1 ELSE 2 END AS o,
        a / (a + b + k) AS p0, b / (a + b + k) AS p1, k / (a + b + k) AS p2 FROM pr WHERE status = 'FINISHED'),
      ok AS (SELECT *, greatest(p0, p1, p2) AS most, [p0, p1, p2][o + 1] AS won, CAST(greatest(p0, p1, p2) - p0 < 1e-9 AS INT) + CAST(greatest(p0, p1, p2) - p1 < 1e-9 AS INT) + CAST(greatest(p0, p1, p2) - p2 < 1e-9 AS INT) AS ties,
        CASE WHEN model = 'a' THEN event_id % 4 = aws END AS exact FROM fi WHERE r = 1 AND NOT done AND event_id % 50 > 0)"""
_H = [f"CAST(o = {k} AS INT)" for k in range(3)]
ORACLE_SQL |= {
    "evaluations": with_sql("matches", f""", {_PRED} SELECT event_id, model, version, {rsql(" + ".join(f"pow(p{k} - {_H[k]}, 2)" for k in range(3)))} AS brier, {rsql("-ln(greatest(0.000001::DOUBLE, won))")} AS log_loss,
      {rsql(f"(pow(p0 - {_H[0]}, 2) + pow(p0 + p1 - {_H[0]} - {_H[1]}, 2)) / 2")} AS rps, ties = 1 AND won = most AS correct, exact FROM ok"""),
    "exact_rates": with_sql("matches", f", {_PRED} SELECT model, count(*) AS n, {rsql('avg(CAST(exact AS INT)::DOUBLE)')} AS rate FROM ok WHERE exact IS NOT NULL GROUP BY model"),
    "league_file": with_sql("matches", """, x AS (SELECT event_id AS i, home, away, hs, aws, DATE '1970-01-01' + CAST(day AS INT) AS dt FROM matches),
      y AS (SELECT *, strftime(make_date(CAST(2000 + year(dt) % 100 AS INT), CAST(month(dt) AS INT), CAST(day(dt) AS INT)), '%Y-%m-%d') AS d, i % 4 > 0 AND i % 6 > 0 AS done FROM x WHERE i % 11 > 0)
      SELECT concat(d, ' ', CASE i % 7 WHEN 0 THEN '09:05' WHEN 1 THEN '20:45' ELSE '15:00' END) AS starts, concat('T', home) AS home, concat('T', away) AS away, CASE WHEN i % 4 > 0 THEN hs END AS hs, CASE WHEN i % 6 > 0 THEN aws END AS aws,
        CASE WHEN done THEN 'FINISHED' ELSE 'SCHEDULED' END AS status, CASE WHEN NOT done THEN NULL WHEN hs > aws THEN 'HOME' WHEN hs < aws THEN 'AWAY' ELSE 'DRAW' END AS winner, count(*) AS n FROM y GROUP BY ALL"""),
    "league_file_stats": with_sql("matches", """, x AS (SELECT event_id AS i, concat('T', home) AS h, concat('T', away) AS a, CASE WHEN event_id % 4 > 0 THEN hs END::DOUBLE AS hg, CASE WHEN event_id % 6 > 0 THEN aws END::DOUBLE AS ag,
        CASE WHEN event_id % 3 > 0 THEN event_id % 13 END::DOUBLE AS sh, CASE WHEN event_id % 2 > 0 THEN event_id % 12 END::DOUBLE AS sa FROM matches), k AS (SELECT * FROM x WHERE hg IS NOT NULL AND sh IS NOT NULL)
      SELECT team, goals, shots, count(*) AS n FROM (SELECT h AS team, hg AS goals, sh AS shots FROM k UNION ALL SELECT a, ag, sa FROM k) GROUP BY ALL"""),
}
