"""Queries on reconciling records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import records as r
from tallyfield.operators import tables as t
from tallyfield.sources import projections as p
from tallyfield.sources.projections import with_sql

c = F.col


def _ranks_as_of(s, d):
    m = t.team_rows(p.matches(s, d)).select("team", "event_id", "venue", "day")
    ra = p.ratings(s, d).groupBy("team", "as_of").agg(F.max_by("value", "id").alias("value"))
    return r.as_of(m, ra, ["team"], "day", "as_of", "as_of").select("team", "event_id", "venue", c("r.value").alias("rank"), c("r.as_of").alias("as_of"))


def _odds_as_of(s, d):
    e = p.table(s, d, "events").select("user_id", "event_id", F.unix_micros(c("ts").cast("timestamp")).alias("at"), "event_type", "value")
    left, right = e.filter("event_type = 'purchase'").drop("event_type", "value"), e.filter("event_type = 'view'").select("user_id", c("at").alias("taken"), c("event_id").alias("view_id"), "value")
    return r.as_of(left, right, ["user_id"], "at", "taken", "view_id", 3 * 86_400_000_000).select("event_id", c("r.view_id").alias("view_id"), c("r.value").alias("value"))


def _nearest(s, d):
    """Each match that is not over, and the nearest one of its pairing that is."""
    m = p.matches(s, d)
    x = m.filter("status <> 'FINISHED'").select("home", "away", (c("day") + c("event_id") % 3).alias("day"), c("event_id").alias("ref"))
    return r.nearest(x, m.filter("status = 'FINISHED'"), ["home", "away"], "day", "day", "event_id", 40).select("ref", "match")


def _upsert(s, d):
    """Of each pairing's season the first match as it stands, and all matches as reports on it."""
    key = (c("home") * 25 + c("away")) * 10_000 + c("season")
    m = p.matches(s, d).select(key.alias("key"), "event_id", "status", c("day").cast("bigint").alias("at"), F.when(c("hs") > 0, c("hs")).alias("score"))
    cur = m.groupBy("key").agg(F.min_by(F.struct("status", "at", "score"), "event_id").alias("x")).select("key", "x.*")
    return r.upsert(cur, m.withColumn("at", c("at") * 10_000_000 + c("event_id")).drop("event_id"), "key", "at")


def _injuries(s, d):
    cu = p.table(s, d, "customer").select(c("c_name").alias("player"), c("c_nationkey").alias("team"), "c_acctbal", c("c_mktsegment").alias("state"))
    listed = cu.filter("c_acctbal >= 0").withColumn("player", F.upper("player")).withColumn("state", F.when(c("c_acctbal") > 8000, "OUT").otherwise(c("state")))
    return r.reconcile(cu.filter("c_acctbal < 5000"), listed, ["player", "team"], "state", F.lit(20_000))


def _resolve(s, d):
    cu = p.table(s, d, "customer")
    names = p.table(s, d, "orders").select("o_orderkey", c("o_custkey").alias("ext"), F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("Customer#"), F.lpad((c("o_custkey") + 1).cast("string"), 9, "0"))).alias("name"))
    ents = cu.select(c("c_custkey").alias("entity"), F.when(c("c_custkey") % 4 > 0, c("c_custkey")).alias("alias"), c("c_name"))
    return r.resolve(names, ents, [("ext", "alias"), ("name", "c_name")]).select("o_orderkey", "entity", "rule")


def _merge(s, d):
    mapping = s.createDataFrame([(k, k - 1) for k in range(1, 25, 3)], "from int, into int")
    return r.remap(p.matches(s, d), mapping, ["home", "away"]).groupBy("home", "away").count()


def _next(s, d):
    e = p.table(s, d, "events").select("user_id", "event_id")
    old = p.table(s, d, "orders").groupBy(c("o_custkey").alias("user_id")).agg(F.count("*").alias("version"))
    return r.next_versions(old, e, "user_id", "event_id")


def _props(s, d):
    e = p.table(s, d, "events")
    m = F.from_json("props", "map<string,string>")
    return e.withColumn("m", m).select("event_id", F.try_to_number(c("m")["k"], F.lit("99999")).cast("int").alias("k"), F.size(F.map_keys("m")).alias("n"), c("m")["none"].isNull().alias("none"))


def _export(s, d):
    from tallyfield.plans.accuracy import score

    f = score(p.forecasts(s, d)).withColumns({n: F.printf(F.lit("%.4f"), F.floor(c(n) * 10000 + 0.5) / 10000) for n in ("brier", "log_loss", "rps")})
    cell = lambda x: F.when(x.rlike("[\",\n]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    line = F.concat_ws(",", c("id").cast("string"), cell(F.concat(c("model"), F.when(c("id") % 2 == 0, ', "x"').otherwise(""))), "brier", "log_loss", "rps")
    return f.select("id", line.alias("line"))


QUERIES = {
    "ranks_as_of": _ranks_as_of, "odds_as_of": _odds_as_of, "nearest_event": _nearest, "event_upsert": _upsert, "injury_reconcile": _injuries,
    "resolve_names": _resolve, "merge_teams": _merge, "next_versions": _next, "json_props": _props, "csv_export": _export,
    "dropped_entrants": lambda s, d: r.dropped(p.races(s, d), p.races(s, d).filter("position <= 20"), ["season", "month", "team"]).select("season", "month", "team", "position"),
    "events_without_stats": lambda s, d: p.matches(s, d).join(p.match_stats(s, d).groupBy("event_id").count().filter("count >= 2"), "event_id", "left_anti").select("event_id", "status"),
    "team_events": lambda s, d: p.matches(s, d).filter(((c("home") == 7) | (c("away") == 7)) & c("status").isin("FINISHED", "LIVE") & c("day").between(9000, 10_000)).select("event_id", "home", "away", "day"),
    "head_to_head_list": lambda s, d: p.matches(s, d).filter((F.least("home", "away") == 3) & (F.greatest("home", "away") == 9)).select("event_id", "home", "away"),
    "team_pairs": lambda s, d: p.matches(s, d).select("comp", c("home").alias("team")).union(p.matches(s, d).select("comp", "away")).distinct(),
    "event_counts": lambda s, d: p.matches(s, d).groupBy("comp", "status").count(),
    "daily_usage": lambda s, d: p.table(s, d, "events").groupBy(c("event_type").alias("provider"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("requests"), F.count_if(c("value") > 9).alias("errors")),
    "stage_due": lambda s, d: p.matches(s, d).select("event_id", F.when(c("status") != "SCHEDULED", "none").when(c("event_id") % 3000 <= 60, "lineup").when(c("event_id") % 3000 <= 1440, "day").otherwise("early").alias("stage")),
    "local_days": lambda s, d: p.table(s, d, "events").groupBy(F.date_format(F.from_utc_timestamp(c("ts").cast("timestamp"), "Asia/Tokyo"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")),
    "weekly_chunks": lambda s, d: p.table(s, d, "events").groupBy(F.floor(F.unix_micros(c("ts").cast("timestamp")) / 604_800_000_000).alias("chunk")).agg(F.count("*").alias("n")),
}

_EXPORT = """, s AS (SELECT id, model, [p0, p1, p2][outcome + 1] AS won, pow(p0 - CAST(outcome = 0 AS INT), 2) AS a, pow(p1 - CAST(outcome = 1 AS INT), 2) AS b, pow(p2 - CAST(outcome = 2 AS INT), 2) AS d,
        pow(p0 + p1 - CAST(outcome < 2 AS INT), 2) AS e FROM forecasts),
      x AS (SELECT id, model, a + b + d AS brier, -ln(greatest(0.000001::DOUBLE, won)) AS log_loss, (a + e) / 2 AS rps FROM s)
      SELECT id, concat(id, ',', CASE WHEN id % 2 = 0 THEN concat(chr(34), model, ', ', chr(34), chr(34), 'x', chr(34), chr(34), chr(34)) ELSE model END, ',', {}) AS line FROM x""".format(
    ", ',', ".join(f"printf('%.4f', floor({k} * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE)" for k in ("brier", "log_loss", "rps"))
)
_RANK = "CASE {} WHEN 'CANCELLED' THEN 4 WHEN 'POSTPONED' THEN 3 WHEN 'FINISHED' THEN 3 WHEN 'LIVE' THEN 2 WHEN 'SCHEDULED' THEN 1 ELSE 0 END"
ORACLE_SQL = {
    "csv_export": with_sql("forecasts", _EXPORT),
    "ranks_as_of": with_sql("matches ratings", """, m AS (SELECT home AS team, event_id, 'H' AS venue, day FROM matches UNION ALL SELECT away, event_id, 'A', day FROM matches),
      r AS (SELECT team, as_of, arg_max(value, id) AS value FROM ratings GROUP BY ALL)
      SELECT m.team, event_id, venue, r.value AS rank, r.as_of FROM m ASOF LEFT JOIN r ON m.team = r.team AND m.day >= r.as_of"""),
    "odds_as_of": """WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, arg_max(event_id, event_id) AS view_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
      SELECT event_id, CASE WHEN r.ts >= l.ts - INTERVAL 3 DAY THEN r.view_id END AS view_id, CASE WHEN r.ts >= l.ts - INTERVAL 3 DAY THEN r.value END AS value
      FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "nearest_event": with_sql("matches", """, x AS (SELECT home, away, day + event_id % 3 AS day, event_id AS ref FROM matches WHERE status <> 'FINISHED'),
      j AS (SELECT x.ref, m.event_id, row_number() OVER (PARTITION BY x.ref ORDER BY abs(x.day - m.day), m.event_id) AS k FROM x JOIN matches m
            ON m.home = x.home AND m.away = x.away AND m.status = 'FINISHED' AND abs(x.day - m.day) <= 40)
      SELECT x.ref, j.event_id AS match FROM x LEFT JOIN j ON j.ref = x.ref AND j.k = 1"""),
    "event_upsert": with_sql("matches", f""", m AS (SELECT (home * 25 + away) * 10000 + season AS key, event_id, status, day AS d, CASE WHEN hs > 0 THEN hs END AS score FROM matches),
      a AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id) = 1), i AS (SELECT *, CAST(d AS BIGINT) * 10000000 + event_id AS t FROM m),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, status DESC) AS k FROM i) WHERE k = 1),
      j AS (SELECT coalesce(a.key, b.key) AS key, a.status AS sa, b.status AS sb, CAST(a.d AS BIGINT) AS ta, CAST(b.t AS BIGINT) AS tb, a.score AS ca, b.score AS cb,
        b.key IS NOT NULL AND (a.key IS NULL OR NOT (b.status = 'SCHEDULED' AND {_RANK.format('a.status')} > 1)) AS take FROM a FULL JOIN b ON a.key = b.key)
      SELECT key, CASE WHEN take THEN coalesce(sb, sa) ELSE sa END AS status, CASE WHEN take THEN coalesce(tb, ta) ELSE ta END AS "at", CASE WHEN take THEN coalesce(cb, ca) ELSE ca END AS score FROM j"""),
    "injury_reconcile": """WITH a AS (SELECT lower(c_name) AS player, CAST(c_nationkey AS VARCHAR) AS team, c_mktsegment AS old FROM customer WHERE c_acctbal < 5000),
      b AS (SELECT lower(c_name) AS player, CAST(c_nationkey AS VARCHAR) AS team, CASE WHEN c_acctbal > 8000 THEN 'OUT' ELSE c_mktsegment END AS new FROM customer WHERE c_acctbal >= 0)
      SELECT coalesce(a.player, b.player) AS player, coalesce(a.team, b.team) AS team, coalesce(new, old) AS state,
        CASE WHEN b.player IS NULL THEN 'resolved' WHEN a.player IS NULL THEN 'opened' ELSE 'updated' END AS action, CASE WHEN b.player IS NULL THEN 20000 END AS resolved_at
      FROM a FULL JOIN b ON a.player = b.player AND a.team = b.team""",
    "resolve_names": """WITH n AS (SELECT o_orderkey, o_custkey AS ext, CASE WHEN o_orderkey % 3 = 0 THEN concat('Customer#', lpad(CAST(o_custkey + 1 AS VARCHAR), 9, '0')) END AS name FROM orders),
      k AS (SELECT c_name, min(c_custkey) AS entity FROM customer GROUP BY c_name)
      SELECT o_orderkey, coalesce(a.c_custkey, k.entity) AS entity, CASE WHEN a.c_custkey IS NOT NULL THEN 1 WHEN k.entity IS NOT NULL THEN 2 END AS rule
      FROM n LEFT JOIN customer a ON a.c_custkey = ext AND a.c_custkey % 4 > 0 LEFT JOIN k ON k.c_name = n.name""",
    "merge_teams": with_sql("matches", """SELECT CASE WHEN home % 3 = 1 THEN home - 1 ELSE home END AS home, CASE WHEN away % 3 = 1 THEN away - 1 ELSE away END AS away, count(*) AS count FROM matches GROUP BY ALL"""),
    "next_versions": """WITH o AS (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1)
      SELECT e.user_id, event_id, coalesce(n, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS version FROM events e LEFT JOIN o ON o.user_id = e.user_id""",
    "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(len(json_keys(props)) AS INT) AS n, json_extract_string(props, '$.none') IS NULL AS none FROM events",
    "dropped_entrants": with_sql("races", "SELECT season, month, team, position FROM races WHERE position > 20"),
    "events_without_stats": with_sql("matches match_stats", "SELECT event_id, status FROM matches WHERE event_id NOT IN (SELECT event_id FROM match_stats GROUP BY event_id HAVING count(*) >= 2)"),
    "team_events": with_sql("matches", "SELECT event_id, home, away, day FROM matches WHERE (home = 7 OR away = 7) AND status IN ('FINISHED', 'LIVE') AND day BETWEEN 9000 AND 10000"),
    "head_to_head_list": with_sql("matches", "SELECT event_id, home, away FROM matches WHERE (home = 3 AND away = 9) OR (home = 9 AND away = 3)"),
    "team_pairs": with_sql("matches", "SELECT comp, home AS team FROM matches UNION SELECT comp, away FROM matches"),
    "event_counts": with_sql("matches", "SELECT comp, status, count(*) AS count FROM matches GROUP BY ALL"),
    "daily_usage": "SELECT event_type AS provider, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (value > 9) AS errors FROM events GROUP BY ALL",
    "stage_due": with_sql("matches", "SELECT event_id, CASE WHEN status <> 'SCHEDULED' THEN 'none' WHEN event_id % 3000 <= 60 THEN 'lineup' WHEN event_id % 3000 <= 1440 THEN 'day' ELSE 'early' END AS stage FROM matches"),
    "local_days": "SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL",
    "weekly_chunks": "SELECT epoch_us(ts) // 604800000000 AS chunk, count(*) AS n FROM events GROUP BY ALL",
}
