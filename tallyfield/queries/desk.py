"""Queries on lists, counts, keys and times as pages and jobs ask for them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.operators import probability as o
from tallyfield.operators import records as r
from tallyfield.sources import projections as p
from tallyfield.sources.projections import rounded, rsql, with_sql

c = F.col
ZONE = "America/New_York"


def _created(s, d):
    names = p.table(s, d, "customer").select("c_custkey", c("c_name").alias("name"), F.concat(F.lit("seg "), F.lower("c_mktsegment"), (c("c_custkey") % 7).cast("string")).alias("plain"))
    ents = p.table(s, d, "supplier").select(c("s_suppkey").alias("entity"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("s_name"))
    return r.resolve_or_create(names, ents, [("name", "s_name")], "plain").select("c_custkey", "entity", "rule", "created")


def _put(s, d):
    e = p.table(s, d, "events").select("user_id", "event_type", F.unix_micros(c("ts").cast("timestamp")).alias("at"), F.when(c("event_id") % 3 > 0, c("value")).alias("value"), F.when(c("event_id") % 2 > 0, c("event_id")).alias("first"))
    cur = e.groupBy("user_id", "event_type").agg(F.min("at").alias("at"), F.lit(None).cast("double").alias("value"), F.max("first").alias("first")).filter("event_type <> 'purchase'")
    return r.put(cur, e, ["user_id", "event_type"], "at", ["first"])


def _absent(s, d):
    e = p.table(s, d, "events").select((c("user_id") % 40).alias("team"), F.concat(F.lit("http://n/"), c("event_id") % 500).alias("url"), "event_id", "event_type")
    return r.insert_absent(e.filter("event_type = 'view'"), e.drop("event_type"), ["url", "team"], "event_id")


def _ids(s, d):
    cur = p.table(s, d, "supplier").select("s_suppkey", F.create_map(F.lit("a"), c("s_suppkey").cast("string"), F.lit("b"), c("s_nationkey").cast("string")).alias("ids"))
    new = p.table(s, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", F.create_map(F.lit("b"), F.concat(F.lit("x"), "s_suppkey"), F.lit("c"), c("s_nationkey").cast("string")).alias("ids"))
    m = r.merged_ids(cur, new, "s_suppkey", "ids")
    return m.select("s_suppkey", *(c("ids")[k].alias(k) for k in "abc"))


def _tally(s, d):
    return r.tally(p.table(s, d, "events").select("user_id", "event_type", (c("value") < F.when(c("user_id") % 3 == 0, 1000).when(c("user_id") % 3 == 1, 5).otherwise(-1)).alias("ok")), ["user_id", "event_type"])


def _picks(s, d):
    side = lambda k: F.element_at(F.array(F.lit("HOME"), F.lit("DRAW"), F.lit("AWAY")), (k % 3 + 1).cast("int"))
    m = p.matches(s, d)
    outcome = F.when(c("status") == "FINISHED", F.when(c("hs") > c("aws"), "HOME").when(c("hs") < c("aws"), "AWAY").otherwise("DRAW"))
    return r.pick_accuracy(m.select("event_id", side(c("event_id")).alias("pick"), outcome.alias("outcome")), m.filter("season >= 1994").select("event_id", side(c("event_id") + c("home")).alias("favourite")))


def _times(s, d):
    e = p.table(s, d, "events").select("event_id", (c("ts").cast("timestamp") + F.make_interval(days=(c("event_id") % 400).cast("int"))).alias("at"))
    return e.select("event_id", F.unix_seconds(f.wall_to_utc(c("at"), ZONE)).alias("utc"), f.day_key(c("at"), ZONE).alias("day"), F.unix_seconds(f.month_start(c("at"), ZONE)).alias("month"))


def _instants(s, d):
    """When jobs were due: from each event to so many hours later, by two lists of run times, a year with both changes of clocks."""
    e = p.table(s, d, "events").select("event_id", (c("ts").cast("timestamp") + F.make_interval(days=(c("event_id") % 366).cast("int"))).alias("a"), (1 + c("event_id") % 60).cast("int").alias("hours"))
    times = f.run_times(F.when(c("event_id") % 3 == 0, "02:30, 7:00;19:00 25:00 7:00").when(c("event_id") % 3 == 1, "00:00,01:30").otherwise("x"))
    b = c("a") + F.make_interval(hours=c("hours"))
    x = e.select("event_id", f.run_times_text(times).alias("times"), f.instants_between(c("a"), b, times, ZONE).alias("due"))
    return x.select("event_id", "times", F.size("due").cast("bigint").alias("n"), F.unix_seconds(F.array_min("due")).alias("first"), F.unix_seconds(F.array_max("due")).alias("last"))


def _to_date(s, d):
    """Spend of each local day, of its month up to it, and whether a budget lets calls through: one of 0 is none.  Days are
    summed first, so a month has 31 rows at most."""
    day = f.day_key(c("ts").cast("timestamp"), ZONE)
    days = p.table(s, d, "events").groupBy(day.alias("day")).agg(F.sum(F.floor(c("value") * 100).cast("bigint")).alias("cents"))
    month = W.partitionBy(F.substring("day", 1, 7)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    x = days.withColumn("month_cents", F.sum("cents").over(month)).withColumn("budget", F.when(F.substring("day", 9, 2).cast("int") % 4 == 0, 0).otherwise(400_000))
    return x.withColumn("within", (c("budget") <= 0) | (c("month_cents") < c("budget")))


def _texts(s, d):
    e = p.table(s, d, "events").select("event_id", (c("event_id") % 130).alias("n"), "props", "event_type")
    fmt = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("Clay", "grass", "Indoor", "HARD", ""))), (c("event_id") % 5 + 1).cast("int")), F.when(c("event_id") % 3 == 0, " BO5").otherwise(" bo3"))
    status = F.when(c("event_id") % 4 == 1, "Finished").when(c("event_id") % 4 == 2, F.concat(F.lit("+"), c("event_id") % 9, F.lit(" Laps"))).when(c("event_id") % 4 == 3, "Engine")
    wrapped = F.when(c("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(c("event_id") % 3 == 1, F.concat(F.lit("Here "), "props", F.lit(" so"))).otherwise("no object")
    x = f.match_format(fmt)
    return e.select("event_id", x.surface.alias("surface"), x.best_of.alias("best_of"), f.classified(status).alias("finished"), f.json_object(wrapped).alias("json"), f.ordinal(c("n")).alias("nth"), f.shortened(c("event_type"), 6).alias("short"), f.binomial(c("n") % 30, c("n") % 11).alias("binomial"))


def _baseline(s, d):
    x = p.races(s, d).select("season", "month", "team", F.when(c("team") % 5 > 0, c("position")).alias("grid"), (c("season") * 12 + c("month")).alias("event"))
    return o.grid_baseline(x, "event").select("season", "month", "team", rounded(c("share")).alias("share"))


def _next(s, d):
    m = p.matches(s, d).filter((c("status") == "SCHEDULED") & (c("day") >= 10_000))
    return m.groupBy("comp").agg(F.min(F.struct("day", "event_id")).alias("x"), F.count("*").alias("left")).select("comp", c("x.day").alias("day"), c("x.event_id").alias("event_id"), "left")


def _due(s, d):
    e = p.table(s, d, "events").select("event_id", (c("event_id") % 3 > 0).alias("enabled"), c("ts").cast("timestamp").alias("due"))
    x = e.filter(c("enabled") & (c("due") <= F.lit("2024-01-15 00:00:00").cast("timestamp")))
    return x.select("event_id", F.unix_micros("due").alias("due"))


QUERIES = {
    "resolve_or_create": _created, "rank_upsert": _put, "headlines_absent": _absent, "provider_ids": _ids, "job_tally": _tally, "pick_accuracy": _picks,
    "wall_times": _times, "scheduled_instants": _instants, "spend_to_date": _to_date, "text_forms": _texts, "grid_baseline": _baseline, "next_kickoff": _next, "due_jobs": _due,
    "relation_counts": lambda s, d: p.table(s, d, "customer").join(p.table(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(c("o_orderstatus") == "O").alias("open")), "c_custkey", "left").select("c_custkey", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("orders", "open"))),
    "filtered_counts": lambda s, d: p.matches(s, d).agg(F.count("*").alias("events"), F.count_if(c("status") == "FINISHED").alias("finished"), F.count_if((c("status") == "SCHEDULED") & (c("day") >= 10_000)).alias("upcoming"), F.count_if(c("status") == "LIVE").alias("live")),
    "appearances": lambda s, d: p.matches(s, d).filter("status = 'FINISHED'").select(F.explode(F.array("home", "away")).alias("team")).groupBy("team").agg(F.count("*").alias("n")),
    "first_seen": lambda s, d: p.table(s, d, "events").withColumn("k", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))).filter("k = 1").select("user_id", "event_type", "event_id", "value"),
    "name_search": lambda s, d: p.table(s, d, "part").filter(F.contains(F.lower("p_name"), F.lit("widget"))).select("p_partkey", "p_name"),
    "nested_filter": lambda s, d: p.matches(s, d).join(F.broadcast(p.table(s, d, "region").filter("r_name in ('ASIA', 'EUROPE')")), c("comp") == c("r_regionkey")).select("event_id", "r_name", "day"),
    "month_spend": lambda s, d: p.table(s, d, "events").groupBy(f.day_key(c("ts").cast("timestamp"), ZONE).alias("day")).agg(F.sum(F.floor(c("value") * 100).cast("bigint")).alias("cents")).withColumn("within", c("cents") < 50_000),
}

_SIDE = "['HOME', 'DRAW', 'AWAY'][({}) % 3 + 1]"


def _twice(name: str, source: str, local: str, out: str) -> str:
    """Two tables: the instant of a local time by the offset at it taken as UTC, then by the offset at that instant."""
    shown = lambda x: f"timezone('{ZONE}', timezone('UTC', {x}))"
    return f"""{name}0 AS (SELECT *, {local} - ({shown(local)} - {local}) AS guess FROM {source}), {name} AS (SELECT * EXCLUDE (guess), {local} - ({shown("guess")} - guess) AS {out} FROM {name}0)"""


ORACLE_SQL = {
    "resolve_or_create": """WITH n AS (SELECT c_custkey, c_name AS name, concat('seg ', lower(c_mktsegment), c_custkey % 7) AS plain FROM customer),
      e AS (SELECT min(s_suppkey) AS entity, replace(s_name, 'Supplier', 'Customer') AS s_name FROM supplier GROUP BY ALL), j AS (SELECT n.*, e.entity FROM n LEFT JOIN e ON e.s_name = n.name),
      w AS (SELECT plain, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY plain) AS id FROM (SELECT DISTINCT plain FROM j WHERE entity IS NULL))
      SELECT c_custkey, CAST(coalesce(entity, id) AS BIGINT) AS entity, CASE WHEN entity IS NOT NULL THEN 1 END AS rule, entity IS NULL AS created FROM j LEFT JOIN w USING (plain)""",
    "rank_upsert": """WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t, CASE WHEN event_id % 3 > 0 THEN value END AS value, CASE WHEN event_id % 2 > 0 THEN event_id END AS first FROM events),
      a AS (SELECT user_id, event_type, min(t) AS t, max(first) AS first FROM e WHERE event_type <> 'purchase' GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC) AS k FROM e) WHERE k = 1)
      SELECT user_id, event_type, b.t AS "at", b.value, coalesce(a.first, b.first) AS first FROM b LEFT JOIN a USING (user_id, event_type)""",
    "headlines_absent": """WITH e AS (SELECT user_id % 40 AS team, concat('http://n/', event_id % 500) AS url, event_id, event_type FROM events),
      f AS (SELECT url, team, min(event_id) AS event_id FROM e GROUP BY ALL) SELECT team, url, event_id FROM f WHERE (url, team) NOT IN (SELECT (url, team) FROM e WHERE event_type = 'view')""",
    "provider_ids": """SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS a, CASE WHEN s_acctbal > 0 THEN concat('x', s_suppkey) ELSE CAST(s_nationkey AS VARCHAR) END AS b, CASE WHEN s_acctbal > 0 THEN CAST(s_nationkey AS VARCHAR) END AS c FROM supplier""",
    "job_tally": """WITH x AS (SELECT user_id, event_type, value < CASE user_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 5 ELSE -1 END AS ok FROM events), y AS (SELECT user_id, event_type, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS failed FROM x GROUP BY ALL)
      SELECT *, CASE WHEN failed = 0 THEN 'OK' WHEN good > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS state FROM y""",
    "pick_accuracy": with_sql("matches", f""", x AS (SELECT {_SIDE.format("event_id")} AS pick, CASE WHEN hs > aws THEN 'HOME' WHEN hs < aws THEN 'AWAY' ELSE 'DRAW' END AS o, CASE WHEN season >= 1994 THEN {_SIDE.format("event_id + home")} END AS fav FROM matches WHERE status = 'FINISHED')
      SELECT count(*) AS n, count(*) FILTER (pick = o) AS right, count(fav) AS model_n, count(*) FILTER (fav = o) AS model_right FROM x"""),
    "wall_times": f"""WITH e AS (SELECT event_id, CAST(ts AS TIMESTAMP) + to_days(CAST(event_id % 400 AS INT)) AS t FROM events), l AS (SELECT *, timezone('{ZONE}', timezone('UTC', t)) AS w FROM e),
        m AS (SELECT *, CAST(date_trunc('month', w) AS TIMESTAMP) AS b FROM l), {_twice("g", "m", "t", "t1")}, {_twice("h", "g", "b", "b1")}
      SELECT event_id, CAST(floor(epoch(t1)) AS BIGINT) AS utc, strftime(w, '%Y-%m-%d') AS day, CAST(floor(epoch(b1)) AS BIGINT) AS month FROM h""",
    "scheduled_instants": f"""WITH e AS (SELECT event_id, CAST(ts AS TIMESTAMP) + to_days(CAST(event_id % 366 AS INT)) AS a, to_hours(CAST(1 + event_id % 60 AS INT)) AS h FROM events),
        m AS (SELECT event_id, a, a + h AS b, CASE event_id % 3 WHEN 0 THEN [150, 420, 1140] WHEN 1 THEN [0, 90] ELSE [] END AS ms, CASE event_id % 3 WHEN 0 THEN '02:30,07:00,19:00' WHEN 1 THEN '00:00,01:30' ELSE '' END AS times FROM e),
        x AS (SELECT event_id, a, b, CAST(CAST(a AS DATE) + CAST(k AS INT) AS TIMESTAMP) + to_minutes(u.m) AS t FROM m, range(-2, 5) r(k), unnest(ms) u(m)), {_twice("g", "x", "t", "t1")},
        n AS (SELECT event_id, count(DISTINCT t1) AS n, min(t1) AS lo, max(t1) AS hi FROM g WHERE t1 > a AND t1 <= b GROUP BY event_id)
      SELECT m.event_id, times, coalesce(n, 0) AS n, CAST(floor(epoch(lo)) AS BIGINT) AS first, CAST(floor(epoch(hi)) AS BIGINT) AS last FROM m LEFT JOIN n ON n.event_id = m.event_id""",
    "spend_to_date": f"""WITH d AS (SELECT strftime(timezone('{ZONE}', timezone('UTC', CAST(ts AS TIMESTAMP))), '%Y-%m-%d') AS day, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1),
        m AS (SELECT day, cents, CAST(sum(cents) OVER (PARTITION BY day[1:7] ORDER BY day) AS BIGINT) AS month_cents, CASE WHEN CAST(day[9:10] AS INT) % 4 = 0 THEN 0 ELSE 400000 END AS budget FROM d)
      SELECT *, budget <= 0 OR month_cents < budget AS within FROM m""",
    "text_forms": """WITH e AS (SELECT event_id AS i, event_id % 130 AS n, props, event_type AS t FROM events)
      SELECT i AS event_id, ['Clay', 'Grass', 'Hard', 'Hard', 'Hard'][i % 5 + 1] AS surface, CASE WHEN i % 3 = 0 THEN 5 ELSE 3 END AS best_of, i % 4 < 3 AS finished, CASE WHEN i % 3 < 2 THEN props END AS json,
        concat(n, CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END) AS nth, CASE WHEN length(t) > 6 THEN concat(rtrim(t[1:5]), '…') ELSE t END AS short,
        CASE WHEN n % 11 > n % 30 THEN 0.0::DOUBLE ELSE round(CAST(factorial(CAST(n % 30 AS INT)) AS DOUBLE) / CAST(factorial(CAST(n % 11 AS INT)) AS DOUBLE) / CAST(factorial(CAST(n % 30 - n % 11 AS INT)) AS DOUBLE)) END AS binomial FROM e""",
    "grid_baseline": with_sql("races", f""", x AS (SELECT season, month, team, CASE WHEN team % 5 > 0 THEN exp(-0.35::DOUBLE * (position - 1)) ELSE 0.0::DOUBLE END AS u FROM races)
      SELECT season, month, team, {rsql("CASE WHEN sum(u) OVER w > 0 THEN u / sum(u) OVER w ELSE 0.0::DOUBLE END")} AS share FROM x WINDOW w AS (PARTITION BY season, month)"""),
    "next_kickoff": with_sql("matches", "SELECT comp, min(day) AS day, arg_min(event_id, (day, event_id)) AS event_id, count(*) AS left FROM matches WHERE status = 'SCHEDULED' AND day >= 10000 GROUP BY comp").replace(" AS left", ' AS "left"'),
    "due_jobs": "SELECT event_id, epoch_us(ts) AS due FROM events WHERE event_id % 3 > 0 AND ts <= TIMESTAMP '2024-01-15 00:00:00'",
    "relation_counts": "SELECT c_custkey, count(o_orderkey) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "filtered_counts": with_sql("matches", "SELECT count(*) AS events, count(*) FILTER (status = 'FINISHED') AS finished, count(*) FILTER (status = 'SCHEDULED' AND day >= 10000) AS upcoming, count(*) FILTER (status = 'LIVE') AS live FROM matches"),
    "appearances": with_sql("matches", "SELECT team, count(*) AS n FROM (SELECT home AS team FROM matches WHERE status = 'FINISHED' UNION ALL SELECT away FROM matches WHERE status = 'FINISHED') GROUP BY team"),
    "first_seen": "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL",
    "name_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')",
    "nested_filter": with_sql("matches", "SELECT event_id, r_name, day FROM matches JOIN region ON r_regionkey = comp WHERE r_name IN ('ASIA', 'EUROPE')"),
    "month_spend": f"""SELECT strftime(timezone('{ZONE}', timezone('UTC', CAST(ts AS TIMESTAMP))), '%Y-%m-%d') AS day, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents, sum(CAST(floor(value * 100) AS BIGINT)) < 50000 AS within FROM events GROUP BY 1""",
}
