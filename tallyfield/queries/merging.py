"""Queries on reports of events, merges of entities, archives of matches and overlays of settings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.operators import events as e
from tallyfield.operators import merging as m
from tallyfield.sources import projections as p
from tallyfield.sources.projections import rounded, rsql, with_sql

c = F.col


def _stored(s, d):
    """Stored events: of matches of a pairing on a day the first."""
    x = p.matches(s, d).groupBy("comp", "home", "away", "day").agg(F.min_by(F.struct("event_id", "status", "hs", "aws"), "event_id").alias("x"))
    i, none = c("x.event_id"), F.lit(None).cast("string")
    return x.select(
        i.alias("event_id"), "comp", "home", "away", (c("day") * 24.0).alias("starts"), c("x.status").alias("status"), F.when(c("x.status") == "FINISHED", F.concat(c("x.hs").cast("string"), F.lit("-"), c("x.aws").cast("string"))).alias("result"),
        F.lit("R1").alias("round"), F.lit(None).cast("int").alias("minute"), F.when(i % 3 == 0, "Smith").alias("referee"), none.alias("venue"), none.alias("format"), F.create_map(F.lit("own"), i.cast("string")).alias("ids"),
    )


def _reports(s, d):
    """Another provider's reports of the same matches, up to ten hours off; each seventh is of a match a thousand years later."""
    x = p.matches(s, d).groupBy("comp", "home", "away", "day").agg(F.max("event_id").alias("ref"))
    r = c("ref")
    status = F.when(r % 4 == 0, "SCHEDULED").when(r % 4 == 1, "FINISHED").when(r % 4 == 2, "LIVE").otherwise("CANCELLED")
    return x.select(
        "ref", F.lit("other").alias("provider"), F.concat(F.lit("x"), r.cast("string")).alias("ext"), "comp", "home", "away", (c("day") * 24.0 + (r % 21 - 10) + F.when(r % 7 == 0, 8_766_000.0).otherwise(0.0)).alias("starts"), status.alias("status"),
        F.when(r % 5 > 0, F.concat(F.lit("r"), (r % 9).cast("string"))).alias("result"), F.when(r % 2 == 0, "R2").alias("round"), F.when(r % 4 == 2, (r % 90).cast("int")).alias("minute"), F.lit("Jones").alias("referee"), F.when(r % 6 > 0, "Park").alias("venue"), F.lit(None).cast("string").alias("format"),
    )


def _event_reports(s, d):
    x = e.upsert_events(_stored(s, d), _reports(s, d))
    return x.select("comp", "home", "away", rounded(c("starts")).alias("starts"), "status", "result", "round", "minute", "referee", "venue", c("ids")["own"].alias("own"), c("ids")["other"].alias("other"), "action")


def _merges(s, d):
    """Customers of a nation and segment are one: each goes into the one before it."""
    w = W.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    cu = p.table(s, d, "customer").select("c_custkey", F.lag("c_custkey").over(w).alias("into"))
    return cu.filter("into is not null").select(c("c_custkey").alias("from"), "into")


def _merged(s, d):
    o = p.table(s, d, "orders").select("o_orderkey", c("o_custkey").alias("team"), c("o_orderdate").cast("date").alias("as_of"), F.floor(c("o_totalprice") * 100).cast("bigint").alias("cents"))
    out = m.merge_entities(_merges(s, d), {"orders": (o, ["team"], None, None), "days": (o, ["team"], ["team", "as_of"], ["cents", "o_orderkey"])}, p.table(s, d, "customer").select(c("c_custkey").alias("team")))
    events = out["orders"].groupBy("team").agg(F.count("*").alias("orders"))
    days = out["days"].groupBy("team").agg(F.count("*").alias("days"), F.sum("cents").alias("cents"))
    return out["team"].join(events, "team", "left").join(days, "team", "left").select("team", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("orders", "days", "cents")))


def _unmatched(s, d):
    x = p.table(s, d, "part")
    aliases = x.select(c("p_partkey").alias("team"), F.explode(F.when(c("p_size") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("provider"))
    return m.unmatched(x.select(c("p_partkey").alias("team"), c("p_name").alias("name"), c("p_brand").alias("sport")), aliases, 0.9)


QUERIES = {"event_reports": _event_reports, "merged_entities": _merged, "unmatched_teams": _unmatched}

ORACLE_SQL = {
    "event_reports": with_sql("matches", f""", a AS (SELECT comp, home, away, day, min(event_id) AS event_id, arg_min(status, event_id) AS status, arg_min(hs, event_id) AS hs, arg_min(aws, event_id) AS aws FROM matches GROUP BY 1, 2, 3, 4),
      b AS (SELECT comp, home, away, day, max(event_id) AS ref FROM matches GROUP BY 1, 2, 3, 4),
      st AS (SELECT *, day * 24.0::DOUBLE AS starts, CASE WHEN status = 'FINISHED' THEN hs || '-' || aws END AS result, CASE WHEN event_id % 3 = 0 THEN 'Smith' END AS referee FROM a),
      re AS (SELECT *, day * 24.0::DOUBLE + (ref % 21 - 10) + CASE WHEN ref % 7 = 0 THEN 8766000.0::DOUBLE ELSE 0 END AS starts, ['SCHEDULED', 'FINISHED', 'LIVE', 'CANCELLED'][ref % 4 + 1] AS status, CASE WHEN ref % 5 > 0 THEN 'r' || (ref % 9) END AS result,
          CASE WHEN ref % 2 = 0 THEN 'R2' END AS round, CASE WHEN ref % 4 = 2 THEN CAST(ref % 90 AS INT) END AS minute, CASE WHEN ref % 6 > 0 THEN 'Park' END AS venue FROM b),
      j AS (SELECT st.*, re.ref, re.starts AS s2, re.status AS t2, re.result AS r2, re.round, re.minute, re.venue, {{}} AS old, {{}} AS new FROM st LEFT JOIN re ON re.comp = st.comp AND re.home = st.home AND re.away = st.away AND re.day = st.day AND re.ref % 7 > 0),
      k AS (SELECT *, ref IS NOT NULL AND t2 = 'SCHEDULED' AND old > new AS keep FROM j)
      SELECT comp, home, away, {rsql("CASE WHEN ref IS NOT NULL AND NOT keep AND abs(starts - s2) > 1.0::DOUBLE / 60 THEN s2 ELSE starts END")} AS starts, CASE WHEN ref IS NOT NULL AND NOT keep THEN t2 ELSE status END AS status,
        CASE WHEN r2 IS NOT NULL AND (t2 <> 'SCHEDULED' OR result IS NULL) THEN r2 ELSE result END AS result, coalesce(round, 'R1') AS round, minute, coalesce(referee, CASE WHEN ref IS NOT NULL THEN 'Jones' END) AS referee, venue,
        CAST(event_id AS VARCHAR) AS own, 'x' || ref AS other, CASE WHEN ref IS NULL THEN 'kept' ELSE 'updated' END AS action FROM k
      UNION ALL SELECT comp, home, away, {rsql("starts")}, status, result, round, minute, 'Jones', venue, NULL, 'x' || ref, 'inserted' FROM re WHERE ref % 7 = 0""").format(
        "CASE status WHEN 'CANCELLED' THEN 4 WHEN 'FINISHED' THEN 3 WHEN 'LIVE' THEN 2 ELSE 1 END".replace("status", "st.status"), "CASE re.status WHEN 'CANCELLED' THEN 4 WHEN 'FINISHED' THEN 3 WHEN 'LIVE' THEN 2 ELSE 1 END"),
    "merged_entities": """WITH f AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS team FROM customer),
      o AS (SELECT team, o_orderkey, CAST(o_orderdate AS DATE) AS as_of, CAST(floor(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN f ON c_custkey = o_custkey),
      a AS (SELECT team, count(*) AS orders FROM o GROUP BY team), b AS (SELECT team, count(*) AS days, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT team, as_of, max(cents) AS cents FROM o GROUP BY ALL) GROUP BY team)
      SELECT t.team, coalesce(orders, 0) AS orders, coalesce(days, 0) AS days, coalesce(cents, 0) AS cents FROM (SELECT DISTINCT team FROM f) t LEFT JOIN a ON a.team = t.team LEFT JOIN b ON b.team = t.team""",
}
