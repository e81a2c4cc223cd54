"""Queries on nested documents, archives and settings; the documents are made from the tables as their providers write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import replies
from tallyfield.operators import serve as sv
from tallyfield.operators.settings import overlay
from tallyfield.queries import forecasts as fo
from tallyfield.sources import boards as b
from tallyfield.sources import parsers
from tallyfield.sources import projections as p
from tallyfield.sources.projections import with_sql

c = F.col


def _page(rows, keys, **lists):
    """Listing pages: a page for each value of ``keys``, a race for each season and month in it."""
    season, month = c("season").cast("string"), c("month")
    date = F.concat(season, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-15"))
    race = F.struct(season.alias("season"), month.cast("string").alias("round"), F.concat(F.lit("Race "), month.cast("string")).alias("raceName"), date.alias("date"), F.lit("13:00:00Z").alias("time"), *(v.alias(k) for k, v in lists.items()))
    table = F.struct(F.struct(F.struct(F.array_sort(F.collect_list("race")).alias("Races")).alias("RaceTable")).alias("MRData"))
    return rows.select(*keys, race.alias("race")).groupBy(*keys).agg(F.to_json(table).alias("json")).select(F.hash(*keys).alias("page"), "json")


def _race_seasons(s, d):
    r = p.races(s, d)
    driver = F.struct(F.concat(F.lit("d"), c("team").cast("string")).alias("driverId"))
    text = lambda v: v.cast("string")
    result = F.struct(text(c("position") * 7 % 25).alias("grid"), text(c("position")).alias("position"), text(F.greatest(F.lit(0), 11 - c("position"))).alias("points"), F.when(c("position") <= 20, "Finished").otherwise("Engine").alias("status"), driver.alias("Driver"))
    grid = F.struct(text(26 - c("position")).alias("position"), driver.alias("Driver"))
    half = (c("team") % 2).alias("half")
    results = r.filter("month <= 8").groupBy("season", "month", half).agg(F.collect_list(result).alias("x"))
    ranked = r.filter("month <= 10").groupBy("season", "month", half).agg(F.collect_list(grid).alias("x"))
    teams = r.select("season", "team").distinct().groupBy("season").agg(F.collect_list(driver).alias("Drivers"))
    drivers = teams.select(F.to_json(F.struct(F.struct(F.struct(c("season").cast("string").alias("season"), "Drivers").alias("DriverTable")).alias("MRData"))).alias("json"))
    x = b.race_entrants(_page(r.select("season", "month").distinct(), ["season"]), _page(results, ["season", "half"], Results=c("x")), _page(ranked, ["season", "half"], QualifyingResults=c("x")), drivers, F.lit("2001-01-01").cast("timestamp"))
    return x.select("season", "round", "status", "driver", "grid", "position", "points", "note")


def _archive_rates(s, d):
    """Serve rates from an archive's rows, as text, to players' levels."""
    m = fo._serve_matches(s, d).filter("status = 'FINISHED'")
    text = lambda v: v.cast("bigint").cast("string")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), c("day")), "yyyyMMdd")
    rows = m.select(
        c("event_id").cast("string").alias("tourney_id"), F.lit("1").alias("match_num"), day.alias("tourney_date"), F.lit("R128").alias("round"), "surface", F.lit("6-4 6-4").alias("score"),
        *(v.alias(f"{who}_{k}") for who, side in (("winner", "home"), ("loser", "away")) for k, v in (("id", c(side).cast("string")), ("name", F.concat(F.lit("P"), c(side).cast("string"))), ("rank", F.lit("5")), ("seed", F.lit("")))),
        *(v.alias(f"{w}_{k}") for w, side in (("w", "home"), ("l", "away")) for k, v in (("svpt", text(c(f"{side}_points"))), ("1stWon", text(F.floor(c(f"{side}_won") / 2))), ("2ndWon", text(c(f"{side}_won") - F.floor(c(f"{side}_won") / 2))), *((x, F.lit("")) for x in ("ace", "df", "1stIn", "SvGms", "bpSaved", "bpFaced")))),
    )
    x = sv.serve_rates(sv.serve_samples(parsers.archive_serves(rows)), fo.AS_OF)
    return fo._r(x.withColumn("player", c("player").cast("int")), "serve", "ret", "points", "tour")


def _overlay(s, d):
    """Settings of order priorities: defaults for each region, rows by the newest orders of a region or of one of its nations."""
    o = p.table(s, d, "orders").join(p.table(s, d, "customer"), c("o_custkey") == c("c_custkey")).join(F.broadcast(p.table(s, d, "nation")), c("c_nationkey") == c("n_nationkey"))  # 25 rows
    sport, model = c("n_regionkey").cast("string"), c("o_orderpriority")
    k = c("o_orderkey")
    param = lambda x: F.concat(F.lit("k"), (x % 4).cast("string"))
    rows = o.select(
        sport.alias("sport"), F.when(k % 5 > 0, c("n_nationkey").cast("string")).alias("comp"), model.alias("model"), (c("o_orderstatus") == "F").alias("enabled"), F.floor("o_totalprice").cast("double").alias("weight"),
        F.map_concat(F.create_map(F.lit("status"), c("o_orderstatus")), F.create_map(param(k), k.cast("string"))).alias("params"), F.when(k % 3 > 0, F.concat(F.lit("s"), k.cast("string"))).alias("state"), k.alias("fitted_at"),
    )
    defaults = o.groupBy(sport.alias("sport"), model.alias("model")).agg(F.lit(True).alias("enabled"), F.lit(1.0).alias("weight")).filter("model <> '5-LOW'").withColumn("params", F.create_map(F.lit("k0"), F.lit("d"), F.lit("own"), c("model")))
    comps = p.table(s, d, "nation").select(c("n_regionkey").cast("string").alias("sport"), c("n_nationkey").cast("string").alias("comp"))
    x = overlay(defaults, rows, comps)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat(e.key, F.lit("="), e.value, F.lit("@"), F.element_at("sources", e.key)))), " ")
    return x.select("sport", "comp", "model", "enabled", "weight", "state", "fitted_at", "specific", shown.alias("params"))


def _replies(s, d):
    """How many replies are refused for what: each event's is made with the faults its numbers give it."""
    i, v = c("event_id"), c("value")
    factor = F.struct(F.lit("rest").alias("key"), F.lit("Rest").alias("label"), F.when(i % 7 == 0, "much").otherwise((i % 40 - 20).cast("string")).alias("effect"), F.when(i % 5 == 0, "sure").otherwise("low").alias("confidence"), F.lit("n").alias("note"))
    text = F.to_json(F.struct(
        F.when(i % 11 > 0, c("event_type")).alias("narrative"), F.array_repeat(factor, (i % 10).cast("int")).alias("factors"), F.array(F.struct(F.when(i % 3 > 0, "HOME").alias("side"), F.lit("P").alias("player"), F.lit("key").alias("importance"))).alias("absences"),
        F.when(i % 2 == 0, F.struct(F.floor(v).alias("HOME"), F.lit(0.5).alias("AWAY"))).alias("probabilities"), F.lit("high").alias("confidence"),
    ))
    text = F.regexp_replace(text, r'"effect":"(-?\d+)"', '"effect":$1')
    text = F.when(i % 13 == 0, F.substring(text, 1, 20)).when(i % 4 == 0, F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```"))).otherwise(text)
    why = p.table(s, d, "events").select("event_id", replies.refusals(text).alias("why"))
    return why.select(F.explode(F.when(F.size("why") == 0, F.array(F.lit("none"))).otherwise(c("why"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {"reply_checks": _replies, "race_seasons": _race_seasons, "archive_rates": _archive_rates, "settings_overlay": _overlay}

ORACLE_SQL = {
    "reply_checks": """WITH x AS (SELECT event_id AS i, floor(value) AS h, event_id % 10 AS f FROM events),
        r AS (SELECT CASE WHEN i % 13 = 0 THEN ['no object'] ELSE list_filter([
            CASE WHEN i % 11 = 0 THEN 'narrative: missing' END, CASE WHEN f > 8 THEN 'factors: too many' END,
            CASE WHEN f > 0 AND i % 7 = 0 THEN 'factors[].effect: no number' WHEN f > 0 AND abs(i % 40 - 20) > 16 THEN 'factors[].effect: out of range' END, CASE WHEN f > 0 AND i % 5 = 0 THEN 'factors[].confidence: unknown word' END,
            CASE WHEN i % 3 = 0 THEN 'absences[].side: missing' END, CASE WHEN i % 2 = 0 AND (h < 0 OR h > 1) THEN 'probabilities.HOME: out of range' END], lambda z: z IS NOT NULL) END AS why FROM x)
      SELECT unnest(CASE WHEN len(why) = 0 THEN ['none'] ELSE why END) AS reason, count(*) AS n FROM r GROUP BY 1""",
    "race_seasons": with_sql("races", """, st AS (SELECT season, team FROM (SELECT *, max(month) FILTER (month <= 8) OVER (PARTITION BY season) AS last FROM races) WHERE month = last OR last IS NULL GROUP BY ALL),
        ro AS (SELECT DISTINCT season, month FROM races)
      SELECT CAST(season AS VARCHAR) AS season, month AS round, 'FINISHED' AS status, 'd' || team AS driver, CASE WHEN position * 7 % 25 > 0 THEN position * 7 % 25 END AS grid, position, CAST(greatest(0, 11 - position) AS DOUBLE) AS points, CASE WHEN position <= 20 THEN 'Finished' ELSE 'Engine' END AS note FROM races WHERE month <= 8
      UNION ALL SELECT CAST(season AS VARCHAR), month, 'SCHEDULED', 'd' || team, 26 - position, NULL, NULL, NULL FROM races WHERE month BETWEEN 9 AND 10
      UNION ALL SELECT CAST(ro.season AS VARCHAR), month, 'SCHEDULED', 'd' || team, NULL, NULL, NULL, NULL FROM ro JOIN st ON st.season = ro.season WHERE month > 10"""),
    "archive_rates": fo.ORACLE_SQL["serve_rates"],
    "settings_overlay": """WITH o AS (SELECT CAST(n_regionkey AS VARCHAR) AS sport, CASE WHEN o_orderkey % 5 > 0 THEN CAST(n_nationkey AS VARCHAR) ELSE '' END AS comp, o_orderpriority AS model, o_orderstatus = 'F' AS enabled, CAST(floor(o_totalprice) AS DOUBLE) AS weight,
          o_orderstatus AS st, o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN 's' || o_orderkey END AS state FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
        r AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY sport, comp, model ORDER BY k DESC) = 1),
        n AS (SELECT CAST(n_regionkey AS VARCHAR) AS sport, CAST(n_nationkey AS VARCHAR) AS comp FROM nation),
        d AS (SELECT DISTINCT sport, model FROM o WHERE model <> '5-LOW'),
        l AS (SELECT d.sport, n.comp, d.model, 0 AS level, true AS enabled, 1.0::DOUBLE AS weight, ['k0', 'own'] AS ks, ['d', d.model] AS vs, NULL AS state, NULL::BIGINT AS fitted_at FROM d JOIN n ON n.sport = d.sport
          UNION ALL SELECT r.sport, n.comp, r.model, 1, enabled, weight, ['status', 'k' || (k % 4)], [st, CAST(k AS VARCHAR)], state, k FROM r JOIN n ON n.sport = r.sport JOIN d ON d.sport = r.sport AND d.model = r.model WHERE r.comp = ''
          UNION ALL SELECT r.sport, n.comp, r.model, 2, enabled, weight, ['status', 'k' || (k % 4)], [st, CAST(k AS VARCHAR)], state, k FROM r JOIN n ON n.sport = r.sport AND n.comp = r.comp JOIN d ON d.sport = r.sport AND d.model = r.model),
        q AS (SELECT sport, comp, model, level, unnest(ks) AS name, unnest(vs) AS value FROM l),
        v AS (SELECT sport, comp, model, name, arg_max(value, level) AS value, max(level) AS level FROM q GROUP BY 1, 2, 3, 4),
        t AS (SELECT sport, comp, model, string_agg(name || '=' || value || '@' || ['default', 'sport', 'competition'][level + 1], ' ' ORDER BY name || '=' || value || '@' || ['default', 'sport', 'competition'][level + 1]) AS params FROM v GROUP BY 1, 2, 3)
      SELECT l.sport, l.comp, l.model, arg_max(enabled, level) AS enabled, arg_max(weight, level) AS weight, arg_max(state, level) FILTER (state IS NOT NULL) AS state, arg_max(fitted_at, level) FILTER (fitted_at IS NOT NULL) AS fitted_at, max(level) = 2 AS specific, any_value(params) AS params
      FROM l JOIN t ON t.sport = l.sport AND t.comp = l.comp AND t.model = l.model GROUP BY 1, 2, 3""",
}
