"""Queries on scores of forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.plans import accuracy as a
from tallyfield.sources import projections as p
from tallyfield.sources.projections import rounded, rsql, with_sql

c = F.col
MODELS = ["click", "error", "purchase", "signup", "view"]


def _r(df, *names):
    return df.withColumns({n: rounded(c(n)) for n in names})


def _scored(s, d):
    return a.score(p.forecasts(s, d))


def _weights(s, d):
    f = p.forecasts(s, d)
    flat = [c("p0"), c("p1"), c("p2")]
    rows = f.select(
        "outcome",
        F.array(*(F.log(x) for x in flat)).alias("l_a"),
        F.array(*(F.log(x) for x in (flat[1], flat[2], flat[0]))).alias("l_b"),
        F.array(*(F.lit(1 / 3.0) for _ in flat)).alias("l_u"),
    )
    return a.best_weights(s, rows, ["a", "b", "u"])


def _versions(s, d):
    e = p.table(s, d, "events").select((c("event_id") % 700).alias("event_id"), c("event_id").alias("id"), F.unix_micros(c("ts").cast("timestamp")).alias("created"))
    from pyspark.sql import Window as W

    preds = e.withColumn("version", F.row_number().over(W.partitionBy("event_id").orderBy("created", "id")))
    starts = e.groupBy("event_id").agg((F.min("created") + (F.max("created") - F.min("created")) / 3 * (c("event_id") % 4)).cast("long").alias("starts"))
    return a.final_version(preds, starts).select("event_id", "id", "version", "next")


QUERIES = {
    "scored_forecasts": lambda s, d: _r(_scored(s, d), "brier", "log_loss", "rps").select("id", "model", "brier", "log_loss", "rps", "tied", "correct"),
    "accuracy_summaries": lambda s, d: _r(a.summaries(_scored(s, d)), "brier", "log_loss", "rps", "accuracy"),
    "calibration": lambda s, d: _r(a.calibration(_scored(s, d)), "mean", "rate"),
    "calibration_slope": lambda s, d: _r(a.calibration_slope(a.calibration(_scored(s, d))), "slope"),
    "weekly_timeline": lambda s, d: a.weekly(_scored(s, d), MODELS),
    "upsets": lambda s, d: _r(a.upsets(_scored(s, d)), "favourite", "winner"),
    "accuracy_report": lambda s, d: _r(a.report(_scored(s, d), 19_700), "brier", "log_loss", "accuracy"),
    "best_weights": lambda s, d: _r(_weights(s, d), "log_loss"),
    "final_versions": _versions,
}

_S = """, s AS (SELECT *, greatest(p0, p1, p2) AS most, [p0, p1, p2][outcome + 1] AS won,
    CAST(greatest(p0, p1, p2) - p0 < 1e-9 AS INT) + CAST(greatest(p0, p1, p2) - p1 < 1e-9 AS INT) + CAST(greatest(p0, p1, p2) - p2 < 1e-9 AS INT) AS ties,
    CAST(outcome = 0 AS INT)::DOUBLE AS h0, CAST(outcome = 1 AS INT)::DOUBLE AS h1, CAST(outcome = 2 AS INT)::DOUBLE AS h2 FROM forecasts),
  scored AS (SELECT *, (p0 - h0) * (p0 - h0) + (p1 - h1) * (p1 - h1) + (p2 - h2) * (p2 - h2) AS brier, -ln(greatest(0.000001::DOUBLE, won)) AS log_loss,
    ((p0 - h0) * (p0 - h0) + (p0 + p1 - h0 - h1) * (p0 + p1 - h0 - h1)) / 2 AS rps, ties > 1 AS tied, ties = 1 AND won = most AS correct FROM s)
"""
_CAL = """, pairs AS (SELECT model, p0 AS p, h0 AS hit FROM scored UNION ALL SELECT model, p1, h1 FROM scored UNION ALL SELECT model, p2, h2 FROM scored),
  sums AS (SELECT model, CAST(least(9, greatest(0, floor(p * 10.0::DOUBLE))) AS INT) AS bin, count(*) AS n, avg(p) AS mean, avg(hit) AS rate FROM pairs GROUP BY ALL),
  cal AS (SELECT g.model, g.bin, coalesce(n, 0) AS n, mean, rate FROM (SELECT DISTINCT model, CAST(r.bin AS INT) AS bin FROM scored, range(10) r(bin)) g LEFT JOIN sums ON sums.model = g.model AND sums.bin = g.bin)
"""


def _sql(query: str, more: str = "") -> str:
    return with_sql("forecasts", _S + more + query)


ORACLE_SQL = {
    "scored_forecasts": _sql(f"SELECT id, model, {rsql('brier')} AS brier, {rsql('log_loss')} AS log_loss, {rsql('rps')} AS rps, tied, correct FROM scored"),
    "accuracy_summaries": _sql(f"""SELECT comp, model, count(*) AS n, count(*) FILTER (tied) AS ties, {rsql('avg(brier)')} AS brier, {rsql('avg(log_loss)')} AS log_loss,
      {rsql('avg(rps)')} AS rps, {rsql('coalesce(CAST(count(*) FILTER (correct) AS DOUBLE) / nullif(count(*) FILTER (NOT tied), 0), 0)')} AS accuracy FROM scored GROUP BY GROUPING SETS ((model), (comp, model))"""),
    "calibration": _sql(f"SELECT model, bin, n, {rsql('mean')} AS mean, {rsql('rate')} AS rate FROM cal", _CAL),
    "calibration_slope": _sql(f"""SELECT model, count(*) AS bins, CASE WHEN count(*) >= 3 THEN {rsql('(sum(n * mean * rate) - sum(n * mean) * sum(n * rate) / sum(n)) / (sum(n * mean * mean) - sum(n * mean) * sum(n * mean) / sum(n))')} END AS slope
      FROM cal WHERE n >= 5 GROUP BY model""", _CAL),
    "weekly_timeline": _sql("SELECT CAST(day - (day + 4) % 7 AS INT) AS week, " + ", ".join(f"floor(avg(log_loss) FILTER (model = '{m}') * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS \"{m}\"" for m in MODELS) + " FROM scored GROUP BY ALL"),
    "upsets": _sql(f"SELECT id, model, {rsql('most')} AS favourite, {rsql('won')} AS winner FROM scored WHERE most >= 0.55 AND won <= 0.2 ORDER BY most DESC, won, id LIMIT 8"),
    "accuracy_report": _sql(f"""SELECT model, count(*) AS n, {rsql('avg(brier)')} AS brier, {rsql('avg(log_loss)')} AS log_loss, {rsql('avg(CAST(correct AS INT)::DOUBLE)')} AS accuracy
      FROM (SELECT * FROM scored WHERE day >= 19700) GROUP BY model"""),
    "best_weights": _sql(f"""SELECT CAST(combo AS INT) AS combo, a, b, u, {rsql('log_loss')} AS log_loss FROM (
      SELECT combo, a, b, u, avg(least(-ln(0.000001::DOUBLE), top + ln(exp(v0 - top) + exp(v1 - top) + exp(v2 - top)) - CASE outcome WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END)) AS log_loss FROM (
        SELECT *, greatest(v0, v1, v2) AS top FROM (
          SELECT combo, a, b, u, outcome, a * ln(p0) + b * ln(p1) + u / 3.0::DOUBLE AS v0, a * ln(p1) + b * ln(p2) + u / 3.0::DOUBLE AS v1, a * ln(p2) + b * ln(p0) + u / 3.0::DOUBLE AS v2
          FROM scored, (SELECT row_number() OVER (ORDER BY i, j) - 1 AS combo, i / 10.0::DOUBLE AS a, j / 10.0::DOUBLE AS b, (10 - i - j) / 10.0::DOUBLE AS u
                        FROM range(11) x(i), range(11) y(j) WHERE i + j <= 10)))
      GROUP BY ALL) ORDER BY floor(log_loss * 1000000000.0::DOUBLE + 0.5::DOUBLE), combo LIMIT 1"""),
    "final_versions": """WITH e AS (SELECT event_id % 700 AS event_id, event_id AS id, epoch_us(ts) AS created FROM events),
      v AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created, id) AS version FROM e),
      st AS (SELECT event_id, CAST(trunc(min(created) + (max(created) - min(created)) / 3.0::DOUBLE * (event_id % 4)) AS BIGINT) AS starts FROM e GROUP BY event_id)
      SELECT event_id, id, CAST(version AS INT) AS version, CAST(next AS INT) AS next FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CAST(created <= starts AS INT) DESC, version DESC) AS k,
        max(version) OVER (PARTITION BY event_id) + 1 AS next FROM v JOIN st USING (event_id)) WHERE k = 1""",
}
