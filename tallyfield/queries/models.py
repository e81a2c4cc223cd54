"""Queries on fitted models, simulations, fuzzy matches and streams; SQL cannot express most of them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyfield.operators import tables as t
from tallyfield.plans import accuracy, fits
from tallyfield.scratch import folder
from tallyfield.sources import projections as p
from tallyfield.sources.projections import rounded, rsql
from tallyfield.streaming import results

c = F.col
AS_OF = 10_000


def _model(s, d):
    return fits.dixon_coles(p.matches(s, d), AS_OF)


def _fixture_rates(s, d):
    m = p.matches(s, d).filter((c("status") == "SCHEDULED") & (c("day") >= AS_OF))
    return fits.dixon_coles_rates(m.select("comp", "event_id", "home", "away"), _model(s, d))


def _season(s, d):
    m = p.matches(s, d)
    fx = m.filter("status = 'SCHEDULED'").select("comp", "season", "event_id", "home", "away")
    rates = fits.dixon_coles_rates(fx, _model(s, d))
    fx = rates.select("comp", "season", "event_id", "home", "away", fits.score_cdf(c("lam"), c("mu"), c("rho")).alias("cdf"))
    played = t.league_table(m).select("comp", "season", "team", "points", "scored", "conceded").join(fx.select("comp", "season").distinct(), ["comp", "season"], "left_semi")
    # a task's fixtures are drawn thousands of times: dealt to all cores, however few rows they are
    return fits.simulate_season(played, fx.repartition(s.sparkContext.defaultParallelism, "event_id"))


def _race(s, d):
    from tallyfield.operators.probability import pace

    r = p.races(s, d).withColumn("race", c("season") * 12 + c("month"))
    x = pace(r, F.lit(1999 * 12), 0.02).select(F.lit(1).alias("event"), "team", "pace", "dnf", F.when(c("team") % 2 == 0, c("team") % 20 + 1).alias("grid"))
    return fits.simulate_race(x)


def _rank_beta(s, d):
    r = p.matches(s, d).filter("status = 'FINISHED' and hs <> aws").select((1 + c("home") * 4).alias("rank_home"), (1 + c("away") * 3).alias("rank_away"), (c("hs") > c("aws")).alias("home_won"))
    return s.createDataFrame([(fits.rank_beta(r),)], "beta double")


def _temperature(s, d):
    return s.createDataFrame([(fits.fit_temperature(p.forecasts(s, d)),)], "temperature double")


def _markov(s, d):
    x = p.table(s, d, "part").select(c("p_partkey").alias("id"), (0.5 + c("p_partkey") % 29 / 100).alias("p"), (0.5 + c("p_partkey") % 23 / 100).alias("q"))
    return x.select("id", fits.set_win_udf("p", "q").alias("set"))


def _fuzzy(s, d):
    x = p.table(s, d, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"))
    return fits.fuzzy_match(x, x, "name", "id", 0.9)


def _stream_counts(s, d):
    out = results.windowed_counts(results.stream(s, d, "events.parquet"), late="60 days")
    table = results.run_to_end(out, folder(s, "counts"), "complete")
    return table.filter(c("batch") == table.agg(F.max("batch")).first()[0]).select("start", "event_type", "n", rounded(c("total")).alias("total"))


def _stream_ratings(s, d):
    """Season by season: each one's files arrive as a batch of the stream, which goes on from the state of the one before.  The
    matches are read and written once, a folder a season; a season arrives by its folder being moved."""
    waiting, source, out = folder(s, "waiting"), folder(s, "matches"), folder(s, "ratings")
    m = p.matches(s, d).filter("status = 'FINISHED'")
    m.repartition("season").write.partitionBy("season").parquet(waiting)
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(waiting).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(source))
    schema, table = m.select(*(x for x in m.columns if x != "season"), "season").schema, None
    for name in sorted(x.getPath().getName() for x in fs.listStatus(path(waiting)) if x.isDirectory()):  # a folder for each year
        fs.rename(path(f"{waiting}/{name}"), path(f"{source}/{name}"))
        table = results.run_to_end(results.ratings(s.readStream.schema(schema).parquet(source)), out, "update")
    return table if table is not None else s.createDataFrame([], "comp int, team int, rating double, day int, batch int")


def _walk(s, d):
    m = p.matches(s, d)
    w = fits.walk_forward(fits.elo_history(m), m)
    return accuracy.score(w).groupBy("comp").agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss"), F.avg("rps").alias("rps"))


QUERIES = {
    "elo_history": lambda s, d: fits.elo_history(p.matches(s, d)).drop("foreseen"), "walk_forward": _walk, "dixon_coles": _model, "fixture_rates": _fixture_rates,
    "season_simulation": _season, "race_simulation": _race, "rank_beta": _rank_beta, "temperature": _temperature,
    "tennis_sets": _markov, "fuzzy_match": _fuzzy, "stream_counts": _stream_counts, "stream_ratings": _stream_ratings,
}

ORACLE_SQL = {
    "stream_counts": f"""SELECT (epoch_us(ts) // 604800000000) * 604800 AS start, event_type, count(*) AS n, {rsql("sum(value)")} AS total FROM events GROUP BY ALL""",
}


def _reports(s, d):
    """Reports of events: a line item says of its order how things stood when it was shipped."""
    x = p.table(s, d, "lineitem")
    at = c("l_shipdate").cast("timestamp") + F.make_interval(hours=c("l_linenumber"))
    status = F.when(c("l_linenumber") % 4 < 2, "SCHEDULED").when(c("l_returnflag") == "R", "POSTPONED").when(c("l_returnflag") == "A", "LIVE").otherwise("FINISHED")
    scores = c("l_quantity") < 25
    n = lambda k: F.when(scores, F.floor(c("l_quantity") / k).cast("int"))
    return x.select(c("l_orderkey").alias("event_id"), at.alias("at"), status.alias("status"), (c("l_shipdate").cast("timestamp") + F.make_interval(hours=(c("l_partkey") % 90).cast("int"))).alias("starts"), n(5).alias("hs"), n(7).alias("aws"))


def _event_states(s, d):
    """Where the stream of reports ends, by state and stage."""
    from tallyfield.streaming import states

    source = folder(s, "reports")
    _reports(s, d).write.parquet(source)
    out = results.run_to_end(states.event_states(s.readStream.schema(s.read.parquet(source).schema).parquet(source), "30 days"), folder(s, "states"), "update")
    last = out.groupBy("event_id").agg(F.max_by(F.struct("status", "hs", "aws", "starts", "stage"), "batch").alias("x")).select("event_id", "x.*")
    return last.groupBy("status", "stage").agg(F.count("*").alias("n"), F.sum("hs").alias("hs"), F.sum("aws").alias("aws"), F.sum(F.floor(c("starts") / 3_600_000)).cast("bigint").alias("hours"))


QUERIES["event_states"] = _event_states
ORACLE_SQL["event_states"] = """
    WITH r AS (SELECT l_orderkey AS e, epoch_ms(l_shipdate + to_hours(CAST(l_linenumber AS INT))) AS a, CASE WHEN l_linenumber % 4 < 2 THEN 'SCHEDULED' WHEN l_returnflag = 'R' THEN 'POSTPONED' WHEN l_returnflag = 'A' THEN 'LIVE' ELSE 'FINISHED' END AS s,
          epoch_ms(l_shipdate + to_hours(CAST(l_partkey % 90 AS INT))) AS t, CASE WHEN l_quantity < 25 THEN CAST(floor(l_quantity / 5) AS INT) END AS hs, CASE WHEN l_quantity < 25 THEN CAST(floor(l_quantity / 7) AS INT) END AS aws FROM lineitem),
      w AS (SELECT max(a) - 30 * 86400000::BIGINT AS now FROM r),
      g AS (SELECT e, max({'a': a, 's': s, 't': t}) FILTER (s <> 'SCHEDULED') AS ns, max({'a': a, 't': t}) FILTER (s = 'SCHEDULED') AS sc,
          max({'a': a, 'h': hs, 'g': aws}) FILTER (s <> 'SCHEDULED' AND hs IS NOT NULL) AS nr, max({'a': -a, 'h': hs, 'g': aws}) FILTER (s = 'SCHEDULED' AND hs IS NOT NULL) AS sr FROM r GROUP BY e),
      x AS (SELECT e, coalesce(ns.s, 'SCHEDULED') AS s, coalesce(ns.t, sc.t) AS t, CASE WHEN nr IS NOT NULL THEN nr.h ELSE sr.h END AS hs, CASE WHEN nr IS NOT NULL THEN nr.g ELSE sr.g END AS aws FROM g),
      y AS (SELECT *, CASE WHEN s = 'SCHEDULED' AND hs IS NOT NULL AND now >= t + 10800000 THEN 'FINISHED' ELSE s END AS status FROM x, w)
    SELECT status, CASE WHEN status <> 'SCHEDULED' THEN 0 WHEN now >= t - 3600000 THEN 2 WHEN now >= t - 86400000 THEN 1 ELSE 0 END AS stage, count(*) AS n, CAST(sum(hs) AS BIGINT) AS hs, CAST(sum(aws) AS BIGINT) AS aws, CAST(sum(floor(t / 3600000)) AS BIGINT) AS hours
    FROM y GROUP BY ALL"""
