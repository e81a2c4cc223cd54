"""Match statistics: what teams make and allow, forecasts with intervals, and how often these held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import scalars as f

c = F.col


def fit_statistics(samples: DataFrame, xi: float = 0.003, shrink: float = 4.0, max_age: int = 730) -> tuple[DataFrame, DataFrame]:
    """(stat, home, away, sd) of the league and (team, stat, made, allowed) of teams, over the league's mean.

    samples: team, opponent, side (HOME or AWAY), stat, value, age in days; ages of 0 or less and beyond ``max_age`` don't
    count.  A league without one side has the other's mean for it.  Teams' sums are drawn to the mean as if by ``shrink``
    more rows; a team that only made or only allowed has 1 for the other."""
    used = samples.filter((c("age") > 0) & (c("age") <= max_age) & c("value").isNotNull() & ~F.isnan(c("value").cast("double"))).withColumn("w", f.decay(c("age"), xi))
    at = lambda side, x: F.sum(F.when(c("side") == side, x))
    v, w = c("w") * c("value"), c("w")
    home, away = F.try_divide(at("HOME", v), at("HOME", w)), F.try_divide(at("AWAY", v), at("AWAY", w))
    spread = F.greatest(F.lit(0.0), F.sum(v * c("value")) / F.sum(w) - F.pow(F.sum(v) / F.sum(w), 2))
    league = used.groupBy("stat").agg(F.coalesce(home, away).alias("home"), F.coalesce(away, home).alias("away"), F.when(F.sum(w) > 1, F.sqrt(spread)).otherwise(0.0).alias("sd"))
    sides = F.explode(F.array(F.struct(c("team").alias("who"), F.lit(True).alias("own")), F.struct(c("opponent").alias("who"), F.lit(False).alias("own")))).alias("s")
    rows = used.select("stat", v.alias("v"), "w", sides).select("stat", "v", "w", "s.*")
    of = lambda own, x: F.sum(F.when(c("own") == own, c(x)))
    sums = rows.groupBy(c("who").alias("team"), "stat").agg(*(of(own, x).alias(f"{x}{int(own)}") for own in (True, False) for x in ("v", "w")))
    mean = (c("home") + c("away")) / 2
    rate = lambda k: F.when(mean > 0, F.coalesce((c(f"v{k}") + shrink * mean) / (c(f"w{k}") + shrink), mean) / mean).otherwise(1.0)
    return league, sums.join(F.broadcast(league), "stat").select("team", "stat", rate(1).alias("made"), rate(0).alias("allowed"))  # a row for each statistic


def interval(kind: Column, mean: Column, sd: Column) -> Column:
    """The middle four fifths: by the Poisson for counts, a band of 3 to 12 points for percentages, else by the normal."""
    rate = F.greatest(F.lit(0.01), mean)
    band = F.greatest(F.lit(3.0), F.least(F.lit(12.0), F.when(sd > 0, sd * 1.28).otherwise(8.0)))
    wide = f.normal_quantile(F.lit(0.9)) * sd
    count = F.struct(f.poisson_quantile(F.lit(0.1), rate).cast("double").alias("low"), f.poisson_quantile(F.lit(0.9), rate).cast("double").alias("high"))
    share = F.struct(F.greatest(F.lit(0.0), mean - band).alias("low"), F.least(F.lit(100.0), mean + band).alias("high"))
    plain = F.struct(F.greatest(F.lit(0.0), mean - wide).alias("low"), (mean + wide).alias("high"))
    return F.when(kind.isin("poisson", "count"), count).when(kind == "percent", share).otherwise(plain)


def forecast_statistics(fixtures: DataFrame, league: DataFrame, teams: DataFrame, kinds: dict[str, tuple[str, int]]) -> DataFrame:
    """event_id, stat, home_mean, home_low, home_high, away_mean ...: for each fixture (event_id, home, away) and each known
    statistic of ``kinds``, which names its distribution and digits.

    Both sides' rates multiply; possession is split so that it sums to 100, other percentages are a team's own habit,
    moved by the root of what the other side allows.  Unknown teams count as average."""
    rows = [F.struct(F.lit(k).alias("stat"), F.lit(d).alias("kind"), F.lit(n).alias("digits")) for k, (d, n) in kinds.items()]
    x = fixtures.select("event_id", "home", "away", F.explode(F.array(*rows)).alias("k")).select("event_id", c("home").alias("h"), c("away").alias("a"), "k.*")
    x = x.join(F.broadcast(league), "stat")  # a row for each statistic
    for side in "ha":
        x = x.join(teams.select(c("team").alias(side), "stat", c("made").alias(f"made_{side}"), c("allowed").alias(f"allowed_{side}")), [side, "stat"], "left")
    x = x.fillna(1.0, ["made_h", "allowed_h", "made_a", "allowed_a"])
    edge = ((c("made_h") - 1) * c("home") - (c("made_a") - 1) * c("away")) / 2 + (c("home") - 50)
    split = f.clamp(50 + edge, 25.0, 75.0)
    share = lambda league, made, allowed: f.clamp(league * made * F.sqrt(allowed), 0.0, 100.0)
    zero_sum = (c("kind") == "percent") & (c("stat") == "possession")
    home = F.when(zero_sum, split).when(c("kind") == "percent", share(c("home"), c("made_h"), c("allowed_a"))).otherwise(c("home") * c("made_h") * c("allowed_a"))
    away = F.when(zero_sum, 100 - split).when(c("kind") == "percent", share(c("away"), c("made_a"), c("allowed_h"))).otherwise(c("away") * c("made_a") * c("allowed_h"))
    x = x.withColumn("m_home", home).withColumn("m_away", away)
    x = x.withColumn("i_home", interval(c("kind"), c("m_home"), c("sd"))).withColumn("i_away", interval(c("kind"), c("m_away"), c("sd")))
    tens = F.pow(F.lit(10.0), c("digits"))
    r = lambda v: F.floor(v * tens + 0.5) / tens
    return x.select("event_id", "stat", *(r(c(v)).alias(f"{s}_{k}") for s in ("home", "away") for k, v in (("mean", f"m_{s}"), ("low", f"i_{s}.low"), ("high", f"i_{s}.high"))))


def statistics_error(forecasts: DataFrame, actual: DataFrame) -> DataFrame:
    """event_id, stat, err_home, err_away (two digits), within, of forecasts whose event has the statistic (event_id, stat,
    home, away) for both sides."""
    x = forecasts.join(actual.filter("home is not null and away is not null"), ["event_id", "stat"])
    inside = c("home").between(c("home_low"), c("home_high")) & c("away").between(c("away_low"), c("away_high"))
    return x.select("event_id", "stat", f.half_up(c("home") - c("home_mean"), 2).alias("err_home"), f.half_up(c("away") - c("away_mean"), 2).alias("err_away"), inside.alias("within"))


def coverage(errors: DataFrame) -> DataFrame:
    """Of each statistic how many forecasts there were, the share within range and the mean absolute error of both sides."""
    size = (F.abs("err_home") + F.abs("err_away")) / 2
    return errors.groupBy("stat").agg(F.count("*").alias("n"), F.avg(c("within").cast("double")).alias("within"), F.avg(size).alias("error"))
