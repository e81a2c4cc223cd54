"""Structured Streaming: windowed counts with late data, latest states, and ratings that go on from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyfield.plans.fits import elo_step

c = F.col


def stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The parquet files of a folder as a stream, with the schema of those that are there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, at: str = "ts", width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and kind; rows later than ``late`` behind the newest are dropped."""
    e = events.withColumn(at, c(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


def ratings(matches: DataFrame) -> DataFrame:
    """Elo ratings by competition over a stream of matches in order; the state of a competition is a rating and a season
    for each of its teams.  Each batch gives the ratings of the teams that played in it."""
    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        teams, values, years = state.get if state.exists else ([], [], [])
        rating, season = dict(zip(teams, values)), dict(zip(teams, years))
        pdf = pd.concat(list(parts)).sort_values(["day", "event_id"])
        for x in pdf.itertuples():
            elo_step(rating, season, x.home, x.away, x.hs, x.aws, x.season)
        state.update((list(rating), [float(v) for v in rating.values()], [int(v) for v in season.values()]))
        seen = sorted({*pdf.home, *pdf.away})
        yield pd.DataFrame({"comp": key[0], "team": seen, "rating": [rating[t] for t in seen], "day": int(pdf.day.max())})

    return matches.groupBy("comp").applyInPandasWithState(fold, "comp int, team int, rating double, day int", "teams array<int>, ratings array<double>, seasons array<int>", "update", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a parquet table below ``folder``, and return the table."""
    def write(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/out/b={k}")  # a batch that runs again replaces itself

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.withColumn("batch", F.lit(0)).schema).parquet(f"{folder}/out/b=*")
