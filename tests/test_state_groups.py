"""States of events are kept by groups of events: as many rows of state as groups, and the same results."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tallyfield.streaming import states

SCHEMA = "event_id long, at timestamp, status string, starts timestamp, hs int, aws int"
BASE = datetime(2024, 1, 1)


def test_states_are_kept_by_group_not_by_event(spark, tmp_path):
    rows = [(i, BASE + timedelta(minutes=i % 50), "SCHEDULED" if i % 3 else "LIVE", BASE + timedelta(hours=i % 70), i % 4, i % 3) for i in range(900)]
    spark.createDataFrame([*rows, (None, BASE, "FINISHED", BASE, 2, 1)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = states.event_states(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "1 day", groups=8)
    q = stream.writeStream.outputMode("update").format("memory").queryName("by_group").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 8
    last = spark.table("by_group").groupBy("event_id").agg(F.max_by(F.struct("status", "hs", "aws", "starts", "stage"), "seen").alias("x")).select("event_id", "x.*")
    now = int((BASE + timedelta(minutes=49) - timedelta(days=1)).replace(tzinfo=timezone.utc).timestamp() * 1000)
    want = states.states_at(spark.createDataFrame([*rows, (None, BASE, "FINISHED", BASE, 2, 1)], SCHEMA), F.lit(now))
    assert sorted(map(tuple, last.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
