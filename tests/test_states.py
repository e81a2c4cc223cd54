"""The stream of event states ends where the batch rule is, late rows and timers included."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tallyfield.streaming import results, states

SCHEMA = "event_id long, at timestamp, status string, starts timestamp, hs int, aws int"
BASE = datetime(2024, 1, 1)


def test_stream_equals_batch_rule(spark, tmp_path):
    rng = random.Random(9)
    folder, late = tmp_path / "in", timedelta(days=1)
    kept, newest = [], None
    for batch in range(5):
        rows = []
        for _ in range(60):
            at = BASE + timedelta(hours=24 * batch + rng.uniform(-50, 24))
            scores = rng.random() < 0.5
            rows.append((rng.randrange(40), at, rng.choice(["SCHEDULED", "SCHEDULED", "LIVE", "FINISHED", "POSTPONED"]), BASE + timedelta(hours=rng.randrange(0, 200)), rng.randrange(4) if scores else None, rng.randrange(4) if scores else None))
        # an event on its own, which no later row wakes
        rows.append((100 + batch, BASE + timedelta(hours=24 * batch + 20), "SCHEDULED", BASE + timedelta(hours=24 * batch + 30), *((1, 0) if batch % 2 else (None, None))))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = states.event_states(spark.readStream.schema(SCHEMA).parquet(str(folder)), "1 day")
        out = results.run_to_end(stream, str(tmp_path / "out"), "update")
        kept += [r for r in rows if newest is None or r[1] >= newest - late]
        newest = max([r[1] for r in rows] + ([newest] if newest else []))
    assert len(kept) < 5 * 61
    now = int((newest - late).replace(tzinfo=timezone.utc).timestamp() * 1000)
    got = {r.event_id: tuple(r)[1:6] for r in out.groupBy("event_id").agg(F.max_by(F.struct("event_id", "status", "hs", "aws", "starts", "stage"), "batch").alias("x")).select("x.*").collect()}
    want = {r.event_id: tuple(r)[1:] for r in states.states_at(spark.createDataFrame(kept, SCHEMA), F.lit(now)).collect()}
    assert got == want
    assert {s for s, *_ in got.values()} >= {"SCHEDULED", "FINISHED", "LIVE"} and {x[-1] for x in got.values()} == {0, 1, 2}


def test_order_of_reports_does_not_matter():
    rng = random.Random(1)
    for _ in range(50):
        rows = [(rng.randrange(5), rng.choice(["SCHEDULED", "LIVE", "FINISHED"]), rng.randrange(3), rng.choice([None, 1, 2]), rng.choice([None, 0])) for _ in range(6)]
        ends = set()
        for _ in range(5):
            s = None
            for r in rng.sample(rows, len(rows)):
                s = states.merged(s, *r)
            ends.add(s)
        assert len(ends) == 1
