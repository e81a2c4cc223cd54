"""States of events that change by time as well as by reports, over a stream of reports that may come late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col
MINUTE = 60_000
#: An event that is only scheduled but has scores counts as over this long after its start (minutes).
OVER = 180
#: Forecasts are due this long before the start (minutes): a day, and the line-ups.
DAY, LINEUP = 1440, 60
#: Groups of events by a hash of their id; the states of a group are one row of state.
GROUPS = 4096
STATE = "parts binary, seen long"
OUT = "event_id long, status string, hs int, aws int, starts long, stage int, seen long"
#: Of an event's reports at most four count, one of each kind: the newest that is more than scheduled and the newest scheduled
#: one (a: start), the newest with scores that is more than scheduled and the first scheduled one with scores (a, b: scores).
#: Of a kind that with the largest (t, status, a, b) counts; t is negative where the first one does.
PART = pa.schema([("event_id", pa.int64()), ("kind", pa.int32()), ("t", pa.int64()), ("status", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
ORDER = [(k, "ascending") for k in PART.names]


def _parts() -> Column:
    """What a report says by kind: an array of (kind, t, status, a, b)."""
    at, starts = F.unix_millis("at"), F.unix_millis("starts")
    more, scores = c("status") != "SCHEDULED", c("hs").isNotNull() & c("aws").isNotNull()
    n = lambda k: c(k).cast("long")
    part = lambda kind, keep, t, status, a, b: F.when(keep, F.struct(F.lit(kind).alias("kind"), t.alias("t"), status.alias("status"), a.alias("a"), b.alias("b")))
    none, zero = F.lit(""), F.lit(0).cast("long")
    kinds = F.array(part(0, more, at, c("status"), starts, zero), part(1, ~more, at, none, starts, zero), part(2, more & scores, at, none, n("hs"), n("aws")), part(3, ~more & scores, -at, none, n("hs"), n("aws")))
    return F.filter(kinds, lambda x: x.isNotNull())


def counting(parts: pa.Table) -> pa.Table:
    """The parts that count: the largest of each event and kind."""
    x = parts.take(pc.sort_indices(parts, sort_keys=ORDER, null_placement="at_start"))
    last = pc.ScalarAggregateOptions(skip_nulls=False)
    keys, values = PART.names[:2], PART.names[2:]
    out = x.group_by(keys, use_threads=False).aggregate([(k, "last", last) for k in values])
    return out.select(keys + [f"{k}_last" for k in values]).rename_columns(PART.names).cast(PART)


def current(parts: pa.Table, now: int) -> dict[str, pa.Array]:
    """By event, at a time (milliseconds): event_id, status, hs, aws, starts, stage, and the times that change it (null: none).
    Of reports that are more than scheduled the newest says state and start, else the newest of all; their newest scores
    count, else the first that a scheduled one gave.  stage: 2 from the line-ups on, 1 from a day before, for events to come."""
    of = lambda kind, k: pc.if_else(pc.equal(parts["kind"], kind), parts[k], pa.scalar(None, PART.field(k).type))
    cols = {"said": of(0, "status"), "n": of(0, "a"), "s": of(1, "a"), "nh": of(2, "a"), "na": of(2, "b"), "sh": of(3, "a"), "sa": of(3, "b")}
    x = pa.table({"event_id": parts["event_id"], **cols}).group_by("event_id", use_threads=False).aggregate([(k, "first") for k in cols])
    get = lambda k: x[f"{k}_first"].combine_chunks()
    said = pc.fill_null(get("said"), "SCHEDULED")
    starts, hs, aws = (pc.coalesce(get(a), get(b)) for a, b in (("n", "s"), ("nh", "sh"), ("na", "sa")))
    open_ = pc.equal(said, "SCHEDULED")
    after = lambda minutes, keep: pc.if_else(keep, pc.add(starts, minutes * MINUTE), pa.scalar(None, pa.int64()))
    times = [after(-DAY, open_), after(-LINEUP, open_), after(OVER, pc.and_(open_, pc.is_valid(hs)))]
    day, lineup, over = (pc.fill_null(pc.less_equal(t, now), False) for t in times)
    stage = pc.if_else(over, 0, pc.add(day.cast(pa.int32()), lineup.cast(pa.int32())))
    return {"event_id": x["event_id"].combine_chunks(), "status": pc.if_else(over, "FINISHED", said), "hs": hs.cast(pa.int32()), "aws": aws.cast(pa.int32()), "starts": starts, "stage": stage.cast(pa.int32()), "times": times}


def merged(state: tuple | None, at: int, status: str, starts: int, hs: int | None, aws: int | None) -> tuple:
    """The rule for one event, a report at a time, which the stream takes for many at once: the state (at, status and start;
    at and start; at and scores, twice) with one report more.  The order in which reports come does not matter.  Of reports
    of one time the larger status, start and scores count."""
    s = list(state or (None,) * 11)
    newer = lambda i, key: s[i] is None or key > tuple(s[i : i + len(key)])
    if status != "SCHEDULED":
        if newer(0, (at, status, starts)):
            s[0:3] = at, status, starts
        if hs is not None and aws is not None and newer(5, (at, hs, aws)):
            s[5:8] = at, hs, aws
    else:
        if newer(3, (at, starts)):
            s[3:5] = at, starts
        if hs is not None and aws is not None and (s[8] is None or (-at, hs, aws) > (-s[8], s[9], s[10])):
            s[8:11] = at, hs, aws
    return tuple(s)


def _written(parts: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, PART, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(parts)
    return out.getvalue().to_pybytes()


def event_states(reports: DataFrame, late: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """A row for each event and batch in which it was reported on or a time came: its state as the watermark has it.

    reports: event_id, at (timestamp), status, starts (timestamp), hs, aws.  Rows more than ``late`` behind the newest are
    dropped.  Events are kept in ``groups`` by a hash of their id, so Python is called for each group, not for each event.  A
    group's state has up to four short rows for each of its events, and one timer for the next time that changes any of
    them: a day before the start, the line-ups, or three hours after the start of a scheduled event with scores."""
    rows = reports.withWatermark("at", late).select("at", "event_id", F.inline(_parts()))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("event_id"), F.lit(groups)).cast("int"))
    types = {pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old, since = state.get if state.exists else (None, None)
        now = state.getCurrentWatermarkMs()
        kept = PART.empty_table() if old is None else pa.ipc.open_stream(bytes(old)).read_all()
        new = PART.empty_table()
        if not state.hasTimedOut:
            new = pa.concat_tables([new, *(pa.Table.from_pandas(pdf[PART.names], PART, preserve_index=False) for pdf in frames)])
        parts = counting(pa.concat_tables([kept, new])) if len(new) else kept
        x = current(parts, now)
        times = x.pop("times")
        show = pc.is_in(x["event_id"], value_set=pc.unique(new["event_id"]).cast(pa.int64()))
        if since is not None:  # what came by time since this group was last looked at
            for t in times:
                show = pc.or_(show, pc.fill_null(pc.and_(pc.greater(t, since), pc.less_equal(t, now)), False))
        state.update((_written(parts), now))
        ahead = [m for m in (pc.min(pc.filter(t, pc.greater(t, now))).as_py() for t in times) if m is not None]
        if ahead:
            state.setTimeoutTimestamp(min(ahead))
        out = pa.table(x).filter(show)
        yield out.append_column("seen", pa.array([now] * len(out), pa.int64())).to_pandas(types_mapper=types.get)

    return rows.groupBy("group").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def states_at(reports: DataFrame, now: Column) -> DataFrame:
    """The same states by one aggregation over all reports, at a time: event_id, status, hs, aws, starts (milliseconds), stage."""
    at, starts = F.unix_millis("at"), F.unix_millis("starts")
    more, scores = c("status") != "SCHEDULED", c("hs").isNotNull() & c("aws").isNotNull()
    x = reports.groupBy("event_id").agg(
        F.max(F.when(more, F.struct(at.alias("at"), "status", starts.alias("starts")))).alias("ns"), F.max(F.when(~more, F.struct(at.alias("at"), starts.alias("starts")))).alias("s"),
        F.max(F.when(more & scores, F.struct(at.alias("at"), "hs", "aws"))).alias("nr"), F.max(F.when(~more & scores, F.struct((-at).alias("at"), "hs", "aws"))).alias("sr"),
    )
    said = F.when(c("ns").isNotNull(), c("ns.status")).otherwise("SCHEDULED")
    x = x.select("event_id", said.alias("said"), F.coalesce("ns.starts", "s.starts").alias("starts"), F.coalesce("nr.hs", "sr.hs").alias("hs"), F.coalesce("nr.aws", "sr.aws").alias("aws"))
    over = (c("said") == "SCHEDULED") & c("hs").isNotNull() & (now >= c("starts") + OVER * MINUTE)
    x = x.withColumn("status", F.when(over, "FINISHED").otherwise(c("said")))
    stage = F.when(c("status") != "SCHEDULED", 0).when(now >= c("starts") - LINEUP * MINUTE, 2).when(now >= c("starts") - DAY * MINUTE, 1).otherwise(0)
    return x.select("event_id", "status", "hs", "aws", "starts", stage.alias("stage"))
