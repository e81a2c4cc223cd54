"""Reports of events brought onto stored ones: one report for an event at most, gaps filled, states of higher rank kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.operators.records import nearest, status_rank
from tallyfield.scratch import save

c = F.col
PAIR = ["comp", "home", "away"]
#: Hours between a report's start and a stored one's within which they may be one event, and the difference that counts as none.
WINDOW, SAME = 36.0, 1.0 / 60
#: Columns that a report replaces where it has a value, and those it only fills.
REPLACED, FILLED = ("round", "minute"), ("referee", "venue", "format")


def assigned(reports: DataFrame, stored: DataFrame, window: float = WINDOW) -> DataFrame:
    """ref and event_id of the reports that are of a stored event, a written table.  Neither stands twice.

    reports: ref, provider, ext, comp, home, away, starts; stored: event_id, comp, home, away, starts, ids (map of providers'
    ids).  A report of the same pairing within ``window`` hours that names the event's own id of its provider is of that event
    first of all (of several the smallest ref).  The others are assigned in rounds: a report and an event that are each other's
    nearest (of equals the smaller id) are one.  That is what taking the nearest pair of all again and again would give.  The
    nearest pair of all is taken in every round, so rounds end; each leaves only what has met a nearer rival."""
    own = stored.select(*PAIR, "event_id", c("starts").alias("at"), F.explode("ids").alias("provider", "ext"))
    named = reports.join(own, [*PAIR, "provider", "ext"]).filter(F.abs(c("starts") - c("at")) <= window)
    gap = F.struct(F.abs(c("starts") - c("at")), "event_id")
    named = named.groupBy("ref").agg(F.min_by("event_id", gap).alias("event_id")).groupBy("event_id").agg(F.min("ref").alias("ref"))
    done = save(named.select("ref", "event_id"), "assigned")
    left = save(reports.select("ref", *PAIR, "starts").join(done, "ref", "left_anti"), "reports-left")
    free = stored.select("event_id", *PAIR, c("starts").alias("at")).join(done, "event_id", "left_anti")
    while True:
        asks = nearest(left, free, PAIR, "starts", "at", "event_id", window).filter(c("match").isNotNull())
        takes = nearest(free, left, PAIR, "at", "starts", "ref", window).select("event_id", c("match").alias("ref"))
        won = save(asks.select("ref", c("match").alias("event_id")).join(takes, ["ref", "event_id"]), "assigned")
        if won.isEmpty():
            return save(done, "assignment")
        done = done.union(won)
        # who asked for nothing now will find no more later
        left = save(asks.select("ref", *PAIR, "starts").join(won, "ref", "left_anti"), "reports-left")
        free = free.join(won, "event_id", "left_anti")


def numbered(rows: DataFrame, order: list[str], first: int, name: str) -> DataFrame:
    """``rows`` with whole numbers in the order of columns, from ``first`` on: rows are numbered within ranges of the order, which
    are written first so that they stay as they are."""
    parts = save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    before = parts.groupBy("__p").count().withColumn("__before", F.coalesce(F.sum("count").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    n = first + c("__before") + F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    return parts.join(F.broadcast(before.drop("count")), "__p").withColumn(name, n).drop("__p", "__before")


def upsert_events(stored: DataFrame, reports: DataFrame, window: float = WINDOW) -> DataFrame:
    """All stored events as they are after the reports, and a new one for each report that is of none; ``action`` says which:
    kept, updated or inserted.

    stored: event_id, comp, home, away, starts (hours), status, result, round, minute, referee, venue, format, ids; reports: ref,
    provider, ext and the same without event_id and ids.  Reports of a side against itself are left out: two names have been
    taken for one.  A report that is only scheduled leaves the state and start of an event of higher rank, and a result that
    is there; starts that differ by a minute or less are the same.  New ids follow the largest, in the order of refs."""
    usable = reports.filter("home <> away")
    pairs = assigned(usable, stored, window)
    report = usable.join(pairs, "ref", "left")
    fields = ("starts", "status", "result", *REPLACED, *FILLED, "provider", "ext")
    old = stored.join(report.filter(c("event_id").isNotNull()).select("event_id", F.struct(*fields).alias("b")), "event_id", "left")
    has = c("b").isNotNull()
    keep = (c("b.status") == "SCHEDULED") & (status_rank(c("status")) > status_rank(c("b.status")))
    moved = has & ~keep & (F.abs(c("starts") - c("b.starts")) > SAME)
    told = has & c("b.result").isNotNull() & ((c("b.status") != "SCHEDULED") | c("result").isNull())
    others = F.map_filter("ids", lambda k, _: ~k.eqNullSafe(c("b.provider")))
    new = {
        "starts": F.when(moved, c("b.starts")).otherwise(c("starts")), "status": F.when(has & ~keep, c("b.status")).otherwise(c("status")), "result": F.when(told, c("b.result")).otherwise(c("result")),
        **{k: F.coalesce(c(f"b.{k}"), c(k)) for k in REPLACED}, **{k: F.coalesce(c(k), c(f"b.{k}")) for k in FILLED},
        "ids": F.when(has, F.map_concat(others, F.create_map("b.provider", "b.ext"))).otherwise(c("ids")),
    }
    cols = ["event_id", *PAIR, *new]
    old = old.select("event_id", *PAIR, *(v.alias(k) for k, v in new.items()), F.when(has, "updated").otherwise("kept").alias("action"))
    last = stored.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    fresh = numbered(report.filter(c("event_id").isNull()).drop("event_id"), ["ref"], last + 1, "event_id")
    fresh = fresh.withColumn("ids", F.create_map("provider", "ext")).select(*cols, F.lit("inserted").alias("action"))
    return old.unionByName(fresh)


def upsert_sides(current: DataFrame, reports: DataFrame, aliases: DataFrame, values: list[str]) -> DataFrame:
    """Rows by event and team (statistics, line-ups) with the reports' in place of what was there; the newest of several counts.
    reports: event_id, provider, ext (the team's id there), at and ``values``; aliases: provider, ext, team.  Reports on teams
    that no alias knows are left out."""
    known = reports.join(aliases.groupBy("provider", "ext").agg(F.min("team").alias("team")), ["provider", "ext"])
    newest = known.groupBy("event_id", "team").agg(F.max_by(F.struct(*values, c("provider").alias("source")), F.struct("at", "provider", "ext")).alias("b"))
    both = current.select("event_id", "team", F.struct(*values, "source").alias("a")).join(newest, ["event_id", "team"], "full")
    return both.select("event_id", "team", F.coalesce("b", "a").alias("x")).select("event_id", "team", "x.*")
