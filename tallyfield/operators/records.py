"""Reconciling records: as-of and interval joins, upserts by precedence, open and resolved rows, entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col
#: Of two states of an event the one of higher rank stays.
STATUS_RANK = {"CANCELLED": 4, "POSTPONED": 3, "FINISHED": 3, "LIVE": 2, "SCHEDULED": 1}


def status_rank(status: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in STATUS_RANK.items() for x in kv))[status], F.lit(0))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, tie: str, within: int | None = None) -> DataFrame:
    """Each left row with the newest right row of its keys at or before its time, not older than ``within``.

    Both sides go through one shuffle by key, as one sequence of rows in order of time, and the last right row is
    carried forward; no pair of rows that does not match is ever built.  Right columns are the struct ``r``.
    """
    rcols = [x for x in right.columns if x not in keys]
    lcols = [x for x in left.columns if x not in keys]
    l_ = left.select(*keys, c(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.struct(*lcols).alias("__l"), F.lit(None).cast(right.select(F.struct(*rcols).alias("x")).schema["x"].dataType).alias("__r"))
    r_ = right.select(*keys, c(right_at).alias("__t"), F.lit(0).alias("__side"), c(tie).alias("__tie"), F.lit(None).cast(left.select(F.struct(*lcols).alias("x")).schema["x"].dataType).alias("__l"), F.struct(*rcols).alias("__r"))
    w = W.partitionBy(*keys).orderBy("__t", "__side", "__tie").rowsBetween(W.unboundedPreceding, 0)
    out = l_.unionByName(r_).withColumn("r", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    if within is not None:
        out = out.withColumn("r", F.when(c(f"r.{right_at}") >= c("__t") - within, c("r")))
    return out.select(*keys, "__l.*", "r")


def nearest(incoming: DataFrame, known: DataFrame, keys: list[str], at: str, known_at: str, id_col: str, within: int) -> DataFrame:
    """Each incoming row's nearest known row of its keys within a distance, the smaller id of equals; ``match`` is null
    without one.

    Both sides go through one shuffle by key.  In order of time, the last known row before and, the other way round, the
    first one after are carried along; only these two can be the nearest, so no pairs are built."""
    k = known.groupBy(*keys, c(known_at).alias("__at")).agg(F.min(id_col).alias("__id"))
    cols = [x for x in incoming.columns if x not in keys]
    row = F.struct(*cols).alias("__l")
    kind = incoming.select(row).schema["__l"].dataType
    mine = incoming.select(*keys, c(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(k.schema["__id"].dataType).alias("__id"), row)
    theirs = k.select(*keys, "__at", F.lit(0).alias("__side"), "__id", F.lit(None).cast(kind).alias("__l"))
    found = F.when(c("__side") == 0, F.struct(c("__at").alias("at"), c("__id").alias("id")))
    w = W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    both = theirs.unionByName(mine)
    both = both.withColumn("__b", F.last(found, ignorenulls=True).over(w.orderBy("__at", "__side")))
    both = both.withColumn("__a", F.last(found, ignorenulls=True).over(w.orderBy(F.desc("__at"), "__side")))
    near = [F.when(F.abs(c("__at") - c(f"{x}.at")) <= within, F.struct(F.abs(c("__at") - c(f"{x}.at")).alias("gap"), c(f"{x}.id").alias("id"))) for x in ("__b", "__a")]
    return both.filter("__side = 1").select(*keys, "__l.*", F.least(*near)["id"].alias("match"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, at: str) -> DataFrame:
    """Current rows with the incoming ones applied: of several for a key the newest; a row that is only scheduled does
    not replace one of higher rank; nulls of the incoming row leave what was there."""
    newest = incoming.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at), F.desc("status")))).filter("__k = 1").drop("__k")
    cols = [x for x in current.columns if x != key]
    both = current.select(key, F.struct(*cols).alias("a")).join(newest.select(key, F.struct(*cols).alias("b")), key, "full")
    refuse = (c("b.status") == "SCHEDULED") & (status_rank(c("a.status")) > 1)
    take = c("b").isNotNull() & (c("a").isNull() | ~refuse)
    return both.select(key, *(F.when(take, F.coalesce(c(f"b.{x}"), c(f"a.{x}"))).otherwise(c(f"a.{x}")).alias(x) for x in cols))


def reconcile(open_rows: DataFrame, listed: DataFrame, keys: list[str], value: str, now: Column) -> DataFrame:
    """Open rows against the list that counts now: absent ones are resolved, present ones updated, new ones opened.  Keys
    are compared without case."""
    low = lambda d: d.select(*(F.lower(c(k).cast("string")).alias(k) for k in keys), value)
    a, b = low(open_rows).withColumnRenamed(value, "old").withColumn("was", F.lit(True)), low(listed).withColumnRenamed(value, "new").withColumn("is", F.lit(True))
    both = a.join(b, keys, "full")
    action = F.when(c("is").isNull(), "resolved").when(c("was").isNull(), "opened").otherwise("updated")
    return both.select(*keys, F.coalesce("new", "old").alias(value), action.alias("action"), F.when(action == "resolved", now).alias("resolved_at"))


def dropped(current: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows whose keys the new list lacks."""
    return current.join(listed.select(*keys).distinct(), keys, "left_anti")


def resolve(names: DataFrame, entities: DataFrame, rules: list[tuple[str, str]], id_col: str = "entity") -> DataFrame:
    """Each row of names with the entity of the first rule that finds one: rules are pairs of a column of names and one of
    entities, in order of trust.  Within a rule the smallest id counts, so each lookup has one row for each key."""
    out = names
    for i, (left, right) in enumerate(rules):
        look = entities.filter(c(right).isNotNull()).groupBy(c(right).alias(f"__k{i}")).agg(F.min(id_col).alias(f"__e{i}"))
        out = out.join(look, c(left) == c(f"__k{i}"), "left")
    found = [c(f"__e{i}") for i in range(len(rules))]
    rule = F.coalesce(*(F.when(x.isNotNull(), F.lit(i + 1)) for i, x in enumerate(found)))
    return out.select(*names.columns, F.coalesce(*found).alias(id_col), rule.alias("rule"))


def remap(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with merged entities' ids replaced in the given columns.  mapping: ``from``, ``into``."""
    for x in columns:
        m = mapping.select(c("from").alias("__f"), c("into").alias("__i"))
        rows = rows.join(m, c(x) == c("__f"), "left").withColumn(x, F.coalesce("__i", x)).drop("__f", "__i")
    return rows


def next_versions(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows with versions that go on from the largest there is."""
    last = existing.groupBy(key).agg(F.max("version").alias("__last"))
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    return incoming.join(last, key, "left").withColumn("version", F.coalesce("__last", F.lit(0)) + n).drop("__last")


def resolve_or_create(names: DataFrame, entities: DataFrame, rules: list[tuple[str, str]], key: str, id_col: str = "entity") -> DataFrame:
    """``resolve``, and new ids for rows that no rule finds: one for each value of ``key`` among them, in its order, from the
    largest known id on.  Rows without a key stay without an id; ``created`` tells new ones."""
    found = resolve(names, entities, rules, id_col)
    new = found.filter(c(id_col).isNull() & c(key).isNotNull()).select(key).distinct()
    last = entities.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("__last"))
    # one order over all new keys: values are numbered within ranges of the sorted keys
    parts = new.repartitionByRange(key).sortWithinPartitions(key).select(key, F.spark_partition_id().alias("__p"))
    sizes = parts.groupBy("__p").count()
    before = sizes.select("__p", F.coalesce(F.sum("count").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each range
    ranked = parts.join(F.broadcast(before), "__p").withColumn("__n", c("__before") + F.row_number().over(W.partitionBy("__p").orderBy(key)))
    ids = ranked.crossJoin(F.broadcast(last)).select(c(key).alias("__key"), (c("__last") + c("__n")).alias("__new"))  # one row
    out = found.join(ids, c(key).eqNullSafe(c("__key")) & c(id_col).isNull(), "left")
    return out.select(*names.columns, F.coalesce(c(id_col).cast("bigint"), "__new").alias(id_col), "rule", c("__new").isNotNull().alias("created"))


def put(current: DataFrame, incoming: DataFrame, keys: list[str], order: str, fill_only: list[str] = ()) -> DataFrame:
    """Rows by key, the newest incoming one in place of the current one.  Columns of ``fill_only`` keep a current value;
    nulls of the incoming row never replace anything.  Both sides have the same columns; of several incoming rows for a
    key the largest ``order`` counts."""
    newest = incoming.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("__k = 1").drop("__k")
    cols = [x for x in current.columns if x not in keys]
    both = current.select(*keys, F.struct(*cols).alias("a")).join(newest.select(*keys, F.struct(*cols).alias("b")), keys, "full")
    pick = lambda x: F.coalesce(c(f"a.{x}"), c(f"b.{x}")) if x in fill_only else F.coalesce(c(f"b.{x}"), c(f"a.{x}"))
    return both.select(*keys, *(pick(x).alias(x) for x in cols))


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The incoming rows whose keys are not there yet, the first of several for a key."""
    first = incoming.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("__k = 1").drop("__k")
    return first.join(current.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns)


def merged_ids(current: DataFrame, incoming: DataFrame, key: str, ids: str) -> DataFrame:
    """Current rows with the incoming maps of provider ids put over their own, provider by provider."""
    new = incoming.groupBy(key).agg(F.map_from_entries(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_entries(ids)))))).alias("__new"))
    own = F.map_filter(c(ids), lambda k, v: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False)))
    return current.join(new, key, "left").withColumn(ids, F.map_concat(own, F.coalesce("__new", F.map_filter(c(ids), lambda k, v: F.lit(False))))).drop("__new")


def tally(runs: DataFrame, keys: list[str]) -> DataFrame:
    """ok, failed and the state of each group of runs (a boolean ``ok``): OK, PARTIAL or FAILED."""
    out = runs.groupBy(*keys).agg(F.count_if("ok").alias("good"), F.count_if(~c("ok")).alias("failed"))
    return out.withColumn("state", F.when(c("failed") == 0, "OK").when(c("good") > 0, "PARTIAL").otherwise("FAILED"))


def pick_accuracy(picks: DataFrame, forecasts: DataFrame) -> DataFrame:
    """n, right, model_n and model_right of users' picks (event_id, pick, outcome) next to the favourite of the final
    forecast of the same event, if it has one (event_id, favourite)."""
    x = picks.join(forecasts, "event_id", "left").filter("outcome is not null")
    return x.agg(F.count("*").alias("n"), F.count_if(c("pick") == c("outcome")).alias("right"), F.count("favourite").alias("model_n"), F.count_if(c("favourite") == c("outcome")).alias("model_right"))
