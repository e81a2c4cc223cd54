"""Helpers the training-data operators share: scratch tables, hot-key joins, connected components.

Scratch tables go to the folder the cluster names in ``spark.checkpoint.dir``, which the driver and all executors
share.  A stage that is read more than once is written there once, so that a lost executor costs only the tasks it
was running, and lineage stays short.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has more than one row in so many; there can be no more hot keys than this.
HOT_KEYS = 1000
#: Nodes that a task's union-find holds at a time.
HELD = 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder, ``spark.checkpoint.dir``.  Where it is unset, a session on this machine alone gets a
    temporary folder; on a cluster no machine's own folder would do, so that raises."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="spark-scratch-")).as_uri()
        spark.sparkContext._conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Within this block the session has this setting."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def save(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and return the written table; its shuffle files go when it is written.  batch: so
    many rows go to Python at a time, where rows are large."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, CLEANUP, "true"), setting(spark, BATCH, str(batch)) if batch else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``save`` wrote and nothing will read again."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def hot_join(rows: DataFrame, groups: DataFrame, key: str, count: str, n_rows: int, how: str = "left", top: int | None = None) -> DataFrame:
    """Join ``rows`` with one row of ``groups`` for each key; no task gets all rows of a hot key.

    ``groups`` has, in ``count``, each key's number of rows and should be a written table.  Keys with more than
    ``n_rows / HOT_KEYS`` rows number fewer than ``HOT_KEYS``, which bounds what is broadcast at every input size; the
    rest are joined by a shuffle in which no key has more than that share.  top: the largest count, if it is known.
    """
    most = max(1, n_rows // HOT_KEYS)
    if top is None:
        top = groups.agg(F.max(count)).first()[0] or 0
    if top <= most:
        return rows.join(groups, key, how)
    hot = F.broadcast(groups.filter(F.col(count) > most))
    light = groups.filter(F.col(count) <= most)
    keys = hot.select(key)
    return rows.join(hot, key, "inner").unionByName(rows.join(F.broadcast(keys), key, "left_anti").join(light, key, how))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) for each node of a task's edges, by union-find; root is the smallest node of what the task has seen to be
    connected.  Starts anew when it has HELD nodes, which loses no connection: the roots of both parts meet at the nodes
    that they share."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while up[r] != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def rows() -> pa.RecordBatch:
        ids = list(up)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["id", "root"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(up.setdefault(x, x) if x not in up else x), root(up.setdefault(y, y) if y not in up else y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) >= HELD:
            yield rows()
            up.clear()
    if up:
        yield rows()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (id, component) for each id that has an edge; component is the
    smallest id reachable.  A written table; no edges: no rows.

    Distributed union-find by contraction.  In each round every task finds the components of its own edges; a node that
    several tasks have seen goes to the smallest of their roots, and those roots are the edges of the next round's much
    smaller graph, which fewer tasks take: each as many edges as it can hold.  What fits one task, by that bound, needs no shuffle and is
    the last round; the rounds' labels are followed from the last to the first.  No
    round moves more than a row for each node and task, and a hub is one node like any other.
    """
    rounds: list[DataFrame] = []
    cur = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    while True:
        tasks = cur.count() // max(1, HELD // 2 - 1) + 1
        stars = cur.coalesce(tasks).mapInArrow(_stars, "id bigint, root bigint")
        if tasks == 1:
            last = save(stars.withColumnRenamed("root", "component"), f"{name}-last")
            break
        seen = stars.groupBy("id").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
        seen = save(seen.select("id", "root", F.when(F.size("roots") > 1, F.col("roots")).alias("roots")), f"{name}-round")
        rounds.append(seen)
        cur = seen.filter("roots is not null").select(F.explode("roots").alias("a"), F.col("root").alias("b")).filter("a <> b")
    for seen in reversed(rounds):
        after = last.select(F.col("id").alias("root"), "component")
        last = seen.select("id", "root").join(after, "root", "left").select("id", F.coalesce("component", "root").alias("component"))
    if rounds:
        last = save(last, f"{name}-c")
    return last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
