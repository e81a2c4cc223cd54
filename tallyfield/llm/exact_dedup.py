"""Exact dedup by two-pass Bloom filtering.

Pass 1 hashes every text and counts, in a filter of cells, whether a cell was hit once or more often.  Pass 2 tests
each row: a text that occurs twice has hit each of its cells twice, so a row with a cell hit once is unique and passes
straight through.  Only the other rows shuffle, to be grouped by SHA-256.

The filter has ``CELLS_PER_ROW`` cells for each row up to ``MAX_CELLS`` (a bit each, 64 MiB, the bound of what is
broadcast).  Beyond about 30 million rows the cells fill and more unique rows shuffle; results do not change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import drop, hot_join, save, text_of

PROBES = 4
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 29
SEGMENT = 1 << 16


def cells(h: np.ndarray, m: int, probes: int = PROBES) -> np.ndarray:
    """Row i: the cells of hash i, each probe in its own part of the filter, so that no row hits a cell twice."""
    h = h.astype(np.int64, copy=False).view(np.uint64)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    part = np.uint64(m // probes)
    return np.stack([(a + np.uint64(i) * b) % part + np.uint64(i) * part for i in range(probes)], 1).astype(np.int64)


def n_cells(n_rows: int, probes: int = PROBES) -> int:
    """Cells for so many rows, at most MAX_CELLS."""
    m = SEGMENT * probes
    while m < min(MAX_CELLS, n_rows * CELLS_PER_ROW):
        m *= 2
    return m


def cell_hits(h: np.ndarray, m: int, probes: int = PROBES) -> pa.RecordBatch:
    """The hits of hashes as rows (segment of the filter, places there)."""
    c = np.sort(cells(h, m, probes).ravel())
    c = c[np.r_[True, True, c[2:] != c[:-2]][: len(c)]]  # a third hit of a cell tells nothing new
    seg, at = np.unique(c // SEGMENT, return_index=True)
    off = (c % SEGMENT).astype("<u2")
    ends = np.r_[at[1:], len(c)]
    cols = [pa.array(seg, pa.int32()), pa.array([off[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["seg", "hits"])


def merged_cells(hits: DataFrame, m: int, least: int = 2) -> np.ndarray:
    """A bit for each of m cells that the rows (seg, hits) of all tasks hit ``least`` times (1 or 2) or more."""

    def merge(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SEGMENT, np.uint8)
        for g in groups:
            for x in g.column("hits"):
                o, k = np.unique(np.frombuffer(x.as_buffer(), "<u2"), return_counts=True)
                n[o] = np.minimum(n[o] + np.minimum(k, 2), 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(n >= least, bitorder="little").tobytes()], pa.binary())],
            ["seg", "bits"],
        )

    bits = np.zeros(m // 8, np.uint8)
    for r in hits.groupBy("seg").applyInArrow(merge, "seg int, bits binary").collect():  # MAX_CELLS bits at most
        bits[r.seg * SEGMENT // 8 : (r.seg + 1) * SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def repeated_cells(hashes: DataFrame, n_rows: int) -> tuple[np.ndarray, int]:
    """(a bit for each cell that was hit twice or more, number of cells) for the bigint column ``h``."""
    m = n_cells(n_rows)

    def hit(batches):
        for b in batches:
            if b.num_rows:
                yield cell_hits(b.column(0).to_numpy(zero_copy_only=False), m)

    return merged_cells(hashes.select("h").mapInArrow(hit, "seg int, hits binary"), m), m


def flagger(spark, bits: np.ndarray, m: int, probes: int = PROBES):
    """A function of a bigint column: are all cells of the hash set?"""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        c = cells(h.to_numpy(), m, probes)
        return pd.Series(((shared.value[c >> 3] >> (c & 7).astype(np.uint8)) & 1).all(1) if len(c) else np.zeros(0, bool))

    return maybe


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts the row with the largest id stays, and of
    fully repeated rows exactly one.  A null id is smaller than any other; keep_id is null only if all ids of the
    group are.  Empty table: no rows.  Further columns are ignored, whatever their names.
    """
    rows = save(
        df.select(
            df[id_col].cast("bigint").alias("doc_id"),
            F.sha2(text_of(df, text), 256).alias("text_sha256"),
            F.xxhash64(text_of(df, text)).alias("h"),
        ).withColumn("rid", F.monotonically_increasing_id()),
        "exact-rows",
    )
    n = rows.count()
    maybe = flagger(df.sparkSession, *repeated_cells(rows, n))
    flagged = rows.withColumn("maybe", maybe("h"))
    again = save(flagged.filter("maybe").drop("maybe", "h"), "exact-maybe")
    groups = save(
        again.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("top")),
        "exact-groups",
    )
    joined = hot_join(again, groups, "text_sha256", "group_size", again.count())
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return (
        flagged.filter(~F.col("maybe"))
        .select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        .unionByName(joined.withColumn("keep_id", F.col("top.doc_id")).withColumn("kept", F.col("rid") == F.col("top.rid")).select(out))
    )


def keep_distinct(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose texts stay, all columns as they are; the rule of ``exact_dedup``.

    Rows that the filter finds unique are passed on without a shuffle.  Of rows that agree in id and text one stays,
    any of them if other columns differ.
    """
    sha, h = F.sha2(text_of(df, text), 256), F.xxhash64(text_of(df, text))
    hashes = save(df.select(h.alias("h")), "exact-hashes")
    maybe = flagger(df.sparkSession, *repeated_cells(hashes, hashes.count()))
    drop(hashes)
    key, top, size = (f"__{c}_{len(df.columns)}" for c in ("sha", "top", "size"))
    again = df.filter(maybe(h)).withColumn(key, sha)
    groups = save(again.groupBy(key).agg(F.count("*").alias(size), F.max(df[id_col]).alias(top)), "exact-groups")
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    won = hot_join(again, groups, key, size, total, "inner").filter(F.col(id_col).eqNullSafe(F.col(top)))
    return df.filter(~maybe(h)).unionByName(won.dropDuplicates([key]).select(df.columns))
