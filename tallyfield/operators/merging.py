"""Duplicates among entities: who looks like whom, chains of merges followed to their end, all tables rewritten."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfield.scratch import save

c = F.col


def unmatched(teams: DataFrame, aliases: DataFrame, least: float = 0.86) -> DataFrame:
    """team, match and sim of teams that one provider alone knows, or none, with the most similar other team of their sport.

    teams: team, name, sport; aliases: team, provider.  Names are compared within a sport, equal ones once."""
    from tallyfield.functions.scalars import normalise_name
    from tallyfield.plans.fits import similar_names

    several = aliases.groupBy("team").agg(F.count_distinct("provider").alias("n")).filter("n > 1")
    named = teams.select("team", "sport", normalise_name(c("name")).alias("n")).filter("n is not null")
    own = named.join(several, "team", "left_anti")
    pairs = similar_names(own.select("n").distinct(), named.select("n").distinct(), least)
    # two teams of a name are enough: one of them is another one
    few = named.withColumn("k", F.row_number().over(W.partitionBy("sport", "n").orderBy("team"))).filter("k <= 2")
    other = few.select(c("n").alias("other"), "sport", c("team").alias("match"))
    both = own.join(pairs, "n").join(other, ["other", "sport"]).filter(c("team") != c("match"))
    return both.groupBy("team").agg(F.max_by(F.struct("match", "sim"), F.struct("sim", -c("match"))).alias("x")).select("team", "x.*")


def final_ids(merges: DataFrame) -> DataFrame:
    """from and into, the end of each chain of merges, a written table.  merges: from, into; of several for an id the smallest
    ``into`` counts.  A cycle ends at its smallest id, for itself and for what leads into it.

    Pointers are doubled: after k rounds each id knows the one 2 ** k merges on and the smallest on the way there.  Rounds end
    when no pointer moves, and after as many as reach around any cycle; the smallest on the way from an id on a cycle is then
    the cycle's."""
    first = merges.filter("from is not null and into is not null").groupBy("from").agg(F.min("into").alias("next"))
    ends = merges.select(c("into").alias("from")).distinct().join(first, "from", "left_anti").filter("from is not null").select("from", c("from").alias("next"))
    cur = save(first.unionByName(ends).withColumn("low", c("from")), "merges")
    rounds = max(1, math.ceil(math.log2(max(2, cur.count()))) + 1)
    for _ in range(rounds):
        ahead = cur.select(c("from").alias("next"), c("next").alias("after"), c("low").alias("least"))
        moved = save(cur.join(ahead, "next").select("from", "next", "after", F.least("low", "least").alias("low")), "merges")
        still = moved.filter("next <> after").isEmpty()
        cur = moved.select("from", c("after").alias("next"), "low")
        if still:
            break
    end = cur.select(c("from").alias("next"), c("low").alias("into"))
    out = cur.join(end, "next").select("from", "into")
    return save(out.filter(c("from") != c("into")), "merged")


def rewritten(rows: DataFrame, final: DataFrame, columns: list[str], unique: list[str] | None = None, newest: list[str] | None = None) -> DataFrame:
    """``rows`` with merged ids replaced in columns.  Where a row's ``unique`` columns then are another's too, the one that is
    largest by ``newest`` stays, of equals the one whose ids were not replaced.  An id with many rows is looked up in a
    table with one row for each merged id, so no rows of an id need to meet."""
    was = F.lit(0)
    for x in columns:
        m = final.select(c("from").alias("__from"), c("into").alias("__into"))
        rows = rows.join(m, c(x) == c("__from"), "left").withColumn(x, F.coalesce("__into", x)).withColumn(f"__m_{x}", c("__into").isNotNull().cast("int")).drop("__from", "__into")
        was = was + c(f"__m_{x}")
    if unique is not None:
        order = W.partitionBy(*unique).orderBy(*(F.desc(x) for x in newest or []), was, *(F.asc(x) for x in rows.columns if not x.startswith("__m_") and x not in unique))
        rows = rows.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")
    return rows.drop(*(f"__m_{x}" for x in columns))


def merge_entities(merges: DataFrame, tables: dict[str, tuple[DataFrame, list[str], list[str] | None, list[str] | None]], entities: DataFrame, id_col: str = "team") -> dict[str, DataFrame]:
    """All tables after merges: each table (rows, columns with ids, unique columns or None, order of age or None) rewritten, and
    the entities without those that went into others, under the name of ``id_col``.  Merges of ids that are no entities are
    followed too."""
    final = final_ids(merges)
    out = {name: rewritten(*(df, final, columns), unique, newest) for name, (df, columns, unique, newest) in tables.items()}
    out[id_col] = entities.join(final.select(c("from").alias(id_col)), id_col, "left_anti")
    return out
