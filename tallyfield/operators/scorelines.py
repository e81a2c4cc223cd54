"""What a grid of scores says, summed within a row.

Home and away goals are independent but for four low scores, so most sums over the grid are products of sums over one side's
goals, and only those cells that a sum needs are looked at.  Nothing is exploded; rows with the same rates can share a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.scratch import save

#: Goals of a side that a grid goes up to, scorelines that are named, and goals of the small grid that is shown.
MOST, TOP, SHOWN = 10, 8, 6


def _low(lam: Column, mu: Column, rho: Column) -> dict[tuple[int, int], Column]:
    """The factors of the four low scores."""
    plain = {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}
    return {k: F.greatest(F.lit(0.0), v) for k, v in plain.items()}


def _sides(lam: Column, mu: Column, most: int) -> Column:
    k = F.sequence(F.lit(0), F.lit(most))
    return F.struct(F.transform(k, lambda i: f.poisson_pmf(i, lam, most)).alias("h"), F.transform(k, lambda i: f.poisson_pmf(i, mu, most)).alias("a"))


def by_rates(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns made of ``lam`` and ``mu`` alone, each worked out once for each pair of rates in the rows and joined to
    those that have it: a grid costs far more than a row of a join.  The pairs' columns are written, since a filter that Spark
    infers from a generator above would else work them out for each row again; they are dealt out evenly, as few small rows
    would go to one task."""
    pairs = rows.select("lam", "mu").distinct().repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    done = save(pairs.select(F.col("lam").alias("__lam"), F.col("mu").alias("__mu"), *(v.alias(k) for k, v in columns.items())), "rates")
    return rows.join(done, rows.lam.eqNullSafe(done["__lam"]) & rows.mu.eqNullSafe(done["__mu"])).drop("__lam", "__mu")


def score_cells(lam: Column, mu: Column, rho: Column, most: int = MOST) -> Column:
    """An array of (h, a, p), home goals first, not made to sum to 1."""
    k = F.sequence(F.lit(0), F.lit(most))
    low = _low(lam, mu, rho)

    def cells(x):
        fix = lambda h, a: F.coalesce(*(F.when((h == i) & (a == j), v) for (i, j), v in low.items()), F.lit(1.0))
        return F.flatten(F.transform(k, lambda h: F.transform(k, lambda a: F.struct(h.alias("h"), a.alias("a"), (fix(h, a) * F.get(x.h, h) * F.get(x.a, a)).alias("p")))))

    return f.let(_sides(lam, mu, most), cells)


def score_sums(lam: Column, mu: Column, rho: Column, most: int = MOST) -> Column:
    """home, draw, away, over15, over25, over35, both, clean_home, clean_away, exp_home and exp_away of a grid, and its ``total``
    before it is made to sum to 1."""
    low = _low(lam, mu, rho)

    def sums(x):
        h, a = (lambda i: F.get(x.h, F.lit(i))), (lambda i: F.get(x.a, F.lit(i)))
        add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y)
        mean = lambda v: F.aggregate(F.transform(v, lambda y, i: y * i), F.lit(0.0), lambda s, y: s + y)
        extra = {k: (v - 1.0) * h(k[0]) * a(k[1]) for k, v in low.items()}
        some = lambda keep: sum((v for k, v in extra.items() if keep(*k)), F.lit(0.0))
        sh, sa = add(x.h), add(x.a)
        under = lambda goals: sum((h(i) * a(j) for i in range(goals + 1) for j in range(goals + 1 - i)), F.lit(0.0)) + some(lambda i, j: i + j <= goals)
        by_home = lambda part: add(F.transform(x.h, lambda p, i: p * add(part(i))))
        out = {
            "home": by_home(lambda i: F.slice(x.a, F.lit(1), i)) + some(lambda i, j: i > j), "draw": add(F.zip_with(x.h, x.a, lambda p, q: p * q)) + some(lambda i, j: i == j),
            "away": by_home(lambda i: F.slice(x.a, i + 2, F.lit(most + 1))) + some(lambda i, j: i < j), **{f"under{g}": under(g) for g in (1, 2, 3)},
            "both": (sh - h(0)) * (sa - a(0)) + some(lambda i, j: i > 0 and j > 0), "clean_home": sh * a(0) + some(lambda i, j: j == 0), "clean_away": h(0) * sa + some(lambda i, j: i == 0),
            "exp_home": mean(x.h) * sa + extra[1, 0] + extra[1, 1], "exp_away": sh * mean(x.a) + extra[0, 1] + extra[1, 1], "total": sh * sa + some(lambda i, j: True),
        }
        return F.struct(*(v.alias(k) for k, v in out.items()))

    def shares(s):
        names = ("home", "draw", "away", "over15", "over25", "over35", "both", "clean_home", "clean_away", "exp_home", "exp_away")
        value = lambda n: 1.0 - s[f"under{n[4]}"] / s.total if n.startswith("over") else s[n] / s.total
        return F.struct(*(value(n).alias(n) for n in names), s.total.alias("total"))

    return f.let(f.let(_sides(lam, mu, most), sums), shares)


def likeliest(cells: Column, top: int = TOP) -> Column:
    """The likeliest scorelines of ``score_cells``; ties (to a millionth of a millionth) in the grid's order."""
    keyed = F.transform(cells, lambda x: F.struct((-F.floor(x.p * 1e12)).alias("k"), x.h.alias("h"), x.a.alias("a"), x.p.alias("p")))
    return F.transform(F.slice(F.array_sort(keyed), 1, top), lambda x: F.struct(x.h.alias("h"), x.a.alias("a"), x.p.alias("p")))


def score_forecast(lam: Column, mu: Column, rho: Column, most: int = MOST) -> Column:
    """The document that a score model's forecast is stored as: expected scores (two digits), the likeliest scoreline and the
    ``TOP`` likeliest with their shares (four digits), the grid up to five goals each, and the lines."""
    four = lambda v: f.half_up(v, 4)
    lines = ("over15", "over25", "over35", "both", "clean_home", "clean_away")

    def document(x):
        best = F.transform(likeliest(x.cells), lambda y: F.struct(y.h.alias("h"), y.a.alias("a"), four(y.p / x.sums.total).alias("p")))
        grid = F.transform(F.sequence(F.lit(0), F.lit(SHOWN - 1)), lambda i: F.transform(F.slice(x.cells, i * (most + 1) + 1, F.lit(SHOWN)), lambda y: four(y.p / x.sums.total)))
        return F.struct(
            f.half_up(lam, 2).alias("expected_home"), f.half_up(mu, 2).alias("expected_away"), F.get(best, F.lit(0)).alias("likeliest"), best.alias("top"), grid.alias("grid"),
            F.struct(*(four(x.sums[n]).alias(n) for n in lines)).alias("lines"),
        )

    return f.let(F.struct(score_cells(lam, mu, rho, most).alias("cells"), score_sums(lam, mu, rho, most).alias("sums")), document)
