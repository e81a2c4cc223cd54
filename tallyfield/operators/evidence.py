"""How much a forecast has to go by, and who is favoured when it cannot tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def evidence(matches_home: Column, matches_away: Column, ranked_home: Column, ranked_away: Column, serve_home: Column, serve_away: Column) -> Column:
    """level and factor: strong, moderate, thin or none, by matches on record, published ranks and serve statistics."""
    fewest = F.least(matches_home, matches_away)
    strong = ranked_home & ranked_away & serve_home & serve_away & (fewest >= 20)
    moderate = (ranked_home | ranked_away) & (fewest >= 8)
    levels = ((strong, "strong", 1.0), (moderate, "moderate", 0.85), (fewest >= 3, "thin", 0.6))
    out = F
    for when, name, factor in levels:
        out = out.when(when, F.struct(F.lit(name).alias("level"), F.lit(factor).alias("factor")))
    return out.otherwise(F.struct(F.lit("none").alias("level"), F.lit(0.4).alias("factor")))


def break_tie(home: Column, away: Column, ids: tuple[Column, Column], ranks: tuple[Column, Column], form: tuple[Column, Column], edge: Column, matches: tuple[Column, Column], epsilon: float = 0.01, nudge: float = 0.005) -> Column:
    """favourite, reason (null if the shares tell) and both shares of a two-way forecast whose shares differ by less than
    ``epsilon``: by rank, recent form, meetings, matches on record, and at last by a hash of the ids, which is the same
    whichever side is at home."""
    side = lambda better: F.when(better, "HOME").otherwise("AWAY")
    why = lambda better, reason: F.struct(side(better).alias("favourite"), F.lit(reason).alias("reason"))
    clear = F.abs(home - away) >= epsilon
    drawn = [F.md5(x.cast("string")) for x in ids]
    found = (
        F.when(clear, F.struct(side(home >= away).alias("favourite"), F.lit(None).cast("string").alias("reason")))
        .when(F.coalesce(ranks[0] != ranks[1], F.lit(False)), why(ranks[0] < ranks[1], "rank"))
        .when(F.abs(form[0] - form[1]) >= 0.02, why(form[0] > form[1], "form"))
        .when(edge != 0, why(edge > 0, "meetings"))
        .when(matches[0] != matches[1], why(matches[0] > matches[1], "matches"))
        .otherwise(why((drawn[0] > drawn[1]) | ((drawn[0] == drawn[1]) & (ids[0] <= ids[1])), "nothing"))
    )
    up = F.when(found.favourite == "HOME", 0.5 + nudge).otherwise(0.5 - nudge)
    return F.struct(found.favourite.alias("favourite"), found.reason.alias("reason"), F.when(clear, home).otherwise(up).alias("home"), F.when(clear, away).otherwise(1.0 - up).alias("away"))
