"""Structured replies checked field by field: what a reply may say, and why it is refused.

A reply is read as a variant, so a field of the wrong type is told from one that is missing, and one bad field does not hide
the others.  The checks stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfield.functions.scalars import json_object, let

# fixed values: the words, lengths and limits that a reply is held to
LEVELS, SIDES, WEIGHTS = ("low", "medium", "high"), ("HOME", "AWAY"), ("key", "regular", "fringe")
NARRATIVE, FACTORS, ABSENCES, EFFECT, GOALS = 1200, 8, 16, 16, 20
FACTOR_TEXTS, PLAYER = {"key": 40, "label": 60, "note": 300}, 80
REPLY = (
    "struct<narrative: string, factors: array<struct<key: string, label: string, effect: double, confidence: string, note: string>>, absences: array<struct<side: string, player: string, importance: string>>, "
    "probabilities: struct<HOME: double, DRAW: double, AWAY: double>, expectedScore: struct<home: int, away: int>, confidence: string>"
)
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(_kind(v).startswith(kind), F.lit(False))


def _text(v: Column, name: str, most: int | None = None, words: tuple[str, ...] = ()) -> Column:
    """Why a text is refused, or null."""
    text = F.try_variant_get(v, "$", "string")
    out = F.when(v.isNull(), f"{name}: missing").when(~_is(v, "STRING"), f"{name}: no text")
    if most is not None:
        out = out.when(F.length(text) > most, f"{name}: too long")
    return out.when(~text.isin(*words), f"{name}: unknown word") if words else out


def _number(v: Column, name: str, low: float, high: float, whole: bool = False, needed: bool = True) -> Column:
    """Why a number is refused, or null."""
    x = F.try_variant_get(v, "$", "double")
    out = F.when(v.isNull(), f"{name}: missing") if needed else F.when(v.isNull(), F.lit(None).cast("string"))
    out = out.when(~F.coalesce(_kind(v).rlike(NUMBER), F.lit(False)), f"{name}: no number").when((x < low) | (x > high), f"{name}: out of range")
    return out.when(x != F.floor(x), f"{name}: not whole") if whole else out


def _object(v: Column, name: str, reasons: list[Column]) -> Column:
    """The reasons of an object's fields; that it is none is the only one if it is none."""
    return F.when(~_is(v, "OBJECT"), F.array(F.lit(f"{name}: no object"))).otherwise(F.array(*reasons))


def _list(v: Column, name: str, most: int, reasons) -> Column:
    """The reasons of a list and of its members."""
    members = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    all_ = let(members, lambda xs: F.concat(F.array(F.when(F.size(xs) > most, f"{name}: too many")), F.flatten(F.transform(xs, lambda x: _object(x, f"{name}[]", reasons(x))))))
    return F.when(v.isNull(), F.array(F.lit(f"{name}: missing"))).when(~_is(v, "ARRAY"), F.array(F.lit(f"{name}: no list"))).otherwise(all_)


def _optional(v: Column, name: str, reasons: list[Column]) -> Column:
    return F.when(v.isNull(), F.array().cast("array<string>")).otherwise(_object(v, name, reasons))


def refusals(text: Column) -> Column:
    """The reasons for which a reply is refused, each once and in order of the fields; none if it is as it should be.  Texts with a
    fence or prose around the object are replies too."""
    factor = lambda x: [*(_text(_get(x, k), f"factors[].{k}", n) for k, n in FACTOR_TEXTS.items()), _number(_get(x, "effect"), "factors[].effect", -EFFECT, EFFECT), _text(_get(x, "confidence"), "factors[].confidence", words=LEVELS)]
    absence = lambda x: [_text(_get(x, "side"), "absences[].side", words=SIDES), _text(_get(x, "player"), "absences[].player", PLAYER), _text(_get(x, "importance"), "absences[].importance", words=WEIGHTS)]

    def reasons(x: Column) -> Column:
        """x: the reply and those of its fields that are looked at more than once, each taken out of it once."""
        shares, score = x.shares, x.score
        return F.concat(
            F.array(_text(x.narrative, "narrative", NARRATIVE)), _list(x.factors, "factors", FACTORS, factor), _list(x.absences, "absences", ABSENCES, absence),
            _optional(shares, "probabilities", [_number(_get(shares, k), f"probabilities.{k}", 0, 1, needed=k != "DRAW") for k in ("HOME", "DRAW", "AWAY")]),
            _optional(score, "expectedScore", [_number(_get(score, k), f"expectedScore.{k}", 0, GOALS, True) for k in ("home", "away")]),
            F.array(_text(x.confidence, "confidence", words=LEVELS)),
        )

    def checked(v: Column) -> Column:
        fields = {"narrative": "narrative", "factors": "factors", "absences": "absences", "shares": "probabilities", "score": "expectedScore", "confidence": "confidence"}
        found = let(F.struct(*(_get(v, path).alias(k) for k, path in fields.items())), reasons)
        return F.when(v.isNull() | ~_is(v, "OBJECT"), F.array(F.lit("no object"))).otherwise(F.array_distinct(F.filter(found, lambda r: r.isNotNull())))

    return let(F.try_parse_json(json_object(text)), checked)


def reply(text: Column) -> Column:
    """The reply as a struct; null if it is refused."""
    return F.when(F.size(refusals(text)) == 0, F.from_json(json_object(text), REPLY))
