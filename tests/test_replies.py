import copy
import json

from pyspark.sql import functions as F

from tallyfield.functions import replies as r

GOOD = {
    "narrative": "Close.", "factors": [{"key": "rest", "label": "Rest", "effect": 2, "confidence": "low", "note": "n"}, {"key": "news", "label": "News", "effect": -1.5, "confidence": "high", "note": ""}],
    "absences": [{"side": "HOME", "player": "X", "importance": "key"}], "probabilities": {"HOME": 0.5, "AWAY": 0.5}, "expectedScore": {"home": 2, "away": 0}, "confidence": "medium",
}


def changed(**kw):
    d = copy.deepcopy(GOOD)
    for path, v in kw.items():
        *way, last = path.split("__")
        x = d
        for k in way:
            x = x[int(k) if k.isdigit() else k]
        if v is ...:
            del x[last]
        else:
            x[last] = v
    return d


def test_reasons(spark):
    cases = [
        (json.dumps(GOOD), []), ("```json\n" + json.dumps(GOOD) + "\n```", []), ("prose " + json.dumps(changed(probabilities=..., expectedScore=...)), []), ("nothing", ["no object"]), (None, ["no object"]), ("[1]", ["no object"]),
        (json.dumps(changed(narrative=...)), ["narrative: missing"]), (json.dumps(changed(narrative=3)), ["narrative: no text"]), (json.dumps(changed(narrative="x" * 1201)), ["narrative: too long"]),
        (json.dumps(changed(factors={})), ["factors: no list"]), (json.dumps(changed(factors=[1, "x"])), ["factors[]: no object"]), (json.dumps(changed(factors=GOOD["factors"] * 5)), ["factors: too many"]),
        (json.dumps(changed(factors__0__effect=17, factors__1__effect="2", factors__1__confidence="sure")), ["factors[].effect: out of range", "factors[].effect: no number", "factors[].confidence: unknown word"]),
        (json.dumps(changed(absences=..., confidence="none")), ["absences: missing", "confidence: unknown word"]), (json.dumps(changed(absences__0__side="BOTH", absences__0__player="p" * 81)), ["absences[].side: unknown word", "absences[].player: too long"]),
        (json.dumps(changed(probabilities__HOME=1.5, probabilities__AWAY=...)), ["probabilities.HOME: out of range", "probabilities.AWAY: missing"]), (json.dumps(changed(probabilities=0.5)), ["probabilities: no object"]),
        (json.dumps(changed(expectedScore__home=1.5, expectedScore__away=21)), ["expectedScore.home: not whole", "expectedScore.away: out of range"]), (json.dumps(changed(factors=[], absences=[])), []),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {x.k: x for x in df.select("k", r.refusals(F.col("t")).alias("why"), r.reply(F.col("t")).alias("reply")).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k].why == want, k
        assert (got[k].reply is None) == bool(want)
    assert got[0].reply.factors[1].effect == -1.5 and got[0].reply.expectedScore.home == 2 and got[0].reply.probabilities.DRAW is None
