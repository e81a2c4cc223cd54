"""Fill-in-the-middle against plain slicing, and unit grammars against plain matching."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import fill_in_middle as fim

SCHEMA = "doc_id long, text string"


def brute(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:i], text[i:j], text[j:]
    if not text or any(x in text for x in fim.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", i, j - i, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", i, j - i, f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [None, "", "a", "é", "😀", "a😀b", "\r\n\x00 ", "<P", "a<S>b", "<M>", "<", "<<S", "S>M>", "x" * 300_000, "😀é\n" * 20_000, "<P<S<M" * 9, "$1\\E", "\U0010ffff"]


def test_digests_are_those_of_slices(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "null id"), (None, "null id"), (5, "again"), (5, "again"), (-3, "less")]
    got = fim.digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *brute(i, t)[:4], sha(brute(i, t)[4]), sha(t or "")) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_parts_join_and_restore(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for grammar in fim.GRAMMARS:
        for sentinels in (fim.SENTINELS, ("<|prefix|>", "<|suffix|>", "<|middle|>")):
            out = fim.transform(docs, grammar=grammar, percent=100, percent_spm=50, sentinels=sentinels)
            for r in out.withColumn("back", fim.restore(F.col("output"), F.col("form"), sentinels)).collect():
                text = rows[r.doc_id][1] or ""
                assert r.back == text
                assert r.form == "plain" or r.prefix + r.middle + r.suffix == text
                assert (r.form == "plain") == (not text or any(s in text for s in sentinels))


@pytest.mark.parametrize(
    ("grammar", "plain"),
    [("codepoint", r"(?s)."), ("word", r"(?s)\A\s+|\S+\s*"), ("line", r"(?s)[^\n]*\n|[^\n]+\Z"), ("token", r"[a-zé]+|[0-9]+|\s+|.")],
)
def test_units_are_those_of_the_grammar(spark, grammar, plain):
    texts = ["", " ", "a", "\n", "ab  c\n\nd12,;3é 😀😀x", " lead and trail \n", "a\n b", "12ab.cd\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fim.units(F.col("t"), fim.GRAMMARS[grammar]).alias("u"))
    for r in df.collect():
        assert r.u == re.findall(plain, r.t), (grammar, r.t)
        assert "".join(r.u) == r.t


def test_empty_table_and_clashing_columns(spark):
    assert fim.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "abc", 5, "x", "y", "z", "w")], SCHEMA + ", n int, u string, t string, form string, id string")
    r = fim.transform(df).first()
    assert r.n == 3 and set(fim.transform(df).columns) == {"doc_id", "n", "form", "prefix", "middle", "suffix", "output"}


def test_one_stage_without_python(spark):
    plan = fim.digests(spark.createDataFrame([(1, "abc")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
