"""Chat windows against a plain walk over each conversation."""

import hashlib
import random
from itertools import groupby

import pytest

from tallyfield.llm import chat_windows as cw

SCHEMA = "conv_id long, turn long, role string, text string"


def escape(t):
    return t.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")


def written(role, text):
    return "### " + escape(role).replace(":", ":\\") + ": " + escape(text) + "</turn>\n"


def brute(rows, budget, history):
    """Windows as lists of (role, text) with the number of repeated ones, for conversations of any length."""
    rows = sorted((r[0] is not None, r[0] or 0, cw.FIRST if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows)
    rows.sort(key=lambda r: (*r[:4], written(r[3], r[4]).encode()))
    out = {}
    for key, turns in groupby(rows, key=lambda r: r[:2]):
        turns = [(t, role, text, -(-len(written(role, text).encode()) // 4)) for _, _, t, role, text in turns]
        system = next((i for i, t in enumerate(turns) if t[1] == "system"), None)
        windows = out[key[1] if key[0] else None] = []
        for block in sorted({t[0] // cw.BLOCK for t in turns}):
            own = [i for i, t in enumerate(turns) if t[0] // cw.BLOCK == block]
            s = own[0]
            while s <= own[-1]:
                first = s
                while first > 0 and turns[first - 1][0] >= block * cw.BLOCK - cw.REACH and sum(t[3] for t in turns[first - 1 : s]) <= history:
                    first -= 1
                again = ([system] if system is not None and system < first else []) + list(range(first, s))
                used, e = sum(turns[i][3] for i in again) + turns[s][3], s + 1
                while e <= own[-1] and used + turns[e][3] <= budget:
                    used, e = used + turns[e][3], e + 1
                windows.append(([turns[i][1:3] for i in [*again, *range(s, e)]], len(again), used))
                s = e
    return out


def check(spark, rows, budget=60, history=20):
    got = {}
    df = cw.windows(spark.createDataFrame(rows, SCHEMA).repartition(3), budget=budget, history=history).cache()
    for r in sorted(df.collect(), key=lambda r: (r.block, r.window)):
        got.setdefault(r.conv_id, []).append(r)
    want = brute(rows, budget, history)
    assert set(got) == set(want)
    for conv, windows in want.items():
        assert [r.text for r in got[conv]] == ["".join(written(*t) for t in ts) for ts, _, _ in windows]
        assert [(r.n_repeated, r.tokens, r.over) for r in got[conv]] == [(n, used, used > budget) for _, n, used in windows]
        for r, (ts, n, _) in zip(got[conv], windows):
            assert [r.text[m.start : m.end] for m in r.loss] == [escape(t) for role, t in ts[n:] if role == "assistant"]
    back = {r.conv_id: r for r in cw.read_back(df).collect()}
    assert set(back) == set(want)
    for conv, windows in want.items():
        own = [t for ts, n, _ in windows for t in ts[n:]]
        lost = "".join(t for role, t in own if role == "assistant")
        r = back[conv]
        assert r.n_turns == len(own) == sum(1 for x in rows if x[0] == conv)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
        assert r.formatted_chars == sum(len(x.text) for x in got[conv])
    return got


def test_random_conversations(spark):
    rng = random.Random(3)
    words = ["ok", "###", "</turn>", "\\", "####", "#", "é😀", "\n", ": ", "\\### Assistant: </turn> ok", "a" * 30, "$1", "<\\/turn>", "##"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 12)):
            role = "system" if turn == rng.choice([0, 0, 2]) and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "to: ol\\:", "###"])
            rows.append((conv, turn, role, "".join(rng.choice(words) for _ in range(rng.randint(0, 8)))))
    for budget, history in ((60, 20), (30, 0), (200, 100), (1, 1)):
        check(spark, rows, budget, history)


def test_long_conversation_in_blocks(spark):
    rng = random.Random(4)
    rows = [(1, t * rng.choice([1, 1, 3]) if t < 200 else t, "system" if t == 3 else rng.choice(["user", "assistant"]), "x" * rng.randint(0, 40)) for t in range(-20, 1100)]
    got = check(spark, rows, 80, 30)
    assert len({r.block for r in got[1]}) >= 5
    assert all(r.text.startswith("### system: ") for r in got[1][20:])


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "é# \\" * 60_000
    rows = [
        (None, None, None, None), (None, 1, "user", "a"), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"),
        (2, 5, "assistant", long), (2, 6, "assistant", ""), (2, None, "assistant", "first"), (3, 2**62, "user", "late"), (3, -(2**62), "assistant", "early"),
    ]
    got = check(spark, rows)
    assert got[2][1].over and got[2][0].text.endswith("first</turn>\n")


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cw.read_back(cw.windows(df)).count() == 0
    assert [r.conv_id for r in cw.digests(df).collect()] == [-7]
    df = spark.createDataFrame([(1, 0, "user", "a", 9, "x", 3, 4)], SCHEMA + ", block long, t string, window int, conv int")
    assert [(r.conv_id, r.n_turns) for r in cw.read_back(cw.windows(df)).collect()] == [(1, 1)]


def test_other_names_and_token_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(7, k, "assistant", "abc") for k in range(5)], "c long, k long, who string, said string")
    got = cw.windows(df, "c", "k", "who", "said", budget=2, history=0, tokens=lambda w: F.lit(1)).orderBy("window").collect()
    assert [len(r.loss) for r in got] == [2, 2, 1] and [r.c for r in got] == [7, 7, 7]


@pytest.mark.parametrize("text", ["", "\\", "#" * 7, "<<//turn></turn>", "\\\\#\\#", "##\\##", ": :", "a\\: b"])
def test_escapes_are_reversible(spark, text):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "t string").select(cw.escape(F.col("t")).alias("e"), cw.escape_role(F.col("t")).alias("r"))
    r = df.select("e", "r", cw.unescape(F.col("e")).alias("t"), cw.unescape(F.col("r")).alias("u")).first()
    assert r.t == text and r.u == text
    assert "###" not in r.e and "</turn>" not in r.e and ": " not in r.r


def test_no_python_in_the_plan(spark):
    df = cw.digests(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
