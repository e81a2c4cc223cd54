"""Crowded tokens: a few rounds, whatever is left by blocks, and the groups are those of all pairs."""

import random
from collections import Counter


def shingle_set(x):
    return frozenset(x[i : i + 5] for i in range(len(x) - 4))


def crowd(rnd):
    """Lines with one long passage in common, most of them too different to link, some in chains and groups."""
    letters = "abcdefghijklmnopqrstuvwxyz "
    draw = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    common, lines = draw(160), []
    for _ in range(60):
        own = draw(60)
        lines.append(f"x{common}{own}y")
        for _ in range(rnd.choice([0, 0, 1, 3])):
            own = own[8:] + draw(8)  # next of a chain
            lines.append(f"x{common}{own}y")
    return lines


def roots(lines, percent):
    sets = [shingle_set(x) for x in lines]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(sets))]


def test_a_crowd_takes_few_rounds_and_loses_no_group(spark, monkeypatch):
    from tallyfield.llm import line_dedup as ld
    from tallyfield.llm import linking as lk

    lines = crowd(random.Random(5))
    names, save = [], lk.save
    monkeypatch.setattr(lk, "save", lambda df, name, *more: names.append(name) or save(df, name, *more))
    monkeypatch.setattr(lk, "CROWD", 1)
    for k, v in {"CROWD_BLOCKS": 10**6, "BLOCK_NODES": 7, "PART_ROWS": 50}.items():
        monkeypatch.setattr(lk, k, v, raising=False)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.keep_id for r in ld.line_dedup(df).collect()}
    want = roots(lines, 80)
    assert got == dict(enumerate(want)) and 1 < max(Counter(want).values()) and len(set(want)) > 20
    # one round with leads, then the nearest, then what is left: the tokens' rows are joined twice
    assert names.count("link-lead") == 2 and names.count("link-pairs") == 2


def test_blocks_compare_each_two_nodes_of_different_components(spark, monkeypatch):
    """Whatever component has most of a token, and however many blocks there are."""
    from pyspark.sql import functions as F

    from tallyfield.llm import linking as lk

    for size, main, block in ((1, 0, 4), (9, 9, 4), (40, 25, 4), (40, 0, 4), (40, 39, 4), (40, 12, 100)):
        monkeypatch.setattr(lk, "BLOCK_NODES", block)
        monkeypatch.setattr(lk, "PART_ROWS", 16)
        comp = {k: 0 if k < main else k // 2 for k in range(size)}
        # a few nodes have a token of their own with the first one
        rows = [(1, k, comp[k], 10 if k % 7 else 30) for k in range(size)] + [(2, k, comp.get(k, k), 10) for k in [0, *range(100, 103)]]
        cur = spark.createDataFrame(rows, "token long, node long, comp long, n int")
        some = cur.groupBy("token").agg(F.count("*").alias("c"))
        whole = lambda x: x.select("*", *(F.lit(0).cast("bigint").alias(s) for s in lk.MAP))
        dealt = lk._dealt(cur, some, len(rows), max(size, 4), whole)
        want = {
            (a, b)
            for t, a, p, n in rows
            for u, b, q, m in rows
            if t == u and a < b and p != q and n == m
        }
        assert {(r.a, r.b) for r in lk._between(dealt, 80, False).collect()} == want
        near = {(r.a, r.b) for r in lk._between(dealt, 80, True).collect()}
        assert near <= want and {k for p in near for k in p} == {k for p in want for k in p}
