"""Components, joins with hot keys, parity maps, packets and the packing search against brute force."""

import random
import time

import numpy as np


def test_components_are_those_of_brute_force(spark, monkeypatch):
    from tallyfield.llm import common

    rnd = random.Random(5)
    edges = [(rnd.randrange(3000), rnd.randrange(3000)) for _ in range(1500)]
    edges += [(10_000 + i, 10_001 + i) for i in range(400)] + [(20_000, 20_001 + i) for i in range(300)] + [(7, 7), (-5, 8)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for held in (common.HELD, 50):
        monkeypatch.setattr(common, "HELD", held)
        rows = common.components(df).collect()
        assert len(rows) == len(want) and {r.id: r.component for r in rows} == want
    assert common.components(df.limit(0)).count() == 0


def test_hot_join(spark, monkeypatch):
    from tallyfield.llm import common

    rows = [(k % 50, i) for i, k in enumerate([7] * 900 + list(range(500)))] + [(None, -1)]
    left = spark.createDataFrame(rows, "k int, v int")
    groups = spark.createDataFrame([(k, sum(a == k for a, _ in rows), k * 10) for k in range(49)], "k int, n long, g int")
    want = sorted((k, v, None if k is None or k > 48 else k * 10) for k, v in rows if k is not None)
    for keys in (1000, 10, 2):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        got = common.hot_join(left.filter("k is not null"), groups, "k", "n", len(rows))
        assert sorted((r.k, r.v, r.g) for r in got.collect()) == sorted(want, key=lambda r: (r[0], r[1]))
        assert common.hot_join(left, groups, "k", "n", len(rows), "inner").count() == sum(k is not None and k < 49 for k, _ in rows)


def test_parity_maps_never_differ_more_than_the_sets():
    from tallyfield.llm.linking import parity_maps

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 5000, n).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) for n in (1, 5, 90, 400, 400, 2000)]
    sets += [np.union1d(sets[3][5:], sets[1]), sets[3][:0]]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    maps = parity_maps(owner, np.concatenate(sets), len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = sum(int(x).bit_count() for x in (maps[i] ^ maps[j]).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b)) and (bits == 0 or i != j)


def test_packets_lose_no_pair_of_a_token():
    from tallyfield.llm import linking as ln

    rng = np.random.default_rng(8)
    token = rng.integers(0, 300, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    token[:600] = token[0]
    node = rng.integers(0, 900, 4000)
    for short in (False, True):
        parts = 4
        own = ln.shortened(token, parts) if short else token
        want = {}
        for t, v in zip(own.tolist(), node.tolist()):
            want.setdefault(t, set()).add(v)
        got = {}
        batches = [b for at in range(0, 4000, 1000) for b in ln.packet(own[at : at + 1000], node[at : at + 1000], parts, short)]
        for part in range(parts):
            mine = [b.filter(b.column("part").to_numpy() % parts == part) if len(b) and b.column("kind")[0].as_py() >= ln.MEMBER else b.filter(np.asarray(b.column("part")) == part) for b in batches]
            single, (t, v, size, large) = ln.gathered(iter(mine), part, parts if short else 0)
            for b in single:
                for x, y in zip(b.column("x").to_numpy().view(np.uint64).tolist(), b.column("y").to_pylist()):
                    got.setdefault(x, set()).add(y)
            for x, y in zip(t.tolist(), v.tolist()):
                got.setdefault(x, set()).add(y)
        assert {t: s for t, s in got.items() if len(s) > 1} == {t: s for t, s in want.items() if len(s) > 1}


def test_packing_search_on_many_equal_pieces_and_hard_sizes():
    from tallyfield.llm.packing import best_fit, local_search, pack

    rnd = random.Random(3)
    for size in (7, 13):
        began = time.process_time()
        _, _, n = pack([size] * 50_000)
        assert n == -(-50_000 // (2048 // size)) and time.process_time() - began < 5
    sizes = [rnd.randint(500, 900) for _ in range(900)] + [rnd.randint(1, 40) for _ in range(30)]
    before = best_fit(sizes, 2048)
    after = local_search(best_fit(sizes, 2048), sizes, 2048)
    assert sorted(i for b in after for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 2048 for b in after)
    assert len(after) < len(before)
    assert local_search([], [], 2048) == [] and pack([])[2] == 0


def test_crowds_get_more_leads_and_the_same_components(spark, monkeypatch):
    """One token that all nodes have: as many rounds with leads as it takes, and components as of all pairs."""
    import random

    from pyspark.sql import functions as F

    from tallyfield.llm import linking as ln
    from tallyfield.llm.common import save

    rng = random.Random(2)
    where = {k: rng.randrange(12) * 100 + rng.randrange(30) for k in range(300)}  # linked: at most 8 apart
    index = save(spark.createDataFrame([(1, k, 100, p) for k, p in where.items()], "token long, node long, n int, p int"), "index")
    opened = []

    def passes(x, y):
        return F.abs(x("p") - y("p")) <= 8

    def verify(pairs):
        at = spark.createDataFrame(list(where.items()), "k long, p int")
        for side in "ab":
            pairs = pairs.join(at.select(F.col("k").alias(side), F.col("p").alias(f"p{side}")), side)
        opened.append(pairs.count())
        return save(pairs.filter(F.abs(F.col("pa") - F.col("pb")) <= 8).select("a", "b"), "links")

    up = {k: k for k in where}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in where:
        for b in where:
            if a < b and abs(where[a] - where[b]) <= 8:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert ln._crowded(index, None)
    comp = {r.id: r.component for r in ln.linked_components(index, 80, ["n", "p"], passes, passes, verify, 1).collect()}
    assert {k: comp.get(k, k) for k in where} == {k: root(k) for k in where}
    more = len(opened)
    monkeypatch.setattr(ln, "CROWD", 10**9)
    opened.clear()
    comp = {r.id: r.component for r in ln.linked_components(index, 80, ["n", "p"], passes, passes, verify, 1).collect()}
    assert {k: comp.get(k, k) for k in where} == {k: root(k) for k in where} and len(opened) < more
