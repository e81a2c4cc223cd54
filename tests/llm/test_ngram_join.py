import random

import pytest


def shingle_set(t, size):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def brute(rows, size, percent):
    """{(doc_id, text): (n_shingles, component_id)}"""
    by = {}
    for d, t in rows:
        by.setdefault(shingle_set(t, size), []).append(d)
    sets = [s for s in by if s]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, s in enumerate(sets):
        ids = [d for d in by[s] if d is not None]
        if ids:
            least[find(i)] = min(least.get(find(i), min(ids)), *ids)
    out = {}
    for d, t in rows:
        s = shingle_set(t, size)
        out[d, t] = (len(s), least.get(find(sets.index(s))) if s else d)
    return out


def corpus(seed, n, groups):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([2, 5, 30, 120, 400]))]
        for _ in range(rnd.choice([1, 1, 2, 12, 40])):
            x = list(base)
            for _ in range(rnd.randint(0, max(1, len(x) // 50))):
                x[rnd.randrange(len(x))] = rnd.choice(words)
            texts.append(" ".join(x))
    for _ in range(n):
        texts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 200))))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (2, 60)])
def test_links_are_those_of_brute_force(spark, size, percent):
    from tallyfield.llm.ngram_join import linked

    texts = corpus(5, 60, 25)
    chain = [" ".join(f"c{i}" for i in range(k, k + 200)) for k in range(0, 40, 4)]  # neighbours link, ends do not
    odd = [None, "", " \n\t", "one", "One", "one two", "two one", "A b\x0bC d", "a B c D", "x " * 3000, "y " * 5000]
    rows = list(enumerate(texts + chain + odd))
    rows += [rows[3], rows[3], (None, texts[5]), (None, "only null"), (7, "same id, other text entirely")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = linked(df, size=size, percent=percent)
    th = {(r.doc_id, r.h): r.text for r in df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()}
    found = {}
    n = 0
    for r in got.collect():
        n += 1
        found[r.doc_id, th[r.doc_id, r.th]] = (r.n_shingles, r.component_id)
    assert n == len(rows)
    assert found == brute(rows, size, percent)
    assert linked(df.limit(0)).count() == 0


def test_large_near_group_and_keep_one(spark):
    from tallyfield.llm.ngram_join import keep_one

    rnd = random.Random(2)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(150):
        x = list(base)
        x[rnd.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(x), "extra"))
    rows += [(1000, "quite another text here", "extra"), (1001, None, "extra"), (1002, "", "extra")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1000, 1001, 1002]


def test_pairs_at_the_limit_are_settled_by_whole_hashes(spark, monkeypatch):
    """With hashes cut to one byte many n-grams agree by chance; links are as without a cut."""
    import random

    from tallyfield.llm import ngram_join as nj

    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(4)]
    rows = []
    for k in range(40):
        w = list(base[k % 4])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(40)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(38)} for k, t in rows}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for margin in (3, 1000):  # the second: every pair is compared by whole hashes
        monkeypatch.setattr(nj, "MARGIN", margin)
        assert {r.doc_id: r.component_id for r in nj.linked(df, size=3, percent=80).collect()} == {k: root(k) for k in sets}


def test_in_common_never_less_when_cut():
    import numpy as np
    import pyarrow as pa

    from tallyfield.llm import ngram_join as nj

    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = (np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.r_[y, x[:20]])
        buf = lambda v, w: pa.py_buffer(nj.packed(v, w))
        assert nj.in_common(buf(x, 8), buf(y, 8), 8) == (len(np.intersect1d(x, y)), len(x) + len(y))
        for width in (1, 2, 5):
            both, n = nj.in_common(buf(x, width), buf(y, width), width)
            assert both >= len(np.intersect1d(x, y)) and n == len(x) + len(y)


def test_keep_one_with_null_ids_repeats_and_empty_table(spark):
    from tallyfield.llm.ngram_join import keep_one

    near, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"x{k}" for k in range(60))
    schema = "doc_id long, text string, __gone int, __th string"
    rows = [(None, near, 1, "a"), (3, near + " more", 2, "b"), (5, near, 3, "c"), (5, near, 3, "c"), (None, other, 4, "d"), (None, other + " y", 5, "e"), (None, None, 6, "f"), (None, "", 7, "g"), (9, "short", 8, "h"), (9, "short", 8, "h")]
    got = sorted(r["__gone"] for r in keep_one(spark.createDataFrame(rows, schema)).collect())
    assert got == [2, 4, 5, 6, 7, 8, 8]
    assert keep_one(spark.createDataFrame([], schema)).count() == 0
