import random
from collections import Counter


def shingle_set(t):
    """The shingles of five characters; of a shorter line the line itself, which links with nothing but its equals."""
    x = t.strip().lower()
    return frozenset(x[i : i + 5] for i in range(len(x) - 4)) or frozenset([x])


def brute(rows, percent):
    """{(doc_id, line): (keep_id, keep_line, group_size, kept)}; doc_ids are distinct."""
    at = [(d is None, d, k, shingle_set(x)) for d, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()]
    sets = list({x[3] for x in at})
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
    of = {s: find(i) for i, s in enumerate(sets)}
    size, top = Counter(of[x[3]] for x in at), {}
    for none, d, k, s in at:
        key = (none, d or 0, k)
        top[of[s]] = min(top.get(of[s], key), key)
    out = {}
    for none, d, k, s in at:
        n, e, m = top[of[s]]
        out[d, k] = (None if n else e, m, size[of[s]], (n, e, m) == (none, d or 0, k))
    return out


def corpus():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    lines = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 5, 12, 30, 80]))]
        for _ in range(rnd.choice([1, 2, 9, 40])):
            x = list(base)
            for _ in range(rnd.randint(0, 1 + len(x) // 25)):
                x[rnd.randrange(len(x))] = rnd.choice(words)
            lines.append(" ".join(x))
    chain = [" ".join(f"c{i}" for i in range(k, k + 60)) for k in range(0, 40, 4)]  # neighbours link, ends do not
    lines += chain + ["Same line"] * 30 + [" same LINE\r", " ", "", "\t", "é\x0bü", "one", "One"]
    rnd.shuffle(lines)
    rows, at = [], 0
    while at < len(lines):
        n = rnd.randint(1, 8)
        rows.append((len(rows) * 3, "\n".join(lines[at : at + n])))
        at += n
    return [*rows, (1000, None), (1001, ""), (1002, "\n\n"), (None, "Same line\nonly of the null id")]


def test_groups_are_those_of_brute_force(spark):
    from tallyfield.llm.line_dedup import line_dedup

    rows = corpus()
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, node string").repartition(3)
    got = line_dedup(df).collect()
    want = brute(rows, 80)
    assert len(got) == len(want)
    assert {(r.doc_id, r.line): (r.keep_id, r.keep_line, r.group_size, r.kept) for r in got} == want
    assert line_dedup(df.limit(0)).count() == 0


def test_one_of_repeated_rows_stays(spark):
    from tallyfield.llm.line_dedup import line_dedup

    df = spark.createDataFrame([(1, "a b c\nd"), (1, "a b c\nd"), (2, "a b c\nnothing like it")], "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.line, r.keep_id, r.keep_line, r.group_size, r.kept) for r in line_dedup(df).collect())
    assert got == Counter([(1, 0, 1, 0, 3, True), (1, 0, 1, 0, 3, False), (2, 0, 1, 0, 3, False), (1, 1, 1, 1, 2, True), (1, 1, 1, 1, 2, False), (2, 1, 2, 1, 1, True)])


def test_query_is_registered(spark, sf):
    import __spark_entry__

    out = __spark_entry__.queries()["op7_line_dedup"](spark, sf)
    assert out.filter("kept").count() < out.count()


def test_lines_at_the_limit_are_settled_by_shingles(spark, monkeypatch):
    """With hashes of so few bits that many agree, links at the limit are those of the shingles."""
    import numpy as np

    from tallyfield.llm import line_dedup as ld

    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    lines = []
    for _ in range(40):
        x = "".join(rng.choice(letters, 60)).strip()
        y = list(x)
        for k in rng.choice(len(y), rng.integers(0, 3), replace=False):
            y[k] = "#"
        lines += [x, "".join(y)]
    shingles = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    want = [100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b)) for a, b in zip(lines[::2], lines[1::2])]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "node long, text string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(40)], "a long, b long")
    got = {r.a // 2 for r in ld._verified(texts, 80)(pairs).collect()}
    assert got == {i for i, ok in enumerate(want) if ok} and 0 < len(got) < 40
