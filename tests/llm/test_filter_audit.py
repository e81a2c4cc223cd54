"""The audit of filter orders against applying every order to all rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from tallyfield.llm import filter_audit as fa

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    least, out = {}, Counter()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    total, parts = defaultdict(int), {r[0] for r in rows}
    for part in parts:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(kept), len(here), sum(f in r[1] for r in own) - len(here), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
                total[part, f] += len(here)
                left = kept
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(spark, docs, labels, parts=3, held=fa.HELD):
    got = fa.audit(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(labels, LABELS), held=held).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(docs, labels)


def corpus(rng, n):
    base = [" ".join(rng.choice(["a", "Bb", "ccc", f"w{rng.random()}", "#", "É", "X"][: rng.choice([2, 4, 7])]) for _ in range(rng.choice([3, 90, 120]))) for _ in range(n // 3)]
    base += ["", " \t\x0b\x1c  ", "A", "word " * 99 + "word", " ".join("abc")]
    return [(rng.randrange(n), rng.choice(base), rng.choice(["en", "de", None, ""])) for _ in range(n)]


def test_random_documents_in_many_tasks(spark):
    rng = random.Random(5)
    docs = corpus(rng, 300) + [(None, "null id", "en"), (None, "null id", None), (4, None, "en"), (4, None, "en"), (9, "", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(2, 1, 1), (None, 1, 1)]
    check(spark, docs, labels)
    check(spark, docs, labels, parts=7, held=2000)


def test_one_group_of_copies(spark):
    docs = [(i, "copy", "en" if i % 3 else "de") for i in range(500)] + [(499, "copy", "en"), (0, "copy", "fr")]
    check(spark, docs, [(0, 1, 0), (7, 1, 1)], parts=5, held=10)


def test_colliding_fingerprints_and_long_texts(spark, monkeypatch):
    chains = fa.Chains(16)
    rows = [*chains.add(1, "a", 0, 5, {"x": 1}), *chains.add(1, "b", 1, 3, {"x": 1}), *chains.add(1, "a", 0, 4, {"y": 2}), *chains.add(1, "b", 1, 9, {"x": 1})]
    assert rows == [(5, "x", 16, 1), (9, "x", 17, 1)]
    assert sorted(e[:3] for _, e in chains.entries()) == [["a", 0, 4], ["b", 1, 3]]
    long = "word and more " * 60_000
    check(spark, [(3, long, "en"), (1, long, "en"), (2, long + "!", "en")], [])


def test_empty_tables_and_clashing_columns(spark):
    check(spark, [], [])
    docs = spark.createDataFrame([(1, "a", "en", 7, 8, "p", 3)], DOCS + ", n int, mask int, part string, id int")
    labels = spark.createDataFrame([(1, 1, 0, "x", 4)], LABELS + ", part string, id int")
    got = fa.audit(docs, labels).collect()
    assert len(got) == 600 and sum(r.good_lost for r in got) == 120
