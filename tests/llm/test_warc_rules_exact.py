import base64
import hashlib
import re
from collections import Counter


def test_warc_round_trip(spark):
    from tallyfield.llm.warc import round_trip

    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 5000, "<p>a</p>"]
    rows = [(i, f"http://x/{i}", h, "clash") for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").repartition(3)
    got = {r.page_id: r for r in round_trip(df).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        f = first.setdefault(raw, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if f == i else ("revisit", f))
    assert round_trip(df.limit(0)).count() == 0


def test_rule_figures(spark):
    from tallyfield.llm.quality_rules import judged, keep_good

    good = " ".join(f"word{i}." if i % 9 == 8 else f"word{i}" for i in range(120))
    texts = [None, "", " \n", "a b c", good, "x y z " * 60, "##$ " * 80, good + "\nsame line\nsame line\n\nsame line", "é\x0bü " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "n_words long, text string")
    src = df.withColumnRenamed("n_words", "doc_id")
    got = {r.doc_id: r for r in judged(src, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = list(zip(w, w[1:], w[2:]))
        n = Counter(tri)
        repeat = {k + d for k, x in enumerate(tri) if n[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = keep_good(df)  # a column named like a figure stays as it is
    assert kept.columns == df.columns and sorted(r.n_words for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_exact_dedup(spark):
    from tallyfield.llm.exact_dedup import exact_dedup, keep_distinct

    texts = ["a", "b", "a", None, "", "A", "b", "long " * 900, "a"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, h string").repartition(3)
    size, last = Counter(t or "" for t in texts), {t or "": i for i, t in enumerate(texts)}
    for r in exact_dedup(df).collect():
        t = texts[r.doc_id] or ""
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (last[t], size[t], last[t] == r.doc_id, hashlib.sha256(t.encode()).hexdigest())
    assert sorted(r.doc_id for r in keep_distinct(df).collect()) == sorted(last.values())
    assert exact_dedup(df.limit(0)).count() == 0


def planted_votes(seed=5, n=40_000):
    """(codes, labels) of seven rules: two kinds of junk, each known to three rules, one of them to both; two that know none."""
    import numpy as np

    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.9
    kind = rng.random(n) < 0.5
    miss = rng.random((n, 7)) < [0.006, 0.01, 0.03, 0.01, 0.03, 0.008, 0.05]
    one, two = np.array([0.95, 0.9, 0.7, 0.01, 0.03, 0.01, 0.05]), np.array([0.95, 0.01, 0.03, 0.9, 0.7, 0.01, 0.05])
    catch = rng.random((n, 7)) < np.where(kind[:, None], one, two)
    junk = np.where(good[:, None], miss, catch)
    none = rng.random((n, 7)) < 0.1
    digit = np.where(none, 1, np.where(junk, 0, 2))
    return (digit * 3 ** np.arange(7)).sum(1), good


def test_fit_finds_planted_kinds_of_junk():
    import numpy as np

    from tallyfield.llm.quality_rules import fit

    codes, good = planted_votes()
    patterns, counts = np.unique(codes, return_counts=True)
    m = fit(patterns, counts, 7)
    assert abs(m.prior - 0.9) < 0.02
    assert np.abs(m.junk - [0.95, 0.455, 0.365, 0.455, 0.365, 0.01, 0.05]).max() < 0.05 and np.abs(m.good - [0.994, 0.99, 0.97, 0.99, 0.97, 0.992, 0.95]).max() < 0.01
    kept = m.posterior(codes) >= 0.5
    assert kept[good].mean() > 0.98 and kept[~good].mean() < 0.1
    # a document on which only a rule that knows nothing votes junk is kept
    only = np.full(7, 2)
    only[6] = 0
    assert m.posterior(np.array([(only * 3 ** np.arange(7)).sum()]))[0] > 0.5
    empty = fit(patterns[:0], counts[:0], 7)
    assert np.isfinite(empty.posterior(patterns)).all()


def test_fit_finds_accuracies_of_independent_rules():
    """Both accuracies of every rule, freely estimated, useless and one-sided rules among them."""
    import numpy as np

    from tallyfield.llm.quality_rules import fit

    rng = np.random.default_rng(11)
    right_good = np.array([0.99, 0.95, 0.985, 0.9, 0.98, 0.96, 0.93])
    right_junk = np.array([0.9, 0.8, 0.6, 0.5, 0.3, 0.06, 0.75])
    for share in (0.92, 0.7):
        n = 60_000
        good = rng.random(n) < share
        junk_vote = rng.random((n, 7)) < np.where(good[:, None], 1 - right_good, right_junk)
        digit = np.where(rng.random((n, 7)) < 0.15, 1, np.where(junk_vote, 0, 2))
        codes = (digit * 3 ** np.arange(7)).sum(1)
        patterns, counts = np.unique(codes, return_counts=True)
        m = fit(patterns, counts, 7)
        assert abs(m.prior - share) < 0.02
        assert np.abs(m.good - right_good).max() < 0.05 and np.abs(m.junk - right_junk).max() < 0.05, (m.good, m.junk)
        kept = m.posterior(codes) >= 0.5
        assert kept[good].mean() > 0.97 and kept[~good].mean() < 0.2
        # all must pass would lose more than a quarter of the good ones
        assert (digit != 0).all(1)[good].mean() < 0.8


def test_every_rule_has_an_accuracy_of_its_own(spark, sf):
    """On the smallest tables at least five rules call documents junk, none is taken at its word, and labels agree."""
    import numpy as np
    from pyspark.sql import functions as F

    from tallyfield.llm import quality_rules as q

    rows = q.add_figures(spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet"), keep=["doc_id"]).filter(~q.base_failed()).select("doc_id", q.vote_pattern().alias("v")).toPandas()
    patterns, counts = np.unique(rows.v, return_counts=True)
    m = q.fit(patterns, counts, len(q.rules()))
    called = [(rows.v // 3**i % 3 == 0).sum() for i in range(len(q.rules()))]
    assert sum(n > 0 for n in called) >= 7
    assert sum(0.02 < x < 0.98 for x in m.junk) >= 5 and ((m.good > 0.9) & (m.good < 1)).all()
    keep = dict(zip(rows.doc_id, m.posterior(rows.v.to_numpy()) >= 0.5))
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet").select("doc_id", F.col("quality")).collect()
    assert all(keep[r.doc_id] == bool(r.quality) for r in labels if r.doc_id in keep)
    # documents that some rule calls junk and the others bear out as good stay
    assert sum(keep[d] for d, v in zip(rows.doc_id, rows.v) if any(v // 3**i % 3 == 0 for i in range(9))) > 0


def test_rules_reject_junk_and_keep_clashing_columns_out(spark):
    import random

    from tallyfield.llm.quality_rules import FIGURES, judged, keep_good

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "ing", "ea"]) for _ in range(rnd.randint(1, 4)))
    text = lambda junk: " ".join(word() + ("***" if junk and k % 2 else "." if k % 9 == 8 else "") for k in range(120))
    rows = [(i, text(i % 10 == 0), 0.5, True, 7) for i in range(400)] + [(400, None, None, None, None), (1, text(False), 0.1, False, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, posterior double, kept boolean, n_words long")
    out = judged(df)
    assert out.columns == ["doc_id", "text", *FIGURES, "posterior", "base_failed", "kept"]
    kept = {r.doc_id for r in out.filter("kept").collect()}
    assert kept == {i for i in range(400) if i % 10}
    assert {r.doc_id for r in keep_good(df).collect()} == kept and keep_good(df).columns == df.columns
    assert judged(df.limit(0)).count() == 0 and keep_good(df.limit(0)).count() == 0


def test_exact_dedup_null_ids_and_repeated_rows(spark):
    from tallyfield.llm.exact_dedup import exact_dedup, keep_distinct

    rows = [(None, "a"), (None, "a"), (3, "a"), (1, "b"), (1, "b"), (1, "b"), (None, "c"), (None, "c"), (None, "d"), (5, None), (6, ""), (None, None), (7, "long " * 5000), (8, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact_dedup(df).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        kept = [r for r in g if r.kept]
        assert len(kept) == 1 and {r.group_size for r in g} == {len(g)}
        assert {r.keep_id for r in g} == {max(ids) if ids else None} and kept[0].doc_id == kept[0].keep_id
    assert sorted((r.doc_id or 0, r.text) for r in keep_distinct(df).collect()) == sorted([(3, "a"), (1, "b"), (0, "c"), (0, "d"), (6, ""), (8, "long " * 5000)])
