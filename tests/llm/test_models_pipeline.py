import random
import zlib

import pytest

PRONE = ["idiot", "moron", "scum", "trash"]


def labelled(seed=3, n=500):
    """(documents, labels): junk has passages of symbols, toxic texts some words of a list."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["th", "er", "on", "ing", "a", "re"]) for _ in range(rnd.randint(1, 3))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.choice([20, 80, 300, 1500]))]
        quality, toxic = int(rnd.random() < 0.7), int(rnd.random() < 0.3)
        if not quality:
            k = rnd.randrange(len(w))
            w[k : k + 20] = [x + rnd.choice(["***", "$$$", "%%%"]) for x in w[k : k + 20]]
        if toxic:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(PRONE)
        docs.append((i, " ".join(w), "en", "src", "clash"))
        labels.append((i, quality, toxic))
    docs += [(n, None, None, None, None), (n + 1, "", None, None, None), (None, "no id", None, None, None), (7, docs[7][1], "en", "src", "x")]
    labels += [(None, 1, 1), (3, None, None), (n + 50, 1, 0)]
    return docs, labels


@pytest.mark.parametrize(("module", "label", "threshold", "least"), [("toxicity", 2, 0.5, 0.95), ("quality_model", 1, 0.3, 0.9)])
def test_models_learn(spark, module, label, threshold, least):
    import importlib

    m = importlib.import_module(f"tallyfield.llm.{module}")
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = m.score_all(d, lab).collect()
    assert len(got) == len(docs)
    truth = {r[0]: r[label] for r in labels if r[0] is not None and r[label] is not None}
    right = []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert len(right) > 60 and sum(right) >= least * len(right)
    scores = lambda rows: {(r.doc_id, round(r.score, 6)) for r in rows}
    again = scores(m.score_all(d.repartition(5), lab).collect())
    assert again == scores(got)  # the same model whatever the partitions
    # labels of held-out rows change nothing
    other = lab.selectExpr("doc_id", *(f"case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - {c} else {c} end {c}" for c in ("quality", "toxic")))
    assert scores(m.score_all(d, other).collect()) == again
    assert m.score_all(d.limit(0), lab).count() == 0
    assert m.score_all(d, lab.limit(0)).count() == len(docs)


def test_gradient_is_that_of_the_loss():
    import numpy as np

    from tallyfield.llm.quality_model import INPUTS, Model

    r = np.random.default_rng(1)
    x, count, y = r.normal(0, 1, (9, INPUTS)), np.array([4, 1, 4]), np.array([1.0, 0.0, 1.0])
    m = Model.start(x, 0.5)
    loss = lambda: float(-(y * np.log(p := m.forward(x, count)["p"]) + (1 - y) * np.log(1 - p)).mean())
    for name, g in m.gradient(x, count, y).items():
        at = tuple(r.integers(0, k) for k in g.shape)
        keep = m.p[name].copy()
        m.p[name][at] = keep[at] + 1e-5
        up = loss()
        m.p[name][at] = keep[at] - 1e-5
        down = loss()
        m.p[name] = keep
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_passages_cover_every_word():
    from tallyfield.llm.quality_model import INPUTS, PASSAGE, passages
    from tallyfield.llm.words import Words

    texts = [b"", b" \n", b"one", b"w " * 120, "é ".encode() * 50, b"x" * 9000, b""]
    x, count = passages(Words(texts))
    assert count.tolist() == [1, 1, 1, 3, 1, 1, 1] and x.shape == (9, INPUTS)
    assert passages(Words([b"w " * 120]))[0].tolist() == x[3:6].tolist()
    assert PASSAGE == 50


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from test_ngram_join import brute
    from test_sentencepiece_packing import check_packing
    from test_suffix_dedup import brute as brute_bytes

    from tallyfield.llm.quality_rules import judged

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "ing", "ea", "re", "st"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() + ("." if k % 9 == 8 else "") for k in range(n))
    shared = text(30)
    texts = [text(rnd.randint(60, 300)) for _ in range(60)] + [text(100) + " " + shared + " " + text(80) for _ in range(6)]
    texts += [texts[1], texts[2], texts[3] + " tail", "junk *** $$$ " * 90, "short", "", None, "same word " * 200]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    good = {r.doc_id for r in judged(docs, keep=["doc_id"]).filter("kept").select("doc_id").collect()}
    steps = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, folder).write.parquet(f"{folder}/s{k}")
        docs = spark.read.parquet(f"{folder}/s{k}")
        steps.append(docs.collect())
        if k < 4:
            assert docs.columns == names
    text_at = lambda k: {r.doc_id: r.text for r in steps[k]}
    assert text_at(0) == {i: t for i, t in enumerate(texts) if i in good} and len(good) >= 60
    last = {t: d for d, t in text_at(0).items()}
    assert text_at(1) == {d: t for t, d in last.items()}
    near = brute(list(text_at(1).items()), 5, 80)
    assert text_at(2) == {d: t for d, t in text_at(1).items() if near[d, t][1] == d}
    sizes = {r[0]: r[1] - r[2] for r in brute_bytes(list(text_at(2).items()))}
    assert {d: len(t.encode()) for d, t in text_at(3).items()} == {d: n for d, n in sizes.items() if n}
    assert all(r.n_chars == len(r.text) for r in steps[3])
    check_packing(steps[4], list(text_at(3).items()), 2048)
    whole = sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())
    assert whole == sorted((r.doc_id, r.piece, r.ids_crc32) for r in steps[4])


def test_pipeline_on_an_empty_table_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = f"{tmp_path}/empty"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("abcdefg") for _ in range(5)) + ("." if k % 9 == 8 else "") for k in range(90))
    rows = [(1, text, "en", "s", 1, 7), (1, text, "en", "s", 1, 7), (None, text + " more", "en", "s", 1, 8), (2, None, None, None, None, 9)]
    for name in ("__hits", "__uid", "__text", "__gone", "th", "node", "bucket"):
        docs = spark.createDataFrame(rows, f"{schema}, {name} int")
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, folder)
            assert docs.columns[-1] == name
        assert [tuple(r) for r in docs.collect()] == [(1, text, "en", "s", len(text), 7)], name
