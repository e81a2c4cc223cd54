"""How many tables the steps of the linking operators write: each is a few shuffles more."""

import random


def written(monkeypatch, *modules):
    names = []
    for m in modules:
        save = m.save
        monkeypatch.setattr(m, "save", lambda df, name, *more, save=save: names.append(name) or save(df, name, *more))
    return names


def test_a_graph_that_fits_one_task_is_one_round(spark, monkeypatch):
    from tallyfield.llm import common

    names = written(monkeypatch, common)
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1001)]
    random.Random(1).shuffle(edges)
    comp = common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r.id: r.component for r in comp} == {i: 0 for i in range(401)} | {1000: 1000, 1001: 1000}
    assert names == ["cc-last"]


def test_pairs_that_cut_hashes_leave_are_settled_once(spark, monkeypatch):
    from tallyfield.llm import ngram_join as nj

    names = written(monkeypatch, nj)
    # neighbours link, all within MARGIN of the limit, ends do not
    rows = [(k, " ".join(f"c{i}" for i in range(k, k + 22))) for k in range(5)]
    got = nj.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), size=3, percent=90).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 0 for k in range(5)}
    assert names.count("ngram-settled") == 1 and names.count("ngram-links") > 1
