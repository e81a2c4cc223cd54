import hashlib
import random

import numpy as np
import pytest

SPAN = 50


def brute(rows):
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        d = -(1 << 63) if d is None else d
        for p in range(len(raw) - SPAN + 1):
            w = raw[p : p + SPAN]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - SPAN + 1):
            if least[raw[p : p + SPAN]] < (-(1 << 63) if d is None else d):
                gone[p : p + SPAN] = b"\1" * SPAN
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((-(1 << 63) if d is None else d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "é", "on", "ing", "日"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rnd.randint(8, 60)) for _ in range(12)]
    out = []
    for _ in range(120):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            i = rnd.randint(0, len(s) // 2)
            parts += [s[i : i + rnd.randint(20, 300)], text(rnd.randint(0, 20))]
        out.append(rnd.choice(["", " ", "x"]).join(parts))
    out += [out[3], out[3], out[5] + "!", "a" * 400, "a" * 60 + "b" + "a" * 70, "ab" * 200, "ba" * 90, "-" * 49, "-" * 50, "-" * 51, "\0" * 120, "\0" * 70, None, "", " "]
    return out


def test_bytes_removed_are_those_of_brute_force(spark):
    from tallyfield.llm.suffix_dedup import removed

    texts = corpus(1)
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    rows = [(d, t) for d, t in zip(order, texts)]
    rows += [rows[0], rows[0], (None, texts[7]), (None, texts[7]), (rows[4][0], texts[9]), (rows[4][0], texts[4] + " and more")]
    df = spark.createDataFrame([(d, t, "clash", 5) for d, t in rows], "doc_id long, text string, uid string, hit int").repartition(3)
    got = sorted((-(1 << 63) if r[0] is None else r[0], *r[1:]) for r in map(tuple, removed(df).collect()))
    assert got == brute(rows)
    assert removed(df.limit(0)).count() == 0


def test_blocks_of_long_texts(spark, monkeypatch):
    from tallyfield.llm import suffix_dedup as s

    monkeypatch.setattr(s, "BLOCK", 200)
    rnd = random.Random(4)
    base = bytes(rnd.choice(b"abcdef ") for _ in range(3000))
    got = []
    for buf, starts, ends, number, offset in s.blocks(iter([(0, base), (1, base[:30]), (2, base[100:900])])):
        q, low, high, part, h = s.anchors(buf, starts, ends)
        for a, lo, hi, p in zip(q, low, high, part):
            got += [(int(number[p]), int(offset[p] + a - starts[p] - j)) for j in range(lo, hi + 1)]
    assert sorted(got) == [(0, p) for p in range(3000 - SPAN + 1)] + [(2, p) for p in range(800 - SPAN + 1)]


@pytest.mark.parametrize("n_runs", [1, 2, 5, 8])
def test_merge_knows_common_prefixes(n_runs):
    from tallyfield.llm.suffix_dedup import WIDTH, merge_runs, neighbours, sort_keys

    rng = np.random.default_rng(n_runs)
    runs, all_keys = [], []
    for _ in range(n_runs):
        k = rng.integers(0, 2, (rng.integers(1, 60), WIDTH)).astype(np.uint8)
        k[:, : WIDTH - 4] = rng.integers(0, 3, (1, WIDTH - 4)) if rng.random() < 0.5 else 1
        k = k[sort_keys(k)]
        shared = neighbours(k)
        all_keys.append(k)
        runs.append((shared.astype(np.uint8).tobytes(), k[np.arange(WIDTH) >= shared[:, None]].tobytes()))
    source, common, keys = merge_runs([*runs, (b"", b"")])
    every = np.concatenate(all_keys)
    assert (keys == every[sort_keys(every)]).all()
    assert (common == neighbours(keys)).all()
    assert np.bincount(source, minlength=n_runs).tolist() == [len(k) for k in all_keys]


def test_trim_keeps_characters_whole(spark):
    from tallyfield.llm.suffix_dedup import trim

    shared = "日本語のテキスト" * 5 + "the end of it"
    rows = [(1, "first " + shared, 1), (2, shared, 2), (3, "own é" + shared[1:] + " tail", 3), (4, None, 4), (5, "", 5)]
    out = {r.doc_id: r.text for r in trim(spark.createDataFrame(rows, "doc_id long, text string, __k int")).collect()}
    assert out == {1: rows[0][1], 3: "own é tail", 4: None, 5: ""}


def test_trim_with_columns_of_internal_names(spark):
    from tallyfield.llm.suffix_dedup import trim

    passage = "this passage of more than fifty bytes stands in both of them."
    names = ["doc_id", "text", "__hits", "__uid", "__text", "__old", "row", "old", "c0"]
    rows = [(1, "a " + passage, 1, 2, 3, 4, 5, 6, 7), (2, "b " + passage + " c", 1, 2, 3, 4, 5, 6, 8), (3, None, 1, 2, 3, 4, 5, 6, 9), (4, passage, 0, 0, 0, 0, 0, 0, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[2:]))
    out = trim(df)
    assert out.columns == names
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    # of " this passage ... them." document 1 has all but its place; what document 2 keeps is around it, and 4 has nothing left
    assert got[1] == rows[0][1:] and got[3] == rows[2][1:] and 4 not in got
    assert got[2][1:] == rows[1][2:] and got[2][0] == "b c"
    assert trim(df.limit(0)).count() == 0
    only = spark.createDataFrame([(1, passage), (2, passage)], "doc_id long, text string")
    assert [tuple(r) for r in trim(only).collect()] == [(1, passage)]
