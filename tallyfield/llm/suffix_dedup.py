"""Removal of passages that repeat across documents, by a distributed merge sort of suffixes that knows common prefixes.

A passage is a string of ``SPAN`` bytes; it goes from every document but the one with the smallest id that has it.

Which suffixes are sorted.  Of the strings of K bytes in a passage the one with the smallest hash (the leftmost of
equals) is its anchor.  Equal passages have their anchors at the same place, so only the suffixes at anchors, one in
about fourteen, need to be sorted, with the few bytes to the left of the anchor behind them.  A suffix whose anchor
string no two documents share cannot have a partner; a filter of cells hit once or more often, of bounded size, finds
most of those, and they are not exchanged.

The sort.  Each task sorts its suffixes, settles those that agree in all their bytes (all but the smallest id's go),
and sends the rest as runs, front-coded: a suffix is the length of the prefix it shares with the one before, and the
bytes after it.  A task for each bucket of anchor strings merges its runs with a loser tree that keeps, for each run,
the length of the common prefix with the last suffix put out, so that known prefixes are never compared again; the
merge yields the common prefix of each two neighbours with the sorted suffixes.  These lengths give the classes of equal
bytes to the right, a sort of the few bytes to the left gives those to the left, and a passage's class is the pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.common import BATCH, save, setting, text_of
from tallyfield.llm.exact_dedup import cell_hits, cells, merged_cells, n_cells
from tallyfield.llm.words import release

#: Bytes of a passage; of an anchor string; places an anchor string can have in a passage.
SPAN, K = 50, 24
PLACES = SPAN - K + 1
LEFT = PLACES - 1
WIDTH = SPAN + LEFT
#: Bytes that are searched for anchors at a time; suffixes of a run; bytes of text for each bucket; fewest buckets.
BLOCK, RUN, BUCKET_BYTES, LEAST_BUCKETS = 1 << 19, 60_000, 16 << 20, 64
PROBES = 2
#: Anchors whose cells are sorted together; texts that go to Python at a time.
HITS, ROWS = 500_000, 500
AT_BITS = 26  # of a place in a block
#: A hit is a place and a mask of the passages around it, in one number.
MASK_BITS = PLACES
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, least and most bytes before it, text number, hash of the anchor string) of each anchor in texts that lie
    one behind the other in ``buf``.  The passages that have the anchor start from most to least bytes before it."""
    n = len(buf)
    d = np.zeros(n + 1, np.int8)
    long = ends - starts >= SPAN
    if not long.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    d[starts[long]] += 1
    d[ends[long] - SPAN + 1] -= 1
    m = n - K + 1
    word = np.ndarray((n - 7,), "<u8", buf, 0, (1,))
    h = word[:m] * A
    h ^= h >> np.uint64(31)
    h += word[8 : 8 + m] * B
    h ^= h >> np.uint64(29)
    h *= C
    h += word[16 : 16 + m] * A
    h ^= h >> np.uint64(32)
    h *= B
    h ^= h >> np.uint64(28)
    least = (h >> np.uint64(AT_BITS) << np.uint64(AT_BITS)) | np.arange(m, dtype=np.uint64)
    size = 1
    while 2 * size <= PLACES:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (PLACES - size)], least[PLACES - size :])
    p = np.flatnonzero(np.cumsum(d, dtype=np.int8)[: len(least)])
    at = (least[p] & np.uint64((1 << AT_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    q = at[first]
    low, high = p[first], p[np.r_[first[1:], len(p)] - 1]
    return q, q - high, q - low, np.searchsorted(starts, q, "right") - 1, h[q]


def blocks(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as (buffer, starts, ends, text number, offset in the text).  Long texts are cut; parts overlap so that each
    passage is in one part."""
    parts, number, offset, total = [], [], [], 0
    for k, t in texts:
        if len(t) < SPAN:
            continue
        for at in range(0, max(1, len(t) - SPAN + 1), BLOCK):
            x = t[at : at + BLOCK + SPAN - 1]
            parts.append(x)
            number.append(k)
            offset.append(at)
            total += len(x)
            if total >= BLOCK:
                yield _block(parts, number, offset)
                parts, number, offset, total = [], [], [], 0
    if parts:
        yield _block(parts, number, offset)


def _block(parts, number, offset):
    ends = np.cumsum([len(x) for x in parts])
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, ends[:-1]], ends, np.array(number), np.array(offset, np.int64)


def _raw(col) -> Iterator[tuple[int, bytes]]:
    return ((i, x.as_buffer().to_pybytes() if x.is_valid else b"") for i, x in enumerate(col.cast(pa.binary())))


def _shared_anchors(src: DataFrame, m: int) -> np.ndarray:
    """A bit for each cell that the anchor strings of two documents hit."""

    def run(batches):
        release()
        got, n = [], 0
        for b in batches:
            for buf, starts, ends, number, _ in blocks(_raw(b.column(0))):
                _, _, _, part, h = anchors(buf, starts, ends)
                doc = number[part]
                o = np.lexsort((h, doc))
                h, doc = h[o], doc[o]
                got.append(h[np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]])  # once for each document
                n += len(got[-1])
                if n >= HITS:
                    yield cell_hits(np.concatenate(got), m, PROBES)
                    got, n = [], 0
        if n:
            yield cell_hits(np.concatenate(got), m, PROBES)
        release()

    with setting(src.sparkSession, BATCH, str(ROWS)):
        return merged_cells(src.select("text").mapInArrow(run, "seg int, hits binary"), m)


def sort_keys(keys: np.ndarray, *lower: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix; among equals by ``lower``."""
    width = -keys.shape[1] % 8
    words = np.ascontiguousarray(np.pad(keys, ((0, 0), (0, width)))).view(">u8").astype(np.uint64)
    return np.lexsort((*lower[::-1], *words.T[::-1]))


def neighbours(keys: np.ndarray) -> np.ndarray:
    """The length of the prefix that each row shares with the row before; 0 for the first."""
    if len(keys) < 2:
        return np.zeros(len(keys), np.int64)
    ne = keys[1:] != keys[:-1]
    out = np.where(ne.any(1), ne.argmax(1), keys.shape[1])
    return np.r_[0, out]


def _run_rows(rec: dict[str, np.ndarray], n_buckets: int) -> pa.RecordBatch:
    """A sorted run as rows (bucket, shared, tails, meta), and what it settles by itself as rows (bucket, null, null,
    meta)."""
    order = sort_keys(rec["key"], rec["low"], rec["high"])
    rec = {k: x[order] for k, x in rec.items()}
    same = (neighbours(rec["key"]) == WIDTH) & (np.r_[False, (rec["low"][1:] == rec["low"][:-1]) & (rec["high"][1:] == rec["high"][:-1])])
    group = np.cumsum(~same) - 1
    least = np.minimum.reduceat(rec["doc"], np.flatnonzero(~same))[group]
    gone = rec["doc"] > least
    hits = [rec["uid"][gone], (rec["at"][gone] << MASK_BITS) | _ones(rec["low"][gone], rec["high"][gone])]
    rec = {k: x[~gone] for k, x in rec.items()}
    bucket = (rec["hash"] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rec, bucket = {k: x[order] for k, x in rec.items()}, bucket[order]
    first = np.r_[True, bucket[1:] != bucket[:-1]]
    shared = np.where(first, 0, neighbours(rec["key"]))
    tails = rec["key"][np.arange(WIDTH) >= shared[:, None]]
    at = np.r_[0, np.cumsum(WIDTH - shared)]
    cut = np.r_[np.flatnonzero(first), len(bucket)]
    rows: list[tuple] = []
    for i, j in zip(cut, cut[1:]):
        meta = b"".join(rec[k][i:j].astype(t).tobytes() for k, t in META)
        rows.append((int(bucket[i]), shared[i:j].astype(np.uint8).tobytes(), tails[at[i] : at[j]].tobytes(), meta))
    if len(hits[0]):
        to = hits[0] % n_buckets  # anywhere, spread
        order = np.argsort(to, kind="stable")
        to = to[order]
        uid, hit = (x[order].astype("<i8") for x in hits)
        cut = np.r_[np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), len(to)]
        rows += [(int(to[i]), None, None, uid[i:j].tobytes() + hit[i:j].tobytes()) for i, j in zip(cut, cut[1:])]
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "shared", "tails", "meta"])


META = (("doc", "<i8"), ("uid", "<i8"), ("at", "<i8"), ("low", "u1"), ("high", "u1"))


def _ones(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Masks with the bits from low to high set."""
    return (np.int64(1) << (high + 1)) - (np.int64(1) << low)


def _runs(src: DataFrame, bits: np.ndarray, m: int, n_buckets: int) -> DataFrame:
    shared = src.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        release()  # what the stage before has left, before the filter is read
        got: list[dict[str, np.ndarray]] = []
        n = 0
        for b in batches:
            ids, uids = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for buf, starts, ends, number, offset in blocks(_raw(b.column(2))):
                q, low, high, part, h = anchors(buf, starts, ends)
                c = cells(h, m, PROBES)
                ok = ((shared.value[c >> 3] >> (c & 7).astype(np.uint8)) & 1).all(1)
                q, low, high, part, h = q[ok], low[ok], high[ok], part[ok], h[ok]
                if not len(q):
                    continue
                right, left = np.arange(SPAN), np.arange(LEFT)
                key = np.zeros((len(q), WIDTH), np.uint8)
                key[:, :SPAN] = buf[np.minimum(q[:, None] + right, len(buf) - 1)] * (right < SPAN - low[:, None])
                key[:, SPAN:] = buf[np.maximum(q[:, None] - 1 - left, 0)] * (left < high[:, None])
                doc = number[part]
                got.append({"key": key, "doc": ids[doc], "uid": uids[doc], "at": offset[part] + q - starts[part], "low": low, "high": high, "hash": h})
                n += len(q)
                if n >= RUN:
                    yield _run_rows({k: np.concatenate([x[k] for x in got]) for k in got[0]}, n_buckets)
                    got, n = [], 0
        if n:
            yield _run_rows({k: np.concatenate([x[k] for x in got]) for k in got[0]}, n_buckets)
        del got
        release()

    return src.select("doc", "uid", "text").mapInArrow(run, "bucket int, shared binary, tails binary, meta binary")


def merge_runs(runs: list[tuple[bytes, bytes]], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run of each suffix in order, length of the prefix it shares with the one before, the suffixes as a matrix).

    runs: (lengths of shared prefixes, tails) of front-coded sorted suffixes of ``width`` bytes.  A loser tree; ``known``
    has for each run the length of the prefix its next suffix shares with the last one put out.  Of two suffixes, that
    which shares more with the last is the smaller; only equals are compared, from there on.
    """
    k = len(runs)
    size = 1 << max(0, k - 1).bit_length()
    known, key = [-1] * size, [b""] * size  # -1: the run is over
    at, offset = [0] * size, [0] * size
    for r, (shared, tails) in enumerate(runs):
        if shared:
            known[r], key[r], at[r], offset[r] = 0, tails[:width], 1, width
    lost = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix is then that with the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        i = known[a]
        x, y = key[a][i:], key[b][i:]
        d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        i = width - (d.bit_length() + 7) // 8
        if x < y or (d == 0 and a < b):
            known[b] = i
            return a, b
        known[a] = i
        return b, a

    winners = list(range(size))
    for node in range(size - 1, 0, -1):
        pair = [winners[c] if c < size else c - size for c in (2 * node, 2 * node + 1)] if size > 1 else [0, 0]
        winners[node], lost[node] = play(*pair)
    w = winners[1] if size > 1 else 0
    source: list[int] = []
    common: list[int] = []
    out: list[bytes] = []
    while known[w] >= 0:
        source.append(w)
        common.append(known[w])
        last = key[w]
        out.append(last)
        shared, tails = runs[w]
        i = at[w]
        if i < len(shared):  # the next of this run shares with the last put out what the front coding says
            n = known[w] = shared[i]
            o = offset[w]
            key[w] = last[:n] + tails[o : o + width - n]
            at[w], offset[w] = i + 1, o + width - n
        else:
            known[w] = -1
        node = (w + size) >> 1
        while node:
            b = lost[node]
            kb, kw = known[b], known[w]
            if kb > kw:
                lost[node], w = w, b
            elif kb == kw and kb >= 0:
                w, lost[node] = play(w, b)
            node >>= 1
    return np.array(source, np.int64), np.array(common, np.int64), np.frombuffer(b"".join(out), np.uint8).reshape(-1, width)


def repeated(keys: np.ndarray, common: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each sorted suffix a mask of its passages that a smaller document has; bit j: that which starts j bytes
    before the anchor.  common: lengths of prefixes shared with the suffix before."""
    n = len(doc)
    mask = np.zeros(n, np.int64)
    first = np.flatnonzero(np.r_[True, common[1:] < K])
    several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    # suffixes that stay share, with those before, the least of all that lie between
    rows = np.flatnonzero(np.repeat(several, np.diff(np.r_[first, n])))
    if not len(rows):
        return mask
    right = np.where(np.isin(rows, first), 0, common[rows])
    keys, doc, low, high = keys[rows], doc[rows], low[rows], high[rows]
    side = np.ascontiguousarray(keys[:, SPAN:])
    by_left = sort_keys(side)
    left = neighbours(side[by_left])
    found = np.zeros(len(rows), np.int64)
    lclass = np.empty(len(rows), np.int64)
    for j in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= j) & (j <= high))
        if len(own) < 2:
            continue
        lclass[by_left] = np.cumsum(left < j)
        pair = (np.cumsum(right < SPAN - j) * np.int64(len(rows) + 1) + lclass)[own]
        o = np.argsort(pair, kind="stable")
        pair, d = pair[o], doc[own][o]
        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        least = np.repeat(np.minimum.reduceat(d, start), np.diff(np.r_[start, len(d)]))
        found[own[o[d > least]]] |= np.int64(1) << j
    mask[rows] = found
    return mask


def _merge(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, meta = [], {k: [] for k, _ in META}

    def out(uid, hit):
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(hit, pa.int64())], ["uid", "hit"])

    for g in groups:
        for shared, tails, m in zip(*(g.column(c).to_pylist() for c in ("shared", "tails", "meta"))):
            if shared is None:
                uid, hit = np.frombuffer(m, "<i8").reshape(2, -1)
                yield out(uid, hit)
                continue
            runs.append((shared, tails))
            at = 0
            for k, t in META:
                x = np.frombuffer(m, t, len(shared), at)
                meta[k].append(x.astype(np.int64))
                at += x.nbytes
    if not runs:
        return
    source, common, keys = merge_runs(runs)
    order = np.argsort(source, kind="stable")  # the place in the sorted sequence of each suffix, run by run
    rec = {}
    for k, parts in meta.items():
        rec[k] = np.empty(len(source), np.int64)
        rec[k][order] = np.concatenate(parts)
    mask = repeated(keys, common, rec["doc"], rec["low"], rec["high"])
    hit = np.flatnonzero(mask)
    yield out(rec["uid"][hit], (rec["at"][hit] << MASK_BITS) | mask[hit])
    del runs, meta, rec, keys, source, common, order, mask
    release()


def with_hits(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with __text (null as empty) and __hits, an array of places with masks of the passages that go, or null.

    Rows with equal ids never cause anything to be removed from each other, be their texts equal or not.  A null id is
    smaller than all others.
    """
    t = text_of(df, text)
    ids = F.coalesce(df[id_col].cast("bigint"), F.lit(-(1 << 63)))
    src = df.select(ids.alias("doc"), F.xxhash64(ids, t).alias("uid"), t.alias("text"))
    n_bytes = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    m = n_cells(2 * n_bytes // (PLACES + 1), PROBES)
    n_buckets = max(LEAST_BUCKETS, n_bytes // BUCKET_BYTES)
    runs = _runs(src, _shared_anchors(src, m), m, n_buckets)
    hits = save(runs.groupBy("bucket").applyInArrow(_merge, "uid bigint, hit bigint"), "suffix-hits", ROWS)
    by_doc = hits.groupBy(F.col("uid").alias("__uid")).agg(F.collect_set("hit").alias("__hits"))
    docs = df.withColumn("__uid", F.xxhash64(ids, t)).join(by_doc, "__uid", "left").drop("__uid")
    return docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))  # behind the join, which moves the text once


def removed_bytes(n: int, hits: list[int] | None) -> np.ndarray:
    """A flag for each of ``n`` bytes: does a passage that goes cover it?"""
    d = np.zeros(n + 1, np.int32)
    if hits is not None and len(hits):
        x = np.asarray(hits, np.int64)
        at, mask = x >> MASK_BITS, x & ((1 << MASK_BITS) - 1)
        for j in range(PLACES):
            p = at[(mask >> j) & 1 == 1] - j
            np.add.at(d, p, 1)
            np.add.at(d, p + SPAN, -1)
    return np.cumsum(d[:n]) > 0


def removed(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``df``.

    Each byte goes that is covered by a string of SPAN bytes which also starts in a document with a smaller id, all as
    they are in the input.  Null and empty texts have no bytes.  Repeated rows give equal results.  Empty table: no rows.
    """
    src = df.select(df[id_col].alias("doc_id"), df[text].alias("text"))
    schema = T.StructType([src.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for b in batches:
            out = []
            for (_, raw), hits in zip(_raw(b.column(1)), b.column(2)):
                if not hits.is_valid:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                gone = removed_bytes(len(raw), hits.values.to_numpy())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], schema.names)

    return with_hits(src).select("doc_id", "__text", "__hits").mapInArrow(run, schema)


def trim(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the characters all of whose bytes ``removed`` takes, and without rows that have no text left but
    had some; all other columns stay, whatever they are called.

    Null and empty texts stay as they are.  A null id is smaller than all others.  Repeated rows are trimmed alike.  An
    empty table gives no rows."""
    rest = [c for c in df.columns if c != text]
    # all other columns are one, whatever they are called
    row = F.struct(F.lit(True).alias("_"), *(df[c].alias(f"c{i}") for i, c in enumerate(rest)))
    marked = with_hits(df.select(row.alias("row"), df[id_col].cast("bigint").alias("doc_id"), df[text].cast("string").alias("text")))
    src = marked.select("row", F.col("text").alias("old"), "__text", "__hits")
    schema = T.StructType([*src.select("row").schema.fields, T.StructField("text", T.StringType())])
    n = 1

    def run(batches):
        for b in batches:
            out, stay = [], []
            for k, (old, (_, raw), hits) in enumerate(zip(b.column(n), _raw(b.column(n + 1)), b.column(n + 2))):
                if not hits.is_valid:
                    out.append(old.as_py())
                    stay.append(k)
                    continue
                data = np.frombuffer(raw, np.uint8)
                start = np.flatnonzero((data & 0xC0) != 0x80)  # of characters
                whole = np.minimum.reduceat(removed_bytes(len(raw), hits.values.to_numpy()), start)
                kept = data[~np.repeat(whole, np.diff(np.r_[start, len(data)]))].tobytes().decode()
                if kept:
                    out.append(kept)
                    stay.append(k)
            cols = [c.take(pa.array(stay, pa.int64())) for c in b.columns[:n]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string())], schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(*((F.col("text") if c == text else F.col("row").getField(f"c{rest.index(c)}")).alias(c) for c in df.columns))
