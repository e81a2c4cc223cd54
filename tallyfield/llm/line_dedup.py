"""Fuzzy line dedup by MinHash.

A line, lower-cased and without white space at its ends, is the set of its distinct shingles of ``SHINGLE`` characters, as
64-bit hashes; equal lines are one node.  A set's signature has ``BANDS`` * ``ROWS`` minima, by one permutation: hashes
fall into so many ranges, each gives its least hash, and empty ranges copy that of a range drawn for them.  Nodes that
agree in all rows of a band share a bucket.  Candidates are verified on the whole sets, so every link is exact; a pair of
Jaccard similarity s shares a bucket with a chance of about 1 - (1 - s^6)^21: 0.998 at 0.8, 0.99995 at 0.85.  Links make
components by distributed union-find, and of each component one line stays.

Bands go to tasks by range of their hashes, packed, and each task sorts its own, so its size does not grow with the
input.  Of a bucket that is large within one packet only the smallest node is sent on, so a bucket with a third of all
nodes is never gathered.  Buckets of two nodes are pairs; larger ones go through ``linking``, which compares their nodes
with leads before it compares what is left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import drop, hot_join, save, text_of
from tallyfield.llm.exact_dedup import cell_hits, cells, merged_cells, n_cells
from tallyfield.llm.linking import MAP, MEMBER, PACKET, PACKETS, PAIR, SMALL, apart, bucket_names, common, gathered, linked_components, packet, parity_maps, rows_of, shortened
from tallyfield.llm.words import A, mix, release

SHINGLE, BANDS, ROWS = 5, 21, 6
BINS = BANDS * ROWS
#: Characters, and lines, that are worked on at a time, but for longer lines.
BLOCK, LINES = 1 << 16, 8192
#: Lines for each range of bands.
RANGE_LINES = 50_000
#: A line's hash has so many bits where lines are sorted together.
HASH_BITS = 44
#: Pairs that so many shingles more or fewer in common would make or unmake are settled by the shingles themselves.
MARGIN = 2
REMEMBERED = 500_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(7)
#: Of each range those that it copies from if it is empty, in order.
SPARE = np.stack([_rng.integers(0, BINS, BINS) for _ in range(32)])
WEIGHTS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal(line: str) -> str:
    return line.strip().lower()


def node_of(line: str) -> int:
    x = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line of each, hash) of the shingles of some lines, in the order of lines; a hash has HASH_BITS bits.  A line shorter
    than a shingle has none."""
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = np.array([len(x) for x in lines], np.int64)
    m = len(c) - SHINGLE + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = c[:m] * WEIGHTS[0]
    part = np.empty_like(h)
    for k in range(1, SHINGLE):
        h += np.multiply(c[k : k + m], WEIGHTS[k], out=part)
    starts = np.ones(len(c), bool)
    ends = np.cumsum(n)
    for k in range(1, SHINGLE):
        starts[ends - k] = False  # of a line shorter than k a place near the end of an earlier one, or of the last
    owner = np.repeat(np.arange(len(n)), np.maximum(0, n - SHINGLE + 1))
    return owner, mix(h[starts[:m]]) >> np.uint64(64 - HASH_BITS)


def sets_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line of each, hash) of the distinct shingles of some lines, in order."""
    owner, h = shingles(lines)
    key = np.sort(h | (owner.astype(np.uint64) << np.uint64(HASH_BITS)))
    key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1)


def bands_of(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Row i: the bands of set i, of which ``h`` has all hashes, with repeats or not; no set is empty."""
    own = np.full(BINS * n, EMPTY)
    range_ = ((h >> np.uint64(HASH_BITS - 32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(own, range_ * n + owner, h)
    own = own.reshape(BINS, n)
    empty = own == EMPTY
    own = np.where(empty, EMPTY, mix(own))
    sig = own.copy()
    at, line = np.nonzero(empty)
    for spare in SPARE:
        if not len(line):
            break
        got = own.ravel()[spare[at] * n + line]
        sig.ravel()[at * n + line] = got
        still = got == EMPTY
        at, line = at[still], line[still]
    if len(line):  # few shingles: the next range that has one
        lines, where = np.unique(line, return_inverse=True)
        place = np.where(np.tile(~empty[:, lines], (2, 1)), np.arange(2 * BINS)[:, None], 2 * BINS)
        after = np.minimum.accumulate(place[::-1], axis=0)[::-1]
        sig[at, line] = own[after[at, where] % BINS, line]
    sig = sig.reshape(ROWS, BANDS, n)
    x = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], n, 1)
    for row in sig:
        x = mix(x * A + row)
    return np.ascontiguousarray(x.T)


def blocks(lines: Iterable[tuple[int, str]]) -> Iterator[tuple[list[int], list[str]]]:
    """(nodes, lines) a block at a time."""
    nodes, texts, size = [], [], 0
    for node, text in lines:
        nodes.append(node)
        texts.append(text)
        size += len(text)
        if size >= BLOCK or len(texts) >= LINES:
            yield nodes, texts
            nodes, texts, size = [], [], 0
    if texts:
        yield nodes, texts


def _shared_buckets(src: DataFrame, parts: int) -> DataFrame:
    """Members (bucket x, node y) of buckets of three nodes and more, and pairs (nodes x, y) of those of two; written."""

    def run(batches):
        done: set[int] = set()

        def fresh():
            for b in batches:
                for t in b.column(0):
                    for line in t.as_py().split("\n"):
                        x = normal(line)
                        if len(x) < SHINGLE:
                            continue
                        k = node_of(x)
                        if k in done:
                            continue
                        if len(done) < REMEMBERED:
                            done.add(k)
                        yield k, x

        token, node, n = [], [], 0
        for nodes, texts in blocks(fresh()):
            x = bands_of(*shingles(texts), len(texts))
            token.append(shortened(x.ravel(), parts))
            node.append(np.repeat(np.array(nodes, np.int64), BANDS))
            n += x.size
            if n >= PACKET:
                yield from packet(np.concatenate(token), np.concatenate(node), parts, short=True)
                token, node, n = [], [], 0
        if n:
            yield from packet(np.concatenate(token), np.concatenate(node), parts, short=True)
        del token, node
        release()

    def gather(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs and members of the buckets of one part."""
        single, (token, node, size, large) = gathered(groups, key[0].as_py(), parts)
        yield from single
        two = (size == 2) & ~large
        if two.any():
            pairs = np.unique(node[two].reshape(-1, 2), axis=0)
            yield rows_of(PAIR, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
        token, node, size, large = (x[~two] for x in (token, node, size, large))
        if len(token):
            first, name = bucket_names(token, node, size, ~large & (size <= SMALL))
            once = np.zeros(len(first), bool)
            once[np.unique(name, return_index=True)[1]] = True
            n = size[first]
            once = np.repeat(once, n)
            yield rows_of(MEMBER, np.repeat(name, n)[once], node[once])

    packed = src.select("text").mapInArrow(run, PACKETS)
    return save(packed.groupBy("part").applyInArrow(gather, PACKETS).select("kind", "x", "y"), "line-buckets")


def _texts(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text, n and the parity map of the wanted nodes, and of a few others that the filter of cells lets through;
    written."""
    m = n_cells(wanted.agg(F.approx_count_distinct("node")).first()[0])

    def hit(batches):
        for b in batches:
            if b.num_rows:
                yield cell_hits(np.unique(b.column(0).to_numpy(zero_copy_only=False)), m)

    bits = merged_cells(wanted.select("node").mapInArrow(hit, "seg int, hits binary"), m, 1)
    shared = src.sparkSession.sparkContext.broadcast(bits)

    def found(batches):
        done: set[int] = set()
        for b in batches:
            nodes, texts = [], []
            for t in b.column(0):
                for line in t.as_py().split("\n"):
                    x = normal(line)
                    if len(x) >= SHINGLE:
                        nodes.append(node_of(x))
                        texts.append(x)
                if len(nodes) >= LINES:
                    yield from some(nodes, texts, done)
                    nodes, texts = [], []
            if nodes:
                yield from some(nodes, texts, done)
        release()

    def some(nodes, texts, done):
        node = np.array(nodes, np.int64)
        c = cells(node, m)
        at = [k for k in np.flatnonzero(((shared.value[c >> 3] >> (c & 7).astype(np.uint8)) & 1).all(1)).tolist() if nodes[k] not in done]
        at = list({nodes[k]: k for k in at}.values())
        if len(done) < REMEMBERED:
            done.update(nodes[k] for k in at)
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array([texts[k] for k in at], pa.string())], ["node", "text"])

    # equal nodes meet in one task, which keeps one of each
    rows = src.select("text").mapInArrow(found, "node bigint, text string").repartition("node")

    def sized(batches):
        kept: set[int] = set()
        for b in batches:
            at = {k: i for i, k in enumerate(b.column(0).to_pylist()) if k not in kept}
            kept.update(at)
            b = b.take(pa.array(list(at.values()), pa.int64()))
            for at in range(0, b.num_rows, LINES):
                part = b.slice(at, LINES)
                done = 0
                for nodes, texts in blocks((0, x) for x in part.column(1).to_pylist()):
                    owner, h = sets_of(texts)
                    n = np.bincount(owner, minlength=len(texts)).astype(np.int32)
                    maps = parity_maps(owner, h, len(texts))
                    own = part.slice(done, len(texts))
                    done += len(texts)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(len(MAP)))], ["node", "text", "n", *MAP])
        release()

    return save(rows.mapInArrow(sized, "node bigint, text string, n int, " + ", ".join(f"{s} bigint" for s in MAP)), "line-texts")


def _passes(percent: int):
    """The length filter, and this together with that of the maps: linked sets differ in few elements."""

    def near(x, y) -> Column:
        return 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))

    def passes(x, y) -> Column:
        n1, n2 = x("n"), y("n")
        return near(x, y) & (apart(x, y) <= n1 + n2 - 2 * common(n1, n2, percent))

    return near, passes


def _verified(texts: DataFrame, percent: int):
    """Of pairs (a, b) of nodes those whose sets link.  Texts with their maps pass the filters first."""

    def linked(lines: list[str]) -> np.ndarray:
        """For each two lines in a row: do they link?"""
        owner, h = shingles(lines)
        # of a pair's shingles those of the first line come before equal ones of the second
        key = np.sort((h << np.uint64(1)) | (owner & 1).astype(np.uint64) | ((owner >> 1).astype(np.uint64) << np.uint64(HASH_BITS + 1)))
        key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
        pair = (key >> np.uint64(HASH_BITS + 1)).astype(np.int64)
        n = np.bincount(pair, minlength=len(lines) // 2)
        both = np.bincount(pair[1:][(key[1:] ^ key[:-1]) == np.uint64(1)], minlength=len(n))
        ok = 100 * both >= percent * (n - both)
        # cut hashes may agree by chance: where MARGIN shingles decide, the shingles themselves are compared
        near = (100 * (both + MARGIN) >= percent * (n - both - MARGIN)) & (100 * (both - MARGIN) < percent * (n - both + MARGIN))
        for k in np.flatnonzero(near).tolist():
            x, y = (set(x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1)) for x in lines[2 * k : 2 * k + 2])
            ok[k] = 100 * len(x & y) >= percent * len(x | y)
        return ok

    def run(batches):
        for b in batches:
            lines: list[str] = []
            first, size = 0, 0
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                lines += (x.as_py(), y.as_py())
                size += len(lines[-1]) + len(lines[-2])
                if size >= BLOCK or len(lines) >= LINES or k + 1 == b.num_rows:
                    ok = pa.array(linked(lines))
                    yield pa.RecordBatch.from_arrays([b.column(i).slice(first, k + 1 - first).filter(ok) for i in (0, 1)], ["a", "b"])
                    lines, first, size = [], k + 1, 0
        release()

    c = F.col

    own = [x for x in ("n", *MAP) if x in texts.columns]

    def verify(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(texts.select(c("node").alias(x), c("text").alias(f"{x}_text"), *(c(k).alias(f"{x}_{k}") for k in own)), x)
        if own:
            pairs = pairs.filter(_passes(percent)[1](lambda k: c(f"a_{k}"), lambda k: c(f"b_{k}")))
        return save(pairs.select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint"), "line-links")

    return verify


def _occurrences(src: DataFrame) -> DataFrame:
    """doc_id, rid, line, node of each line that is not blank; written."""

    def run(batches):
        for b in batches:
            row, line, node = [], [], []
            for i, t in enumerate(b.column(2)):
                for k, x in enumerate(t.as_py().split("\n")):
                    x = normal(x)
                    if x:
                        row.append(i)
                        line.append(k)
                        node.append(node_of(x))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(line, pa.int32()), pa.array(node, pa.int64())], ["doc_id", "rid", "line", "node"])
        release()

    return save(src.select("doc_id", "rid", "text").mapInArrow(run, "doc_id bigint, rid bigint, line int, node bigint"), "line-occurrences")


def _components(src: DataFrame, n_lines: int, percent: int) -> DataFrame | None:
    """(id, component) of the nodes that link, or None."""
    c = F.col
    shared = _shared_buckets(src, max(64, n_lines // RANGE_LINES))
    # a pair is a bucket of its own
    two = c("kind") == PAIR
    token = F.when(two, F.xxhash64("x", "y")).otherwise(c("x")).alias("token")
    rows = shared.select(token, F.explode(F.when(two, F.array("x", "y")).otherwise(F.array("y"))).alias("node"))
    texts = _texts(src, rows)
    # one exchange by node for all of it: repeats, how many buckets a node has, its size
    rows = rows.repartition("node").distinct().withColumn("central", F.count("*").over(Window.partitionBy("node")))
    index = save(rows.join(texts.select("node", "n"), "node"), "line-index")
    drop(shared)
    maps = texts.select("node", *MAP)
    return linked_components(index, percent, ["n"], *_passes(percent), _verified(texts, percent), 1, lambda open_: open_.join(maps, "node"), blocks=True)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row for each line of ``df`` that is not blank: doc_id, line (its number from 0, lines end at \\n), keep_id,
    keep_line, group_size, kept.

    Lines are compared in lower case and without white space at their ends.  Equal ones are in one group, and two lines
    link if 100 * (size of the intersection) >= ``percent`` * (size of the union) of their sets of shingles; lines shorter
    than a shingle have none and are in a group with equal ones only.  Of the lines
    reachable by links the one with the smallest (doc_id, line) stays, and of repeated rows one; a null doc_id comes last.
    Null texts and blank lines have no rows.  Empty table: no rows.  Further columns are ignored, whatever their names.
    """
    c = F.col
    src = df.select(df[id_col].cast("bigint").alias("doc_id"), text_of(df, text).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    occ = _occurrences(src)
    at = F.struct(c("doc_id").isNull().alias("none"), "doc_id", "line", "rid")
    n_lines = occ.count()
    comp = _components(src, n_lines, percent)
    classes = occ.groupBy("node").agg(F.count("*").alias("copies"), F.min(at).alias("least"))
    own = [c("least").alias("top"), c("copies").alias("group_size")]
    # lines of groups of one need no label
    if comp is not None:
        some = classes.join(comp.select(c("id").alias("node"), "component"), "node", "left").filter("copies > 1 or component is not null")
        some = save(some, "line-classes")
        linked = some.filter("component is not null")
        roots = linked.groupBy("component").agg(F.min("least").alias("top"), F.sum("copies").alias("group_size"), F.count("*").alias("members"))
        joined = hot_join(linked.drop("least"), save(roots, "line-roots"), "component", "members", linked.count(), "inner")
        label = joined.select("node", "copies", "top", "group_size").unionByName(some.filter("component is null").select("node", "copies", *own))
    else:
        label = classes.filter("copies > 1").select("node", "copies", *own)
    label = save(label, "line-label")
    out = hot_join(occ, label, "node", "copies", n_lines)
    own = F.coalesce(c("top.rid") == c("rid"), F.lit(True)) & F.coalesce(c("top.line") == c("line"), F.lit(True))
    return out.select(
        "doc_id",
        "line",
        F.when(c("top").isNull(), c("doc_id")).otherwise(c("top.doc_id")).alias("keep_id"),
        F.coalesce(c("top.line"), c("line")).alias("keep_line"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        own.alias("kept"),
    )
