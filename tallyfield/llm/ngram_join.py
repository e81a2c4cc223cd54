"""Jaccard join of documents on sets of word n-grams, by rare-first prefix filtering.

A document is the set of its distinct n-grams, as 64-bit hashes; equal sets are one node.  Sets are ordered by how often
an n-gram occurs, rare ones first, so that two similar sets share an n-gram within a short prefix.  The order comes from
a sketch of counts over all documents, of fixed size; any order that all documents share gives the same links, a worse
one only more candidates.  Candidates share a prefix n-gram and pass a length filter, a positional filter (the shared
n-gram leaves enough n-grams behind it) and a suffix filter: of what lies behind the shared n-gram each has a parity map,
which differ in no more bits than the suffixes differ in n-grams, and linked sets differ in few.  For the first n-gram
that two linked sets share all of these hold, so no link is lost.  Each pair is verified once, on the whole sets.

Prefixes go to tasks by range of their n-grams' hashes, packed, and each task sorts its own, so its size does not grow
with the input.  N-grams that the same nodes have are one, the first in the order.  Links make components, and only these
are asked for: ``linking`` compares nodes with leads before it compares what is left.

Node ids and n-grams are 64-bit hashes; two of 10^9 different sets collide with a chance of about one in 40.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import components, drop, hot_join, save, text_of
from tallyfield.llm.exact_dedup import cell_hits, flagger, merged_cells, n_cells
from tallyfield.llm.linking import BITS, BUCKET, LIST, MAP, MEMBER, PACKET, PACKETS, apart, bucket_names, common, gathered, least_linked, linked_components, packet, parity_maps
from tallyfield.llm.words import blocks, ngrams, release

#: Cells of the sketch of counts, and the parts it is summed in.
CELL_BITS, PARTS = 20, 64
#: Bytes of text for each range of n-grams.
RANGE_BYTES = 32 << 20
REMEMBERED = 500_000
#: Bytes of a hash by which a pair is verified first, and how many n-grams fewer in common it must stand to be settled so.
WIDTH, MARGIN = 5, 3


def shingle_sets(col: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) for blocks of texts: of each text the sorted hashes of its distinct n-grams of ``size`` words, A-Z
    as a-z.  Words are runs of bytes other than space and \\t to \\r.  Fewer words: the whole sequence as one n-gram; no
    word: empty."""
    for first, _, w in blocks(col):
        yield first, [np.unique(ngrams(w.hash[i:j], size)) for i, j in zip(w.first, w.first[1:])]


def node_of(h: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))
    return x - (1 << 64) if x >> 63 else x


def packed(h: np.ndarray, width: int = WIDTH) -> bytes:
    """The upper ``width`` bytes of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]).tobytes()


def unpacked(raw: pa.Buffer, width: int = WIDTH) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def in_common(x: pa.Buffer, y: pa.Buffer, width: int = WIDTH) -> tuple[int, int]:
    """How many hashes two packed sets have in common and have in all, counted twice where they do.  Cut hashes that agree by
    chance count as common, so a cut never makes a pair look less alike."""
    n = (len(x) + len(y)) // width
    key = np.sort(np.concatenate([unpacked(x, width), unpacked(y, width)]))
    return int(np.count_nonzero(key[1:] == key[:-1])), n


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _sources(df: DataFrame, id_col: str, text: str) -> DataFrame:
    t = text_of(df, text)
    return df.select(df[id_col].cast("bigint").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))


def _profile(src: DataFrame, size: int) -> DataFrame:
    """For each row doc_id, th, n, node; besides them rows with parts of the sketch."""
    schema = "doc_id bigint, th bigint, n int, node bigint, part int, counts binary"
    names = ["doc_id", "th", "n", "node", "part", "counts"]

    def run(batches):
        total = np.zeros(1 << CELL_BITS, np.int64)
        seen = False
        for b in batches:
            for at, sets in shingle_sets(b.column(2), size):
                seen = True
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
                none = pa.nulls(len(sets))
                n, node = pa.array([len(h) for h in sets], pa.int32()), pa.array([node_of(h) for h in sets], pa.int64())
                cols = [*(b.column(k).slice(at, len(sets)) for k in (0, 1)), n, node, none.cast(pa.int32()), none.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)
        if seen:
            each = np.minimum(total, 0xFFFFFFFF).astype("<u4").reshape(PARTS, -1)
            none = pa.nulls(PARTS)
            cols = [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in each], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)
        release()

    return src.mapInArrow(run, schema)


def _sketch(profile: DataFrame) -> np.ndarray:
    """The counts of n-grams by cell, 4 MiB whatever the input."""

    def add(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << CELL_BITS) // PARTS, np.int64)
        for g in groups:
            for x in g.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_buffer()), "<u4")
        out = np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out], pa.binary())], ["part", "counts"])

    parts = profile.filter("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary")
    out = np.zeros((PARTS, (1 << CELL_BITS) // PARTS), np.uint32)
    for r in parts.collect():  # PARTS rows of fixed size
        out[r.part] = np.frombuffer(r.counts, "<u4")
    return out.ravel()


def _prefixes(src: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """node, n, th (a hash of its text), tokens (its prefix, rarest first) and the parity map of the whole set, for each node
    that can link; of equal sets that a task sees one.  A written table."""
    shared = src.sparkSession.sparkContext.broadcast(counts)
    least = least_linked(percent)

    def run(batches):
        done: set[int] = set()
        for b in batches:
            for first, sets in shingle_sets(b.column(0), size):
                node, new, at = [], [], []
                for i, h in enumerate(sets, first):
                    if len(h) < least or (k := node_of(h)) in done:
                        continue
                    if len(done) < REMEMBERED:
                        done.add(k)
                    node.append(k)
                    new.append(h)
                    at.append(i)
                if new:
                    yield rows(node, new, b.column(1).take(pa.array(at)))
        release()

    def rows(node, sets, th):
        n = np.array([len(h) for h in sets])
        maps = parity_maps(np.repeat(np.arange(len(n)), n), np.concatenate(sets), len(n))
        prefix = []
        for h in sets:
            m = prefix_length(len(h), percent)
            c = shared.value[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
            if m < len(h):  # ties by hash: the sort is stable and h in order
                low = np.flatnonzero(c <= np.partition(c, m - 1)[m - 1])
                h, c = h[low], c[low]
            prefix.append(h[np.argsort(c, kind="stable")[:m]].view(np.int64))
        ends = np.r_[0, np.cumsum([len(x) for x in prefix])].astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))
        cols = [pa.array(node, pa.int64()), pa.array(n.astype(np.int32)), th, tokens, *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(len(MAP)))]
        return pa.RecordBatch.from_arrays(cols, ["node", "n", "th", "tokens", *MAP])

    out = src.select("text", "th").mapInArrow(run, "node bigint, n int, th bigint, tokens array<bigint>, " + ", ".join(f"{s} bigint" for s in MAP))
    return save(out, "ngram-prefixes")


def _buckets(prefixes: DataFrame, parts: int, counts: np.ndarray) -> DataFrame:
    """(token, node) of prefix n-grams that two nodes share, repeats among them.  Of n-grams with the same nodes the first in the order stays:
    the first that two sets share is the first of all that the same nodes have."""
    shared = prefixes.sparkSession.sparkContext.broadcast(counts)
    schema = "kind tinyint, x bigint, y bigint, c bigint, nodes array<bigint>"
    names = ["kind", "x", "y", "c", "nodes"]

    def pack(batches):
        token, node, n = [], [], 0
        for b in batches:
            t = b.column(1)
            token.append(t.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            node.append(np.repeat(b.column(0).to_numpy(zero_copy_only=False), t.value_lengths().to_numpy(zero_copy_only=False)))
            n += len(token[-1])
            if n >= PACKET:
                yield from packet(np.concatenate(token), np.concatenate(node), parts)
                token, node, n = [], [], 0
        if n:
            yield from packet(np.concatenate(token), np.concatenate(node), parts)
        del token, node
        release()

    def gather(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, (token, node, size, large) = gathered(groups)

        def members(x, y):
            none = pa.nulls(len(x), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), MEMBER, np.int8)), x, y, none, pa.nulls(len(x), pa.list_(pa.int64()))], names)

        for g in single:
            yield members(g.column("x"), g.column("y"))
        whole = ~large & (size <= LIST)
        if not whole.all():
            yield members(pa.array(token[~whole].view(np.int64)), pa.array(node[~whole]))
        token, node, size = token[whole], node[whole], size[whole]
        if not len(token):
            return
        first, name = bucket_names(token, node, size, np.ones(len(token), bool))
        c = shared.value[(token[first] >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.int64)
        o = np.lexsort((token[first], c, name))
        o = o[np.r_[True, name[o][1:] != name[o][:-1]]]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(token)].astype(np.int32)), pa.array(node)).take(pa.array(o))
        cols = [np.full(len(o), BUCKET, np.int8), name[o].view(np.int64), token[first][o].view(np.int64), c[o]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), lists], names)

    c = F.col
    rows = prefixes.select("node", "tokens").mapInArrow(pack, PACKETS).groupBy("part").applyInArrow(gather, schema)
    rows = save(rows, "ngram-buckets")
    unsigned = c("y").bitwiseXOR(F.lit(-(1 << 63)))
    lists = rows.filter(f"kind = {BUCKET}").groupBy("x").agg(F.min_by(F.struct("y", "nodes"), F.struct(c("c"), unsigned)).alias("b"))
    one = rows.filter(f"kind = {MEMBER}").select(c("x").alias("token"), c("y").alias("node"))
    return one.unionByName(lists.select(c("b.y").alias("token"), F.explode("b.nodes").alias("node")))


def _index(prefixes: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, node, n, pos, th (a hash of its text), central (the node's number of tokens here) and the parity map of what lies behind
    the token, for (token, node) of ``tokens``; besides them a row for each node at pos -1, behind which the whole set lies.
    Written."""
    by_node = tokens.groupBy("node").agg(F.collect_set("token").alias("own"))  # no more than a prefix
    # equal sets from several tasks fall together
    both = by_node.join(prefixes.dropDuplicates(["node"]), "node").select("node", "own", "n", "tokens", "th", *MAP)
    names = ["token", "node", "n", "pos", "th", "central", *MAP]

    def run(batches):
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            nodes, ns, ths = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 4))
            maps = np.stack([b.column(5 + k).to_numpy(zero_copy_only=False) for k in range(len(MAP))], 1)
            for k in range(b.num_rows):
                own, prefix = (b.column(i)[k].values.to_numpy(zero_copy_only=False) for i in (1, 3))
                at = np.flatnonzero(np.isin(prefix, own))
                bit = ((prefix.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
                each = np.zeros((len(prefix), len(MAP)), np.int64)
                each[np.arange(len(prefix)), bit >> 6] = np.left_shift(np.int64(1), bit & 63)
                behind = np.concatenate([maps[k][None], (np.bitwise_xor.accumulate(each, axis=0) ^ maps[k])[at]])
                m = len(at) + 1
                out.append((np.r_[np.int64(0), prefix[at]], np.full(m, nodes[k]), np.full(m, ns[k], np.int32), np.r_[-1, at].astype(np.int32), np.full(m, ths[k]), np.full(m, len(at), np.int32), behind))
            if out:
                cols = [np.concatenate(x) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:6]), *(pa.array(np.ascontiguousarray(cols[6][:, k])) for k in range(len(MAP)))], names)
        release()

    return save(both.mapInArrow(run, "token bigint, node bigint, n int, pos int, th bigint, central int, " + ", ".join(f"{s} bigint" for s in MAP)), "ngram-index")


def _passes(percent: int):
    """The length and the positional filter, and these together with the suffix filter."""

    def near(x, y) -> Column:
        n1, n2 = x("n"), y("n")
        return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - x("pos"), n2 - y("pos")) >= common(n1, n2, percent))

    def passes(x, y) -> Column:
        behind = x("n") - x("pos") - 1 + y("n") - y("pos") - 1
        return near(x, y) & (apart(x, y) <= behind - 2 * (common(x("n"), y("n"), percent) - 1))

    return near, passes


def _verifier(src: DataFrame, nodes: DataFrame, size: int, percent: int):
    """(verify, settle).  verify: of pairs (a, b) of nodes those whose sets link, without those that cut hashes can't settle;
    pairs whose whole sets' maps differ too much are dropped before any set is moved.  settle: of all pairs that were left so
    those that link, by whole hashes, once; None if none were left."""
    c = F.col
    left: list[DataFrame] = []

    def compared(pairs: DataFrame, sets: DataFrame, width: int, name: str) -> DataFrame:
        """Written pairs (a, b, a_th, b_th, sure) that link by hashes of so many bytes; sure: with MARGIN fewer in common they would too."""
        for x in "ab":
            pairs = pairs.join(sets.select(c("node").alias(x), c("h").alias(f"h{x}")), x)

        def run(batches):
            for b in batches:
                ok, sure = [], []
                for x, y in zip(b.column(4), b.column(5)):
                    both, n = in_common(x.as_buffer(), y.as_buffer(), width)
                    ok.append(100 * both >= percent * (n - both))
                    both -= MARGIN
                    sure.append(100 * both >= percent * (n - both))
                ok = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([*(b.column(k).filter(ok) for k in range(4)), pa.array(sure, pa.bool_()).filter(ok)], ["a", "b", "a_th", "b_th", "sure"])
            release()

        return save(pairs.select("a", "b", "a_th", "b_th", "ha", "hb").mapInArrow(run, "a bigint, b bigint, a_th bigint, b_th bigint, sure boolean"), name, 500)

    def sets_of(pairs: DataFrame, width: int = WIDTH) -> DataFrame:
        wanted = pairs.select(c("a").alias("node"), c("a_th").alias("th")).union(pairs.select("b", "b_th")).distinct()
        return _sets(src, save(wanted, "ngram-wanted"), size, width)

    def verify(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(nodes.select(c("node").alias(x), *(c(k).alias(f"{x}_{k}") for k in ("th", "n", *MAP))), x)
        differ = apart(lambda k: c(f"a_{k}"), lambda k: c(f"b_{k}"))
        keep = differ <= c("a_n") + c("b_n") - 2 * common(c("a_n"), c("b_n"), percent)
        pairs = save(pairs.filter(keep).select("a", "b", "a_th", "b_th"), "ngram-pairs")
        sets = sets_of(pairs)
        found = compared(pairs, sets, WIDTH, "ngram-links")
        drop(sets, pairs)
        left.append(found.filter("not sure").drop("sure"))
        return found.filter("sure").select("a", "b")

    def settle() -> DataFrame | None:
        close = None
        for x in left:
            close = x if close is None else close.union(x)
        if close is None or not close.limit(1).count():
            return None
        close = close.distinct()
        sets = sets_of(close, 8)
        found = compared(close, sets, 8, "ngram-settled").select("a", "b")
        drop(sets)
        return found

    return verify, settle


def linked(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``df``: doc_id, th (a hash of its text), n_shingles, component_id.

    Two documents link if 100 * (size of the intersection) >= ``percent`` * (size of the union) of their sets;
    component_id is the smallest doc_id reachable by links.  Null and empty texts and texts without words have empty
    sets, which link with nothing: component_id is their own doc_id.  A null doc_id is never the smallest; a component
    in which all ids are null has a null id.  Repeated rows are linked like all equal sets.  Empty table: no rows.
    """
    src = _sources(df, id_col, text)
    profile = save(_profile(src, size), "ngram-profile")
    docs = profile.filter("part is null").select("doc_id", "th", "n", "node")
    full = docs.filter("n > 0")
    counts = _sketch(profile)
    prefixes = _prefixes(src, size, percent, counts)
    n_bytes = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    index = _index(prefixes, _buckets(prefixes, max(64, n_bytes // RANGE_BYTES), counts))
    c = F.col
    drop(prefixes)
    verify, settle = _verifier(src, index.filter("pos < 0"), size, percent)
    comp = linked_components(index.filter("pos >= 0"), percent, ["n", "pos"], *_passes(percent), verify)
    close = settle()
    if close is not None:
        comp = components(close if comp is None else close.union(comp.select(c("id").alias("a"), c("component").alias("b"))), "ngram-cc")
    drop(index)
    classes = full.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    # a document that is alone needs no label
    if comp is not None:
        some = classes.join(comp.select(c("id").alias("node"), "component"), "node", "left").filter("copies > 1 or component is not null")
        some = save(some, "ngram-classes")
        near = some.filter("component is not null")
        roots = near.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
        label = hot_join(near, save(roots, "ngram-roots"), "component", "members", near.count(), "inner").select("node", "copies", "component_id")
        label = label.unionByName(some.filter("component is null").select("node", "copies", c("least").alias("component_id")))
    else:
        label = classes.filter("copies > 1").select("node", "copies", c("least").alias("component_id"))
    label = save(label, "ngram-label")
    # only where all ids of a component are null is there none
    joined = hot_join(full, label, "node", "copies", full.count()).select("doc_id", "th", c("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    empty = docs.filter("n = 0").select("doc_id", "th", F.lit(0).cast("bigint").alias("n_shingles"), c("doc_id").alias("component_id"))
    return joined.unionByName(empty)


def _sets(src: DataFrame, wanted: DataFrame, size: int, width: int = WIDTH) -> DataFrame:
    """node, h (the hashes, packed in ``width`` bytes each) of the wanted (node, th), each from one of the documents with a text of that hash; a
    written table.  A filter of cells, of bounded size, keeps most other texts from being shuffled."""
    m = n_cells(wanted.count())

    def hit(batches):
        for b in batches:
            if b.num_rows:
                yield cell_hits(b.column(0).to_numpy(zero_copy_only=False), m)

    bits = merged_cells(wanted.select("th").mapInArrow(hit, "seg int, hits binary"), m, 1)
    maybe = flagger(src.sparkSession, bits, m)
    # copies of a text are one row before they are shuffled, and a node has one text
    texts = src.select("th", "text").filter(maybe("th")).groupBy("th").agg(F.min("text").alias("text"))
    texts = texts.join(wanted, "th").select("node", "text")

    def run(batches):
        for b in batches:
            for at, sets in shingle_sets(b.column(1), size):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.array([packed(x, width) for x in sets], pa.binary())], ["node", "h"])
        release()

    sets = save(texts.mapInArrow(run, "node bigint, h binary"), "ngram-sets", 1000)
    drop(wanted)
    return sets


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, all columns as they are, without those that have another's id as component_id: of each group
    of near duplicates the row with the smallest id stays.

    A row with a null id goes if its group has an id at all; where no row of a group has one, all stay, as nothing tells
    them apart.  Repeated rows (equal ids and texts) stay or go together.  Texts without words stay.  Empty table: no rows."""
    gone = linked(df, id_col, text, size, percent).filter("component_id is not null and not doc_id <=> component_id").select("doc_id", "th").distinct()
    gone = save(gone, "ngram-gone").select(F.col("doc_id").alias("__gone"), F.col("th").alias("__th"))
    return df.join(gone, df[id_col].cast("bigint").eqNullSafe(gone["__gone"]) & (F.xxhash64(text_of(df, text)) == gone["__th"]), "left_anti")
