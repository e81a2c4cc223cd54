"""From nodes that share tokens to connected components of those that link.

An index has a row for each token of each node.  Two nodes that link share a token, or are taken not to link.  Comparing
all nodes of a token with each other would cost the square of its size, and only components are asked for.  So nodes are
compared with leads first: in each round every token that still has nodes of several components has one of its nodes
as its lead, the most central one at first, later one drawn at random, and every node is compared with the lead that most
of its tokens have among those of other components.  A group of near copies falls together in the first round or two, whatever its size.  At last all pairs of
nodes that share a token and are in different components are compared, so no link between components is missed.  Pairs
are filtered by what the index has of their sizes and sets before anything of the sets is moved.

Where whole sets' sizes and maps are the filter, the last step goes by blocks of a token's nodes, and Spark moves rows of
blocks instead of pairs.  While tokens are crowded it is done twice: first each node is compared with the nearest one of
another component alone, by the maps, which joins most of what links, then whatever still passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import components, drop, hot_join, save
from tallyfield.llm.words import A, mix

#: Rounds with leads, if not told otherwise.
ROUNDS = 2
#: Rounds at most, and how many pairs for each row of an index are so many that leads are tried again.
MOST_ROUNDS, CROWD = 8, 24
#: The same where blocks are compared: a pair costs so much less there than a round does.
CROWD_BLOCKS = 256
#: Nodes of a block, rows of blocks that a task takes at a time, pairs that it holds.
BLOCK_NODES, PART_ROWS, HELD_PAIRS = 1024, 8192, 1 << 20
#: 64-bit words of a parity map.
WORDS = 8
BITS = 64 * WORDS
MAP = [f"s{k}" for k in range(WORDS)]
#: Tokens of a packet; nodes of a token that a packet sends on; nodes of a bucket that are kept as a list.
PACKET, SMALL, LIST = 1_000_000, 8, 64
#: What a row is: tokens and nodes packed, those of tokens that are large in their packet, one token and node.
PACKED, LARGE, MEMBER, PAIR, BUCKET = range(5)
PACKETS = "kind tinyint, part int, x bigint, y bigint, tokens binary, nodes binary"
NAMES = ["kind", "part", "x", "y", "tokens", "nodes"]
#: Pairs (a, b) of nodes to those of them that link.
Verify = Callable[[DataFrame], DataFrame]
#: A condition on two rows of the index, whose columns the two functions give.
Passes = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def parity_maps(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Row i: WORDS words with the parity of how many hashes of set i (those with ``owner`` i) fall on each bit.  Two sets
    differ in at least as many elements as their maps in bits."""
    at = owner * BITS + ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, -1), axis=1, bitorder="little").view("<i8").reshape(n, WORDS)


def apart(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """The number of bits in which the maps of two rows differ."""
    out = F.lit(0)
    for s in MAP:
        out = out + F.bit_count(x(s).bitwiseXOR(y(s)))
    return out


def common(n1: Column, n2: Column, percent: int) -> Column:
    """The least size of the intersection of two linked sets of these sizes."""
    return F.ceil(percent * (n1 + n2) / (100 + percent)).cast("int")


def least_linked(percent: int) -> int:
    """The smallest size of a set that links with another one: the larger has one hash more."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def buckets(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, nodes, number of distinct nodes of the row's token) of the distinct rows, in order."""
    o = np.argsort(token)
    token, node = token[o], node[o]
    # most tokens have one node: only where they have more are nodes sorted too
    same = token[1:] == token[:-1]
    several = np.flatnonzero(np.r_[False, same] | np.r_[same, False][: len(token)])
    node[several] = node[several[np.lexsort((node[several], token[several]))]]
    new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])][: len(token)]
    token, node = token[new], node[new]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
    size = np.diff(np.r_[first, len(token)])
    return token, node, np.repeat(size, size)


def rows_of(kind: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Single rows among packets, spread over the parts."""
    n = len(x)
    none = pa.nulls(n, pa.binary())
    spread = (x.view(np.uint64) % np.uint64(1 << 30)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(spread), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), none, none], NAMES)


def shortened(token: np.ndarray, parts: int) -> np.ndarray:
    """Tokens by 32 bits and their part alone.  Tokens that fall together so give candidates that are none, which the
    filters drop; links are not lost."""
    return (token >> np.uint64(32)) * np.uint64(parts) + token % np.uint64(parts)


def packet(token: np.ndarray, node: np.ndarray, parts: int, short: bool = False) -> Iterator[pa.RecordBatch]:
    """Tokens and nodes packed by part, a range of hashes.  Of a token with more than SMALL nodes only the smallest node is
    packed, and its nodes are members of it already, so no token gathers more than a few nodes of a packet.  ``short``:
    tokens are ``shortened`` and take four bytes."""
    token, node, size = buckets(token, node)
    large = size > SMALL
    if large.any():
        yield rows_of(MEMBER, token[large], node[large])
    lead = np.r_[True, token[1:] != token[:-1]][: len(token)]
    for kind, stay in ((PACKED, ~large), (LARGE, large & lead)):
        t, v = token[stay], node[stay]
        if not len(t):
            continue
        part = (t % np.uint64(parts)).astype(np.int32)
        o = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        t, v, part = t[o], v[o], part[o]
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[at[1:], len(part)]
        if short:
            t = (t // np.uint64(parts)).astype("<u4")
        cells = [pa.array([x[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()) for x in (t, v)]
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int8)), pa.array(part[at]), none, none, *cells], NAMES)


def gathered(batches: Iterator[pa.RecordBatch], part: int = 0, parts: int = 0) -> tuple[list[pa.RecordBatch], tuple[np.ndarray, ...]]:
    """(single rows of a part, (tokens, nodes, number of the token's nodes, is it large in some packet?)) of tokens that two
    nodes share.  parts: how many there are, if tokens are short."""
    single, tokens, nodes, large = [], [], [], []
    for g in batches:
        kind = g.column("kind").to_numpy(zero_copy_only=False)
        own = kind >= MEMBER
        if own.any():
            single.append(pa.RecordBatch.from_arrays([g.column(k).filter(pa.array(own)) for k in NAMES], NAMES))
        for k in np.flatnonzero(~own).tolist():
            raw = g.column("tokens")[k].as_buffer()
            tokens.append(np.frombuffer(raw, "<u4").astype(np.uint64) * np.uint64(parts) + np.uint64(part) if parts else np.frombuffer(raw, "<u8"))
            nodes.append(np.frombuffer(g.column("nodes")[k].as_buffer(), "<i8"))
            if kind[k] == LARGE:
                large.append(tokens[-1])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    token, node, size = buckets(cat(tokens, np.uint64), cat(nodes, np.int64))
    several = size > 1
    token, node, size = token[several], node[several], size[several]
    return single, (token, node, size, np.isin(token, np.unique(cat(large, np.uint64))))


def bucket_names(token: np.ndarray, node: np.ndarray, size: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each bucket, its name): by its nodes where ``whole``, for tokens with the same nodes are one bucket;
    else by its token."""
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
    if not len(first):
        return first, token[:0]
    same = np.add.reduceat(mix(node.view(np.uint64) + A), first)
    return first, np.where(whole[first], mix(same + size[first].astype(np.uint64)), token[first])


def _with_components(index: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return index.withColumn("comp", F.col("node"))
    named = comp.select(F.col("id").alias("node"), F.col("component").alias("__c"))
    return index.join(named, "node", "left").withColumn("comp", F.coalesce("__c", "node")).drop("__c")


def _leads(cur: DataFrame, salt: int, light: list[str]) -> DataFrame:
    """token, c (its nodes), lead of each token with nodes of several components; a written table.  The text that others
    are copies of shares the most tokens (``central``, if the index has it), so as a lead it links with most of them."""
    c = F.col
    draw = -c("central") if not salt and "central" in cur.columns else F.xxhash64("node", F.lit(salt))
    first = F.min(F.struct(draw.alias("draw"), "node", "comp", *light))
    lead = cur.groupBy("token").agg(F.count("*").alias("c"), first.alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return save(lead.filter("lo <> hi").select("token", "c", "lead"), "link-lead")


def _led(cur: DataFrame, lead: DataFrame, total: int, top: int, passes: Passes, light: list[str]) -> DataFrame:
    """Pairs (a, b): each node and its best lead of another component; a written table.  Of the index only the ``light``
    columns are moved.  All tokens draw alike, so no pair comes twice."""
    c = F.col
    both = hot_join(cur.select("token", "node", "comp", *light), lead, "token", "c", total, "inner", top)
    both = both.filter((c("comp") != c("lead.comp")) & passes(lambda x: c(x), lambda x: c(f"lead.{x}")))
    best = both.groupBy("node").agg(F.mode(c("lead.node"), True).alias("other"))  # of no more than a node's tokens
    return save(best.select(*ordered(c("node"), c("other"))), "link-led")


def _open(cur: DataFrame, some: DataFrame, total: int, top: int, percent: int, passes: Passes, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All pairs (a, b) of nodes in different components that share a token and pass; a written table.  Sizes fall into
    bands so wide that linked sets are in the same or in neighbouring ones; a token's nodes are only matched with those of
    the same band and of the next."""
    c = F.col
    width = float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 1e-9
    band = F.floor(F.log(c("n").cast("double")) / width).cast("bigint")
    cur = whole(hot_join(cur, some, "token", "c", total, "inner", top).drop("c"))
    cur = save(cur.withColumn("band", band), "link-cur")
    cols = [x for x in cur.columns if x not in ("token", "band", "central")]
    left = cur.select("token", "band", *(c(x).alias(f"l_{x}") for x in cols))
    right = cur.select("token", F.explode(F.array(F.struct(c("band"), F.lit(True).alias("same")), F.struct((c("band") - 1).alias("band"), F.lit(False).alias("same")))).alias("at"), *(c(x).alias(f"r_{x}") for x in cols))
    right = right.withColumn("band", c("at.band")).withColumn("same", c("at.same")).drop("at")
    ok = ((c("l_node") < c("r_node")) | ~c("same")) & (c("l_comp") != c("r_comp")) & passes(lambda x: c(f"l_{x}"), lambda x: c(f"r_{x}"))
    out = save(left.join(right, ["token", "band"]).filter(ok).select(*ordered(c("l_node"), c("r_node"))).distinct(), "link-pairs")
    drop(cur)
    return out


def _dealt(cur: DataFrame, some: DataFrame, total: int, top: int, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """part, token, x, y, block, node, comp, n and maps: a row for each two blocks x <= y of a token of which the node's own is
    one.  A token's nodes are in blocks of about BLOCK_NODES; those of the component that has most of a large token are in
    blocks of their own, which are not compared with each other, so a group that has linked costs its size alone."""
    c = F.col
    rows = hot_join(cur.select("token", "node", "comp", "n"), some, "token", "c", total, "inner", top)
    n_rows = total
    if top > BLOCK_NODES:
        # there are fewer large tokens than one for BLOCK_NODES rows
        large = F.broadcast(some.filter(c("c") > BLOCK_NODES).select("token"))
        own = cur.join(large, "token").groupBy("token", "comp").agg(F.count("*").alias("own"))
        own = own.groupBy("token").agg(F.max(F.struct("own", "comp")).alias("main"), F.sum("own").alias("c"))
        parts = lambda n: F.ceil(n / BLOCK_NODES).cast("int")
        own = save(own.select("token", c("main.comp").alias("main"), parts(c("main.own")).alias("mains"), parts(c("c") - c("main.own")).alias("others"), "c", c("main.own").alias("own")), "link-large")
        n_rows += own.agg(F.coalesce(F.sum(c("own") * c("others") + (c("c") - c("own")) * (c("mains") + c("others"))), F.lit(0))).first()[0]
        rows = rows.join(F.broadcast(own.select("token", "main", "mains", "others")), "token", "left")
        is_main = F.coalesce(c("comp") == c("main"), F.lit(False))
        mains, others = F.coalesce("mains", F.lit(0)), F.coalesce("others", F.lit(1))
        draw = F.xxhash64("node", F.lit(7))
        block = F.when(is_main, F.pmod(draw, mains)).otherwise(mains + F.pmod(draw, others)).cast("int")
        rows = rows.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.when(is_main, mains).otherwise(F.lit(0)), mains + others - 1)))
    else:
        rows = rows.withColumn("block", F.lit(0)).withColumn("with", F.lit(0))
    rows = rows.select("token", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "node", "comp", "n")
    part = F.pmod(F.xxhash64("token", "x", "y"), F.lit(n_rows // PART_ROWS + 1)).cast("int")
    return whole(rows.withColumn("part", part)).select("part", "token", "x", "y", "block", "node", "comp", "n", *MAP)


def _between(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of nodes of ``rows`` of ``_dealt`` that share a token, are in different components and pass the filters of
    sizes and maps; nearest: of each node only that with the one whose map is nearest.  A written table."""

    def compare(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(groups))
        col = {k: t[k].to_numpy() for k in t.column_names}
        o = np.lexsort((col["comp"], col["y"], col["x"], col["token"]))
        token, x, y, block, node, comp = (col[k][o] for k in ("token", "x", "y", "block", "node", "comp"))
        n = col["n"][o].astype(np.int64)
        maps = np.stack([col[k] for k in MAP], 1)[o].view(np.uint64)
        group = np.r_[True, (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        end, after = (np.append(np.flatnonzero(new)[1:], len(o))[np.cumsum(new) - 1] for new in (group, group | np.r_[True, comp[1:] != comp[:-1]]))
        best = np.full(len(o), np.inf), np.zeros(len(o), np.int64)
        held, n_held = [], 0
        # each row with those of later components of its two blocks, one after the other
        i, j = np.arange(len(o)), after
        while len(i):
            open_ = j < end[i]
            i, j = i[open_], j[open_]
            n1, n2 = n[i], n[j]
            ok = (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & ((x[i] == y[i]) | (block[i] != block[j]))
            a, b, both = i[ok], j[ok], (n1 + n2)[ok]
            far = np.bitwise_count(maps[a] ^ maps[b]).sum(1, dtype=np.int64)
            ok = far <= both - 2 * -(-percent * both // (100 + percent))
            a, b, far = a[ok], b[ok], far[ok] / both[ok]
            if nearest:
                for u, v in ((a, b), (b, a)):
                    # a row is there once as i, and as j once for each of them
                    u, v, f = (z[np.lexsort((far, u))] for z in (u, v, far))
                    first = np.r_[True, u[1:] != u[:-1]][: len(u)]
                    u, v, f = u[first], v[first], f[first]
                    less = f < best[0][u]
                    best[0][u[less]], best[1][u[less]] = f[less], node[v[less]]
            elif len(a):
                held.append(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], 1))
                n_held += len(a)
                if n_held >= HELD_PAIRS:
                    yield pairs_of(np.unique(np.concatenate(held), axis=0), np.zeros(0))
                    held, n_held = [], 0
            j = j + 1
        if nearest:
            some = np.flatnonzero(np.isfinite(best[0]))
            yield pairs_of(np.stack([node[some], best[1][some]], 1), best[0][some])
        elif held:
            yield pairs_of(np.unique(np.concatenate(held), axis=0), np.zeros(0))

    def pairs_of(pairs: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        far = far if len(far) else np.zeros(len(pairs))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(far)], ["a", "b", "far"])

    c = F.col
    found = rows.groupBy("part").applyInArrow(compare, "a bigint, b bigint, far double")
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best")).select(*ordered(c("a"), c("best.b")))
    return save(found.select("a", "b").distinct(), "link-pairs")


def linked_components(
    index: DataFrame, percent: int, light: list[str], near: Passes, passes: Passes, verify: Verify, rounds: int = ROUNDS, whole: Callable[[DataFrame], DataFrame] = lambda rows: rows, blocks: bool = False
) -> DataFrame | None:
    """(id, component) of the nodes that link with others, a written table, or None if none do.

    Nodes are compared with leads ``rounds`` times, then as long as tokens are crowded and leads still link: so what is left to be
    compared pair by pair grows with the index, not with the square of a group.  index: a written table with token, node, n
    (size of the set) and what ``passes`` needs, or ``whole`` adds to its rows; ``near`` is the part of it that needs the
    ``light`` columns alone and is asked of leads.  ``verify`` gives the pairs of a written table that link, as a
    written table.  blocks: ``passes`` is that of whole sets' sizes and maps, and pairs are compared by blocks.
    """
    links, comp, more, n = None, None, True, index.count()
    for k in range(MOST_ROUNDS + 1):
        cur = _with_components(index, comp)
        lead = _leads(cur, k, light)
        total, top, pairs = lead.agg(F.sum("c"), F.max("c"), F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2)).first()
        if not total:
            drop(lead)
            return comp
        # all pairs of open tokens are more than those between components: if they are few, these need not be counted
        last, crowd = k == MOST_ROUNDS or k > rounds and not more, 0.0
        if k >= rounds and (blocks or not last):
            crowd = pairs / n if pairs <= CROWD * n else _crowded(index, comp)
            last = last or crowd <= (CROWD_BLOCKS if blocks else CROWD)
        if last and blocks:
            rows = dealt = _dealt(cur, lead.select("token", "c"), total, top, whole)
            if crowd > CROWD:
                dealt = save(dealt, "link-dealt")
                links, comp, _ = _joined(_between(dealt, percent, True), verify, links, comp)
                rows = _with_components(dealt.drop("comp"), comp)
            found = _between(rows, percent, False)
            drop(dealt)
        elif last:
            found = _open(cur, lead.select("token", "c"), total, top, percent, passes, whole)
        else:
            found = _led(cur, lead, total, top, near, light)
        drop(lead)
        links, comp, more = _joined(found, verify, links, comp)
        if last:
            break
    return comp


def _joined(pairs: DataFrame, verify: Verify, links: DataFrame | None, comp: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None, bool]:
    """(links, components, did it find any) with those of the pairs that link."""
    if not pairs.limit(1).count():
        return links, comp, False
    new = verify(pairs)
    drop(pairs)
    if not new.limit(1).count():
        return links, comp, False
    links = new if links is None else links.union(new)
    return links, components(links, "link-cc"), True


def _crowded(index: DataFrame, comp: DataFrame | None) -> float:
    """How many pairs of nodes of different components tokens have for each row of the index.  Counted, not built."""
    c = F.col
    own = _with_components(index.select("token", "node"), comp).groupBy("token", "comp").agg(F.count("*").cast("double").alias("c"))
    by_token = own.groupBy("token").agg(F.sum("c").alias("n"), F.sum(c("c") * c("c")).alias("same"))
    n, pairs = by_token.agg(F.sum("n"), F.sum(c("n") * c("n") - c("same")) / 2).first()
    return pairs / n if n else 0.0
