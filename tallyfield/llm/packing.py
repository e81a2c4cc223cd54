"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

Documents become token ids and an end id.  Longer ones than a sequence are cut into full pieces, which are sequences by
themselves, and a rest.  The rests are dealt at random to groups of about ``GROUP`` pieces, each packed by one task:
best fit in falling order, then the local search, if the bound on the number of sequences is not met yet.  It takes the
emptiest sequence and, while it helps, exchanges one of its pieces for one or two smaller ones of a fuller sequence, two
for one, or moves a piece over.  Each step fills the fuller sequence further, so the sum of squared fills rises; the
search ends when the bound is met or a whole pass over the sequences finds no step.  Sequences are looked up by what can
be taken out of them, so a step costs the square of the sequence length at most, however many pieces there are.  A group
wastes less than one sequence beyond what its own bound allows, so the number of groups hardly counts.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.common import save

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs at a time, about.
GROUP = 50_000
#: Words of up to so many characters are remembered, twice so many of them at most.
SHORT, REMEMBERED = 48, 500_000
#: ASCII symbols but the apostrophe, which can begin a token of letters.
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Where it matters whether A-Z become small before or after composing marks, or for special tokens.
UNSAFE = re.compile("[\u0300-\u036f]|<\\|")
SPECIAL = "<|"


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    x = array("I", ids)
    if sys.byteorder != "little":
        x.byteswap()
    return x.tobytes()


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` file that lower-cases and whose pre-tokenizer parts words at white space and
    between letters and symbols; ids of words are remembered, up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the library's threads would only compete with other tasks
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        for whole, parts in (("one Two\nthree's  four", ("one", "two", "three's", "four")), ("end.) ét,", ("end", ".)", "ét", ","))):
            if self._ids([whole])[0] != b"".join(self._ids(parts)):
                raise ValueError("the tokenizer does not part words as expected")
        if self._plain("words") != self._ids(["words"])[0] or self._plain("x") != self._ids(["x"])[0]:
            raise ValueError("the tokenizer does not leave words of a-z as they are")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts) -> list[bytes]:
        return [_packed(e.ids) for e in self.tok.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _plain(self, word: str) -> bytes:
        """The ids of a word of a-z, which the normaliser and the pre-tokenizer leave as it is: the model's own."""
        return _packed([t.id for t in self.model.tokenize(word)])

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if SPECIAL not in text and (text.isascii() or not UNSAFE.search(text)):
            text = text.encode().lower().decode()  # A-Z only
        words = text.replace("\n", " ").split(" ")
        parts = list(map(self.known.get, words))
        if None in parts:
            new = self._learn(dict.fromkeys(w for w, p in zip(words, parts) if p is None))
            parts = [new[w] if p is None else p for w, p in zip(words, parts)]
        return b"".join(parts)

    def _learn(self, words) -> dict[str, bytes]:
        """The ids of words that aren't known.  Symbols behind a letter are tokens of their own, so a word's stem and
        its symbols are looked up one by one."""
        known, older, out, cut, fresh = self.known, self.older, {}, {}, {}
        for w in words:
            if w in older:
                out[w] = older[w]
                continue
            stem = w.rstrip(SYMBOLS)
            if stem and len(stem) < len(w) and stem[-1].lower()[-1].isalpha() and "<|" not in w:
                cut[w] = stem, w[len(stem) :]
                for x in cut[w]:
                    if x in out or x in known:
                        continue
                    if x in older:
                        out[x] = older[x]
                    else:
                        fresh[x] = None
            else:
                fresh[w] = None
        fresh = [x for x in fresh if x not in out]
        odd = []
        for x in fresh:
            if x.isascii() and x.isalpha() and x.islower():
                out[x] = self._plain(x)
            else:
                odd.append(x)
        if odd:
            out |= zip(odd, self._ids(odd))
        for w, (a, b) in cut.items():
            out[w] = (out.get(a) or known[a]) + (out.get(b) or known[b])
        if len(known) + len(out) > REMEMBERED:
            self.older, self.known = known, {}
        self.known.update({w: x for w, x in out.items() if len(w) <= SHORT})
        return out


@lru_cache(4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenise(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as an array."""
    src = df.select(df[id_col].alias("doc_id"), df[text].cast("string").alias("text"))
    schema = T.StructType(
        [src.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    )
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches):
        tok = word_tokenizer(tokenizer)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                raw = tok.ids(t or "") + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            cols = [pc.take(b.column(0), pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, schema.names)

    return src.mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, by best fit in falling order of size."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    left: list[int] = []  # sizes of room that some bin has, in order
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        k = bisect_left(left, s)
        if k < len(left):
            r = left[k]
            b = room[r].pop()
            if not room[r]:
                left.pop(k)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        r -= s
        if r:
            if not room[r]:
                insort(left, r)
            room[r].append(b)
    return bins


class _Receivers:
    """The bins that can take something, by what can be taken out of them: nothing or one piece (kind 0), or two (1).

    ``best[kind][r]`` is the most room of a bin from which pieces of r tokens in all can come.  Each r has a heap of bins,
    whose entries of older versions of a bin are skipped."""

    def __init__(self, capacity: int, n: int):
        self.heaps = [[[] for _ in range(capacity + 1)] for _ in range(2)]
        self.best = np.zeros((2, capacity + 1), np.int64)
        self.version = [0] * n

    @staticmethod
    def taken(by_size: dict[int, list[int]]) -> tuple[list[int], set[int]]:
        """(0 and the sizes of single pieces, sums of two pieces)."""
        sizes = list(by_size)
        two = {a + b for k, a in enumerate(sizes) for b in sizes[k + 1 :]} | {2 * a for a in sizes if len(by_size[a]) > 1}
        return [0, *sizes], two

    def put(self, b: int, by_size: dict[int, list[int]], room: int) -> None:
        """Bin b as it is now."""
        self.version[b] += 1
        for kind, rs in enumerate(self.taken(by_size)):
            for r in rs:
                heappush(self.heaps[kind][r], (-room, b, self.version[b]))
                if room > self.best[kind, r]:
                    self.best[kind, r] = room

    def out(self, b: int, by_size: dict[int, list[int]]) -> None:
        """Bin b, which still has what it was put in with, takes nothing any more."""
        self.version[b] += 1
        for kind, rs in enumerate(self.taken(by_size)):
            for r in rs:
                h = self.heaps[kind][r]
                while h and h[0][2] != self.version[h[0][1]]:
                    heappop(h)
                self.best[kind, r] = -h[0][0] if h else 0

    def step(self, by_size: dict[int, list[int]]) -> tuple[int, int, int, int, int, int] | None:
        """(gain, pieces that go, their tokens, pieces that come, their tokens, bin) of the largest gain, if there is one."""
        found = None
        single, two = self.taken(by_size)
        for go, sums, kinds in ((1, single[1:], (0, 1)), (2, sorted(two), (0,))):
            s = np.array(sums, np.int64)
            for kind in kinds:
                r = np.flatnonzero(self.best[kind])
                if go == 2:
                    r = r[r > 0]  # two for one; two that move are two moves
                if not len(s) or not len(r):
                    continue
                gain = s[:, None] - r
                gain[gain > self.best[kind][r]] = 0
                k = int(gain.argmax())
                g = int(gain.flat[k])
                if g > 0 and (found is None or g > found[0]):
                    i, j = divmod(k, len(r))
                    come = int(r[j])
                    found = (g, go, int(s[i]), (1 + kind) * (come > 0), come, self.heaps[kind][come][0][1])
        return found


def _take(by_size: dict[int, list[int]], n: int, total: int) -> list[int]:
    """n pieces (0, 1 or 2) of so many tokens in all, taken out of a bin."""
    if n == 0:
        return []
    if n == 1:
        pair = [total]
    else:
        a = next(a for a in by_size if total - a in by_size and (2 * a != total or len(by_size[a]) > 1))
        pair = [a, total - a]
    out = []
    for size in pair:
        out.append(by_size[size].pop())
        if not by_size[size]:
            del by_size[size]
    return out


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins after the search; never more of them."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    fewest = -(-sum(fill) // capacity)
    alive = len(bins)
    if alive <= fewest:
        return bins
    inside: list[dict[int, list[int]]] = []
    for b in bins:
        inside.append({})
        for i in b:
            inside[-1].setdefault(sizes[i], []).append(i)
    moved = True
    while moved and alive > fewest:
        moved = False
        open_ = _Receivers(capacity, len(bins))
        order = [(f, b) for b, f in enumerate(fill) if 0 < f < capacity]
        for f, b in order:
            open_.put(b, inside[b], capacity - f)
        heapify(order)
        while order and alive > fewest:
            f, victim = heappop(order)
            if f != fill[victim]:
                if fill[victim] < capacity:
                    heappush(order, (fill[victim], victim))
                continue
            mine = inside[victim]
            open_.out(victim, mine)  # in this pass it only gives
            while mine and (step := open_.step(mine)):
                gain, n, total, m, come, b = step
                open_.out(b, inside[b])
                go, back = _take(mine, n, total), _take(inside[b], m, come)
                for i in go:
                    inside[b].setdefault(sizes[i], []).append(i)
                for i in back:
                    mine.setdefault(sizes[i], []).append(i)
                fill[victim] -= gain
                fill[b] += gain
                moved = True
                if fill[b] < capacity:
                    open_.put(b, inside[b], capacity - fill[b])
            alive -= not mine
    return [[i for x in b.values() for i in x] for b in inside if b]


def pack(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each item, offset of each item there, number of bins)."""
    bins = local_search(best_fit(sizes, capacity), sizes, capacity) if sizes else []
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            where[i], offset[i] = k, at
            at += sizes[i]
    return where, offset, len(bins)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (a written table with a bigint ``length`` up to ``capacity``) with sequence_id and offset.

    Columns of those names are replaced, all others are carried along.  Equal rows are packed each.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset", "__group")]
    pieces = pieces.select(keep)
    rest = pieces.filter(F.col("length") < capacity)
    n = max(1, round(rest.count() / group))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(t: pa.Table) -> pa.Table:
        g = t.column("__group")[0].as_py()
        where, offset, _ = pack(t.column("length").to_pylist(), capacity)
        return t.select(keep).append_column("sequence_id", pa.array(((g << 32) + where) * 2)).append_column("offset", pa.array(offset))

    groups = rest.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    full = pieces.filter(F.col("length") >= capacity)
    return (
        full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1)
        .withColumn("offset", F.lit(0).cast("bigint"))
        .unionByName(groups.groupBy("__group").applyInArrow(run, schema))
    )


def packed(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    Null and empty texts are one piece, the end id.  A repeated row is packed again.  Empty table: no rows.
    """
    return pack_pieces(save(tokenise(df, tokenizer, id_col, text, capacity, with_ids), "pieces"), capacity)
