"""Audit of how filters interact: what each of them removes in every order in which they can be applied.

One filter marks repeated texts.  Its work is a fingerprint-routed RDD: each text goes to the partition of its xxhash, which
keeps a chain of whole texts for every fingerprint, each with the smallest id seen, and emits the ids that are not smallest.
Before texts are routed, each task runs the same chains over its own rows, so that a group of copies sends one row a task,
however many rows it has; a task holds at most ``HELD`` bytes of text at a time there.  What leaves the chains are short rows
(id, part, mask of failed filters), which are joined with the labels; ``combineByKey`` adds them up in a vector of counts
by mask for each part, and all orders are read off that vector.

Every step can be done again with equal results when an executor is lost: no task keeps anything outside its rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Bytes of text that a task holds before it passes on what it has, and that a partition of the routed texts gets.
HELD = ROUTED = 32 << 20
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


class Text:
    """A text and what the filters ask of it; words are maximal runs without ASCII white space."""

    def __init__(self, text: str):
        self.text, self.raw = text, text.encode()
        self.words = self.raw.split()

    def count(self, characters: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, characters))


#: Failure conditions by letter.  E, the filter of repeated texts, is no condition on one text; it stands last.
FILTERS: dict[str, Callable[[Text], bool]] = {
    "A": lambda t: len(t.words) < 100,
    "B": lambda t: 100 * len(set(t.words)) < 80 * len(t.words),
    "C": lambda t: 100 * t.count(UPPER) > 10 * len(t.text),
    "D": lambda t: t.count(SIGNS) > 0,
}
REPEATED = "E"


class Chains:
    """By fingerprint, a chain of entries [text, mask, smallest id, {part: rows with that id}]."""

    def __init__(self, repeated: int):
        self.repeated, self.held, self.chains = repeated, 0, defaultdict(list)

    def find(self, key: int, text: str) -> list | None:
        """The entry of this text: fingerprints may collide, whole texts decide."""
        return next((e for e in self.chains[key] if e[0] == text), None)

    def add(self, key: int, text: str, mask: int, id: int, parts: dict[str, int]) -> Iterator[tuple]:
        """Take in rows of a text; gives the rows (id, part, mask, n) that are now known not to have the smallest id."""
        entry = self.find(key, text)
        if entry is None:
            self.chains[key].append([text, mask, id, dict(parts)])
            self.held += len(text) + 200
        elif id == entry[2]:
            for p, n in parts.items():
                entry[3][p] = entry[3].get(p, 0) + n
        else:
            late, rows = (entry[2], entry[3]) if id < entry[2] else (id, parts)
            for p, n in rows.items():
                yield late, p, mask | self.repeated, n
            if id < entry[2]:
                entry[2], entry[3] = id, dict(parts)

    def entries(self) -> Iterator[tuple[int, list]]:
        for key, chain in self.chains.items():
            for e in chain:
                yield key, e


def _settled(id: int | None, part: str, mask: int, n: int) -> tuple:
    """A row that needs no routing goes anywhere, by its id."""
    return xxhash.xxh64_intdigest(str(id)), (None, mask, id, {part: n})


def _gather(filters: dict[str, Callable[[Text], bool]], held: int) -> Callable:
    """Masks of a task's rows, and its own chains of them: (fingerprint, (text, mask, id, parts)) for each text, and rows
    without a text for what is settled."""
    repeated = 1 << len(filters)

    def run(rows: Iterator[Row]) -> Iterator[tuple]:
        chains = Chains(repeated)
        for id, text, part in rows:
            t = Text(text)
            key = xxhash.xxh64_intdigest(t.raw)
            seen = chains.find(key, text)
            mask = seen[1] if seen else sum(bool(f(t)) << i for i, f in enumerate(filters.values()))
            if id is None:
                yield _settled(None, part, mask, 1)
                continue
            for row in chains.add(key, text, mask, id, {part: 1}):
                yield _settled(*row)
            if chains.held > held:
                yield from ((k, tuple(e)) for k, e in chains.entries())
                chains = Chains(repeated)
        yield from ((k, tuple(e)) for k, e in chains.entries())

    return run


def _settle(repeated: int) -> Callable:
    """All rows of a partition's fingerprints: (id, part, mask, n), with the bit of repeated texts where it is due."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        chains = Chains(repeated)
        for key, (text, mask, id, parts) in rows:
            if text is None:
                yield from ((id, p, mask, n) for p, n in parts.items())
            else:
                yield from chains.add(key, text, mask, id, parts)
        for _, (_, mask, id, parts) in chains.entries():
            yield from ((id, p, mask, n) for p, n in parts.items())

    return run


def _own(key: int) -> int:
    return key


def masks(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang", filters: dict = FILTERS, held: int = HELD) -> DataFrame:
    """(id, part, mask, n): so many rows with this id and part fail the filters in mask, bit i for filter i, the last bit for
    a text that a smaller id has too.  The texts' bytes are summed first, so that the routed partitions are of one size
    however large the table is."""
    size = docs.agg(F.sum(F.octet_length(docs[text].cast("string")))).first()[0] or 0
    rows = docs.select(docs[id].cast("bigint"), F.coalesce(docs[text].cast("string"), F.lit("")), F.coalesce(docs[part].cast("string"), F.lit(""))).rdd
    routed = rows.mapPartitions(_gather(filters, held)).partitionBy(max(-(-size // ROUTED), rows.ctx.defaultParallelism), _own)
    return docs.sparkSession.createDataFrame(routed.mapPartitions(_settle(1 << len(filters))), "id bigint, part string, mask int, n bigint", verifySchema=False)


def _vector(size: int) -> tuple[Callable, Callable, Callable]:
    """createCombiner, mergeValue and mergeCombiners of counts by mask: rows, good ones, toxic ones."""

    def put(v: np.ndarray, x: tuple) -> np.ndarray:
        mask, n, good, toxic = x
        v[:, mask] += (n, n * good, n * toxic)
        return v

    return lambda x: put(np.zeros((3, size), np.int64), x), put, lambda a, b: a + b


def _orders(letters: str) -> Callable:
    """A part's rows for every order and step, from its counts by mask."""
    bit = {x: 1 << i for i, x in enumerate(letters)}

    def run(item: tuple[str, np.ndarray]) -> Iterator[tuple]:
        part, (n, good, toxic) = item
        m = np.arange(len(n))
        out, total = [], dict.fromkeys(letters, 0)
        for order in permutations(letters):
            before = 0
            for step, x in enumerate(order, 1):
                fails, open_ = (m & bit[x]) > 0, (m & before) == 0
                here = fails & open_
                removed = int(n[here].sum())
                total[x] += removed
                out.append([part, "".join(order), step, int(n[open_ & ~fails].sum()), removed, int(n[fails & ~open_].sum()), int(n[bit[x]]), int(good[here].sum()), int(toxic[here].sum()), x])
                before |= bit[x]
        yield from ((*row[:-1], total[row[-1]]) for row in out)

    return run


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang", filters: dict = FILTERS, held: int = HELD) -> DataFrame:
    """For each part, each order of the filters and each step: the columns of ``SCHEMA``, zeros included.

    Null texts count as empty, null parts as the empty string.  A null id is neither smaller nor larger than another: its row
    neither makes a text repeated nor is repeated itself, and has no label.  Of rows with equal ids none has the smaller id,
    so none of them is repeated for the other's sake; repeated rows count each time.  A document with several labels
    is good or toxic if one of them says so.  An empty table has no parts and gives no rows.  Other columns are ignored,
    whatever their names.
    """
    letters = "".join(filters) + REPEATED
    rows = masks(docs, id, text, part, filters, held)
    marks = labels.groupBy(labels[id].cast("bigint").alias("id")).agg(*(F.max(F.coalesce((labels[c] == 1).cast("int"), F.lit(0))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    marked = rows.join(marks, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    counts = marked.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(*_vector(1 << len(letters)))
    return docs.sparkSession.createDataFrame(counts.flatMap(_orders(letters)), SCHEMA, verifySchema=False)


SQL = """
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
      f AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
               (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
               + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
               + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask
        FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
      c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
      x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
      o AS (
        SELECT x1.x || x2.x || x3.x || x4.x || x5.x AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bits
        FROM x x1, x x2, x x3, x x4, x x5 WHERE x1.b + x2.b + x3.b + x4.b + x5.b = 31 AND x1.b | x2.b | x3.b | x4.b | x5.b = 31),
      s AS (
        SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
        FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
      r AS (
        SELECT part, filter_order, step, b,
               coalesce(sum(n) FILTER (mask & (before | b) = 0), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (mask & b > 0 AND mask & before = 0), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (mask & b > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (mask & b > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
               coalesce(sum(toxic) FILTER (mask & b > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
        FROM c, s GROUP BY part, filter_order, step, b)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           sum(removed) OVER (PARTITION BY part, b)::BIGINT AS shapley
    FROM r
"""
