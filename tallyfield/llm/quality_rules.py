"""Quality rules by weak supervision.

Each rule looks at a document's figures and votes good (+1), junk (-1) or abstains (0).  No rule is trusted as it
stands: expectation-maximisation over the patterns of votes estimates each rule's accuracies and the share of good
documents, and a document's posterior probability of being good replaces "all rules must pass".  Rules that mark
different traits of the same junk bear each other out, and a rule that calls documents junk which no other does
turns out to be wrong about them.

Votes of R rules make at most 3**R patterns, so the counts that EM needs are at most that many rows for any input;
only these reach the driver, and the posterior of each pattern goes back as a broadcast of the same bound.  Documents
that fail the base rules are junk whatever the verdict, so only the others are learned from: the kinds of junk that the
base rules take would otherwise be all that the model knows of.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.common import save
from tallyfield.llm.words import release, slices

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
ADDED = ("base_failed", "kept", "posterior", "__votes", "__text")
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_ends", "n_distinct", "n_twice"]


def figures(text: str | None) -> tuple[int, ...]:
    """The figures of one text, in the order of FIGURES; null counts as empty.  Words are runs of bytes other than
    space and \\t to \\r.  n_upper, n_letters: upper-case and all cased or other letters; n_ends: words ending in
    ``.``, ``!`` or ``?``; n_distinct: distinct words; n_twice: words equal to the one before."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0, 0)
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if n > 2:
        tri = list(zip(words, words[1:], words[2:]))
        count = Counter(tri)
        if len(count) < n - 2:
            hit = np.fromiter((count[t] > 1 for t in tri), bool, n - 2)
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= hit
            repeat = int(cover.sum())
    lower = text.lower()
    return (
        n,
        len(text) - blanks,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        sum(map(str.__ne__, text, lower)) if len(lower) == len(text) else sum(map(str.isupper, text)),
        len(text) - blanks - (len(raw) - len(raw.translate(None, b"0123456789.,;:!?'\"()-_/\\[]{}=+@^`~" + SYMBOLS))),
        raw.count(b". ") + raw.count(b".\n") + raw.count(b"! ") + raw.count(b"? ") + (raw.rstrip()[-1:] in b".!?"),
        len(set(words)),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def add_figures(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (default: all but those named like figures) and the figures of its texts."""
    keep = [c for c in df.columns if c not in FIGURES] if keep is None else keep
    src = df.select(*keep, df[text].cast("string").alias("__text"))

    def run(batches):
        for b in slices(batches):
            cols = list(zip(*map(figures, b.column(len(keep)).to_pylist()))) or [[]] * len(FIGURES)
            yield pa.RecordBatch.from_arrays(b.columns[: len(keep)] + [pa.array(c, pa.int64()) for c in cols], keep + FIGURES)
        release()

    schema = src.select(*keep).schema
    for f in FIGURES:
        schema = schema.add(f, T.LongType())
    return src.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column]]:
    """name: (when it votes junk, when it votes good); neither: it abstains.

    Limits are set so that each rule calls between one in a hundred and one in five documents junk, whether it is right or
    not: how often it is, is for the votes of all rules to tell."""
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    length, upper = share("word_chars", "n_words"), share("n_upper", "n_letters")
    return {
        "symbols": (share("n_symbols", "word_chars") > 0.03, share("n_symbols", "word_chars") < 0.005),
        "letters": (share("n_letters", "word_chars") < 0.92, share("n_letters", "word_chars") > 0.95),
        "word_length": (~length.between(4.4, 6.5), length.between(4.55, 6.0)),
        "sentences": (share("n_ends", "n_words") < 0.035, share("n_ends", "n_words").between(0.05, 0.3)),
        "variety": (share("n_distinct", "n_words") < 0.6, share("n_distinct", "n_words") > 0.68),
        "repeats": (share("n_repeat_words", "n_words") > 0.07, share("n_repeat_words", "n_words") < 0.03),
        "lines": (share("n_dup_lines", "n_words") > 0.005, c("n_dup_lines") == 0),
        "stutter": (share("n_twice", "n_words") > 0.02, share("n_twice", "n_words") < 0.012),
        "upper": (~upper.between(0.009, 0.03), upper.between(0.011, 0.026)),
    }


def vote_pattern() -> Column:
    """The votes as digits of base 3: 0 junk, 1 none, 2 good; the first rule is the lowest digit."""
    code = F.lit(0)
    for i, (junk, good) in enumerate(rules().values()):
        code = code + F.when(junk, 0).when(good, 2).otherwise(1) * 3**i
    return code.cast("int")


@dataclass
class Model:
    """good, junk: the chance that each rule's vote is right on a good and on a junk document; prior: the share of good
    ones.  An abstention tells nothing."""

    good: np.ndarray
    junk: np.ndarray
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that documents with these votes are good."""
        up, down = votes_of(patterns, len(self.good))
        z = np.log(self.prior / (1 - self.prior)) + up @ np.log(self.good / (1 - self.junk)) + down @ np.log((1 - self.good) / self.junk)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def votes_of(patterns: np.ndarray, n_rules: int) -> tuple[np.ndarray, np.ndarray]:
    """(votes for good, votes for junk) of patterns, as of ``vote_pattern``."""
    votes = np.asarray(patterns, np.int64)[:, None] // 3 ** np.arange(n_rules) % 3
    return votes == 2, votes == 0


def fit(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 500) -> Model:
    """The model of vote patterns, of which there are so many documents each, by EM.

    It starts from all-must-pass, which also says which class is the good one: a document with a vote for junk is junk with
    a chance of 0.9, any other good.  Each rule has an accuracy for either class, since a rule that knows one kind of junk
    says "good" of all other kinds.  Both are estimated freely; a prior of one document keeps them off 0 and 1, and a
    vote for junk never speaks for good.  Without documents all rules are worth the same.
    """
    up, down = votes_of(patterns, n_rules)
    w = np.asarray(counts, float)
    post = np.where(down.any(1), 0.1, 0.9)
    model = Model(np.full(n_rules, 0.9), np.full(n_rules, 0.5), 0.9)
    for _ in range(rounds):
        g, j = w * post, w * (1 - post)
        good = (g @ up + 0.9) / (g @ (up | down) + 1)
        junk = np.maximum((j @ down + 0.5) / (j @ (up | down) + 1), 1 - good)
        model = Model(good, junk, float((g.sum() + 0.9) / (w.sum() + 1)))
        last, post = post, model.posterior(patterns)
        if not len(post) or np.abs(post - last).max() < 1e-9:
            break
    return model


def _codes(votes: DataFrame) -> DataFrame:
    """(__votes, posterior) of the patterns of ``votes(__votes, __failed)``; the base rules' failures teach nothing."""
    seen = votes.groupBy("__votes").agg(F.count_if(~F.col("__failed")).alias("n")).toPandas()  # at most 3 ** rules rows
    patterns = seen["__votes"].to_numpy(np.int64)
    post = fit(patterns, seen["n"].to_numpy(), len(rules())).posterior(patterns)
    return votes.sparkSession.createDataFrame(list(zip(patterns.tolist(), post.tolist())), "__votes int, posterior double")


def judged(df: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``keep`` columns (default: all but those named like what is added), the figures, posterior, base_failed and kept, for
    each row of ``df``.

    kept is false if base_failed, else posterior >= threshold.  Null and empty texts have no words, so they fail.
    Repeated rows are judged each.  Empty table: no rows.
    """
    keep = [c for c in df.columns if c not in (*FIGURES, *ADDED)] if keep is None else keep
    rows = add_figures(df, text, keep).withColumn("base_failed", base_failed()).withColumn("__votes", vote_pattern())
    rows = save(rows, "rules")
    codes = _codes(rows.select("__votes", F.col("base_failed").alias("__failed")))
    out = rows.join(F.broadcast(codes), "__votes").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    return out.select(*keep, *FIGURES, "posterior", "base_failed", "kept")


def keep_good(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that ``judged`` keeps, all columns as they are, whatever they are called.

    Null and empty texts go.  Repeated rows are judged each and alike.  Empty table: no rows.  The texts are read twice,
    once for the counts of vote patterns and once to judge, so no copy of them is written.
    """
    votes = add_figures(df, text, []).select(vote_pattern().alias("__votes"), base_failed().alias("__failed"))
    codes = _codes(votes)
    src = df.select(F.struct(*df.columns).alias("__row"))  # one column, whatever the others are called
    at = df.columns.index(text)

    def run(batches):
        for b in slices(batches):
            texts = b.column(0).flatten()[at].cast(pa.string()).to_pylist()
            cols = list(zip(*map(figures, texts))) or [[]] * len(FIGURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["__row", *FIGURES])
        release()

    rows = src.mapInArrow(run, T.StructType([*src.schema.fields, *(T.StructField(f, T.LongType()) for f in FIGURES)]))
    rows = rows.filter(~base_failed()).withColumn("__votes", vote_pattern()).join(F.broadcast(codes), "__votes")
    return rows.filter(F.col("posterior") >= threshold).select("__row.*")
