"""Chat formatting in budgeted windows: conversations as templated strings with a loss mask.

A turn is written as ``### role: text</turn>`` and a line feed.  Control strings inside texts are broken up by backslashes
(``#\\#``, ``<\\/turn>``, ``\\\\``), so the template's own marks occur nowhere else and a plain split reads them back.

Turns are dealt out by conversation and block of ``BLOCK`` turn numbers, so no task has all of a long conversation; a block
also gets, as context, the turns just before it and its conversation's system turn.  The rest happens within the block's
array: prefix sums of turn tokens choose spans of whole turns that fit in the budget, each span is one window, and a window
repeats the system turn and a limited history before its own turns.  The loss mask covers assistant texts of a window's own
turns only: repeated targets are masked, so each is learned from once.

All steps are DataFrame functions.  The texts are shuffled once, by conversation and block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: A window's tokens, and how many of them repeated turns other than the system turn may take.
BUDGET, HISTORY = 2048, 512
#: Turn numbers of a block, and how many turn numbers before a block may be history in it.
BLOCK, REACH = 256, 16
TARGET, SYSTEM = "assistant", "system"
#: Stands for a null turn, which comes first.
FIRST = -(2**63)


def escape(text: Column) -> Column:
    """The text without control strings: no three ``#`` in a row and no ``</turn>`` are left."""
    for plain, broken in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(broken))
    return text


def escape_role(role: Column) -> Column:
    """As ``escape``, and no colon is followed by a space."""
    return F.replace(escape(role), F.lit(":"), F.lit(":\\"))


def unescape(text: Column) -> Column:
    """Inverse of both: a backslash only says that the next character is meant."""
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def quarter_bytes(written: Column) -> Column:
    """An estimate of a turn's tokens: one for every four bytes of it as written."""
    return F.ceil(F.octet_length(written) / 4)


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(conv, block, t): each turn as written, its sizes and its place."""
    out = rows.select(
        rows[conv].cast("bigint").alias("conv"),
        F.coalesce(rows[turn].cast("bigint"), F.lit(FIRST)).alias("turn"),
        F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"),
    )
    out = out.withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(COLON))).withColumn("body", escape(F.col("text")))
    out = out.withColumn("written", F.concat("head", "body", F.lit(CLOSE)))
    t = F.struct(
        "turn", "role", "written", F.length("head").alias("head"), F.length("body").alias("body"),
        tokens(F.col("written")).cast("bigint").alias("tokens"), F.lit(False).alias("context"),
    )
    return out.select("conv", F.floor(F.col("turn") / BLOCK).alias("block"), t.alias("t"))


def _with_context(turns: DataFrame) -> DataFrame:
    """The turns and, marked as context, for each block the last turns of the block before and the system turn.  Blocks of
    context alone are dropped later."""
    marked = F.col("t").withField("context", F.lit(True)).alias("t")
    start = F.col("block") * BLOCK
    near = turns.filter(F.col("t.turn") >= start + (BLOCK - REACH)).select("conv", (F.col("block") + 1).alias("block"), marked)
    blocks = turns.select("conv", "block").distinct()
    system = turns.filter(F.col("t.role") == SYSTEM).groupBy(F.col("conv").alias("c")).agg(F.min("t").alias("t"))
    far = blocks.join(system, F.col("conv").eqNullSafe(F.col("c"))).filter(F.col("t.turn") < start - REACH).select("conv", "block", marked)
    return turns.unionByName(near).unionByName(far)


def windows(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens: Callable[[Column], Column] = quarter_bytes,
) -> DataFrame:
    """A row for each window: the conversation's id, ``block`` and ``window`` (its place, in that order), ``text`` as formatted,
    ``n_repeated`` (turns repeated at its start), ``loss`` (array of structs start, end: code points of ``text`` under the
    mask), ``tokens`` and ``over`` (a single turn with what it repeats is larger than the budget; turns are never cut).

    The system turn is the first turn of the conversation with role system; windows after it begin with it.  History is the
    longest run of whole turns of at most ``history`` tokens before a window, within ``REACH`` turn numbers of the block.

    Null texts and roles count as empty, null turns come first, null ids are one conversation.  Turns with equal numbers are
    ordered by role and text, and repeated rows are turns of their own.  An empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    blocks = _with_context(_turns(rows, conv, turn, role, text, tokens)).groupBy("conv", "block").agg(F.array_sort(F.collect_list("t")).alias("t"))
    at = lambda a, i: F.get(F.col(a), i)
    n = F.size("t")
    blocks = blocks.withColumn("own", F.size(F.filter("t", lambda t: t["context"]))).filter(F.col("own") < n)
    sums = F.aggregate("t", F.array(F.lit(0).cast("bigint")), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["tokens"])))
    system = F.array_position(F.transform("t", lambda t: t["role"]), SYSTEM).cast("int") - 1
    blocks = blocks.select("conv", "block", "t", "own", sums.alias("sums"), system.alias("system"))
    # the first turn that a window starting at i repeats, and the prefix sum at which that window is full
    first = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.element_at(F.filter(F.sequence(F.lit(0), i), lambda j: at("sums", i) - at("sums", j) <= history), 1),
    )
    blocks = blocks.select("*", first.alias("first"))
    apart = lambda i: (F.col("system") >= 0) & (F.col("system") < at("first", i))
    full = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: budget + at("sums", at("first", i)) - F.when(apart(i), at("t", F.col("system"))["tokens"]).otherwise(F.lit(0)),
    )
    blocks = blocks.select("*", full.alias("full"))
    starts = F.aggregate(
        F.sequence(F.col("own"), n - 1),
        F.array(F.col("own")),
        lambda a, i: F.when((i > F.element_at(a, -1)) & (at("sums", i + 1) > at("full", F.element_at(a, -1))), F.concat(a, F.array(i))).otherwise(a),
    )
    blocks = blocks.select("*", starts.alias("starts"))
    spans = F.transform("starts", lambda s, k: F.struct(k.alias("window"), s.alias("s"), F.coalesce(at("starts", k + 1), n).alias("e")))
    spans = blocks.select("conv", "block", "t", "system", "first", F.inline(spans).alias("window", "s", "e"))
    repeated = F.when(apart(F.col("s")), F.slice("t", F.col("system") + 1, 1)).otherwise(F.slice("t", 1, 0))
    repeated = F.concat(repeated, F.slice("t", at("first", F.col("s")) + 1, F.col("s") - at("first", F.col("s"))))
    spans = spans.select("conv", "block", "window", repeated.alias("r"), F.slice("t", F.col("s") + 1, F.col("e") - F.col("s")).alias("own"))
    spans = spans.select("conv", "block", "window", F.concat("r", "own").alias("t"), F.size("r").alias("n_repeated"), F.size("own").alias("n_own"))
    places = F.aggregate("t", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["head"] + t["body"] + len(CLOSE))))
    spans = spans.withColumn("places", places)
    mask = F.transform("t", lambda t, k: F.struct((at("places", k) + t["head"]).alias("start"), (at("places", k) + t["head"] + t["body"]).alias("end"), ((k >= F.col("n_repeated")) & (t["role"] == TARGET)).alias("on")))
    loss = F.transform(F.filter(mask, lambda m: m["on"]), lambda m: F.struct(m["start"], m["end"]))
    total = F.aggregate("t", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"])
    return spans.select(
        F.col("conv").alias(conv), "block", "window", F.array_join(F.transform("t", lambda t: t["written"]), "").alias("text"),
        "n_repeated", loss.alias("loss"), total.alias("tokens"), (total > budget).alias("over"),
    )


def turns_of(text: Column) -> Column:
    """The turns (role, text) that a formatted window holds."""
    pieces = F.filter(F.split(text, CLOSE), lambda p: p != "")

    def parse(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), COLON, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, F.length(role) + len(OPEN) + len(COLON) + 1)).alias("text"))

    return F.transform(pieces, parse)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row for each conversation, from its windows' texts and masks alone: turns and loss texts, each once and in order, as
    digests with their sizes.

    A digest needs a conversation's text in one row, in pieces of a block each; the rest is a row for each window."""
    turns = F.slice(turns_of(F.col("text")), F.col("n_repeated") + 1, F.greatest(F.size(turns_of(F.col("text"))) - F.col("n_repeated"), F.lit(0)))
    rows = formatted.select(F.col(conv).alias("conv"), "block", "window", turns.alias("t"), "loss", "text")
    line = F.lit("\n")
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    lost = F.array_join(F.transform("loss", lambda m: unescape(F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"]))), "")
    rows = rows.select("conv", "block", F.struct("window", said.alias("said"), lost.alias("lost")).alias("w"), F.size("t").alias("n"), F.length("text").alias("chars"))
    joined = lambda a, f: F.array_join(F.transform(a, lambda w: w[f]), "")
    rows = rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    rows = rows.select("conv", F.struct("block", joined("w", "said").alias("said"), joined("w", "lost").alias("lost")).alias("b"), "n", "chars")
    rows = rows.groupBy("conv").agg(F.array_sort(F.collect_list("b")).alias("b"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    return rows.select(
        F.col("conv").alias(conv), F.col("n").alias("n_turns"), F.sha2(joined("b", "said"), 256).alias("turns_sha256"),
        F.length(joined("b", "lost")).cast("bigint").alias("loss_chars"), F.sha2(joined("b", "lost"), 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, which says the template's control strings."""
    return spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )


def digests(rows: DataFrame) -> DataFrame:
    """The registered query: all conversations and the planted one, formatted and read back."""
    return read_back(windows(rows.select("conv_id", "turn", "role", "text").unionByName(planted(rows.sparkSession))))


SQL = f"""
    WITH RECURSIVE c AS (
        SELECT conv_id, coalesce(turn, {FIRST}) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
      e AS (
        SELECT *, '### ' || replace(replace(replace(replace(role, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>'), ':', ':\\') || ': '
               || replace(replace(replace(text, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>') || '</turn>' || chr(10) AS written,
               CAST(floor(turn / {BLOCK}) AS BIGINT) AS block FROM c),
      t AS (SELECT *, ceil(strlen(written) / 4)::BIGINT AS tokens, length(written) AS chars FROM e),
      sys AS (SELECT conv_id AS id, turn, role, written, tokens, chars FROM t WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, written) = 1),
      b AS (
        SELECT conv_id, block, turn, role, written, tokens, chars, false AS context FROM t
        UNION ALL SELECT conv_id, block + 1, turn, role, written, tokens, chars, true FROM t WHERE turn >= (block + 1) * {BLOCK} - {REACH}
        UNION ALL SELECT d.conv_id, d.block, s.turn, s.role, s.written, s.tokens, s.chars, true
          FROM (SELECT DISTINCT conv_id, block FROM t) d JOIN sys s ON d.conv_id IS NOT DISTINCT FROM s.id AND s.turn < d.block * {BLOCK} - {REACH}),
      p AS (
        SELECT conv_id, block, context, role, tokens, chars, row_number() OVER w AS i, (sum(tokens) OVER w - tokens)::BIGINT AS before, (sum(chars) OVER w - chars)::BIGINT AS chars_before
        FROM b WINDOW w AS (PARTITION BY conv_id, block ORDER BY turn, role, written ROWS UNBOUNDED PRECEDING)),
      s AS (SELECT conv_id AS id, block AS k, min(i) AS system, min_by(tokens, i) AS system_tokens, min_by(chars, i) AS system_chars FROM p WHERE role = 'system' GROUP BY ALL),
      h AS (
        SELECT p.conv_id, p.block, p.i, any_value(p.before + p.tokens) AS upto, any_value(p.chars) AS chars, any_value(p.before) AS before, any_value(p.chars_before) AS chars_before,
               min(q.i) AS first, min(q.before) AS first_before, min(q.chars_before) AS first_chars
        FROM p JOIN p q ON p.conv_id IS NOT DISTINCT FROM q.conv_id AND p.block = q.block AND q.i <= p.i AND p.before - q.before <= {HISTORY}
        WHERE NOT p.context GROUP BY p.conv_id, p.block, p.i),
      l AS (
        SELECT h.conv_id, h.block, i, upto, chars, row_number() OVER (PARTITION BY h.conv_id, h.block ORDER BY i) AS r,
               {BUDGET} + first_before - CASE WHEN system < first THEN system_tokens ELSE 0 END AS upmost,
               chars_before - first_chars + CASE WHEN system < first THEN system_chars ELSE 0 END AS again
        FROM h LEFT JOIN s ON h.conv_id IS NOT DISTINCT FROM s.id AND h.block = s.k),
      walk AS (
        SELECT conv_id, block, r, upmost, again, chars FROM l WHERE r = 1
        UNION ALL
        SELECT l.conv_id, l.block, l.r, CASE WHEN l.upto > w.upmost THEN l.upmost ELSE w.upmost END, CASE WHEN l.upto > w.upmost THEN l.again ELSE 0 END, l.chars
        FROM walk w JOIN l ON w.conv_id IS NOT DISTINCT FROM l.conv_id AND w.block = l.block AND l.r = w.r + 1),
      f AS (SELECT conv_id, sum(chars + again)::BIGINT AS formatted_chars FROM walk GROUP BY conv_id),
      d AS (
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, written)) AS turns_sha256,
               coalesce(string_agg(text, '' ORDER BY turn, role, written) FILTER (role = 'assistant'), '') AS loss
        FROM t GROUP BY conv_id)
    SELECT d.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
    FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""
