"""Fill-in-the-middle: texts cut at two drawn boundaries of their units and written as prefix, suffix and middle.

A unit grammar says which neighbouring characters belong to different units: a list of pairs of character classes (left,
right).  It becomes one zero-width regular expression that looks behind for the left class and ahead for the right one, so
Spark's ``split`` cuts there and no character is lost: the pieces joined are the text.  ``split`` gives the empty text as
one empty piece; here it has no units.

All of it is row-wise column arithmetic in one stage, without a shuffle and without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class of any character; a pair of classes is a boundary between two neighbours.
ANY = r"\x{0}-\x{10FFFF}"
#: Unit grammars by name: the pairs of neighbouring classes between which a unit ends.
GRAMMARS = {
    # one code point each
    "codepoint": [(ANY, ANY)],
    # a word with the white space behind it
    "word": [(r"\s", r"\S")],
    # a line with its line feed
    "line": [(r"\n", ANY)],
    # runs of letters, of digits and of white space; every other character is a unit
    "token": [(r"\p{L}", r"\P{L}"), (r"\P{L}", r"\p{L}"), (r"\p{N}", r"\P{N}"), (r"\P{N}", r"\p{N}"), (r"\s", r"\S"), (r"\S", r"\s"), (r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}]")],
}
SENTINELS = ("<P>", "<S>", "<M>")


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The zero-width regular expression of a grammar's boundaries.  Both sides hold whole code points, so no boundary lies
    within a character beyond the basic plane."""
    return "|".join(f"(?<=[{left}])(?=[{right}])" for left, right in grammar)


def units(text: Column, grammar: list[tuple[str, str]]) -> Column:
    """A text's units from left to right; the empty text has none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar)))


def draws(key: Column, n: int) -> list[Column]:
    """n numbers of 32 bits, the groups of eight digits of the key's SHA-256: equal in every run and for every partitioning."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def transform(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    grammar: str | list[tuple[str, str]] = "codepoint",
    seed: str = "1:",
    percent: int = 90,
    percent_spm: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One row for each document: its id, ``n`` (units), ``form`` (plain, psm or spm), ``prefix``, ``middle`` and ``suffix``
    (null if plain) and ``output``.

    Two draws by seed and id are boundaries between units; ``percent`` of the texts are transformed, ``percent_spm`` of these
    suffix first.  A text that holds a sentinel stays plain, since it could not be read back; so does the empty text.

    Null texts count as empty, a null id as the empty string.  Rows with equal ids get equal draws, repeated rows give
    repeated rows.  Texts are cut whole, however long.  An empty table gives no rows.  Other columns are ignored, whatever
    their names.
    """
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    p, s, m = (F.lit(x) for x in sentinels)
    base = docs.select(docs[id].alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    base = base.withColumn("u", units(F.col("t"), pairs)).withColumn("n", F.size("u").cast("bigint"))
    h1, h2, h3, h4 = draws(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 4)
    held = F.lit(False)
    for x in sentinels:
        held = held | F.col("t").contains(x)
    base = base.select(
        "id", "t", "u", "n",
        F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).cast("int").alias("i"),
        F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).cast("int").alias("j"),
        F.when((F.col("n") == 0) | held | (h3 % 100 >= percent), "plain").when(h4 % 100 < percent_spm, "spm").otherwise("psm").alias("form"),
    )
    cut = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("u", start, size), ""))
    base = base.select(
        "id", "t", "n", "form",
        cut(F.lit(1), F.col("i")).alias("prefix"),
        cut(F.col("i") + 1, F.col("j") - F.col("i")).alias("middle"),
        cut(F.col("j") + 1, F.col("n").cast("int") - F.col("j")).alias("suffix"),
    )
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t"))
    return base.select(F.col("id").alias(id), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from an output and its form alone.  The texts hold no sentinel, so the first of each kind is the one written."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, m, 1)
        return a, b, F.substr(rest, F.length(b) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The registered query's columns: lengths of the parts and digests of the output and of the text read back from it."""
    return transform(docs).select(
        "doc_id", "n", "form",
        F.length("prefix").cast("bigint").alias("prefix_chars"),
        F.length("middle").cast("bigint").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
      h AS (
        SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
               ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d FROM d),
      f AS (
        SELECT doc_id, t, n, least(a, b) AS i, greatest(a, b) AS j,
               CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM h),
      p AS (SELECT *, substring(t, 1, i) AS pre, substring(t, i + 1, j - i) AS mid, substring(t, j + 1, n - j) AS suf FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p
"""
