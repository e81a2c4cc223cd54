"""The domain's tables as deterministic projections of the driver's star schema.

Each function gives a DataFrame; ``SQL`` has the same projection as a common table expression for the oracle.  All
arithmetic is on integers or explicit doubles, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, comp, season, day (days since 1970), status, home, away, hs, aws: one row for each order.  Nations are
    teams, regions competitions.  Both dimensions have bounded size (customers do not, so that join may shuffle)."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer, c("o_custkey") == c("c_custkey"))
        .join(F.broadcast(nation), c("c_nationkey") == c("n_nationkey"))  # 25 rows at every scale
        .select(
            c("o_orderkey").alias("event_id"),
            c("n_regionkey").cast("int").alias("comp"),
            F.year("o_orderdate").alias("season"),
            F.datediff(c("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"),
            F.when(c("o_orderstatus") == "F", "FINISHED").when(c("o_orderstatus") == "O", "SCHEDULED").otherwise("LIVE").alias("status"),
            c("c_nationkey").cast("int").alias("home"),
            ((c("c_nationkey") + 1 + c("o_orderkey") % 24) % 25).cast("int").alias("away"),
            (F.floor("o_totalprice") % 5).cast("int").alias("hs"),
            ((c("o_orderkey") * 7 + c("o_custkey")) % 4).cast("int").alias("aws"),
        )
    )


def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, side, shots, lines, passes: line items summed by event and side, odd lines HOME."""
    side = F.when(c("l_linenumber") % 2 == 1, "HOME").otherwise("AWAY").alias("side")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(c("l_orderkey").alias("event_id"), side)
        .agg(F.sum("l_quantity").alias("shots"), F.count("*").alias("lines"), F.sum("l_extendedprice").alias("passes"))
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, model, p0, p1, p2, outcome, day: a three-way forecast for each event of the stream."""
    e = table(spark, sf_dir, "events")
    a, b, d = 1 + c("event_id") % 7, 1 + F.floor(c("event_id") / 7) % 5, 1 + c("user_id") % 6
    total = (a + b + d).cast("double")
    return e.select(
        c("event_id").alias("id"),
        c("event_type").alias("model"),
        (a / total).alias("p0"),
        (b / total).alias("p1"),
        (d / total).alias("p2"),
        ((c("event_id") * 31 + c("user_id")) % 3).cast("int").alias("outcome"),
        F.datediff(c("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"),
        (c("user_id") % 5).cast("int").alias("comp"),
    )


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """season, month, team, total, position: nations ranked in each month by what was ordered."""
    from pyspark.sql import Window as W

    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sums = (
        orders.join(customer, c("o_custkey") == c("c_custkey"))
        .groupBy(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("month"), c("c_nationkey").cast("int").alias("team"))
        .agg(F.sum(F.round(c("o_totalprice") * 100).cast("long")).alias("total"))
    )
    w = W.partitionBy("season", "month").orderBy(F.desc("total"), "team")
    return sums.withColumn("position", F.row_number().over(w))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team, as_of (day), value, id: a time series of ranks."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, c("o_custkey") == c("c_custkey")).select(
        c("c_nationkey").cast("int").alias("team"),
        F.datediff(c("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("as_of"),
        (1 + c("o_custkey") % 500).cast("int").alias("value"),
        c("o_orderkey").alias("id"),
    )


def odds(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """event_id, book, outcome, price: three books' prices of three outcomes; on request only of some events (event_id), which
    then lie together, so sums by event need no shuffle of prices."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    if events is not None:
        # Spark does not take a semi join below an explode, and would shuffle nine prices of every order
        orders = orders.join(events.select(c("event_id").alias("o_orderkey")).hint("merge"), "o_orderkey", "left_semi")
    books = orders.select(c("o_orderkey").alias("event_id"), F.explode(F.array(*(F.lit(b) for b in (1, 2, 3)))).alias("book"))
    out = books.select("*", F.posexplode(F.array(*(F.lit(x) for x in ("HOME", "DRAW", "AWAY")))).alias("k", "outcome"))
    return out.select("event_id", "book", "outcome", (1.5 + ((c("event_id") + c("book") * (c("k") + 1)) % 17) / 10).cast("double").alias("price"))


SQL = {
    "matches": """matches AS (
        SELECT o_orderkey AS event_id, n_regionkey AS comp, CAST(year(o_orderdate) AS INT) AS season,
               CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day,
               CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'SCHEDULED' ELSE 'LIVE' END AS status,
               c_nationkey AS home, CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INT) AS away,
               CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS INT) AS hs, CAST((o_orderkey * 7 + o_custkey) % 4 AS INT) AS aws
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "match_stats": """match_stats AS (
        SELECT l_orderkey AS event_id, CASE WHEN l_linenumber % 2 = 1 THEN 'HOME' ELSE 'AWAY' END AS side,
               sum(l_quantity) AS shots, count(*) AS lines, sum(l_extendedprice) AS passes
        FROM lineitem GROUP BY ALL)""",
    "forecasts": """raw_forecasts AS (
        SELECT event_id AS id, event_type AS model, CAST(1 + event_id % 7 AS DOUBLE) AS a,
               CAST(1 + (event_id // 7) % 5 AS DOUBLE) AS b, CAST(1 + user_id % 6 AS DOUBLE) AS d,
               CAST((event_id * 31 + user_id) % 3 AS INT) AS outcome,
               CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS day, CAST(user_id % 5 AS INT) AS comp FROM events),
      forecasts AS (SELECT id, model, a / (a + b + d) AS p0, b / (a + b + d) AS p1, d / (a + b + d) AS p2, outcome, day, comp FROM raw_forecasts)""",
    "races": """race_sums AS (
        SELECT CAST(year(o_orderdate) AS INT) AS season, CAST(month(o_orderdate) AS INT) AS month, c_nationkey AS team,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
      races AS (SELECT *, CAST(row_number() OVER (PARTITION BY season, month ORDER BY total DESC, team) AS INT) AS position FROM race_sums)""",
    "ratings": """ratings AS (
        SELECT c_nationkey AS team, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS as_of,
               CAST(1 + o_custkey % 500 AS INT) AS value, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "odds": """odds AS (
        SELECT o_orderkey AS event_id, book, outcome,
               CAST(1.5 AS DOUBLE) + CAST((o_orderkey + book * k) % 17 AS DOUBLE) / 10 AS price
        FROM orders, (VALUES (1), (2), (3)) b(book), (VALUES (1, 'HOME'), (2, 'DRAW'), (3, 'AWAY')) k(k, outcome))""",
}


def with_sql(names: str, query: str) -> str:
    """A query over projections, by their names."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query


def rounded(x):
    """A double to six digits, half up, as the oracle rounds it."""
    return F.floor(x * 1e6 + 0.5) / 1e6


ROUND = "floor(({}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


def rsql(x: str) -> str:
    return ROUND.format(x)
