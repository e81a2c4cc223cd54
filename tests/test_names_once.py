"""Each step of a name's usual form is taken once."""

from pyspark.sql import functions as F

from tallyfield.functions import scalars as f

c = F.col


def test_a_name_is_normalised_in_one_go(spark):
    names = [("FC Bàyern München",), ("The Club",), ("  ",), (None,), ("Man City",), ("A & B's",)]
    x = spark.createDataFrame(names, "n string").select(f.normalise_name(c("n")).alias("x"))
    assert [r.x for r in x.collect()] == ["bayern munich", "the club", "", None, "manchester city", "a and b's"]
    assert x._jdf.queryExecution().analyzed().toString().count("[^a-z0-9']+") == 1
