from pyspark.sql import functions as F

from bizfit.operators import score


def test_scores_are_rounded_as_in_sql(spark):
    """58.449999999999996 * 10 is 584.5; it is a score of the company table at six times sf0.1."""
    rows = [(58.449999999999996, 58.5), (58.4, 58.4), (58.44, 58.4), (0.0, 0.0), (100.0, 100.0), (12.35, 12.4)]
    got = spark.createDataFrame(rows, "x double, want double").select(score.tenths(F.col("x")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
