from pyspark.sql import functions as F

from bizfit.operators import match


def test_unfolding_block_keys_makes_none_again(spark):
    """A filter of the keys, which unfolding brings along, would be moved below the deal and make them in the task that reads."""
    contact = "contacts array<struct<email:string,phone:string>>"
    schema = f"pos long, name string, website string, domain string, city string, postcode string, latitude double, longitude double, {contact}"
    rows = [(k, f"Blue {k} Inc", f"https://www.a{k % 3}.com", None, "Rome", "90001", None, None, [("x@b.com", "(614) 555-1000")]) for k in range(9)]
    got = match.blocked(spark.createDataFrame(rows, schema)).select("pos", F.explode("block_keys").alias("block"))
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["block"] for r in got.filter("pos = 4").collect()} == {"d:a1.com", "n:blue:90001", "n:blue:rome", "e:b.com", "p:6145551000"}
