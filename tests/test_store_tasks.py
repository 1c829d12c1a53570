"""What one task of an upsert holds doesn't grow with the table."""

from pathlib import Path

from bizfit.operators import store

SCHEMA = "id string, name string, tags map<string,string>"


def test_no_task_takes_all_rows_or_a_whole_large_bucket(spark, tmp_path, monkeypatch):
    plans, cut = [], store.cut

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(store, "cut", noted)
    asked = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in asked.items():
        spark.conf.set(name, value)
    try:
        made = spark.range(20_000).selectExpr("'c' || id AS id", "sha2(CAST(id AS STRING), 256) AS name", "map('k', 'v') AS tags").coalesce(1)
        table = store.keyed_table(made, f"{tmp_path}/t", "id", buckets=2)
        assert plans[0].count("Exchange hashpartitioning") == 2  # dealt before the rows of a key are reduced within tasks
        assert all(len(list(b.glob("*.parquet"))) > 1 for b in Path(f"{tmp_path}/t").glob("data-*/_bucket=*"))
        table.upsert(made.filter("id LIKE '%7'").selectExpr("id", "'new' AS name", "tags"))
    finally:
        for name in asked:
            spark.conf.unset(name)
    got = table.read()
    assert got.count() == got.select("id").distinct().count() == 20_000
    assert got.filter("name = 'new'").count() == got.filter("id LIKE '%7'").count() == 2_000
