"""Hot keys: one key holding a third of all rows is split across tasks."""

import pytest
from pyspark.sql import functions as F

from rubric.operators import groups as G
from rubric.operators import skew as K


@pytest.fixture()
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _hot(spark, n=24000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("sample_id"),
        (F.col("id") % 6).cast("int").alias("gen_idx"), (F.col("id") % 7).cast("double").alias("reward"))


def test_hot_key_table_is_bounded(no_broadcast):
    spark = no_broadcast
    counts = K.key_counts(_hot(spark), "sample_id")
    hot = K.hot_keys(counts, "sample_id")
    rows = hot.collect()
    assert len(rows) <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [r.sample_id for r in rows] == [0] and rows[0]._buckets >= 8


def test_salted_join_spreads_hot_key_and_equals_plain_join(no_broadcast):
    spark = no_broadcast
    big = _hot(spark)
    small = big.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    salted = K.salted_join(big, small, "sample_id", counts=small)
    plain = big.join(small, "sample_id")
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
    per_task = (salted.where(F.col("sample_id") == 0).groupBy(F.spark_partition_id().alias("p"))
                .count().collect())
    assert len(per_task) >= 4
    assert max(r["count"] for r in per_task) < 0.5 * 8000


@pytest.mark.parametrize("how,salt", [("left", None), ("left_semi", None), ("left_anti", None), ("inner", ("sample_id", "gen_idx"))])
def test_salted_join_kinds(no_broadcast, how, salt):
    spark = no_broadcast
    big = _hot(spark, 3000)
    small = big.where(F.col("sample_id") % 2 == 0).select("sample_id").distinct().withColumn("x", F.lit(1))
    counts = K.key_counts(big, "sample_id")
    got = sorted(map(tuple, K.salted_join(big, small, "sample_id", counts, how=how, salt=K.content(*salt) if salt else None).collect()))
    want = sorted(map(tuple, big.join(small, "sample_id", how).collect()))
    assert got == want


def test_group_advantage_with_hot_group(no_broadcast):
    spark = no_broadcast
    df = _hot(spark)
    out = G.group_advantage(df)
    hot = out.where(F.col("sample_id") == 0).agg(F.sum("advantage").alias("s"), F.count(F.lit(1)).alias("n"))
    r = hot.collect()[0]
    assert r.n == 8000 and abs(r.s) < 1e-6
    assert "_salt" in out._jdf.queryExecution().executedPlan().toString()


def test_identical_copies_are_spread(no_broadcast):
    """A third of the rows are the very same row: position salting still
    splits them."""
    spark = no_broadcast
    base = spark.range(6000).select(F.col("id").alias("sample_id"), F.lit("x").alias("c"))
    copies = spark.range(3000).select(F.lit(7).cast("long").alias("sample_id"), F.lit("x").alias("c"))
    big = base.unionByName(copies).repartition(8)
    small = base.select("sample_id").withColumn("y", F.lit(1))
    j = K.salted_join(big, small, "sample_id", K.key_counts(big, "sample_id"))
    per_task = (j.where(F.col("sample_id") == 7).groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(r["count"] for r in per_task) == 3001
    assert len(per_task) >= 4


def test_null_keys_are_spread(no_broadcast):
    """A third of the keys are NULL: a left join keeps those rows, in many tasks."""
    spark = no_broadcast
    big = _hot(spark).withColumn("sample_id", F.when(F.col("sample_id") != 0, F.col("sample_id")))
    small = spark.range(100).select(F.col("id").alias("sample_id"), F.lit(1).alias("y"))
    for how in ("left", "left_anti"):
        j = K.salted_join(big, small, "sample_id", K.key_counts(big, "sample_id"), how=how)
        per_task = j.where("sample_id IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in per_task) == 8000
        assert len(per_task) >= 4 and max(r["count"] for r in per_task) < 0.5 * 8000


def test_joins_by_id_read_no_text(spark):
    from tables_at import SF_SMALL
    from rubric.plans import catalog

    for name in ("j1_with_image", "j1_missing_image", "j2_attach_gold", "j2_unmatched_completions"):
        plan = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" in plan and "text:string" not in plan, name
