import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starcheck.operators.evaluate import stratified_split
from starcheck.operators.positions import first_rows, leaf_bits, leaf_offsets, sample_per_group, with_position
from starcheck.operators.skew import lookup_join


def keys(spark):
    """Three groups: a dense one with over 65,536 rows, a sparse one and one with negative keys."""
    dense = spark.range(0, 140_000).select(F.lit(1).alias("g"), F.col("id").alias("k"))
    sparse = spark.range(0, 500).select(F.lit(2).alias("g"), (F.col("id") * 10_000_000_019).alias("k"))
    negative = spark.range(0, 500).select(F.lit(3).alias("g"), ((F.col("id") - 250) * 70_001).alias("k"))
    return dense.unionByName(sparse).unionByName(negative)


def test_position_equals_row_number(spark):
    expected = F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1
    both = with_position(keys(spark), ["g"], "k", "at").withColumn("expected", expected)
    assert both.count() == 141_000
    assert both.filter("at <> expected").count() == 0


@pytest.mark.parametrize("n", [0, 1, 65_536, 70_000, 139_999, 200_000])
def test_first_rows(spark, n):
    df = spark.range(0, 140_000).select((F.col("id") * 3 - 1000).alias("k"))
    row = first_rows(df, "k", n).agg(F.count("k"), F.max("k")).first()
    kept = min(n, 140_000)
    assert row[0] == kept and row[1] == (kept * 3 - 1003 if kept else None)


def test_sample(spark):
    df = keys(spark).filter("g > 1")
    sample = sample_per_group(df, "g", 50, "k", 7)
    assert {r.g: r["count"] for r in sample.groupBy("g").count().collect()} == {2: 50, 3: 50}
    again = sample_per_group(df.repartition(7), "g", 50, "k", 7)
    assert sorted(r.k for r in sample.collect()) == sorted(r.k for r in again.collect())
    with pytest.raises(Exception, match="fewer than 501"):
        sample_per_group(df, "g", 501, "k", 7).collect()


def test_stratified_split_sizes(spark):
    # 17 rows: ceil(3.4) = 4 held out, 13 for training: 7.65, 3.82 and 1.53 of 10, 5 and 2.
    rows = [(i, 0) for i in range(10)] + [(i, 1) for i in range(10, 15)] + [(i, 2) for i in (15, 16)]
    split = stratified_split(spark.createDataFrame(rows, "id long, label int"), "id")
    sizes = {(r.label, r.is_train): r["count"] for r in split.groupBy("label", "is_train").count().collect()}
    assert sizes == {(0, True): 8, (0, False): 2, (1, True): 4, (1, False): 1, (2, True): 1, (2, False): 1}


def test_hot_keys_are_spread_and_joined_once(spark):
    rows = spark.range(0, 3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("key"), "id")
    lookup = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    plain = sorted(tuple(r) for r in rows.join(lookup, "key").collect())
    salted = lookup_join(rows, lookup, ["key"], "id", "n", rows_per_task=100)
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
    assert sorted(tuple(r) for r in salted.collect()) == plain


def test_sparse_keys_have_few_leaves(spark):
    """Hashed 64-bit keys: leaves and branches grow with the rows and not with the keys."""
    df = spark.range(0, 200_000).select(F.xxhash64("id").alias("k"))
    bits = leaf_bits(df, "k")
    leaves = leaf_offsets(df, [], "k", bits).collect()
    assert len(leaves) < 20 and max(r["_count"] for r in leaves) < 100_000
    expected = F.row_number().over(Window.orderBy("k")) - 1
    assert with_position(df, [], "k", "at").withColumn("expected", expected).filter("at <> expected").count() == 0
    assert leaf_bits(spark.range(10).filter("id < 0"), "id") == leaf_bits(spark.range(100), "id") == 16


def test_split_is_one_scan_without_a_shuffle(spark, tmp_path):
    spark.range(0, 5000).select("id", (F.col("id") % 3).cast("int").alias("label")).write.parquet(str(tmp_path / "t"))
    split = stratified_split(spark.read.parquet(str(tmp_path / "t")), "id")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
