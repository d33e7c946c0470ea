from pyspark.sql import functions as F

from passagework.config import spread
from passagework.operators.positions import dense_positions
from passagework.plans.ingest import progress_of


def test_hot_group_is_numbered_over_many_ranges(spark):
    # one group holds nearly all rows
    df = spark.range(6000).select(F.when(F.col("id") < 5500, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
                                  ((F.col("id") * 7919) % 6000).alias("o"))
    got = dense_positions(df, ["g"], ["o"], "n").collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r.g, []).append((r.o, r.n))
    assert len(got) == 6000 and len(by_group) == 8
    for rows in by_group.values():
        assert [n for _, n in sorted(rows)] == list(range(len(rows)))


def test_progress_of_a_hot_document(spark):
    pages = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.col("id").cast("string")).alias("doc_id"),
                                     F.when(F.col("id") < 2500, F.col("id")).otherwise(F.lit(0)).alias("page_no"))
    done = progress_of(pages)
    assert done.filter("doc_id = 'hot'").agg(F.min("done"), F.max("done"), F.min("total"), F.max("total"), F.count("*")).first() == (1, 2500, 2500, 2500, 2500)
    assert done.filter("doc_id <> 'hot'").select("done", "total").distinct().collect() == [(1, 1)]


def test_small_scans_are_spread_and_large_ones_are_not(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert spread(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df, "id", bytes_per_task=1).rdd.getNumPartitions() == df.rdd.getNumPartitions()
