"""The group helpers against plain windows, with one group holding most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark import skew
from shelfmark.operators import groups, report
from shelfmark.plans.restore import settle_entries


def hot(spark, n=6000):
    """Two thirds of the rows share one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("pos"),
        F.col("id").alias("tie"), (F.col("id") * 37 % 101).alias("v"))


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_running_total(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("pos", "tie").rowsBetween(Window.unboundedPreceding, 0)
    got = skew.running_total(df, ["k"], ["pos"], ["tie"], F.col("v"), "s").select("tie", "s")
    assert same(got, df.select("tie", F.sum("v").over(w).alias("s")))


def test_previous_value(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("pos", "tie")
    got = skew.previous_value(df, ["k"], ["pos"], ["tie"], "v", "p").select("tie", F.coalesce("p", F.lit(-1)).alias("p"))
    assert same(got, df.select("tie", F.coalesce(F.lag("v").over(w), F.lit(-1)).alias("p")))


def test_global_rank(spark):
    got = skew.global_rank(hot(spark), ["v", "tie"], "r").orderBy("v", "tie").select("r").collect()
    assert [r.r for r in got] == list(range(6000))


def test_top_rows_limits_before_the_exchange(spark):
    plan = skew.top_rows(hot(spark), ["k"], [F.col("v"), F.col("tie")], 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("WindowGroupLimit") < text.index("Exchange")
    assert "Partial" in text


def test_attach_splits_a_hot_key(spark):
    """With low thresholds the adaptive rule splits the partition of the hot key."""
    keep = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in keep.items():
        spark.conf.set(key, value)
    try:
        df = hot(spark, 200_000).repartition(6)
        out = skew.with_group_facts(df, ["k"], F.count(F.lit(1)).alias("n"))
        assert out.agg(F.sum("n")).collect()[0][0] == sum(r["count"] ** 2 for r in df.groupBy("k").count().collect())
        out.write.format("noop").mode("overwrite").save()
        job = out.filter("v >= 0")
        job.collect()
        assert "skew=true" in job._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in keep:
            spark.conf.unset(key)


def test_size_stats_on_a_hot_group(spark):
    df = hot(spark).select("k", (F.col("v") * 5000).alias("size")).withColumn("g", F.col("k") == 0)
    got = report.size_stats(df, ["g"], digit_bits=12).orderBy("g").collect()
    want = df.groupBy("g").agg(F.percentile("size", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))).orderBy("g").collect()
    for a, b in zip(got, want):
        assert [round(x, 6) for x in (a.low, a.median, a.high)] == [round(x, 6) for x in b[1]]


def test_duplicates_of_one_page_fold_to_one_member(spark):
    """A document whose copies flood the table keeps one entry per page."""
    df = spark.range(3000).select(
        F.lit("/f").alias("folder"), F.lit("g").alias("group_id"), (F.col("id") % 3).cast("int").alias("page"),
        F.lit(False).alias("is_thumb"), F.concat(F.lit("/f/p"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("path"),
        F.lit(3).alias("declared"), F.lit("c").alias("content_id"), F.lit(0).alias("subfiletype"), F.lit(1).alias("mtime"))
    settled = settle_entries(df)
    counts = {r.role: r["count"] for r in settled.groupBy("role").count().collect()}
    assert counts == {"member": 3, "duplicate": 2997}
    assert groups.group_status(settled.filter("role = 'member'")).collect()[0].status == "complete"


def test_collisions_of_a_hot_destination(spark):
    plan = spark.range(5000).select(F.lit("/out/a.jxl").alias("dest"), F.format_string("/s/%05d", "id").alias("path"))
    row = report.duplicate_destinations(plan).collect()[0]
    assert (row.sources, row.more, row["sample"]) == (5000, 4996, ["/s/00000", "/s/00001", "/s/00002", "/s/00003"])


def test_spread_sample(spark):
    df = spark.range(11).select(F.format_string("/p%02d", "id").alias("path"), (F.col("id") * 10).alias("size"))
    assert sorted(r.path for r in report.spread_sample(df, 3).collect()) == ["/p00", "/p05", "/p10"]
    assert report.spread_sample(df.limit(2), 3).count() == 2
