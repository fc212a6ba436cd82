"""Numbers out of text: the same values as a cast that may fail, without failing casts row by row."""

import time

from pyspark.sql import functions as F

from shelfmark.functions import tokens as T
from shelfmark.functions.numbers import recorded_number, whole_number

TEXTS = ["3", "+3", "-3", " 3 ", "\t3\n", "\x003", "3\x7f", " 3", "٣", "- 3", "3e2", "1.5", "1.", ".5", "", "a", "x7",
         "99999999999", "2147483647", None]
RECORDED = ["1", "1.5", "1.", ".5", ".", "1.2.3", "..", "", "0.05", "00", None]


def test_same_as_a_cast(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert rows.filter(~whole_number(F.col("t")).eqNullSafe(F.col("t").try_cast("int"))).count() == 0
    rows = spark.createDataFrame([(t,) for t in RECORDED], "t string")
    assert rows.filter(~recorded_number(F.col("t")).eqNullSafe(F.col("t").try_cast("double"))).count() == 0


def test_malformed_numbers_cost_no_more_than_good_ones(spark):
    texts = spark.range(0, 200_000, 1, 1).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("t"))

    def seconds(value):
        took = []
        for _ in range(2):
            start = time.perf_counter()
            texts.select(value.alias("n")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(whole_number(F.col("t"))) * 3 < seconds(F.col("t").try_cast("int"))


def test_markers_clean_a_list_once(spark):
    tokens = spark.createDataFrame([([" jxlphoto-mpg:g ", "", "jxlphoto-page:x", "jxlphoto-page:4", "jxlphoto-extrasamples:1,2",
                                      "jxlphoto-extrasamples:a"],), (None,)], "t array<string>")
    marked = tokens.select(T.parse_markers("t").alias("m"))
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coalesce(t#") == 1
    first, empty = [r["m"] for r in marked.collect()]
    assert (first["group_id"], first["page"], first["extrasamples"]) == ("g", 4, [1, 2])
    assert (empty["group_id"], empty["page"], empty["tags"], empty["is_thumb"]) == (None, None, [], False)
    asked = tokens.select(T.parse_markers("t", "page", "group_id").alias("m")).first()["m"]
    assert asked.asDict() == {"page": 4, "group_id": "g"}
