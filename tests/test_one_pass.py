"""Queries that read their rows once and keep no more of them than a hash table holds."""

import re

import workload.all  # noqa: F401  (registers every query)
from shelfmark import fixed_values as fv
from shelfmark.operators import groups, policy, report
from workload.registry import REGISTRY

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unarchivable_reads_pages_once_and_sorts_none(spark):
    text = plan(REGISTRY["unarchivable_content"].run(spark, SF))
    assert "SortAggregate" not in text and text.count("FileScan") == 2


def test_unarchivable_names_the_first_reason_with_or_without_a_table_of_tags(spark):
    rows = [("a", 3, fv.LAYERS_TAG, 7, 1, [8]), ("a", 1, 50001, 7, 1 << 30, [8, 32]), ("b", 1, 50001, 7, 1 << 30, [8]),
            ("b", 1, fv.LAYERS_TAG, 7, 1, [8]), ("c", 2, 100, 7, 1, [32]), ("d", 0, 100, 7, 1, [8, 16]), ("e", 0, 100, 7, 1, [32]),
            ("e", None, fv.LAYERS_TAG, 7, 1, None), ("f", -2, 100, 7, 1, [32]), ("f", -1, fv.LAYERS_TAG, 7, 1, [8])]
    df = spark.createDataFrame(rows, "path string, page int, code int, type int, size int, bits_per_sample array<int>")
    want = {"a": "private tag too large", "b": "layers", "c": "sample depth", "e": "layers", "f": "sample depth"}
    tags, depths = df.select("path", "page", "code", "type", "size"), df.select("path", "page", "bits_per_sample")
    for got in (policy.unarchivable(df), policy.unarchivable(depths, tags)):
        assert {r.path: r.unarchivable for r in got.collect()} == want


def test_layout_diff_takes_both_sides_from_one_count(spark):
    present = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), (None, 2), ("c", 0), ("c", 0)], "g string, page int")
    planned = spark.createDataFrame([(0, "a"), (1, "a"), (None, "b"), (3, "d"), (3, "d"), (0, "c"), (0, "c")], "page int, g string")
    got = report.layout_diff(present, planned)
    assert plan(got).count("Exchange hashpartitioning") == 1
    # As EXCEPT ALL has it: a value that is present more often than planned is stale.
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        ("a", 0, "stale"), (None, 2, "stale"), ("b", None, "missing"), ("d", 3, "missing")], key=repr)


def test_only_places_with_several_entries_are_sent_back_to_the_rows(spark):
    schema = "path string, folder string, group_id string, page int, is_thumb boolean, subfiletype int"
    rows = [("b", "f", "g", 0, False, 0), ("a", "f", "g", 0, False, 0), ("c", "f", "g", 1, True, 1), ("d", "f", "g", 1, True, 1),
            ("e", "f", "g", 2, True, 1), (None, "f", "g", 3, False, 0), ("h", None, "g", 0, False, 0), ("i", "f", None, 0, True, 1),
            ("j", "f", "g", None, False, 0), ("k", "f", "g", 4, None, 1)]
    got = groups.demote_duplicates(spark.createDataFrame(rows, schema))
    assert "(_n" in plan(got)
    assert sorted([(r.path, r.standalone, r.is_thumb, r.subfiletype) for r in got.collect()], key=repr) == sorted([
        ("a", False, False, 0), ("b", True, False, 0), ("c", False, True, 1), ("d", True, False, 0), ("e", False, True, 1),
        (None, True, False, 0), ("h", True, False, 0), ("i", True, False, 0), ("j", True, False, 0), ("k", True, None, 1)], key=repr)


def test_split_by_content_settles_its_entries_once(spark):
    assert "lineitem" not in plan(REGISTRY["split_by_content"].run(spark, SF))


def test_only_overfull_groups_are_judged_by_their_buckets(spark):
    schema = "path string, folder string, group_id string, page int, is_thumb boolean, declared int, content_id string"
    rows = [(f"{g}{k}", "f", g, k, False, n, c) for g, n, cs in (
        ("over", 2, "xxy"), ("tie", 1, "xy"), ("whole", 2, "xy"), ("odd", None, "xyz")) for k, c in enumerate(cs)]
    got = groups.split_by_content(spark.createDataFrame(rows, schema))
    assert re.search(r"Filter .*#\d+L > cast\(", plan(got))
    assert {r.path: r.role for r in got.collect()} == {
        "over0": "member", "over1": "member", "over2": "orphan", "tie0": "conflict", "tie1": "conflict", "whole0": "member",
        "whole1": "member", "odd0": "member", "odd1": "member", "odd2": "member"}
