from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetvitals.operators import profile, workload


def test_missing_children_and_null_keys(spark):
    parent = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    child = spark.createDataFrame([(1,), (1,), (None,)], "r int")
    keep = workload.without_child(parent, child, "k", "r").collect()
    assert {r.k for r in keep} == {2, None}
    assert [r.k for r in workload.without_child(parent, child, "k", "r", True).collect()] == [2]


def test_count_by_key_and_conjuncts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, v string")
    assert workload.count_by_key(df, "k", [1]).first().n == 2
    assert workload.count_by_key(df, "k").count() == 2
    assert workload.filtered_count(df, F.col("k") == 1, F.col("v") == "a").first().n == 1


def test_expand_drops_rows_without_times(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (None,)], "t int")
    assert sorted((r.t, r.n) for r in workload.expand_rows(df, F.col("t")).collect()) == [
        (1, 1), (3, 1), (3, 2), (3, 3)]


def test_json_merge_replaces_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), (None,), ("{}",)], "j string")
    merged = workload.merge_json(F.col("j"), {"b": F.lit(9), "c": F.lit(3)})
    got = [r[0] for r in df.select(merged).collect()]
    assert got == ['{"a":1,"b":9,"c":3}', None, '{"b":9,"c":3}']


def test_json_merge_keeps_values_of_any_kind(spark):
    rows = ['{"session_id":"ab","page":"/p/1"}', '{"a":1.5,"b":{"x":[1,"y",null]},"n":null}',
            '{"iteration":"old"}', "[1]", "oops", '{"a":1']
    merged = workload.merge_json(F.col("j"), {"iteration": F.lit(3)})
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "j string").select(merged).collect()]
    assert got == ['{"session_id":"ab","page":"/p/1","iteration":3}',
                   '{"a":1.5,"b":{"x":[1,"y",null]},"n":null,"iteration":3}', '{"iteration":3}',
                   None, None, None]


@pytest.mark.parametrize("n", [0, 1, 17, 999, 1000, 5000])
@pytest.mark.parametrize("digits", [2, 4])
def test_random_subset_is_the_first_by_hash_at_any_size(spark, n, digits):
    df = spark.range(1000).selectExpr("id as k", "id % 3 as g")
    got = [r.k for r in workload.random_subset(df, n, ["k"], 5, digits).collect()]
    want = df.orderBy(F.md5(F.concat(F.lit("5:"), F.col("k").cast("string"))), "k").limit(n).collect()
    assert sorted(got) == sorted(r.k for r in want)


def test_profile_by_hand(spark):
    wide = "x" * 2000
    df = spark.createDataFrame([("b", 1), ("a", 1), ("é", 2), (None, 2), (wide, None), (wide, 1)],
                               "s string, n int")
    rows = {r.column_name: r for r in profile.column_profile(df, "t").collect()}
    s, n = rows["s"], rows["n"]
    assert (s.n_rows, s.n_distinct, s.null_frac) == (6, 4, 1 / 6)
    assert s.mcv1 == wide and s.mcf1 == 2 / 6
    assert s.avg_width == (1 + 1 + 2 + 4000) / 5
    assert (n.n_distinct, n.mcv1, n.mcf1, n.avg_width) == (2, "1", 0.5, 4.0)


def test_profile_ties_and_empty_columns(spark):
    df = spark.createDataFrame([("b", None), ("a", None)], "s string, e string")
    rows = {r.column_name: r for r in profile.column_profile(df, "t").collect()}
    assert rows["s"].mcv1 == "a"
    assert (rows["e"].n_distinct, rows["e"].mcv1, rows["e"].null_frac) == (0, None, 1.0)
    empty = profile.column_profile(df.limit(0), "t").first()
    assert (empty.n_rows, empty.null_frac) == (0, None)


def test_approx_profile_near_exact(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet")
    exact = {r.column_name: r for r in profile.column_profile(part, "part").collect()}
    for row in profile.approx_column_profile(part, "part").collect():
        want = exact[row.column_name]
        assert (row.n_rows, row.null_frac) == (want.n_rows, want.null_frac)
        assert row.avg_width == want.avg_width
        assert row.mcf1_error < 0.002 and abs(row.mcf1 - want.mcf1) <= 2 * row.mcf1_error
        assert abs(row.n_distinct - want.n_distinct) <= 0.1 * want.n_distinct + 1


def test_approx_profile_of_null_heavy_and_wide_columns(spark):
    wide = "x" * 3000
    df = spark.createDataFrame([(None, wide)] * 6 + [("a", wide + "y")] * 3 + [("b", None)],
                               "s string, w string")
    exact = {r.column_name: r for r in profile.column_profile(df, "t").collect()}
    for row in profile.approx_column_profile(df, "t").collect():
        want = exact[row.column_name]
        assert (row.mcv1, row.mcf1) == (want.mcv1, want.mcf1)
    assert (exact["s"].mcv1, exact["s"].mcf1, exact["w"].mcv1) == ("a", 0.3, wide)
