from pyspark.sql import functions as F

from recordloom.functions import values as V


def one(spark, f, items):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_numbers(spark):
    assert one(spark, V.to_number, ["$1,234", "50%", "1d", "€ 2.5", "x", " 7 "]) == [1234.0, 0.5, None, 2.5, None, 7.0]
    assert one(spark, V.to_integer, ["30", "$1,234", "2.9", "-2.9"]) == [30, 1234, 2, -2]
    assert one(spark, V.is_numeric, ["1e5", "1_000", "nan", "12%", "abc"]) == [True, True, True, True, False]


def test_booleans_and_nulls(spark):
    assert one(spark, V.to_boolean, ["yes", "No", "1", "maybe"]) == [True, False, True, None]
    assert one(spark, V.is_null_token, ["N/A", "#N/A", "-", "x", " "]) == [True, False, True, False, True]
    assert one(spark, lambda v: V.is_null_token(v, True), ["#N/A"]) == [True]


def test_arrays_and_dates(spark):
    assert one(spark, V.to_array, ['["a","b"]', "c"]) == [["a", "b"], ["c"]]
    assert one(spark, V.is_date, ["2024-01-15", "01-Mär-2024", "April 1, 2024", "1/2"]) == [True, True, True, False]
    assert [str(x) for x in one(spark, V.to_date, ["15.02.2024", "01-Mar-2024"])] == ["2024-02-15", "2024-03-01"]
