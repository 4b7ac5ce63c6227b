"""Codebooks as literals, with the task and as tables: one rule for all of them."""

import math

import numpy as np
import pytest

from tessella.operators import nearest, quantize


def plain(vectors, codes):
    out = []
    for key, v in vectors:
        best = None
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            for n, c in codes:
                if c is not None and len(c) == len(v) and all(x is not None and math.isfinite(x) for x in c):
                    d2 = 0.0
                    for x, y in zip(v, c):
                        d2 += (float(x) - float(y)) * (float(x) - float(y))
                    best = min(best or (math.inf, 0), (d2, n))
        out.append((key, best and best[1], best and best[0]))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["k"], r["code_id"], r["d2"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd_vectors():
    deal = np.random.default_rng(3)
    some = [(i, [float(x) for x in v]) for i, v in enumerate(deal.normal(size=(120, 3)).round(1))]
    return some + [(900, None), (901, [1.0, None, 2.0]), (902, [math.nan, 0.0, 0.0]), (903, [math.inf, 0.0, 0.0]), (904, [1.0, 2.0]), (905, []), (906, [0.5, 0.5, 0.5]), (906, [0.5, 0.5, 0.5])]


@pytest.mark.parametrize("count", [5, 64, 65, 150])
def test_one_rule_at_all_sizes(spark, odd_vectors, count):
    """Nulls, NaN, other lengths and ties, for codebooks below and above the literal's limit, and as a table in chunks."""
    deal = np.random.default_rng(count)
    codes = [[float(x) for x in c] for c in deal.integers(-2, 3, size=(count, 3)) / 2]  # few values: many ties
    codes[1] = [math.nan, 0.0, 0.0]
    codes[3] = list(codes[0])
    df = spark.createDataFrame(odd_vectors, "k long, v array<double>").repartition(3)
    want = plain(odd_vectors, list(enumerate(codes)))
    assert rows(quantize.assign(df, codes, "v")) == want
    table = spark.createDataFrame([*enumerate(codes)], "code_id int, centre array<double>")
    for chunk in (nearest.CHUNK, 16):
        assert rows(quantize.assign_to_table(df, table, "v", chunk)) == want


def test_codes_that_nearly_tie(spark):
    """Codes that the matrix product can't tell apart are told apart by their exact distances."""
    base = [1e6 + 0.25 * i for i in range(40)]
    codes = [[x + (n - 100) * 1e-7 * (i == 7) for i, x in enumerate(base)] for n in range(200)]
    vectors = [(0, base), (1, [x + 3.3e-7 * (i == 7) for i, x in enumerate(base)]), (2, codes[150]), (3, codes[50])]
    df = spark.createDataFrame(vectors, "k long, v array<double>")
    want = plain(vectors, list(enumerate(codes)))
    table = spark.createDataFrame([*enumerate(codes)], "code_id int, centre array<double>")
    assert rows(quantize.assign(df, codes, "v")) == want == rows(quantize.assign_to_table(df, table, "v", 32))


def test_tables_with_nulls_other_columns_and_no_rows(spark, odd_vectors):
    df = spark.createDataFrame([(k, v, {"a": k}, "x") for k, v in odd_vectors], "k long, v array<double>, m map<string,long>, id string")
    codes = [(7, [0.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (1, None), (2, [1.0, None, 0.0]), (9, [1.0, 1.0])]
    table = spark.createDataFrame(codes, "code_id long, centre array<double>")
    found = quantize.assign_to_table(df, table, "v")
    assert found.columns == ["k", "v", "m", "id", "code_id", "d2"] and rows(found) == plain(odd_vectors, codes)
    assert {r["code_id"] for r in quantize.assign_to_table(df, table.limit(0), "v").collect()} == {None}
    assert quantize.assign_to_table(df.limit(0), table, "v").count() == 0
    left = quantize.with_residuals(found, table, "v").filter("k = 0").first()
    assert left["residual"] == odd_vectors[0][1]


def test_a_vector_on_most_rows_is_dealt(spark):
    """Copies of one vector are dealt over all tasks."""
    df = spark.range(6_000).selectExpr("id k", "array(0.5D, 0.5D) v")
    table = spark.createDataFrame([(n, [n / 10, 0.5]) for n in range(30)], "code_id int, centre array<double>")
    found = quantize.assign_to_table(df, table, "v", 10)
    assert {(r["code_id"], r["d2"]) for r in found.select("code_id", "d2").distinct().collect()} == {(5, 0.0)}
    from pyspark.sql import functions as F

    sizes = [r["n"] for r in quantize.assign_to_table(df, table, "v").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 0.6 * 6_000 and sum(sizes) == 6_000
