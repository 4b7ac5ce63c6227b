"""Parameters as rows against the functions for one pattern."""

import random

from tessella.functions import params
from tessella.functions.patterns import PATTERNS, InvalidParamsError


def given(count):
    draw, rows = random.Random(2), []
    for n in range(count):
        pattern = PATTERNS[draw.choice(sorted(PATTERNS))]
        values = {}
        for p in pattern.params:
            if p.type in ("float", "int"):
                v = draw.uniform(p.low, p.high) if draw.random() < 0.9 else draw.choice((p.low - 1, p.high + 1, p.low, p.high))
                values[p.name] = float(int(v)) if p.type == "int" else round(v, 4)
            else:
                values[p.name] = draw.choice(p.choices) if p.type == "enum" else draw.random() < 0.5
        if draw.random() < 0.1:
            values.pop(draw.choice(sorted(values)))
        if draw.random() < 0.1:
            values["other"] = 1.0
        rows.append((n, pattern.name, values))
    return rows


def texts(values):
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in values.items()}


def test_rows_are_judged_and_coded_as_single_patterns_are(spark):
    rows = given(400)
    df = spark.createDataFrame([(n, name, texts(v)) for n, name, v in rows], "id int, name string, params map<string,string>")
    bad = {r["id"] for r in params.violations(df).collect()}
    coded = {r["id"]: r for r in params.decoded(params.encoded(df)).collect()}
    for n, name, values in rows:
        pattern = PATTERNS[name]
        try:
            vector = params.to_vector(pattern, values)
        except InvalidParamsError:
            assert n in bad
            continue
        assert n not in bad and coded[n]["codes"] == vector
        back = params.from_vector(pattern, vector)
        for v, p in zip(coded[n]["values"], pattern.params):
            assert v["param"] == p.name and (v["choice"] if p.type == "enum" else v["number"]) == back[p.name]
    assert bad and len(bad) < 300


def test_every_violation_is_a_row(spark):
    rows = [
        (1, "WORLEY", {"scale": "0", "metric": "none", "invert": "maybe", "extra": "1"}), (2, "WORLEY", {"scale": "abc", "metric": None}), (3, "NOTHING", {"a": "1"}), (4, None, {}),
        (5, "RINGS", None), (6, "WORLEY", {"scale": "NaN", "metric": "euclidean", "invert": "TRUE"}), (7, "WORLEY", {"scale": "2", "metric": "manhattan", "invert": "0"}), (8, "RINGS", {}),
    ]
    df = spark.createDataFrame(rows, "id int, name string, params map<string,string>")
    found = sorted((r["id"], r["param"] or "", r["problem"]) for r in params.violations(df).collect())
    rings = [(n, p.name, "missing") for n in (5, 8) for p in PATTERNS["RINGS"].params]
    assert found == sorted([
        (1, "extra", "unknown parameter"), (1, "invert", "neither true nor false"), (1, "metric", "no such choice"), (1, "scale", "out of range"), (2, "invert", "missing"), (2, "metric", "no value"), (2, "scale", "not a number"),
        (3, "", "unknown pattern"), (4, "", "unknown pattern"), (6, "scale", "not a number"), *rings,
    ])
    assert params.violations(df.limit(0)).count() == 0
    codes = {r["id"]: r["codes"] for r in params.encoded(df).collect()}
    assert codes[7] == [2.0, 1.0, 0.0] and codes[3] is None
    odd = spark.createDataFrame([(1, "WORLEY", [2.0, 7.0, 0.5]), (2, "WORLEY", [2.0, -3.0, 0.4])], "id int, name string, codes array<double>")
    back = {r["id"]: [(v["number"], v["choice"]) for v in r["values"]] for r in params.decoded(odd).collect()}
    assert back == {1: [(2.0, None), (2.0, "chebyshev"), (1.0, None)], 2: [(2.0, None), (0.0, "euclidean"), (0.0, None)]}


def test_shares_of_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(name, [s] * 8) for name in (*sorted(PATTERNS), "NOTHING") for s in (0.0, 0.37, 1.0)]
    df = spark.createDataFrame(rows, "name string, shares array<double>").select("*", params.at_shares(F.col("name"), F.col("shares")).alias("codes"))
    for r in df.collect():
        if r["name"] == "NOTHING":
            assert r["codes"] is None
            continue
        for p, code in zip(PATTERNS[r["name"]].params, r["codes"]):
            if p.type in ("float", "int"):
                want = params.at_share(PATTERNS[r["name"]], r["shares"][0])[p.name]
                assert code == want
