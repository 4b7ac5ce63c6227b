"""Validation and encoding of pattern parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .patterns import PATTERNS, InvalidParamsError, Param, Pattern


def validate(pattern: Pattern, values: dict) -> None:
    """Raises for unknown or missing names, values out of range and choices that don't exist."""
    known = {p.name: p for p in pattern.params}
    if unknown := values.keys() - known.keys():
        raise InvalidParamsError(f"{pattern.name} has no parameter {sorted(unknown)}")
    if missing := known.keys() - values.keys():
        raise InvalidParamsError(f"{pattern.name} lacks {sorted(missing)}")
    for name, value in values.items():
        p = known[name]
        if p.type in ("float", "int") and not p.low <= float(value) <= p.high:
            raise InvalidParamsError(f"{name}={value} is outside {p.low}..{p.high}")
        if p.type == "enum" and value not in p.choices:
            raise InvalidParamsError(f"{name}={value!r} is none of {p.choices}")


def to_vector(pattern: Pattern, values: dict) -> list[float]:
    """Values in the order of the parameters; a choice by its place, a truth value as 0 or 1, integers cut off."""
    validate(pattern, values)
    number = {"bool": lambda p, v: float(bool(v)), "enum": lambda p, v: float(p.choices.index(v)), "int": lambda p, v: float(int(v)), "float": lambda p, v: float(v)}
    return [number[p.type](p, values[p.name]) for p in pattern.params]


def from_vector(pattern: Pattern, vector: list[float]) -> dict:
    """The inverse: integers and places are rounded half to even, places are clamped, truth begins at 0.5."""
    out = {}
    for p, v in zip(pattern.params, vector, strict=True):
        if p.type == "int":
            out[p.name] = round(v)
        elif p.type == "bool":
            out[p.name] = v >= 0.5
        elif p.type == "enum":
            out[p.name] = p.choices[min(max(round(v), 0), len(p.choices) - 1)]
        else:
            out[p.name] = float(v)
    return out


def at_share(pattern: Pattern, share: float) -> dict:
    """Parameters at a share of each range; first choice, false."""
    out = {}
    for p in pattern.params:
        value = p.low + (p.high - p.low) * share if p.type in ("float", "int") else None
        out[p.name] = round(value) if p.type == "int" else value if p.type == "float" else p.choices[0] if p.type == "enum" else False
    return out


def at_shares(name: Column, shares: Column) -> Column:
    """Parameters of the pattern of this name, in their order, at shares of their ranges (an array; 0..1): integers
    rounded, choices by their place, truth from one half on.  Null for a name that isn't a pattern's."""

    def value(p: Param, n: int) -> Column:
        share = F.coalesce(F.get(shares, F.lit(n)), F.lit(0.5))
        if p.type == "bool":
            return (share >= 0.5).cast("double")
        low, high = (0.0, len(p.choices) - 1.0) if p.type == "enum" else (p.low, p.high)
        number = F.lit(low) + F.lit(high - low) * share
        return number if p.type == "float" else F.rint(number)

    return F.coalesce(*[F.when(name == p.name, F.array(*[value(q, n) for n, q in enumerate(p.params)])) for p in PATTERNS.values()])


def coarse(pattern: Pattern) -> list[dict]:
    """Two points to try: the middle of each range, and its lower end."""
    low = {p.name: p.low if p.type == "float" else int(p.low) for p in pattern.params if p.type in ("float", "int")}
    return [at_share(pattern, 0.5), at_share(pattern, 0.5) | low]


def catalogue(spark: SparkSession) -> DataFrame:
    """One row per parameter of each pattern."""
    rows = [
        (p.name, n, q.name, q.type, q.low, q.high, list(q.choices), p.noise)
        for p in PATTERNS.values()
        for n, q in enumerate(p.params)
    ]
    return spark.createDataFrame(rows, "name string, ord int, param string, type string, low double, high double, choices array<string>, noise boolean")


# --- parameters as rows -----------------------------------------------------------------------------------------------------

TRUTH = ("true", "false", "1", "0")


def violations(rows: DataFrame) -> DataFrame:
    """id, name, param, problem: everything that is wrong with parameters, of rows (id, name, params: map of texts).

    A row with nothing wrong leaves no row.  The catalogue is a table of some 150 rows, whatever there is to check.
    """
    known = catalogue(rows.sparkSession)
    names = known.select("name").distinct()
    given = rows.select("id", "name", F.explode("params").alias("param", "value"))
    number = F.expr("try_cast(value AS double)")
    problem = (
        F.when(F.col("type").isNull(), "unknown parameter")
        .when(F.col("value").isNull(), "no value")
        .when(F.col("type").isin("float", "int") & (number.isNull() | F.isnan(number)), "not a number")
        .when(F.col("type").isin("float", "int") & ~number.between(F.col("low"), F.col("high")), "out of range")
        .when((F.col("type") == "enum") & ~F.array_contains("choices", F.col("value")), "no such choice")
        .when((F.col("type") == "bool") & ~F.lower("value").isin(*TRUTH), "neither true nor false")
    )
    wrong = given.join(names, "name", "left_semi").join(known, ["name", "param"], "left").select("id", "name", "param", problem.alias("problem")).filter("problem is not null")
    wanted = rows.join(known, "name").filter(F.col("params").isNull() | ~F.coalesce(F.map_contains_key("params", F.col("param")), F.lit(False)))
    missing = wanted.select("id", "name", "param", F.lit("missing").alias("problem"))
    nameless = rows.join(names, "name", "left_anti").select("id", "name", F.lit(None).cast("string").alias("param"), F.lit("unknown pattern").alias("problem"))
    return wrong.union(missing).union(nameless)


def _by_name(spark: SparkSession) -> DataFrame:
    """name, _of: a pattern's parameters in their order."""
    fields = F.struct("ord", "param", "type", "low", "high", "choices")
    return catalogue(spark).groupBy("name").agg(F.array_sort(F.collect_list(fields)).alias("_of"))


def encoded(rows: DataFrame) -> DataFrame:
    """``rows`` (name, params: map of texts, without violations) with ``codes``: the numbers of ``to_vector``, in the order
    of the pattern's parameters; null for a pattern that isn't known."""

    def number(p: Column) -> Column:
        text = F.col("params")[p["param"]]
        value = text.try_cast("double")
        return (
            F.when(p["type"] == "bool", F.lower(text).isin("true", "1").cast("double"))
            .when(p["type"] == "enum", (F.array_position(p["choices"], text) - 1).cast("double"))
            .when(p["type"] == "int", F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double"))
            .otherwise(value)
        )

    return rows.join(_by_name(rows.sparkSession), "name", "left").select(*rows.columns, F.transform("_of", number).alias("codes"))


def decoded(rows: DataFrame) -> DataFrame:
    """``rows`` (name, codes) with ``values``, an array of (param, number, choice): the inverse, as ``from_vector`` has it;
    a choice is its text, truth is 0 or 1."""

    def value(p: Column) -> Column:
        code = F.get("codes", p["ord"])
        place = F.least(F.greatest(F.rint(code), F.lit(0.0)), F.size(p["choices"]) - 1.0)
        number = F.when(p["type"] == "int", F.rint(code)).when(p["type"] == "bool", (code >= 0.5).cast("double")).when(p["type"] == "enum", place).otherwise(code)
        choice = F.when(p["type"] == "enum", F.get(p["choices"], place.cast("int")))
        return F.struct(p["param"].alias("param"), number.alias("number"), choice.alias("choice"))

    return rows.join(_by_name(rows.sparkSession), "name", "left").select(*rows.columns, F.transform("_of", value).alias("values"))
