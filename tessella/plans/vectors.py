"""Queries on vector quantisation, over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quantize
from .common import sql_tidy, table, tidy

CODES = 8
QUERIES, SQL = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _book(vectors) -> quantize.Codebook:
    """The vectors of the first ids: a fixed start, so that results can be compared."""
    rows = vectors.filter(F.col("vec_id") < CODES).orderBy("vec_id").collect()
    return [[float(x) for x in r["embedding"]] for r in rows]


_ASSIGNED = f"""book AS (SELECT vec_id AS code_id, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < {CODES}
), near AS (
  SELECT vec_id, e, code_id::INT AS code_id, c, list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - c[i]) * (e[i] - c[i]))) AS d2
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), book
), assigned AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, code_id) = 1)"""


@query
def vq_assign(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return quantize.assign(vectors, _book(vectors)).select("vec_id", "code_id", tidy(F.col("d2")).alias("d2"))


SQL["vq_assign"] = f"WITH {_ASSIGNED} SELECT vec_id, code_id, {sql_tidy('d2')} AS d2 FROM assigned"


@query
def vq_lloyd_step(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return quantize.lloyd_step(quantize.assign(vectors, _book(vectors))).select("code_id", "dim", tidy(F.col("centre")).alias("centre"), "n")


SQL["vq_lloyd_step"] = f"""WITH {_ASSIGNED}, flat AS (SELECT code_id, (i - 1)::INT AS dim, e[i] AS x FROM (SELECT code_id, e, unnest(range(1, len(e) + 1)) AS i FROM assigned))
SELECT code_id, dim, {sql_tidy('avg(x)')} AS centre, count(*) AS n FROM flat GROUP BY code_id, dim"""

SCALE = 0.01


def _stepped(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    book = _book(vectors)
    found = quantize.assign(vectors, book).withColumn("code", F.get(quantize.literal(book), F.col("code_id")))
    vector = F.col("embedding").cast("array<double>")
    scale = F.transform("code", lambda c: F.lit(SCALE))
    return found.withColumn("vector", vector).withColumn("scale", scale).withColumn("steps", quantize.offsets(F.col("vector"), F.col("code"), F.col("scale")))


_STEPS = f"{_ASSIGNED}, stepped AS (SELECT *, list_transform(range(1, len(e) + 1), lambda i: least(greatest(round_even((e[i] - c[i]) / {SCALE}, 0), -128), 127)::INT) AS steps FROM assigned)"


@query
def vq_offsets(spark, sf_dir):
    return _stepped(spark, sf_dir).select("vec_id", "code_id", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"))


SQL["vq_offsets"] = f"WITH {_STEPS} SELECT vec_id, code_id, array_to_string(steps, ',') AS steps FROM stepped"


@query
def vq_dequant(spark, sf_dir):
    """Squared error of the vectors restored from whole steps, and from exact residuals."""
    rows = _stepped(spark, sf_dir)
    restored = quantize.restored(F.col("code"), F.col("steps"), F.col("scale"))
    exact = F.zip_with("code", quantize.residual(F.col("vector"), F.col("code")), lambda c, r: c + r)
    error = lambda v: quantize.squared_distance(F.col("vector"), v)
    return rows.select("vec_id", tidy(error(restored)).alias("error"), tidy(error(exact)).alias("exact"))


SQL["vq_dequant"] = f"""WITH {_STEPS}
SELECT vec_id, {sql_tidy(f"list_sum(list_transform(range(1, len(e) + 1), lambda i: pow(e[i] - (c[i] + steps[i] * {SCALE}), 2)))")} AS error, 0.0::DOUBLE AS exact FROM stepped"""


@query
def vq_train(spark, sf_dir):
    """A codebook trained from a spread start, and how many vectors each code has."""
    vectors = _vectors(spark, sf_dir)
    book = quantize.train(vectors, CODES, iterations=6, seed=123)
    sizes = quantize.assign(vectors, book).groupBy("code_id").agg(F.count("*").alias("n"), tidy(F.avg("d2"), 4).alias("d2"))
    return sizes


def _tables(vectors):
    """Two codebooks: the first vectors, and those after them."""
    own = vectors.filter(F.col("vec_id") < 2 * CODES)
    step = F.when(F.col("vec_id") < CODES, 0.01).otherwise(0.02)
    return own.select(F.expr(f"cast(vec_id div {CODES} as int)").alias("table_id"), (F.col("vec_id") % CODES).cast("int").alias("code_id"), F.col("embedding").alias("centre"), F.transform("embedding", lambda x: step).alias("scale"))


@query
def vq_tables(spark, sf_dir):
    """Vectors of two tables: the code of each, its offsets summed, and the error of what is restored from them."""
    vectors = _vectors(spark, sf_dir)
    tables = _tables(vectors)
    back = quantize.dequantize_by_table(quantize.quantize_by_table(vectors.withColumn("table_id", (F.col("vec_id") % 2).cast("int")), tables), tables)
    error = quantize.squared_distance(F.col("embedding").cast("array<double>"), F.col("restored"))
    total = F.aggregate("offsets", F.lit(0.0), lambda s, o: s + o)
    return back.select("vec_id", "table_id", "code_id", tidy(total, 4).alias("offsets"), tidy(error).alias("error"))


SQL["vq_tables"] = f"""WITH t AS (
  SELECT (vec_id // {CODES})::INT AS table_id, (vec_id % {CODES})::INT AS code_id, embedding::DOUBLE[] AS c, CASE WHEN vec_id < {CODES} THEN 0.01 ELSE 0.02 END::DOUBLE AS s FROM embeddings WHERE vec_id < {2 * CODES}
), n AS (
  SELECT vec_id, t.table_id, code_id, e, c, s, list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - c[i]) * (e[i] - c[i]))) AS d2
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v JOIN t ON v.vec_id % 2 = t.table_id
), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, code_id) = 1)
SELECT vec_id, table_id, code_id, {sql_tidy("list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - c[i]) / s))", 4)} AS offsets, 0.0::DOUBLE AS error FROM b"""


def _large_book(vectors) -> quantize.Codebook:
    return [[float(x) for x in r["embedding"]] for r in vectors.filter(F.col("vec_id") < 128).orderBy("vec_id").collect()]


@query
def vq_assign_many(spark, sf_dir):
    """The nearest of 128 codes, by matrix products."""
    vectors = _vectors(spark, sf_dir)
    return quantize.assign(vectors, _large_book(vectors)).select("vec_id", "code_id", tidy(F.col("d2")).alias("d2"))


SQL["vq_assign_many"] = SQL["vq_assign"].replace(f"WHERE vec_id < {CODES}", "WHERE vec_id < 128")


def _some_null(vectors):
    return vectors.withColumn("embedding", F.when(F.col("vec_id") % 17 != 0, F.col("embedding")))


@query
def vq_assign_table(spark, sf_dir):
    """The nearest of the codes of a table in several chunks, for vectors of which some are null; and what is left."""
    vectors = _vectors(spark, sf_dir)
    codes = vectors.filter(F.col("vec_id") < 200).select(F.col("vec_id").cast("int").alias("code_id"), F.col("embedding").alias("centre"))
    found = quantize.with_residuals(quantize.assign_to_table(_some_null(vectors), codes, chunk=64), codes)
    left = F.aggregate("residual", F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", "code_id", tidy(F.col("d2")).alias("d2"), tidy(left, 4).alias("residual"))


SQL["vq_assign_table"] = f"""WITH {_ASSIGNED.replace(f'WHERE vec_id < {CODES}', 'WHERE vec_id < 200')}
SELECT vec_id, CASE WHEN vec_id % 17 <> 0 THEN code_id END::BIGINT AS code_id, CASE WHEN vec_id % 17 <> 0 THEN {sql_tidy('d2')} END AS d2,
       CASE WHEN vec_id % 17 <> 0 THEN {sql_tidy("list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] - c[i]))", 4)} END AS residual FROM assigned"""
