"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import raster


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.vector_pixels(table(spark, sf_dir, "embeddings"))


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.vector_dims(table(spark, sf_dir, "embeddings"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image beside itself in steps of an eighth."""
    return pixels(spark, sf_dir).select("img", "y", "x", F.col("v").alias("a"), (F.floor(F.col("v") * 8 + 0.5) / 8).alias("b"))


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    small = 0.5 * 10.0**-digits
    return F.when(F.abs(value) < small, F.lit(0.0)).otherwise(F.round(value, digits))


def sql_tidy(value: str, digits: int = 6) -> str:
    return f"(CASE WHEN abs({value}) < {0.5 * 10.0**-digits:.{digits + 2}f} THEN 0.0 ELSE round({value}, {digits}) END)::DOUBLE"


#: The same tables in SQL, as the start of a WITH.
PIXELS = """pix AS (
  SELECT img, y, (i - 1)::INT AS x, e[i]::DOUBLE AS v
  FROM (SELECT vec_id // 64 AS img, (vec_id % 64)::INT AS y, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
), dims AS (
  SELECT vec_id // 64 AS img, (max(vec_id % 64) + 1)::INT AS h, max(len(embedding))::INT AS w FROM embeddings GROUP BY 1
)"""
PAIRS = PIXELS + """, pairs AS (SELECT img, y, x, v AS a, floor(v * 8 + 0.5) / 8 AS b FROM pix)"""
