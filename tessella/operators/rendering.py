"""Rendering of patterns: a projection where the pattern is a formula, a kernel per image where it isn't."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import composite as _composite  # noqa: F401  registers its kernel
from ..functions.noise import KERNELS, grid
from ..functions.params import from_vector, to_vector, validate
from ..functions.patterns import PATTERNS, Pattern, get, pixels, rendered


def jobs(spark: SparkSession, name: str, samples: list[dict], seeds: list[int]) -> DataFrame:
    """sample_id, name, params (in the pattern's order), seed: one row per image to render."""
    pattern = get(name)
    rows = [(n, name, to_vector(pattern, p), s) for n, (p, s) in enumerate(zip(samples, seeds, strict=True))]
    return spark.createDataFrame(rows, "sample_id int, name string, params array<double>, seed long")


def render_formula(pattern: Pattern, values: dict, frame: DataFrame, height: int, width: int) -> DataFrame:
    """The rows of ``frame`` with py, px and v."""
    validate(pattern, values)
    literals = {p.name: F.lit(float(values[p.name])) for p in pattern.params}
    grown = pixels(frame, height, width).withColumns(literals)
    return grown.select(*frame.columns, "py", "px", rendered(pattern).alias("v"))


def render_images(frame: DataFrame, height: int, width: int) -> DataFrame:
    """``frame`` (as of ``jobs``) with data: the image's values, row by row.  Patterns that are kernels.

    A task renders its rows one image at a time, so its memory is that of one image.
    """
    schema = T.StructType([*frame.schema.fields, T.StructField("data", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = grid(height, width)
        for batch in batches:
            for i, row in enumerate(batch.select(["name", "params", "seed"]).to_pylist()):
                pattern = get(row["name"])
                values = from_vector(pattern, row["params"])
                image = np.broadcast_to(KERNELS[row["name"]](x, y, values, np.int64(row["seed"])), (height, width))
                data = pa.ListArray.from_arrays([0, height * width], np.ascontiguousarray(image).ravel())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, data], names=schema.names)

    return frame.mapInArrow(run, schema)


def _whole(pattern: Pattern) -> Column:
    """The image of a formula, row by row, from the columns _params, _ys and _xs: a lambda for each parameter, one for y
    and one for x.

    Spark compiles no lambdas, so the formulas of all patterns in one plan don't add up to code that the JVM won't compile.
    """
    sql = f"flatten(transform(_ys, y -> transform(_xs, x -> CAST({pattern.formula} AS DOUBLE))))"
    for n, p in reversed(list(enumerate(pattern.params))):
        sql = f"element_at(transform(array(get(_params, {n})), {p.name} -> {sql}), 1)"
    return F.expr(sql)


def render_formulas(frame: DataFrame, height: int, width: int) -> DataFrame:
    """``frame`` (as of ``jobs``) with data, for patterns that are formulas: each row takes the image of its pattern's
    formula where it lies, so pixels are neither rows nor shuffled."""
    formulas = [p for p in PATTERNS.values() if not p.noise]
    rows = frame.select(F.struct(*frame.columns).alias("_row"), F.col("name").alias("_name"), F.col("params").alias("_params"), *[F.lit([-1.0 + 2.0 * k / (n - 1) if n > 1 else -1.0 for k in range(n)]).alias(a) for a, n in (("_ys", height), ("_xs", width))])
    data = F.coalesce(*[F.when(F.col("_name") == p.name, _whole(p)) for p in formulas])
    return rows.select(*[F.col("_row")[c].alias(c) for c in frame.columns], data.alias("data"))


def render(frame: DataFrame, height: int, width: int) -> DataFrame:
    """``frame`` (name, params, seed and what else there is) with data: the images of patterns of either kind."""
    formula = F.col("name").isin([p.name for p in PATTERNS.values() if not p.noise])
    return render_formulas(frame.filter(formula), height, width).unionByName(render_images(frame.filter(~formula), height, width))


def render_tiles(tiles: DataFrame, name: str, samples: list[dict], seeds: list[int], height: int, width: int) -> DataFrame:
    """Every row of ``tiles`` with every sample of a pattern: their columns, and those of ``jobs`` with data.

    The samples are a literal that each tile explodes into; what a tile shows plays no part.
    """
    pattern = get(name)
    each = F.array(*[F.struct(F.lit(n).alias("sample_id"), F.lit(name).alias("name"), F.array(*map(F.lit, to_vector(pattern, p))).cast("array<double>").alias("params"), F.lit(s).cast("long").alias("seed")) for n, (p, s) in enumerate(zip(samples, seeds, strict=True))])
    return render(tiles.select("*", F.inline(each)), height, width)


def narrow(images: DataFrame, width: int) -> DataFrame:
    """A row per pixel of images: their columns without data, py, px, v."""
    keep = [c for c in images.columns if c != "data"]
    flat = images.select(*keep, F.posexplode("data").alias("_at", "v"))
    return flat.select(*keep, F.floor(F.col("_at") / width).cast("int").alias("py"), (F.col("_at") % width).cast("int").alias("px"), "v")


def audit(images: DataFrame) -> DataFrame:
    """Per pattern: images, least, largest and mean value, whether all are finite and within -1..1, and a digest.

    Each image is summed up where it lies, so pixels aren't rows.
    """
    inside = F.forall("data", lambda v: (v >= -1) & (v <= 1))  # NaN and infinity fail it
    total = F.aggregate("data", F.lit(0.0), lambda s, v: s + v)
    each = images.select("name", "sample_id", F.array_min("data").alias("low"), F.array_max("data").alias("high"), total.alias("total"), F.size("data").alias("n"), inside.alias("inside"), F.xxhash64("sample_id", "data").alias("digest"))
    return each.groupBy("name").agg(
        F.countDistinct("sample_id").alias("images"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.bool_and("inside").alias("sound"), F.bit_xor("digest").alias("digest"),
    )
