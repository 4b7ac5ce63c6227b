"""Vector quantisation.

Vectors stay where they lie and the codebook goes to them: a small one as a literal, within the generated code's reach,
a larger one with the task, which compares blocks of vectors and codes by matrix products.  Such a codebook is a
parameter, held by the driver; one that is a table meets the vectors in ``assign_to_table``.  Training moves sums per
code, never vectors.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import nearest

Codebook = list[list[float]]
#: Codes up to which a codebook is a literal.
LITERAL = 64


def literal(codebook: Codebook) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in code]) for code in codebook])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def assign(vectors: DataFrame, codebook: Codebook, column: str = "embedding") -> DataFrame:
    """``vectors`` with code_id and d2 of the nearest code, by the rule of ``nearest``: of equals the first, null for
    vectors that are null, of another length or not finite; codes that aren't finite are never taken."""
    if not codebook:
        raise ValueError("a codebook has a code at least")
    sound = [(n, [float(x) for x in code]) for n, code in enumerate(codebook) if all(math.isfinite(x) for x in code)]
    if len(codebook) > LITERAL:
        return _assign_many(vectors, sound, column)
    vector = F.col(column).cast("array<double>")
    codes = F.array(*[F.struct(F.lit(n).alias("code_id"), F.array(*map(F.lit, code)).alias("code")) for n, code in sound])
    compared = lambda c: F.when(F.size(vector) == F.size(c["code"]), F.struct(squared_distance(vector, c["code"]).alias("d2"), c["code_id"].alias("code_id")))
    near = F.array_min(F.transform(codes, compared)) if sound else F.lit(None).cast("struct<d2:double,code_id:int>")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vectors.withColumn("_near", F.when(finite, near)).select(*vectors.columns, "_near.code_id", "_near.d2")


def _assign_many(vectors: DataFrame, codebook: list[tuple[int, list[float]]], column: str) -> DataFrame:
    """``assign`` for codebooks of any size that the driver holds, of codes with their numbers."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("code_id", T.IntegerType()), T.StructField("d2", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = nearest.Codes(pa.array([n for n, _ in codebook], pa.int64()), pa.array([c for _, c in codebook], pa.list_(pa.float64())))
        for batch in batches:
            ids, d2 = codes.find(batch.column(column))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids.cast(pa.int32()), d2], names=schema.names)

    return vectors.mapInArrow(run, schema)


def assign_to_table(vectors: DataFrame, codes: DataFrame, column: str = "embedding", chunk: int = nearest.CHUNK) -> DataFrame:
    """``assign`` for a codebook that is a table (code_id, centre) of any size: a blocked nearest-neighbour join."""
    return nearest.join(vectors, codes.select("code_id", F.col("centre").alias("value")), column, chunk=chunk)


def with_residuals(assigned: DataFrame, codes: DataFrame, column: str = "embedding") -> DataFrame:
    """``assigned`` with ``residual``: what the vector is apart from its code, null where it has none."""
    of = codes.select("code_id", F.col("centre").cast("array<double>").alias("_centre"))
    return assigned.join(of, "code_id", "left").select(*assigned.columns, residual(F.col(column).cast("array<double>"), F.col("_centre")).alias("residual"))


def lloyd_step(assigned: DataFrame, column: str = "embedding") -> DataFrame:
    """code_id, dim, centre, n: means of the vectors of each code."""
    flat = assigned.select("code_id", F.posexplode(F.col(column).cast("array<double>")).alias("dim", "x"))
    return flat.groupBy("code_id", "dim").agg(F.avg("x").alias("centre"), F.count("*").alias("n"))


def _draw(seed: int, number: int, key: str) -> Column:
    """A number in 0..1 from a hash of the key."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(number), key), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)


def _drawn_vector(vectors: DataFrame, seed: int, number: int, column: str, key: str) -> list[float]:
    row = vectors.agg(F.max_by(column, F.struct(_draw(seed, number, key), F.col(key)))).first()
    return [float(x) for x in row[0]]


def spread_start(vectors: DataFrame, k: int, seed: int, column: str = "embedding", key: str = "vec_id", rounds: int = 4) -> Codebook:
    """k starting codes far from each other, by oversampling: in each of a few passes every vector is drawn with a chance
    of 2 k times its share of the squared distances, some 2 k a pass; the candidates, weighed by the vectors that are
    nearest to them, are then thinned to k on the driver, each with a chance in proportion to weight and squared distance.
    """
    found = [_drawn_vector(vectors, seed, 0, column, key)]
    for n in range(1, rounds + 1):
        apart = assign(vectors, found, column)
        total = apart.agg(F.sum("d2")).first()[0]
        if not total:
            break
        drawn = apart.filter(_draw(seed, n, key) < 2.0 * k * F.col("d2") / total).select(key, column).orderBy(key)
        found += [[float(x) for x in r[column]] for r in drawn.toLocalIterator()]
    weight = np.zeros(len(found))
    for r in assign(vectors, found, column).groupBy("code_id").agg(F.count("*").alias("n")).collect():
        weight[r["code_id"]] = r["n"]
    points, random, book = np.array(found), np.random.default_rng(seed), []
    chance = weight.copy()
    for _ in range(k):
        if not chance.sum() > 0:  # fewer different vectors than codes
            chance = weight.copy()
        chosen = points[random.choice(len(points), p=chance / chance.sum())]
        book.append(chosen.tolist())
        chance = weight * np.min([((points - np.array(c)) ** 2).sum(axis=1) for c in book], axis=0)
    return book


def train(vectors: DataFrame, k: int, iterations: int = 20, seed: int = 1234, tolerance: float = 1e-6, column: str = "embedding", start: Codebook | None = None, key: str = "vec_id") -> Codebook:
    """Lloyd's iterations, a job each: counts, sums and squared distances per code.  An empty code becomes a drawn vector.
    What returns to the driver is the codebook, k rows."""
    book, before = start or spread_start(vectors, k, seed, column, key), None
    for n in range(iterations):
        value = F.col(column).cast("array<double>")
        means = [F.avg(F.get(value, F.lit(d))).alias(f"m{d}") for d in range(len(book[0]))]
        rows = assign(vectors, book, column).groupBy("code_id").agg(F.sum("d2").alias("_d2"), *means).collect()
        if not rows:
            return book
        inertia = sum(r["_d2"] for r in rows)
        for r in rows:
            book[r["code_id"]] = [r[f"m{d}"] for d in range(len(book[0]))]
        for code in set(range(len(book))) - {r["code_id"] for r in rows}:
            book[code] = _drawn_vector(vectors, seed, 1000 + n * len(book) + code, column, key)
        if before is not None and abs(before - inertia) <= tolerance * max(before, 1e-12):
            break
        before = inertia
    return book


# --- several codebooks ----------------------------------------------------------------------------------------------------


def quantize_by_table(vectors: DataFrame, tables: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` (table_id among their columns) with code_id and the offsets (vector - code) / scale, by the codebook of
    their table: ``tables`` has table_id, code_id, centre, scale.  A table is a row of the join, so it's bounded by what a
    row may hold; a vector of a missing table gets nulls."""
    rows = tables.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("code_id", F.col("centre").cast("array<double>").alias("centre"), F.col("scale").cast("array<double>").alias("scale")))).alias("_codes"))
    value = F.col(column).cast("array<double>")
    near = F.array_min(F.transform("_codes", lambda c: F.struct(squared_distance(value, c["centre"]).alias("d2"), c["code_id"].alias("code_id"), c["centre"].alias("centre"), c["scale"].alias("scale"))))
    joined = vectors.join(rows, "table_id", "left").withColumn("_near", near)
    offset = F.zip_with(residual(value, F.col("_near.centre")), F.col("_near.scale"), lambda d, s: d / s)
    return joined.select(*vectors.columns, F.col("_near.code_id").alias("code_id"), offset.alias("offsets"))


def dequantize_by_table(coded: DataFrame, tables: DataFrame) -> DataFrame:
    """``coded`` (table_id, code_id, offsets) with ``restored``: code + offsets * scale."""
    rows = tables.select("table_id", "code_id", F.col("centre").cast("array<double>").alias("_centre"), F.col("scale").cast("array<double>").alias("_scale"))
    joined = coded.join(rows, ["table_id", "code_id"], "left")
    value = F.zip_with("_centre", F.zip_with("offsets", "_scale", lambda o, s: o * s), lambda c, d: c + d)
    return joined.select(*coded.columns, value.alias("restored"))


def offsets(vector: Column, code: Column, scale: Column) -> Column:
    """Whole steps from the code, half to even, within -128..127; a scale of 0 counts as 1."""
    step = F.transform(scale, lambda s: F.when(s == 0, 1.0).otherwise(s))
    apart = F.zip_with(F.zip_with(vector, code, lambda v, c: v - c), step, lambda d, s: F.rint(d / s))
    return F.transform(apart, lambda o: F.least(F.greatest(o, F.lit(-128.0)), F.lit(127.0)).cast("int"))


def restored(code: Column, steps: Column, scale: Column) -> Column:
    step = F.transform(scale, lambda s: F.when(s == 0, 1.0).otherwise(s))
    return F.zip_with(code, F.zip_with(steps, step, lambda o, s: o * s), lambda c, d: c + d)


def residual(vector: Column, code: Column) -> Column:
    return F.zip_with(vector, code, lambda v, c: v - c)


def pack_codebook(book: Codebook) -> bytes:
    """Counts and single-precision values, little-endian, code by code."""
    return struct.pack("<II", len(book), len(book[0])) + b"".join(struct.pack(f"<{len(c)}f", *c) for c in book)


def unpack_codebook(raw: bytes) -> Codebook:
    k, d = struct.unpack_from("<II", raw)
    if len(raw) != 8 + 4 * k * d:
        raise ValueError("a codebook's size is wrong")
    values = struct.unpack_from(f"<{k * d}f", raw, 8)
    return [list(values[i * d : (i + 1) * d]) for i in range(k)]
