"""A join of vectors with the nearest rows of a table of codes, both of any size.

Codes are cut into chunks by a hash of their id, vectors are dealt over tasks.  A task holds one chunk and streams its
vectors past it, comparing blocks by matrix products; a vector goes once to each chunk, a code once to each deal, and the
least of the chunks is a partial minimum.  Nothing is held by the driver.

One rule, whatever the sizes: a vector is compared with the sound codes of its length, by the sum of squared differences
in the order of the dimensions, in doubles; of equals the code with the least id is taken.  A vector that is null, holds
null, NaN or infinity, or has no code of its length has no nearest code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes of a chunk, on the average, and numbers that a task compares at a time.
CHUNK, AT_ONCE = 16_384, 4_000_000
#: Deals for each shuffle partition, so that partitions come out alike.
DEALS = 4


def sound_rows(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of this length whose numbers are all finite, and these rows as a matrix."""
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == width)
    some = lists.take(pa.array(at)).flatten().cast(pa.float64())
    rows = some.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), width)
    fine = np.isfinite(rows).all(axis=1)
    return at[fine], rows[fine]


def apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Squared distances row by row, summed in the order of the dimensions."""
    total = np.zeros(len(one))
    for d in range(one.shape[1]):
        step = one[:, d] - two[:, d]
        total += step * step
    return total


def closest(vectors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the first of the nearest codes (in order of their ids), and its squared distance.

    The expansion |c|^2 - 2 v c finds the codes that rounding leaves in question; these are compared by ``apart``.
    """
    norms, width = (codes**2).sum(axis=1), vectors.shape[1]
    near, least = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
    rows = max(1, AT_ONCE // max(1, len(codes)))
    for start in range(0, len(vectors), rows):
        part = vectors[start : start + rows]
        rough = norms - 2 * (part @ codes.T)
        slack = 1e-14 * (width + 4) * ((part**2).sum(axis=1) + norms.max())
        i, j = np.nonzero(rough <= (rough.min(axis=1) + slack)[:, None])
        exact = np.concatenate([apart(part[i[at : at + AT_ONCE // 64]], codes[j[at : at + AT_ONCE // 64]]) for at in range(0, len(i), AT_ONCE // 64)])
        order = np.lexsort((j, exact, i))
        first = order[np.append(True, i[order][1:] != i[order][:-1])]
        near[start + i[first]], least[start + i[first]] = j[first], exact[first]
    return near, least


class Codes:
    """A chunk of codes, by length and in order of their ids."""

    def __init__(self, ids: pa.Array, lists: pa.ListArray):
        number = ids.to_numpy(zero_copy_only=False)
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)).tolist():
            if width >= 0:
                at, rows = sound_rows(lists, width)
                order = np.argsort(number[at], kind="stable")
                if len(at):
                    self.of[width] = number[at][order], rows[order]

    def find(self, lists: pa.ListArray) -> list[pa.Array]:
        """code_id and d2, null where a vector has none."""
        ids, d2, none = np.zeros(len(lists), dtype=np.int64), np.zeros(len(lists)), np.ones(len(lists), dtype=bool)
        for width, (number, codes) in self.of.items():
            at, rows = sound_rows(lists, width)
            if len(at):
                near, least = closest(rows, codes)
                ids[at], d2[at], none[at] = number[near], least, False
        return [pa.array(ids, mask=none), pa.array(d2, mask=none)]


def join(vectors: DataFrame, codes: DataFrame, column: str, load: Callable[[pa.Array, pa.ListArray], object] = Codes, found: str = "code_id long, d2 double", chunk: int = CHUNK) -> DataFrame:
    """``vectors`` with the columns ``found``, of the code (code_id, value) whose values there come first.

    ``load`` makes what a task holds of a chunk's codes; its ``find`` gives those columns for a list array of vectors, the
    code's id first and its distance second.  Further columns are numbers and are summed over the chunks.
    """
    wanted = T._parse_datatype_string(found)
    chunks = max(1, -(-codes.count() // chunk))
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = max(1, -(-DEALS * partitions // chunks))
    kept = [c for c in vectors.columns if c not in wanted.names]
    number = F.monotonically_increasing_id()
    of_codes = codes.select(
        F.pmod(F.xxhash64("code_id"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.lit(0).alias("kind"),
        F.col("code_id").cast("long").alias("id"), F.col("value").cast("array<double>").alias("value"), F.lit(None).cast(vectors.select(F.struct(*kept).alias("r")).schema["r"].dataType).alias("row"),
    )
    numbered = vectors.select(number.alias("id"), F.col(column).cast("array<double>").alias("value"), F.struct(*kept).alias("row")).withColumn("deal", F.pmod("id", F.lit(deals)).cast("int"))
    of_vectors = numbered.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # The row travels with one of the vector's copies.
    of_vectors = of_vectors.select("chunk", "deal", F.lit(1).alias("kind"), "id", "value", F.when(F.col("chunk") == 0, F.col("row")).alias("row"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("row", of_vectors.schema["row"].dataType), *wanted.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk_, deal, kind = (batch.column(i).to_numpy() for i in range(3))
            change = (chunk_[1:] != chunk_[:-1]) | (deal[1:] != deal[:-1]) | (kind[1:] != kind[:-1])
            cuts = np.flatnonzero(np.append(True, change)).tolist()
            for start, end in zip(cuts, [*cuts[1:], batch.num_rows]):
                if (key := (chunk_[start], deal[start])) != current:
                    current, parts, held = key, [], None
                part = batch.slice(start, end - start)
                if kind[start] == 0:
                    parts.append(part.select(["id", "value"]))
                    continue
                if held is None:
                    empty = part.slice(0, 0).select(["id", "value"])
                    some = pa.Table.from_batches(parts or [empty]).combine_chunks().to_batches() or [empty]
                    held = load(some[0].column("id"), some[0].column("value"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), *held.find(part.column("value"))], schema=pa.schema([pa.field("id", pa.int64()), part.schema.field("row"), *_fields(wanted)]))

    met = of_codes.union(of_vectors).repartition(partitions, "chunk", "deal").sortWithinPartitions("chunk", "deal", "kind").mapInArrow(run, schema)
    if chunks > 1:
        first, second, *more = wanted.names
        best = F.min(F.when(F.col(first).isNotNull(), F.struct(F.col(second).alias("b"), F.col(first).alias("a")))).alias("_best")
        met = met.groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), best, *[F.sum(c).cast(wanted[c].dataType).alias(c) for c in more])
        met = met.select("row", F.col("_best.a").alias(first), F.col("_best.b").alias(second), *more)
    return met.select(*[F.col("row")[c].alias(c) for c in kept], *wanted.names)


def _fields(wanted: T.StructType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(wanted))
