"""Table functions for SQL: tiles of an image and records of a coded blob, to be exploded by LATERAL.

``register(spark)`` names them ``tile_rects`` and ``unpack_records``.  What they return, and whether their arguments make
sense, is settled when a query is analysed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import bitstream

_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "binary": T.BinaryType(), "string": T.StringType()}


def _schema(fields: str) -> T.StructType:
    """A schema from ``name type, name type``; a query is analysed where there is no session to parse it."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])


RECTS = "tile_id int, y0 int, x0 int, y1 int, x1 int"


def _constant(argument: AnalyzeArgument | None, what: str, default):
    if argument is None:
        return default
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{what} must be a constant")
    return argument.value


def axis_starts(length: int, size: int, overlap: int, clipped: bool) -> list[int]:
    """Starts of tiles on an axis: the grid of the encoder (clipped), or of the decoder."""
    stride = size - overlap
    if clipped:
        return list(range(0, max(length - overlap, 1), stride))
    last = max(length - size, 0)
    return sorted({*range(0, last + 1, stride), last})


@udtf
class TileRects:
    """``tile_rects(h, w, size, overlap, clipped)``: the rectangles of an image's tiles; size, overlap and clipped (false
    unless given) are constants.  No rows for an image without height or width."""

    @staticmethod
    def analyze(h: AnalyzeArgument, w: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, clipped: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, side in (("h", h), ("w", w)):
            if not isinstance(side.dataType, (T.IntegralType, T.NullType)):
                raise ValueError(f"{name} must be a whole number")
        if not 0 <= _constant(overlap, "overlap", 0) < _constant(size, "size", 0):
            raise ValueError("0 <= overlap < size")
        _constant(clipped, "clipped", False)
        return AnalyzeResult(_schema(RECTS))

    def eval(self, h, w, size, overlap, clipped=False):
        if h is None or w is None or h < 1 or w < 1:
            return
        ys, xs = (axis_starts(n, size, overlap, clipped) for n in (h, w))
        for i, y in enumerate(ys):
            for j, x in enumerate(xs):
                yield i * len(xs) + j, y, x, min(y + size, h), min(x + size, w)


@udtf
class UnpackRecords:
    """``unpack_records(blob, old)``: header sizes and fields of each record of a coded image; for a blob that can't be read
    one row with its error.  ``old``, a constant: the older format."""

    @staticmethod
    def analyze(blob: AnalyzeArgument, old: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(blob.dataType, (T.BinaryType, T.NullType)):
            raise ValueError("blob must be binary")
        _constant(old, "old", False)
        return AnalyzeResult(_schema(bitstream.RECORD_FIELDS))

    def eval(self, blob, old=False):
        yield from bitstream.rows_of_blob(None if blob is None else bytes(blob), old)


def register(spark: SparkSession) -> None:
    spark.udtf.register("tile_rects", TileRects)
    spark.udtf.register("unpack_records", UnpackRecords)
