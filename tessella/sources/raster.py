"""Rasters as tables: narrow (a row per pixel), wide (a row per image), and images from files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
ROWS = 64


def vector_pixels(vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """img, y, x, v: every ``rows`` vectors, by vec_id, are an image, a vector a row of it."""
    flat = vectors.select(F.expr(f"vec_id div {rows}").alias("img"), (F.col("vec_id") % rows).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return flat.withColumn("v", F.col("v").cast("double"))


def vector_dims(vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """img, h, w: one row per image, without a look at the pixels."""
    return vectors.groupBy(F.expr(f"vec_id div {rows}").alias("img")).agg(
        (F.max(F.col("vec_id") % rows) + 1).cast("int").alias("h"), F.max(F.size("embedding")).cast("int").alias("w")
    )


def vector_images(vectors: DataFrame, rows: int = ROWS, least: int = 0) -> DataFrame:
    """img, h, w, data: the images of ``vector_pixels`` row by row, with ``least`` rows and columns at least; null where there
    is no pixel.  An image is one row, as in ``wide``."""
    lines = vectors.select(F.expr(f"vec_id div {rows}").alias("img"), (F.col("vec_id") % rows).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("line"))
    found = lines.groupBy("img").agg(F.greatest(F.max("y") + 1, F.lit(least)).alias("h"), F.greatest(F.max(F.size("line")), F.lit(least)).alias("w"), F.array_sort(F.collect_list(F.struct("y", "line"))).alias("_lines"))
    no_pixel = F.lit(None).cast("double")

    def line(y: Column) -> Column:
        own = F.get(F.filter("_lines", lambda one: one["y"] == y), 0)["line"]
        return F.slice(F.concat(F.coalesce(own, F.array().cast("array<double>")), F.array_repeat(no_pixel, F.col("w"))), F.lit(1), F.col("w"))

    return found.select("img", "h", "w", F.flatten(F.transform(F.sequence(F.lit(0), F.col("h") - 1), line)).alias("data"))


def wide(pixels: DataFrame) -> DataFrame:
    """img, h, w, data: an image's values row by row.  An image is one row, so it's bounded by what a row may hold."""
    flat = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return pixels.groupBy("img").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.transform(flat, lambda p: p["v"]).alias("data"))


def scan_images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path and size of the image files below a folder, by suffix; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES)).select("path", F.col("length").alias("size"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """The luma of 8-bit colours, rounded to 8 bits, as a value in -1..1."""
    y = F.floor(0.299 * red + 0.587 * green + 0.114 * blue + 0.5)
    return y / 127.5 - 1


def load_luma(spark: SparkSession, folder: str) -> DataFrame:
    """path, h, w, data: the luma planes of the images that Spark's image reader decodes (BGR, BGRA or grey)."""
    image = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(folder).select("image.*")
    at = lambda i, k: F.conv(F.hex(F.substring("data", i * F.col("nChannels") + k + 1, F.lit(1))), 16, 10).cast("int")
    places = F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)
    grey = F.transform(places, lambda i: at(i, 0) / 127.5 - 1)
    colour = F.transform(places, lambda i: luma(at(i, 2), at(i, 1), at(i, 0)))
    return image.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.when(F.col("nChannels") == 1, grey).otherwise(colour).alias("data"))


def png(height: int, width: int, grey: bytes) -> bytes:
    """A grey image of 8 bits as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + grey[y * width : (y + 1) * width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def as_png(images: DataFrame) -> DataFrame:
    """name, blob (a PNG file) of wide images (name, h, w, u8: an array of 0..255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = batch.column("h").to_pylist(), batch.column("w").to_pylist()
            for i in range(batch.num_rows):
                grey = batch.column("u8")[i].values.to_numpy().astype("uint8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("name").slice(i, 1), pa.array([png(h[i], w[i], grey)], pa.binary())], names=["name", "blob"])

    return images.select("name", "h", "w", "u8").mapInArrow(run, "name string, blob binary")


def to_u8(v: Column) -> Column:
    """A value in -1..1 as 0..255, cut off."""
    return F.floor((F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) + 1) * 127.5).cast("int")
