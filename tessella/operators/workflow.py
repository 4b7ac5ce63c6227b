"""Batch work: a manifest of items, what is left to do, runs that record errors, names and summaries.

A run is a job: an item that fails gives a row with its error, and a resumed run leaves out what a former one has
written.  Spark's task retries and output commits stand for locks and checkpoints.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunConfig:
    tile: int = 256
    overlap: int = 24
    rate_weight: float = 0.02
    mix: float = 0.7

    @classmethod
    def merged(cls, given: dict | None = None, environment: dict | None = None, prefix: str = "TESSELLA_") -> RunConfig:
        """Defaults, then what is given (``lambda`` is the rate's weight), then the environment."""
        environment = os.environ if environment is None else environment
        alias = {"lambda": "rate_weight", "alpha": "mix"}
        out = cls()
        values = {alias.get(k, k): v for k, v in (given or {}).items()}
        for name in ("tile", "overlap", "rate_weight", "mix"):
            value = environment.get(prefix + name.upper(), values.get(name))
            if value is not None:
                out = replace(out, **{name: type(getattr(out, name))(value)})
        return out


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def with_ids(files: DataFrame) -> DataFrame:
    """``files`` (path) with id: the name without its suffix, and where files share it also a digest of the path."""
    shared = files.groupBy(stem(F.col("path")).alias("_stem")).agg(F.count("*").alias("_files"))
    named = files.withColumn("_stem", stem(F.col("path"))).join(shared, "_stem")
    path = F.regexp_replace("path", "^file:/+", "/")  # Spark's readers write a local path in two ways
    own = F.when(F.col("_files") == 1, F.col("_stem")).otherwise(F.concat("_stem", F.lit("-"), F.substring(F.sha2(path, 256), 1, 8)))
    return named.select(*files.columns, own.alias("id"))


def plan(files: DataFrame, out_folder: str, suffix: str = "img") -> DataFrame:
    """id, in, out, state: one item per file, all to do; no two items have one output."""
    out = F.concat(F.lit(out_folder.rstrip("/") + "/"), F.col("id"), F.lit(f".{suffix}"))
    return with_ids(files).select("id", F.col("path").alias("in"), out.alias("out"), F.lit("todo").alias("state"))


def left_to_do(manifest: DataFrame, written: DataFrame) -> DataFrame:
    """Items whose output (column ``out`` of ``written``) isn't there."""
    return manifest.join(written.select("out").distinct(), "out", "left_anti").select(*manifest.columns)


def run(items: DataFrame, work: Callable[[dict], bytes], pixels: Callable[[dict], int] | None = None) -> DataFrame:
    """id, state (done or error), blob, size, sha256, bpp, error: ``work`` of each item's row, failures caught."""
    names = ["id", "state", "blob", "size", "error", "pixels"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    blob = work(row)
                    out = [str(row["id"]), "done", blob, len(blob), None, pixels(row) if pixels else None]
                except Exception as error:  # the item's failure is its result
                    out = [str(row["id"]), "error", None, None, f"{type(error).__name__}: {error}", None]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds)], names=names)

    done = items.mapInArrow(task, "id string, state string, blob binary, size long, error string, pixels long")
    return done.select("id", "state", "blob", "size", F.sha2("blob", 256).alias("sha256"), (8.0 * F.col("size") / F.greatest("pixels", F.lit(1))).alias("bpp"), "error")


def summary(results: DataFrame) -> DataFrame:
    """total, done, errors."""
    count = lambda s: F.sum((F.col("state") == s).cast("long"))
    return results.agg(F.count("*").alias("total"), F.coalesce(count("done"), F.lit(0)).alias("done"), F.coalesce(count("error"), F.lit(0)).alias("errors"))


def output_name(dataset: Column, image: Column, codec: Column, quality: Column, bpp: Column, seed: Column, suffix: str = "img", version: int = 15) -> Column:
    return F.format_string(f"%s_%s_%s__v{version}__q%s__%.3f__s%d.{suffix}", dataset, image, codec, quality.cast("string"), bpp.cast("double"), seed.cast("long"))


def metrics_rows(scores: DataFrame) -> DataFrame:
    """ref, hat, psnr, ssim, bpp as the text of a CSV row."""
    return scores.select("ref", "hat", F.format_string("%.3f", "psnr").alias("psnr"), F.format_string("%.5f", "ssim").alias("ssim"), F.format_string("%.4f", "bpp").alias("bpp"))


def rate_curve(rows: DataFrame) -> DataFrame:
    """bpp, psnr of the rows in which both are numbers."""
    numbers = rows.select(*[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("bpp", "psnr")])
    return numbers.filter("bpp is not null and psnr is not null").orderBy("bpp", "psnr")
