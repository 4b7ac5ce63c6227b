"""Command line: encode, decode, metrics, audit.  ``spark-submit tessella/cli.py <command> ...`` or ``python -m tessella.cli``."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import params
from .operators import bitstream, codec, metrics, workflow
from .sources import raster, streams


def _images(spark: SparkSession, folder: str) -> DataFrame:
    """Luma planes of a folder, numbered by path."""
    planes = workflow.with_ids(raster.load_luma(spark, folder))
    return planes.select(F.xxhash64("path").alias("img"), "id", "h", "w", "data")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """name, length of the files of a suffix below a folder, which needn't be there; contents aren't read."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "name string, length long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(folder)
    return files.select(workflow.stem(F.col("path")).alias("name"), "length")


def _outputs(spark: SparkSession, folder: str) -> DataFrame:
    """name, size, sha256, bpp, error of the coded files in a folder, each read and parsed: a file of another kind, cut
    short or damaged has an error."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "name string, size long, sha256 string, bpp double, error string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.img").load(folder)
    blobs = files.select(workflow.stem(F.col("path")).alias("name"), F.col("content").alias("blob"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    parsed = bitstream.parse_images(blobs, "name").groupBy("name").agg(F.max(F.col("width").cast("long") * F.col("height")).alias("pixels"), F.min("error").alias("error"))
    return blobs.select("name", "size", "sha256").join(parsed, "name").select("name", "size", "sha256", (8.0 * F.col("size") / F.greatest("pixels", F.lit(1))).alias("bpp"), "error")


def encode(spark: SparkSession, args: argparse.Namespace) -> int:
    """Codes what has no sound output yet, ``--batch`` items at a time; a batch puts its outputs in place, then appends an
    event for each of its items (digest, size, rate, seconds, error).  An item that fails is an event, a run that is
    stopped goes on with the items that have no sound output.  1 if an item failed, 2 if there is none."""
    given = json.loads(Path(args.config).read_text()) if args.config else {}
    given |= {k: v for k, v in (("tile", args.tile), ("overlap", args.overlap), ("lambda", args.rate_weight), ("alpha", args.mix)) if v is not None}
    run = workflow.RunConfig.merged(given)
    files = raster.scan_images(spark, args.folder)
    if files.isEmpty():
        print("no images", file=sys.stderr)
        return 2
    manifest = workflow.plan(files, args.out)
    if args.only_plan:
        manifest.write.mode("overwrite").json(f"{args.out}/manifest")
        return 0
    streams.register(spark)
    config = codec.CodecConfig(tile=run.tile, overlap=run.overlap, rate_weight=run.rate_weight, mix=run.mix, seed=args.seed, metric=args.metric, payload=args.payload, bits=args.bits)
    sound = _outputs(spark, args.out).filter("error is null").select("name")
    events = f"{args.out}/events/{uuid.uuid4().hex}"
    # What is to do is written down: it must not change as outputs come.
    manifest.join(sound, F.col("id") == F.col("name"), "left_anti").select("id").write.json(f"{events}/todo")
    todo = spark.read.schema("id string").json(f"{events}/todo")
    batches = max(1, -(-todo.count() // args.batch))
    images = _images(spark, args.folder)
    for n in range(batches):
        _encode_batch(todo.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == n), images, config, args.out, f"{events}/batch-{n}")
    told = spark.read.schema("id string, seconds double, error string").json(f"{events}/batch-*")
    state = manifest.drop("state").join(_outputs(spark, args.out), F.col("id") == F.col("name"), "left").withColumnRenamed("error", "damage").join(told, "id", "left")
    done = F.col("name").isNotNull() & F.col("damage").isNull() & F.col("error").isNull()
    known = [F.when(done, F.col(c)).alias(c) for c in ("size", "sha256", "bpp")]
    why = F.when(~done, F.coalesce("error", "damage", F.lit("it has no output")))
    state.select("id", "in", "out", F.when(done, "done").otherwise("error").alias("state"), *known, "seconds", why.alias("error")).write.mode("overwrite").json(f"{args.out}/manifest")
    (counts,) = workflow.summary(read_manifest(spark, args.out)).collect()
    print(json.dumps(counts.asDict()))
    return 1 if counts["errors"] else 0


def _encode_batch(todo: DataFrame, images: DataFrame, config: codec.CodecConfig, out: str, events: str) -> None:
    """Outputs and events of one batch; done again, it overwrites both."""
    chosen = images.join(todo, "id")
    coded = codec.encode_items(chosen.select("img", "h", "w", "data"), config).join(chosen.select("img", "id"), "img").persist()
    coded.filter("blob is not null").select(F.col("id").alias("name"), "blob").write.format("tiled_images").mode("append").save(out)
    of = coded.select("id", F.octet_length("blob").cast("long").alias("size"), F.sha2("blob", 256).alias("sha256"), "bpp", "seconds", "error", F.lit(True).alias("read"))
    rows = todo.join(of, "id", "left").withColumn("error", F.when(F.col("read").isNull(), "the file isn't an image that can be read").otherwise(F.col("error")))
    rows.select("id", F.when(F.col("error").isNull(), "done").otherwise("error").alias("state"), "size", "sha256", "bpp", "seconds", "error").write.mode("overwrite").json(events)
    coded.unpersist()


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest below a folder: id, in, out, state, and what a run has written of each item."""
    return spark.read.schema("id string, `in` string, out string, state string, size long, sha256 string, bpp double, seconds double, error string").json(f"{folder}/manifest")


def decode(spark: SparkSession, args: argparse.Namespace) -> int:
    """Draws every coded file by its own header, as a PNG file or as pixels; 1 if a file can't be decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.img").option("recursiveFileLookup", "true").load(args.folder)
    blobs = files.select(F.xxhash64("path").alias("img"), workflow.stem(F.col("path")).alias("name"), F.col("content").alias("blob"))
    both = blobs.select("img", "blob")
    bad = codec.problems(both, by=args.by).persist()
    failed = 0
    for row in bad.join(blobs.select("img", "name"), "img").select("name", "error").orderBy("name").toLocalIterator():
        failed += 1
        print(f"{row['name']}: {row['error']}", file=sys.stderr)
    sound = both.join(bad.select("img"), "img", "left_anti") if failed else both
    pixels = codec.decode(sound, by=args.by).withColumn("u8", raster.to_u8(F.col("v"))).join(blobs.select("img", "name"), "img")
    if args.format == "parquet":
        pixels.select("name", "y", "x", "v", "u8").write.mode("overwrite").parquet(args.out)
    else:
        streams.register(spark)
        line = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "u8"))), lambda p: p["u8"])
        wide = pixels.groupBy("name").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), line.alias("u8"))
        raster.as_png(wide).write.format("tiled_images").option("suffix", ".png").mode("append").save(args.out)
    return 1 if failed else 0


def _values(spark: SparkSession, path: str, images: bool) -> DataFrame:
    """img (the name), y, x, v of a folder of images or a table of pixels (name, y, x, v)."""
    if not images:
        return spark.read.parquet(path).select(F.col("name").alias("img"), "y", "x", "v")
    flat = _images(spark, path).select("id", "w", F.posexplode("data").alias("at", "v"))
    return flat.select(F.col("id").alias("img"), F.floor(F.col("at") / F.col("w")).cast("int").alias("y"), (F.col("at") % F.col("w")).cast("int").alias("x"), "v")


def measure(spark: SparkSession, args: argparse.Namespace) -> int:
    """Images of two folders, or pixels of two tables, compared by name; the rate is that of the coded files, if named."""
    a, b = (_values(spark, p, args.images) for p in (args.reference, args.made))
    pairs = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), ["img", "y", "x"])
    both = metrics.psnr(pairs).join(metrics.ssim(pairs), "img")
    if args.coded:
        sizes = pairs.groupBy("img").agg(F.count("*").alias("n")).join(_files(spark, args.coded, "img"), F.col("img") == F.col("name"), "left")
        both = both.join(sizes.select("img", (8.0 * F.col("length") / F.col("n")).alias("bpp")), "img")
    else:
        both = both.withColumn("bpp", F.lit(None).cast("double"))
    rows = both.select(F.col("img").alias("ref"), F.col("img").alias("hat"), "psnr", "ssim", "bpp")
    workflow.metrics_rows(rows).write.mode("overwrite").option("header", True).csv(args.out)
    return 0


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    writer = params.catalogue(spark).withColumn("choices", F.array_join("choices", "|")).coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(args.out) if args.format == "csv" else writer.json(args.out)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella")
    commands = top.add_subparsers(required=True)
    p = commands.add_parser("encode")
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--config")
    p.add_argument("--tile", type=int)
    p.add_argument("--overlap", type=int)
    p.add_argument("--lambda", dest="rate_weight", type=float)
    p.add_argument("--alpha", dest="mix", type=float)
    p.add_argument("--seed", type=int, default=1234)
    p.add_argument("--metric", default="ssim")
    p.add_argument("--payload", choices=("coded", "raw"), default="coded")
    p.add_argument("--bits", choices=("exact", "table"), default="exact")
    p.add_argument("--batch", type=int, default=1000)
    p.add_argument("--only-plan", action="store_true")
    p.set_defaults(run=encode)
    p = commands.add_parser("decode")
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--by", choices=("seed", "symbols"), default="seed")
    p.add_argument("--format", choices=("png", "parquet"), default="png")
    p.set_defaults(run=decode)
    p = commands.add_parser("metrics")
    p.add_argument("reference")
    p.add_argument("made")
    p.add_argument("out")
    p.add_argument("--images", action="store_true")
    p.add_argument("--coded")
    p.set_defaults(run=measure)
    p = commands.add_parser("audit")
    p.add_argument("out")
    p.add_argument("--format", choices=("csv", "json"), default="csv")
    p.set_defaults(run=audit)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    return args.run(spark or SparkSession.builder.appName("tessella").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
