"""The image codec: search the best stripes of each tile, code them, frame the image; and back."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seeds import tile_seed
from . import bitstream, entropy, metrics, search, tiling


@dataclass(frozen=True)
class CodecConfig:
    tile: int = 256
    overlap: int = 24
    rate_weight: float = 0.02
    mix: float = 0.7
    metric: str = "ssim"
    seed: int = 1234
    payload: str = "coded"
    #: The rate of a candidate: "table", the sum of -log2 of its symbols' shares, or "exact", the bits of its payload.
    bits: str = "exact"
    table_id: str = "v15_default"
    table: entropy.Table = entropy.UNIFORM

    def __post_init__(self):
        if not (self.tile > 0 and 0 <= self.overlap < self.tile):
            raise ValueError("0 <= overlap < tile")
        if not (self.rate_weight >= 0 and 0 <= self.mix <= 1):
            raise ValueError("the rate's weight is at least 0, the mix is 0 to 1")
        if self.metric != "mixed":
            metrics.get(self.metric)
        if self.payload not in ("coded", "raw") or self.bits not in ("table", "exact"):
            raise ValueError("unknown payload or rate")


def distortion(tile: np.ndarray, made: np.ndarray, metric: str | metrics.Metric, mix: float) -> np.ndarray:
    """Of each image of ``made`` from the tile, by a metric or ``mixed``: structure and error."""
    if metric == "mixed":
        return mix * distortion(tile, made, "ssim", mix) + (1 - mix) * distortion(tile, made, "mse", mix)
    return (metrics.get(metric) if isinstance(metric, str) else metric).distance(tile, made)


def draw(height: int, width: int, freq: int, ang: int, phase: int) -> np.ndarray:
    x, y = (np.linspace(-1, 1, n) if n > 1 else np.array([-1.0]) for n in (width, height))
    turn = np.radians(ang % 180)
    return np.clip(np.cos(2 * np.pi * freq * (x[None, :] * np.cos(turn) + y[:, None] * np.sin(turn)) + np.radians(phase % 360)), -1, 1)


def symbols(seed: int, steps: list[int]) -> bytes:
    """A tile's symbols, for generator and table 0."""
    return bytes([entropy.TAG, 0, 0, 0, 0, 0, *seed.to_bytes(4, "little"), len(steps), *[s + 128 for s in steps]])


def search_tiles(images: DataFrame, config: CodecConfig) -> DataFrame:
    """img, tile_id, seed, cand_id, steps, d, bits, payload, error, seconds: the best candidate of each tile of wide images.

    An image explodes into its tiles, which carry their own values, so tiles spread over tasks.  All candidates of a
    tile are scored in one array.  A tile that can't be coded has an error and nothing else.
    """
    rect = tiling.tiles(images.select("img", "h", "w", "data"), config.tile, config.overlap, clipped=True)
    rows = F.transform(F.sequence(F.col("y0"), F.col("y1") - 1), lambda y: F.slice("data", y * F.col("w") + F.col("x0") + 1, F.col("x1") - F.col("x0")))
    cut = rect.select("img", "tile_id", tile_seed(F.lit(config.seed), F.col("tile_id")).alias("seed"), (F.col("y1") - F.col("y0")).alias("th"), (F.col("x1") - F.col("x0")).alias("tw"), F.flatten(rows).alias("data"))
    cut = cut.repartition("img", "tile_id")
    schema = "img long, tile_id int, seed long, cand_id int, steps array<int>, d double, bits double, payload binary, error string, seconds double"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.binary(), pa.string(), pa.float64()]
    names = ["img", "tile_id", "seed", "cand_id", "steps", "d", "bits", "payload", "error", "seconds"]
    tries = search.candidates()

    cost = entropy.symbol_bits(config.table)
    metric = config.metric if config.metric == "mixed" else metrics.get(config.metric)  # goes with the task, wherever it was registered

    steps = [[c["i_f"], c["i_a"], c["i_p"]] for c in tries]

    def best_of(row: dict, made: dict[tuple[int, int], np.ndarray]) -> tuple:
        """cand_id, steps, d, bits and the symbols of the best candidate."""
        shape = row["th"], row["tw"]
        if shape not in made:
            made[shape] = np.stack([draw(*shape, c["freq"], c["ang"], c["phase"]) for c in tries])
        d = distortion(np.array(row["data"]).reshape(shape), made[shape], metric, config.mix)
        plain = [symbols(row["seed"], s) for s in steps]
        if config.bits == "exact":
            bits = np.array([8.0 * len(entropy.frame_stream(c, config.table_id)) for c in entropy.encode_many(plain, config.table)])
        else:
            bits = cost[np.frombuffer(b"".join(plain), dtype=np.uint8).reshape(len(plain), -1)].sum(axis=1)
        score = d + config.rate_weight * bits
        if not np.isfinite(score).all():
            raise ValueError("a score isn't finite")
        best = int(np.argmin(score))
        return best, steps[best], float(d[best]), float(bits[best]), plain[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                began = time.perf_counter()
                try:
                    found = (*best_of(r, made), None)
                except Exception as error:  # the tile's failure is its result
                    found = (None, None, None, None, None, f"tile {r['tile_id']}: {type(error).__name__}: {error}")
                rows.append((r["img"], r["tile_id"], r["seed"], *found, time.perf_counter() - began))
            coded = iter(entropy.encode_many([r[7] for r in rows if r[8] is None], config.table))
            rows = [(*r[:7], entropy.frame_stream(next(coded), config.table_id) if r[8] is None else None, *r[8:]) for r in rows]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return cut.mapInArrow(run, schema)


def encode_items(images: DataFrame, config: CodecConfig = CodecConfig()) -> DataFrame:
    """img, blob, tiles, bpp, seconds, error of wide images (img, h, w, data), each tile coded once.  An image of which a
    tile can't be coded has an error and no blob; ``seconds`` are those of its tiles, in whatever tasks."""
    raw = config.payload == "raw"
    payload = F.lit(b"raw") if raw else F.col("payload")
    fields = (F.col("tile_id"), F.lit(0), F.lit(0), F.col("seed"), F.lit(0), F.lit(bitstream.RAW if raw else bitstream.CODED), payload)
    records = search_tiles(images, config).select("img", "tile_id", F.when(F.col("error").isNull(), F.hex(bitstream.packed_record(*fields))).alias("raw"), "error", "seconds")
    ordered = F.array_sort(F.collect_list(F.struct("tile_id", "raw")))
    body = records.groupBy("img").agg(ordered.alias("r"), F.count("*").alias("tiles"), F.sum("seconds").alias("seconds"), F.min_by("error", F.struct(F.col("error").isNull(), "tile_id")).alias("error"))
    fixed = json.dumps({"tile": config.tile, "overlap": config.overlap, "flags": 0, "meta": {"seed": config.seed, "cfg": {"lambda": config.rate_weight, "alpha": config.mix, "table_id": config.table_id}}}, separators=(",", ":"))
    header = F.concat(F.lit('{"width":'), F.col("w").cast("string"), F.lit(',"height":'), F.col("h").cast("string"), F.lit("," + fixed[1:]))
    joined = body.join(images.select("img", "h", "w", bitstream.packed_header(header).alias("header")), "img")
    blob = F.concat("header", bitstream.little(F.size("r"), 4), F.unhex(F.array_join(F.transform("r", lambda x: x["raw"]), "")))
    coded = joined.withColumn("blob", F.when(F.col("error").isNull(), blob))
    bpp = 8.0 * F.octet_length("blob") / F.greatest(F.col("h") * F.col("w"), F.lit(1))
    return coded.select("img", "blob", "tiles", bpp.alias("bpp"), "seconds", "error")


def encode(images: DataFrame, config: CodecConfig = CodecConfig()) -> DataFrame:
    """img, blob, tiles, bpp of wide images (img, h, w, data); an image that can't be coded fails the job."""
    named = F.concat(F.lit("image "), F.col("img").cast("string"), F.lit(": "), F.col("error"))
    good = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(named).cast("boolean"))
    return encode_items(images, config).filter(good).select("img", "blob", "tiles", "bpp")


def checked_records(blobs: DataFrame, by: str = "seed", tables: dict[str, entropy.Table] | None = None) -> DataFrame:
    """The records of blobs (img, blob) with symbols and error: what keeps a blob or a record from being decoded, or null.

    Payloads are decoded whatever tiles are drawn from, so a damaged one is noticed.  A RAW payload holds no steps: it is
    an error where tiles are drawn from them.
    """
    if by not in ("seed", "symbols"):
        raise ValueError("tiles are drawn by seed or by symbols")
    parsed = bitstream.parse_images(blobs).withColumn("_coded", F.when(F.col("payload_fmt") == bitstream.CODED, F.col("payload")))
    decoded = entropy.decode_column(parsed, tables or {"v15_default": entropy.UNIFORM}, "_coded", "symbols", "_problem").drop("_coded")
    byte = lambda k: F.conv(F.hex(F.substring("symbols", k + 1, 1)), 16, 10).cast("int")
    size = F.octet_length("symbols")
    whole = (size >= 11) & (byte(0) == entropy.TAG) & (size >= 11 + byte(10))
    fits = (F.col("tile") > 0) & (F.col("overlap") >= 0) & (F.col("overlap") < F.col("tile")) & (F.col("width") > 0) & (F.col("height") > 0)
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.coalesce(fits, F.lit(False)), F.lit("the header has no sound sizes"))
        .when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when((F.col("payload_fmt") == bitstream.CODED) & ~F.coalesce(whole, F.lit(False)), F.lit("not the symbols of a tile"))
        .when((F.col("payload_fmt") == bitstream.RAW) & F.lit(by == "symbols"), F.lit("a RAW tile holds no steps"))
        .when(~F.coalesce(F.col("payload_fmt").isin(bitstream.CODED, bitstream.RAW), F.lit(True)), F.lit("an unknown payload format"))
    )
    return decoded.withColumn("error", problem).drop("_problem")


def problems(blobs: DataFrame, by: str = "seed", tables: dict[str, entropy.Table] | None = None) -> DataFrame:
    """img, error: the first problem of each blob that can't be decoded."""
    bad = checked_records(blobs, by, tables).filter(F.col("error").isNotNull())
    return bad.groupBy("img").agg(F.min_by("error", F.coalesce("tile_id", F.lit(-1))).alias("error"))


def decode(blobs: DataFrame, by: str = "seed", tables: dict[str, entropy.Table] | None = None, lenient: bool = False) -> DataFrame:
    """img, y, x, v of the images of blobs (img, blob), each by the sizes of its own header.

    ``by`` "seed": a tile is drawn from the seed of its record, as the format's decoder does.  "symbols": from the
    steps that the encoder chose.  A blob that can't be decoded fails the job; with ``lenient`` its records are left
    out, and ``problems`` tells them.
    """
    records = checked_records(blobs, by, tables).filter("error is not null or tile_id is not null")
    if lenient:
        records = records.filter("error is null")
    else:
        named = F.concat(F.lit("image "), F.col("img").cast("string"), F.lit(": "), F.col("error"))
        records = records.filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(named).cast("boolean")))
    if by == "seed":
        drawn = records.select("*", *[c.alias(n) for n, c in search.seed_stripes(F.col("seed")).items()])
    else:
        step = lambda k: F.conv(F.hex(F.substring("symbols", 12 + k, 1)), 16, 10).cast("int") - 128
        pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), step(k))
        drawn = records.select("*", pick(search.FREQUENCIES, 0).alias("freq"), pick(search.ANGLES, 1).alias("ang"), pick(search.PHASES, 2).alias("phase"))
    # The grid is that of the decoder; its tiles are as many as the records, in their order.  A record has its header's
    # sizes, so it finds its own place.
    drawn = drawn.select("img", "tile_id", F.col("height").alias("h"), F.col("width").alias("w"), F.col("tile").alias("size"), "overlap", "freq", "ang", "phase")
    # Records are small and their pixels many: by the bytes of the records, Spark would put them all into one task.
    drawn = drawn.repartition(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), "img", "tile_id")
    grid = tiling.own_tile(drawn, F.col("size"), F.col("overlap"))
    at = grid.select("*", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y")).select("*", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    at = at.withColumns({"ty": F.col("y") - F.col("y0"), "tx": F.col("x") - F.col("x0")})
    unit = lambda c: search.unit(F.col(c), F.col("size"))
    values = at.withColumn("v", search.stripes(unit("tx"), unit("ty"), F.col("freq"), F.col("ang"), F.col("phase")))
    return tiling.blend(values, F.col("size"), F.col("overlap"))
