"""Tiling: grids, pixels of tiles, blend windows, masks, and the blend.

A tile is an explode of an image's row, so tiling needs no shuffle; the blend is one hash aggregate per pixel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(value: Column | int) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def starts(length: Column, size: Column | int, overlap: Column | int, clipped: bool) -> Column:
    """Starts of tiles on an axis, in order; size and overlap are numbers or columns.

    ``clipped``: the grid of the encoder, whose last tile is cut at the border.  Else the grid of the decoder, whose
    last tile is moved back to end at the border.
    """
    if isinstance(size, int) and isinstance(overlap, int) and not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    size, overlap = _number(size), _number(overlap)
    stride = size - overlap
    if clipped:
        return F.sequence(F.lit(0), F.greatest(length - overlap, F.lit(1)) - 1, stride)
    last = F.greatest(length - size, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, stride), F.array(last)))


def tiles(dims: DataFrame, size: Column | int, overlap: Column | int, clipped: bool = False) -> DataFrame:
    """The columns of ``dims`` (h and w among them) with tile_id, y0, x0, y1, x1; rows first."""
    grid = dims.withColumns({"_ys": starts(F.col("h"), size, overlap, clipped), "_xs": starts(F.col("w"), size, overlap, clipped)})
    grid = grid.select("*", F.posexplode("_ys").alias("_iy", "y0")).select("*", F.posexplode("_xs").alias("_ix", "x0"))
    return grid.select(
        *dims.columns, (F.col("_iy") * F.size("_xs") + F.col("_ix")).alias("tile_id"), "y0", "x0", F.least(F.col("y0") + size, F.col("h")).alias("y1"), F.least(F.col("x0") + size, F.col("w")).alias("x1")
    )


def own_tile(rows: DataFrame, size: Column | int, overlap: Column | int, clipped: bool = False) -> DataFrame:
    """``rows`` (h, w, tile_id and what else there is) with y0, x0, y1, x1 of their own tile, from its place in the grid;
    a tile that the grid doesn't have leaves no row."""
    grid = rows.withColumns({"_ys": starts(F.col("h"), size, overlap, clipped), "_xs": starts(F.col("w"), size, overlap, clipped)})
    line = F.expr("tile_id div size(_xs)").cast("int")
    place = grid.withColumns({"y0": F.get("_ys", line), "x0": F.get("_xs", F.pmod("tile_id", F.size("_xs")).cast("int"))}).filter((F.col("tile_id") >= 0) & F.col("y0").isNotNull())
    return place.select(*rows.columns, "y0", "x0", F.least(F.col("y0") + size, F.col("h")).alias("y1"), F.least(F.col("x0") + size, F.col("w")).alias("x1"))


def tile_pixels(pixels: DataFrame, dims: DataFrame, size: int, overlap: int, clipped: bool = False) -> DataFrame:
    """img, tile_id, ty, tx, th, tw, y, x, v: each pixel once per tile that it lies in.

    The tiles of a pixel follow from its place, so a pixel explodes into them; only the dimensions are joined.
    """
    sized = pixels.join(dims, "img").withColumns({"_ys": starts(F.col("h"), size, overlap, clipped), "_xs": starts(F.col("w"), size, overlap, clipped)})

    def those(axis: str, all_starts: str) -> Column:
        own = F.transform(F.col(all_starts), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
        return F.explode(F.filter(own, lambda t: (t["s"] <= F.col(axis)) & (F.col(axis) < t["s"] + size)))

    out = sized.select("*", those("y", "_ys").alias("_y")).select("*", those("x", "_xs").alias("_x"))
    extent = lambda s, n: (F.least(F.col(s) + size, F.col(n)) - F.col(s)).cast("int")
    return out.select(
        "img", (F.col("_y.i") * F.size("_xs") + F.col("_x.i")).alias("tile_id"), (F.col("y") - F.col("_y.s")).alias("ty"), (F.col("x") - F.col("_x.s")).alias("tx"),
        extent("_y.s", "h").alias("th"), extent("_x.s", "w").alias("tw"), "y", "x", "v",
    )


def tile_data(images: DataFrame, size: int, overlap: int, clipped: bool = False) -> DataFrame:
    """img, tile_id, th, tw, data: the values of each tile of wide images (img, h, w, data), row by row."""
    rect = tiles(images.select("img", "h", "w", "data"), size, overlap, clipped)
    rows = F.transform(F.sequence(F.col("y0"), F.col("y1") - 1), lambda y: F.slice("data", y * F.col("w") + F.col("x0") + 1, F.col("x1") - F.col("x0")))
    return rect.select("img", "tile_id", (F.col("y1") - F.col("y0")).alias("th"), (F.col("x1") - F.col("x0")).alias("tw"), F.flatten(rows).alias("data"))


# --- windows and masks ------------------------------------------------------------------------------------------


def hann(i: Column, n: Column | int, overlap: Column | int) -> Column:
    """A ramp of half a cosine over ``overlap`` (at most half) places at both ends, 1 between."""
    n = _number(n)
    ramp, edge = F.least(_number(overlap), F.floor(n / 2).cast("int")), F.least(i, n - 1 - i)
    rise = F.when(ramp > 1, 0.5 * (1 - F.cos(F.lit(3.141592653589793) * edge / F.greatest(ramp - 1, F.lit(1))))).otherwise(0.0)
    return F.when(edge < ramp, rise).otherwise(1.0)


def tukey(i: Column, n: Column | int, alpha: Column | float) -> Column:
    """Tapered cosine; ``alpha`` is the tapered share."""
    n = _number(n)
    alpha = F.least(F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha, F.lit(1.0))
    # Both ends alike, by the distance from the nearer one.
    t = F.least(i, n - 1 - i) / F.greatest(n - 1, F.lit(1))
    tapered = (alpha > 0) & (n > 1) & (t < alpha / 2)
    return F.when(tapered, 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (2 * t / F.greatest(alpha, F.lit(1e-12)) - 1)))).otherwise(1.0)


def kaiser_table(spark, n: int, beta: float = 6.5) -> DataFrame:
    """i, w: the window is small, so it is a table; its series is summed once per place."""
    places = spark.range(n).select(F.col("id").cast("int").alias("i"))
    across = 2 * F.col("i") / max(n - 1, 1) - 1
    z = beta * F.sqrt(F.greatest(1 - across * across, F.lit(0.0)))
    series = lambda value: F.aggregate(
        F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, k: F.struct((a["sum"] + a["term"] * value * value / 4 / (k * k)).alias("sum"), (a["term"] * value * value / 4 / (k * k)).alias("term")), lambda a: a["sum"],
    )
    return places.select("i", (series(z) / series(F.lit(float(beta)))).alias("w"))


def kaiser(i: Column, n: int, beta: float = 6.5) -> Column:
    """The window of Bessel functions: its n values are a literal."""
    return F.get(F.array(*[F.lit(float(w)) for w in np.kaiser(n, beta)]), i)


def window(kind: str, dy: Column, dx: Column, size: Column | int, overlap: Column | int) -> Column:
    """The separable weight of a pixel of a tile: hann, tukey whose share is that of the overlap, or kaiser."""
    if kind == "hann":
        return hann(dy, size, overlap) * hann(dx, size, overlap)
    if kind == "tukey":
        alpha = F.least(F.greatest(2 * _number(overlap) / _number(size), F.lit(0.0)), F.lit(1.0))
        return tukey(dy, size, alpha) * tukey(dx, size, alpha)
    if kind == "kaiser":
        if not isinstance(size, int):
            raise ValueError("a kaiser window needs a size that is a number")
        return kaiser(dy, size) * kaiser(dx, size)
    raise ValueError(f"unknown window {kind!r}")


def _edge(y: Column, x: Column, height: Column | int, width: Column | int) -> Column:
    return F.least(y, x, height - 1 - y, width - 1 - x)


def seam_mask(y: Column, x: Column, size: int, overlap: int, power: float = 1.0) -> Column:
    """1 at the edge of a tile, falling to 0 at a distance of ``overlap``."""
    if overlap <= 0:
        return F.lit(0.0)
    return F.pow(F.greatest(1 - _edge(y, x, F.lit(size), F.lit(size)) / overlap, F.lit(0.0)), F.lit(power))


def border_mask(y: Column, x: Column, height: Column | int, width: Column | int, border: int = 8) -> Column:
    """1 within ``border`` of an edge, else 0."""
    height, width = (F.lit(n) if isinstance(n, int) else n for n in (height, width))
    return F.when(_edge(y, x, height, width) < border, 1.0).otherwise(0.0)


def blend(tile_values: DataFrame, size: Column | int, overlap: Column | int, kind: str = "hann") -> DataFrame:
    """img, y, x, v from the pixels of tiles (img, ty, tx, y, x, v): the weighted mean of the tiles over a pixel."""
    w = window(kind, F.col("ty"), F.col("tx"), size, overlap)
    sums = tile_values.withColumn("_w", w).groupBy("img", "y", "x").agg(F.sum(F.col("_w") * F.col("v")).alias("_s"), F.sum("_w").alias("_w"))
    return sums.select("img", "y", "x", (F.col("_s") / (F.col("_w") + 1e-8)).alias("v"))


def resample(pixels: DataFrame, places: DataFrame) -> DataFrame:
    """img, y, x, v: the pixels of ``places`` (img, h, w, y, x, and gy, gx in -1..1), each a bilinear mix of the four
    pixels (img, y, x, v) around its place in the image; -1 and 1 are the middles of the outer pixels, what lies beyond is
    held at the border.

    A place explodes into its neighbours, which meet the pixels by an equal join, and their weighted sum is an aggregate.
    Neighbours without weight are left out; those that the image lacks don't count.
    """

    def axis(g: str, n: str) -> Column:
        at = F.least(F.greatest((F.col(g) + 1) / 2 * (F.col(n) - 1), F.lit(0.0)), (F.col(n) - 1).cast("double"))
        low = F.floor(at).cast("int")
        return F.array(F.struct(low.alias("at"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("at"), (at - low).alias("w")))

    ways = places.select("img", F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(axis("gy", "h")).alias("v"), axis("gx", "w").alias("hs")).select("img", "_y", "_x", "v", F.explode("hs").alias("h"))
    ways = ways.select("img", "_y", "_x", F.col("v.at").alias("y"), F.col("h.at").alias("x"), (F.col("v.w") * F.col("h.w")).alias("_w")).filter("_w > 0")
    met = ways.join(pixels.select("img", "y", "x", "v"), ["img", "y", "x"]).filter("v is not null")
    return met.groupBy("img", "_y", "_x").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("v")).select("img", F.col("_y").alias("y"), F.col("_x").alias("x"), "v")


def montage(pixels: DataFrame, height: int, width: int, columns: int) -> DataFrame:
    """y, x, v: images pasted in a grid, row by row, by img."""
    at = lambda c: F.expr(f"img div {columns}") if c == "y" else F.col("img") % columns
    return pixels.select((at("y") * height + F.col("y")).alias("y"), (at("x") * width + F.col("x")).alias("x"), "v")
