"""Candidates and the rate-distortion search.

A tile meets its candidates by an explode of a literal array, not by a join; scores are one hash aggregate with a
partial sum in each task, and the best candidate is the least (score, candidate) of a tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metrics, nearest
from .tiling import seam_mask

# The stripes that the encoder tries, in the order frequency, angle, phase.
FREQUENCIES = (4, 7, 10)
ANGLES = (0, 30, 60, 90, 120, 150)
PHASES = (0, 90, 180, 270)


def candidates() -> list[dict]:
    out = []
    for i_f, freq in enumerate(FREQUENCIES):
        for i_a, ang in enumerate(ANGLES):
            for i_p, phase in enumerate(PHASES):
                out.append({"cand_id": len(out), "i_f": i_f, "i_a": i_a, "i_p": i_p, "freq": freq, "ang": ang, "phase": phase})
    return out


def with_candidates(rows: DataFrame) -> DataFrame:
    """Every row with each candidate's columns."""
    each = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in candidates()])
    return rows.select("*", F.explode(each).alias("_c")).select(*rows.columns, "_c.*")


def stripes(x: Column, y: Column, freq: Column, ang: Column, phase: Column) -> Column:
    along = x * F.cos(F.radians(ang)) + y * F.sin(F.radians(ang))
    return F.cos(2 * 3.141592653589793 * freq * along + F.radians(phase))


def seed_stripes(seed: Column) -> dict[str, Column]:
    """The stripes that a seed stands for: what the decoder draws."""
    s = seed.bitwiseAND(F.lit(0xFFFFFFFF))
    return {"freq": 3 + s % 9, "ang": F.floor(s / 7) % 180, "phase": F.shiftright(s, 8) % 360}


def unit(at: Column, length: Column) -> Column:
    """Places 0..length-1 as -1..1."""
    return F.when(length > 1, -1.0 + 2.0 * at / F.greatest(length - 1, F.lit(1))).otherwise(-1.0)


def scores(tile_rows: DataFrame, seam: float = 0.0, size: int = 0, overlap: int = 0, metric: str = "mse") -> DataFrame:
    """img, tile_id, candidate, d: the distortion of each candidate over a tile by a metric of columns, plus, weighted by
    ``seam``, the mean over all its pixels of the squared error at its edge.  ``tile_rows`` as of ``tile_pixels``."""
    mask = seam_mask(F.col("ty"), F.col("tx"), size, overlap) if seam else F.lit(0.0)
    c = with_candidates(tile_rows.select("img", "tile_id", "v", unit(F.col("tx"), F.col("tw")).alias("ux"), unit(F.col("ty"), F.col("th")).alias("uy"), mask.alias("m")))
    made = c.withColumn("s", stripes(F.col("ux"), F.col("uy"), F.col("freq"), F.col("ang"), F.col("phase")))
    d = metrics.get(metric).distortion(F.col("v"), F.col("s"))
    if seam:
        d = d + seam * F.avg((F.col("v") - F.col("s")) ** 2 * F.col("m"))
    return made.groupBy("img", "tile_id", "cand_id", "freq", "ang", "phase").agg(d.alias("d"))


def best(scored: DataFrame, rate: Column, weight: float) -> DataFrame:
    """img, tile_id and the candidate of least d + weight * rate; of equals the first."""
    rows = scored.withColumn("rd", F.round(F.col("d") + weight * rate, 9))
    least = F.min(F.struct("rd", "cand_id", "freq", "ang", "phase", "d")).alias("b")
    return rows.groupBy("img", "tile_id").agg(least).select("img", "tile_id", "b.*")


def top(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates of each tile, with their rank."""
    order = Window.partitionBy("img", "tile_id").orderBy(F.round("d", 9), "cand_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rate(bits: Column | None, payload: Column | None) -> Column:
    """Bits if known, else those of the payload, else 1."""
    known = [c.cast("double") for c in (bits, 8 * F.octet_length(payload) if payload is not None else None) if c is not None]
    return F.coalesce(*known, F.lit(1.0))


def linspace(low: float, high: float, steps: int) -> list[float]:
    return [low + (high - low) * k / (steps - 1) if steps > 1 else low for k in range(steps)]


def parameter_grid(frame: DataFrame, bounds: dict[str, tuple[float, float]], steps: dict[str, int]) -> DataFrame:
    """Every row of ``frame`` with each point of a regular grid; the last name runs fastest."""
    for name, (low, high) in bounds.items():
        frame = frame.select("*", F.explode(F.array(*[F.lit(float(v)) for v in linspace(low, high, steps[name])])).alias(name))
    return frame


def refine(centre: DataFrame, deltas: dict[str, float], steps: int) -> DataFrame:
    """Every row with a grid around its point: the columns named ``fine_<name>``."""
    for name, delta in deltas.items():
        low, high = F.least(F.col(name) - delta, F.col(name) + delta), F.greatest(F.col(name) - delta, F.col(name) + delta)
        points = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: low + (high - low) * k / max(steps - 1, 1))
        centre = centre.select("*", F.explode(points).alias(f"fine_{name}"))
    return centre


# --- from coarse to fine, all tiles at once ---------------------------------------------------------------------------

_POINT = ("freq", "ang", "phase")


def stripe_errors(tile: np.ndarray, freq: np.ndarray, ang: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """The mean squared error of each of many stripes from a tile.

    A wave along a direction is a sum of two products of a wave across and a wave down, so neither the stripes nor their
    squares are drawn: lines of cosines, and a matrix product with the tile.
    """
    height, width = tile.shape
    x, y = (np.linspace(-1, 1, n) if n > 1 else np.array([-1.0]) for n in (width, height))
    turn = np.radians(ang)
    across = 2 * np.pi * (freq * np.cos(turn))[:, None] * x + np.radians(phase)[:, None]
    down = 2 * np.pi * (freq * np.sin(turn))[:, None] * y
    ca, sa, cd, sd = np.cos(across), np.sin(across), np.cos(down), np.sin(down)
    product = ((cd @ tile) * ca).sum(axis=1) - ((sd @ tile) * sa).sum(axis=1)
    energy = (ca * ca).sum(axis=1) * (cd * cd).sum(axis=1) - 2 * (ca * sa).sum(axis=1) * (cd * sd).sum(axis=1) + (sa * sa).sum(axis=1) * (sd * sd).sum(axis=1)
    return ((tile * tile).sum() - 2 * product + energy) / tile.size


def _points(axes: list[np.ndarray]) -> np.ndarray:
    """All points of a grid, the last axis running fastest."""
    return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=1)


class Refinement(NamedTuple):
    """Bounds and steps of the first grid, how far a round goes around a point, and with how many steps; how many points
    are kept, how many rounds there are at most, and how often they get narrower by half."""

    bounds: dict[str, tuple[float, float]]
    steps: dict[str, int]
    deltas: dict[str, float]
    around: int = 3
    beam: int = 2
    rounds: int = 32
    halvings: int = 8

    def best(self, tile: np.ndarray) -> tuple[float, float, float, float, float, int]:
        """The least error of the first grid, the best point found with its error, and the rounds that changed the beam."""
        low, high = (np.array([self.bounds[n][i] for n in _POINT]) for i in (0, 1))
        wide = np.array([self.deltas[n] for n in _POINT])

        def tried(points: np.ndarray, held: np.ndarray) -> np.ndarray:
            new = np.column_stack([np.round(stripe_errors(tile, *points.T), 9), points])
            return np.unique(np.concatenate([held, new]), axis=0)[: self.beam]  # in order of error, then point

        held = tried(_points([np.array(linspace(*self.bounds[n], self.steps[n])) for n in _POINT]), np.zeros((0, 4)))
        coarse, changed, level = held[0, 0], 0, 0
        for _ in range(self.rounds):
            delta = wide / 2**level
            near = [_points([p - d + 2 * d * np.arange(self.around) / max(self.around - 1, 1) for p, d in zip(point, delta)]) for point in held[:, 1:]]
            now = tried(np.clip(np.concatenate(near), low, high), held)
            if np.array_equal(now, held):
                level += 1
                if level > self.halvings:
                    break
            else:
                held, changed = now, changed + 1
        return coarse, *held[0, 1:], held[0, 0], changed


def refine_tiles(tiles: DataFrame, refinement: Refinement) -> DataFrame:
    """img, tile_id, coarse, freq, ang, phase, d, rounds: the best stripes of each tile (th, tw, data), from coarse to fine.

    First all points of a grid are tried.  In each round the best points so far have a grid tried around them; where that
    changes nothing the next round is half as wide, until the narrowest changes nothing.  A tile stays in its row, so all
    rounds are one pass over the tiles, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for th, tw, data in zip(batch.column("th").to_pylist(), batch.column("tw").to_pylist(), batch.column("data")):
                found.append(refinement.best(data.values.to_numpy(zero_copy_only=False).reshape(th, tw)))
            columns = list(zip(*found)) or [()] * 6
            new = [pa.array(c, pa.int32() if n == 5 else pa.float64()) for n, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("img"), batch.column("tile_id"), *new], names=["img", "tile_id", "coarse", *_POINT, "d", "rounds"])

    schema = T.StructType([tiles.schema["img"], tiles.schema["tile_id"], *T._parse_datatype_string("coarse double, freq double, ang double, phase double, d double, rounds int").fields])
    return tiles.select("img", "tile_id", "th", "tw", "data").mapInArrow(run, schema)


# --- over a catalogue of patterns ----------------------------------------------------------------------------------------


def select_generators(names: Column, most: int | None = 8) -> Column:
    """The first ``most`` of an array of generators; all, if it is None."""
    return names if most is None else F.slice(names, 1, most)


class BoundedPatterns:
    """Candidate images of one size, and their means over square blocks of pixels.

    The mean squared error of two images is that of their block means and, beside it, that of what lies within the
    blocks, which is the square of the difference of its norms at least.  Candidates are tried in the order of this
    bound, until it is above the least error found.
    """

    #: What two errors may be apart and count as one.
    SAME = 1e-9

    def __init__(self, ids: pa.Array, lists: pa.ListArray, height: int, width: int):
        self.shape = height, width
        self.side = next(s for s in (4, 2, 1) if height % s == 0 and width % s == 0)
        at, images = nearest.sound_rows(lists, height * width)
        number = ids.to_numpy(zero_copy_only=False)[at]
        order = np.argsort(number, kind="stable")
        self.ids, self.images = number[order], images[order]
        self.means, self.within = self._blocks(self.images)

    def _blocks(self, images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block means of images, and the norms of what is left."""
        (height, width), side = self.shape, self.side
        means = images.reshape(-1, height // side, side, width // side, side).mean(axis=(2, 4)).reshape(len(images), height * width // side**2)
        return means, np.sqrt(np.maximum((images**2).sum(axis=1) - side**2 * (means**2).sum(axis=1), 0))

    def bounds(self, tiles: np.ndarray) -> np.ndarray:
        """Of each tile and candidate, what their mean squared error is at least."""
        means, within = self._blocks(tiles)
        coarse = (means**2).sum(axis=1)[:, None] + (self.means**2).sum(axis=1) - 2 * means @ self.means.T
        return (self.side**2 * np.maximum(coarse, 0) + (within[:, None] - self.within) ** 2) / tiles.shape[1]

    def _cut(self, lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each tile that lacks pixels (null): its place, its values with 0 for null, and where it has pixels."""
        size = self.shape[0] * self.shape[1]
        at = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
        flat = lists.take(pa.array(at)).flatten().cast(pa.float64())
        if flat.null_count:
            has = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(at), size)
            tiles = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(at), size)
            cut = has.any(axis=1) & ~has.all(axis=1) & np.isfinite(tiles).all(axis=1)
            yield from zip(at[cut].tolist(), tiles[cut], has[cut])

    def _cut_bounds(self, tile: np.ndarray, has: np.ndarray) -> np.ndarray:
        """What ``bounds`` gives for a tile that lacks pixels, from the means of what its blocks have.  A block that lacks
        pixels counts as a whole one, so it need not be a bound."""
        (height, width), side = self.shape, self.side
        per_block = lambda values: values.reshape(height // side, side, width // side, side).sum(axis=(1, 3)).ravel()
        pixels = per_block(has)
        means, some = per_block(tile) / np.maximum(pixels, 1), pixels > 0
        within = np.sqrt(max((per_block(tile**2) - side**2 * means**2).sum(), 0))
        return (side**2 * ((means - self.means)[:, some] ** 2).sum(axis=1) + (within - self.within) ** 2) / len(tile)

    def _compared(self, tile: np.ndarray, has: np.ndarray) -> tuple[float, int]:
        """The least mean squared error over the pixels that a tile has, and its candidate; all are compared."""
        step = max(1, nearest.AT_ONCE // len(tile))
        errors = np.concatenate([((tile[has] - self.images[i : i + step, has]) ** 2).mean(axis=1) for i in range(0, len(self.images), step)])
        return min((round(float(errors[c]), 9), int(self.ids[c])) for c in np.flatnonzero(errors <= errors.min() + self.SAME))

    def find(self, lists: pa.ListArray) -> list[pa.Array]:
        ids, d, tried, none = np.zeros(len(lists), dtype=np.int64), np.zeros(len(lists)), np.zeros(len(lists), dtype=np.int64), np.ones(len(lists), dtype=bool)
        at, tiles = nearest.sound_rows(lists, self.shape[0] * self.shape[1])
        if len(self.ids) and len(at):
            for place, tile, bound in zip(at.tolist(), tiles, self.bounds(tiles)):
                best = np.inf, 0
                for n, c in enumerate(np.argsort(bound, kind="stable").tolist()):
                    if bound[c] > best[0] + self.SAME:
                        break
                    best = min(best, (round(float(((tile - self.images[c]) ** 2).mean()), 9), int(self.ids[c])))
                    tried[place] = n + 1
                d[place], ids[place], none[place] = *best, False
        if len(self.ids):
            for place, tile, has in self._cut(lists):
                d[place], ids[place] = self._compared(tile, has)
                tried[place], none[place] = (self._cut_bounds(tile, has) <= d[place] + self.SAME).sum(), False
        return [pa.array(ids, mask=none), pa.array(d, mask=none), pa.array(tried)]


def best_patterns(tiles: DataFrame, candidates: DataFrame, height: int, width: int, chunk: int = nearest.CHUNK) -> DataFrame:
    """``tiles`` (data) with cand_id and d of the candidate image (cand_id, data) of least error, of equals the first, and
    ``tried``, how many candidates had to be compared in full; tiles of another size than height x width get nulls.

    A tile cut by the border of its image has nulls where it has no pixels.  It is compared with all candidates, over its
    pixels; its ``tried`` is how many of their bounds, taken as if its blocks were whole, are not above the error.
    """
    codes = candidates.select(F.col("cand_id").alias("code_id"), F.col("data").alias("value"))
    load = lambda ids, lists: BoundedPatterns(ids, lists, height, width)
    return nearest.join(tiles, codes, "data", load, "cand_id long, d double, tried long", chunk)


def clamp(values: Column, low: Column, high: Column) -> Column:
    """Arrays, dimension by dimension."""
    return F.zip_with(F.zip_with(values, low, lambda v, a: F.greatest(v, a)), high, lambda v, b: F.least(v, b))
