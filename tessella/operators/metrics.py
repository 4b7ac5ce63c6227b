"""Distortion and quality of pairs of images (img, y, x, a, b)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the structural similarity.
TAPS = 11
SIGMA = 1.5
C1, C2 = 1e-4, 9e-4
LEAST_MSE = 1e-12


def gaussian_taps() -> list[float]:
    at = np.arange(TAPS) - TAPS // 2
    g = np.exp(-(at**2) / (2 * SIGMA**2))
    return (g / g.sum()).tolist()


def mse(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("img").agg(F.avg((F.col("a") - F.col("b")) ** 2).alias("mse"))


def psnr_of(error: Column, peak: float = 1.0) -> Column:
    return 10 * F.log10(F.lit(peak * peak) / F.greatest(error, F.lit(LEAST_MSE)))


def psnr(pairs: DataFrame, peak: float = 1.0) -> DataFrame:
    return mse(pairs).select("img", psnr_of(F.col("mse"), peak).alias("psnr"))


def ssim_map(a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """From blurred a, b, a * a, b * b and a * b."""
    va, vb, cov = aa - a * a, bb - b * b, ab - a * b
    return ((2 * a * b + C1) * (2 * cov + C2)) / ((a * a + b * b + C1) * (va + vb + C2))


def _blurred(planes: DataFrame, names: list[str], line: str, along: str) -> DataFrame:
    """Each plane convolved along one axis; what lies beyond the border counts as 0."""
    order = Window.partitionBy("img", line).orderBy(along)
    half = TAPS // 2

    def tap(name: str, k: int) -> Column:
        moved = F.lead(name, k) if k > 0 else F.lag(name, -k)
        return F.coalesce(moved.over(order), F.lit(0.0)) if k else F.col(name)

    taps = gaussian_taps()
    sums = {n: sum((taps[k + half] * tap(n, k) for k in range(-half, half + 1)), F.lit(0.0)) for n in names}
    return planes.withColumns(sums)


def ssim(pairs: DataFrame) -> DataFrame:
    """Mean structural similarity per image, clamped per pixel to 0..1.

    Relational form: two passes of window functions, one per axis, each over the lines of an image, so that no task
    needs more than a line.
    """
    planes = pairs.select("img", "y", "x", "a", "b", (F.col("a") * F.col("a")).alias("aa"), (F.col("b") * F.col("b")).alias("bb"), (F.col("a") * F.col("b")).alias("ab"))
    names = ["a", "b", "aa", "bb", "ab"]
    both = _blurred(_blurred(planes, names, "y", "x"), names, "x", "y")
    value = F.least(F.greatest(ssim_map(*[F.col(n) for n in names]), F.lit(0.0)), F.lit(1.0))
    return both.groupBy("img").agg(F.avg(value).alias("ssim"))


def ssim_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for arrays whose last two axes are images: the kernel of the search."""
    taps = np.array(gaussian_taps())

    def blur(p: np.ndarray) -> np.ndarray:
        for axis in (-1, -2):
            n, half = p.shape[axis], TAPS // 2
            padded = np.pad(p, [(0, 0)] * (p.ndim + axis) + [(half, half)] + [(0, 0)] * (-axis - 1))
            p = sum(t * np.take(padded, range(k, k + n), axis=axis) for k, t in enumerate(taps))
        return p

    m, n = blur(a), blur(b)
    va, vb, cov = blur(a * a) - m * m, blur(b * b) - n * n, blur(a * b) - m * n
    value = ((2 * m * n + C1) * (2 * cov + C2)) / ((m * m + n * n + C1) * (va + vb + C2))
    return np.clip(value, 0, 1).mean(axis=(-1, -2))


# --- metrics by name ------------------------------------------------------------------------------------------------------


class UnknownMetricError(KeyError):
    """No metric has this name."""


@dataclass(frozen=True)
class Metric:
    """A measure of two images, by one form or both.

    ``aggregate`` makes an aggregate of the columns of both images' values: it is summed in part where the pixels lie.
    ``arrays`` takes arrays whose last two axes are images and gives a number for each: it needs an image in one task.
    ``alike``: 1 stands for equal images, so that the distortion is 1 less the value; ``rising``: more is better without a
    bound, so it is the value's negative; else the value is the distortion.
    """

    name: str
    aggregate: Callable[[Column, Column], Column] | None = None
    arrays: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    alike: bool = False
    rising: bool = False

    def __post_init__(self):
        if self.aggregate is None and self.arrays is None:
            raise ValueError("a metric has a form")

    def distance(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The distortion of each image of ``many`` from ``one``."""
        if self.arrays is None:
            raise ValueError(f"{self.name} has no form for arrays")
        return self._distortion(self.arrays(np.broadcast_to(one, many.shape), many))

    def _distortion(self, value):
        return 1 - value if self.alike else -value if self.rising else value

    def distortion(self, a: Column, b: Column) -> Column:
        """The distortion of two columns as an aggregate."""
        if self.aggregate is None:
            raise ValueError(f"{self.name} has no form for columns")
        return self._distortion(self.aggregate(a, b))


_last_two = (-1, -2)
METRICS = {
    m.name: m
    for m in (
        Metric("mse", lambda a, b: F.avg((a - b) ** 2), lambda a, b: ((a - b) ** 2).mean(axis=_last_two)),
        Metric("mae", lambda a, b: F.avg(F.abs(a - b)), lambda a, b: np.abs(a - b).mean(axis=_last_two)),
        Metric("worst", lambda a, b: F.max(F.abs(a - b)), lambda a, b: np.abs(a - b).max(axis=_last_two)),
        Metric("psnr", lambda a, b: psnr_of(F.avg((a - b) ** 2)), lambda a, b: 10 * np.log10(1 / np.maximum(((a - b) ** 2).mean(axis=_last_two), LEAST_MSE)), rising=True),
        Metric("ssim", arrays=ssim_of, alike=True),
    )
}


def register(metric: Metric) -> None:
    """Adds a metric, or replaces the one of its name; the measures and searches take it by name."""
    METRICS[metric.name] = metric


def get(name: str) -> Metric:
    if name not in METRICS:
        raise UnknownMetricError(name)
    return METRICS[name]


def measure(pairs: DataFrame, names: list[str]) -> DataFrame:
    """img and a column for each metric, of pairs of images.

    Metrics of columns are one hash aggregate; the others take an image's pixels together, in one pass for all of them.
    """
    chosen = [get(n) for n in names]
    columns, arrays = [m for m in chosen if m.aggregate], [m for m in chosen if not m.aggregate]
    found = pairs.groupBy("img").agg(*[m.aggregate(F.col("a"), F.col("b")).alias(m.name) for m in columns]) if columns else None
    if arrays:

        def grouped(group: pa.Table) -> pa.Table:
            y, x, a, b = (group.column(c).to_numpy() for c in ("y", "x", "a", "b"))
            images = np.zeros((2, int(y.max()) + 1, int(x.max()) + 1))
            images[0, y, x], images[1, y, x] = a, b
            values = [pa.array([float(m.arrays(images[0], images[1]))]) for m in arrays]
            return pa.Table.from_arrays([group.column("img").slice(0, 1), *values], names=["img", *[m.name for m in arrays]])

        schema = f"img {pairs.schema['img'].dataType.simpleString()}, " + ", ".join(f"`{m.name}` double" for m in arrays)
        by_image = pairs.select("img", "y", "x", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).groupBy("img").applyInArrow(grouped, schema)
        found = by_image if found is None else found.join(by_image, "img")
    return found.select("img", *names)
