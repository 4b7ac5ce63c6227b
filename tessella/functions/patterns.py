"""The catalogue of procedural patterns, and the formulas of those that are plain expressions.

A pattern maps a pixel (x, y in -1..1) and its parameters to a value in -1..1.  A formula is a SQL expression over the
columns x, y and the parameters' names, in functions that Spark and other SQL engines share; Spark compiles it into
its generated code, so a pattern is a projection.  Patterns without a formula need cell hashes or lattice noise and
are kernels in ``noise``.
"""

from __future__ import annotations

import importlib
import pkgutil
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pattern:
    name: str
    params: tuple[Param, ...]
    formula: str | None = None

    @property
    def noise(self) -> bool:
        return self.formula is None


def _params(text: str) -> tuple[Param, ...]:
    """``name type low high`` or ``name type choice|choice``, separated by commas."""
    out = []
    for item in text.split(","):
        name, kind, *rest = item.split()
        if kind in ("float", "int"):
            out.append(Param(name, kind, float(rest[0]), float(rest[1])))
        else:
            out.append(Param(name, kind, choices=tuple(rest[0].split("|")) if rest else ()))
    return tuple(out)


# Building blocks of the formulas.
TURN = "(2 * pi())"
RADIUS = "sqrt(x * x + y * y)"
BOX = "greatest(abs(x), abs(y))"
ANGLE = "(atan2(y, x) + pi())"  # 0..2 pi


def _along(degrees: str) -> str:
    return f"(x * cos(radians({degrees})) + y * sin(radians({degrees})))"


def _clamp(value: str, low: str = "-1.0", high: str = "1.0") -> str:
    return f"least(greatest({value}, {low}), {high})"


def _frac(value: str) -> str:
    return f"(({value}) - floor({value}))"


def _cell(axis: str, cells: str) -> str:
    """Position of a pixel on an axis, counted in cells."""
    return f"(({axis} + 1) * {cells} / 2)"


def _off_centre(value: str) -> str:
    """Distance of a position from the middle of its cell."""
    return f"abs({_frac(value)} - 0.5)"


def _where(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1.0 ELSE -1.0 END)"


def _odd(value: str) -> str:
    return f"(({value}) - 2 * floor(({value}) / 2) = 1)"


def _between_centre(cx: str, cy: str) -> str:
    return f"sqrt((x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy}))"


def _gabor(along: str, across: str, phase: str = "0.0") -> str:
    return f"sin({TURN} * freq * {along} + {phase}) * exp(-0.5 * (({along} / sigma) * ({along} / sigma) + ({across} / sigma) * ({across} / sigma)))"


def _gabor_bank() -> str:
    bands = []
    for k in range(6):
        turn = f"(pi() * {k} / (bands * 2 + 1e-6))"
        along, across = f"(x * cos({turn}) + y * sin({turn}))", f"(y * cos({turn}) - x * sin({turn}))"
        bands.append(f"(CASE WHEN {k} < bands THEN {_gabor(along, across)} ELSE 0.0 END)")
    return _clamp(f"({' + '.join(bands)}) / (bands + 1e-6)")


def _brick() -> str:
    row = f"floor({_cell('y', 'rows')})"
    shifted = f"({_cell('x', 'cols')} + (CASE WHEN {_odd(row)} THEN 0.5 ELSE 0.0 END))"
    return _where(f"{_off_centre(shifted)} > mortar AND {_off_centre(_cell('y', 'rows'))} > mortar")


def _hex_grid() -> str:
    # sqrt(3) / 2 scales y and cancels against the 1 / sqrt(3) of the skewed axes.
    u, v = "((x + 1) * (cells / 2))", "((y + 1) * (cells / 2) * sqrt(3e0) / 2)"
    q, r = _frac(f"{u} - {v} / sqrt(3e0)"), _frac(f"{v} * 2 / sqrt(3e0)")
    return _where(f"least({q}, {r}, {_frac(f'-{q} - {r}')}) < thick")


def _kaleidoscope() -> str:
    sector = f"({TURN} / sectors)"
    folded = f"(atan2(y, x) - {sector} * floor(atan2(y, x) / {sector}))"
    return f"cos(freq * least({folded}, {sector} - {folded}))"


def _checker() -> str:
    turned = [f"(x * cos(radians(angle_deg)) - y * sin(radians(angle_deg)))", f"(x * sin(radians(angle_deg)) + y * cos(radians(angle_deg)))"]
    return _where(_odd(" + ".join(f"floor({_cell(t, 'cells')})" for t in turned)))


CX, CY = _cell("x", "cells"), _cell("y", "cells")
WARP, WEFT = (f"(CASE WHEN {_off_centre(c)} < thick THEN 1.0 ELSE 0.0 END)" for c in (CX, CY))
TILTED = "radians(angle_start_deg * (1 - (y + 1) / 2) + angle_end_deg * ((y + 1) / 2))"
SWIRLED = f"({{}}(k * (x * x + y * y)))"
DEGREES = "0 180"

#: The names, parameters and ranges of the patterns.
PATTERNS = {
    p.name: p
    for p in (
        Pattern("ANGLE_GRADIENT", _params("angle_start_deg float 0 360, angle_end_deg float 0 360"), _clamp(f"x * cos({TILTED}) + y * sin({TILTED})")),
        Pattern("BRICK", _params("rows int 2 512, cols int 2 512, mortar float 0.002 0.1"), _brick()),
        Pattern("BRICK_NOISE", _params("rows int 2 512, cols int 2 512, mortar float 0.002 0.1, contrast float 0.5 2")),
        Pattern("CHECKER_DISTORTED", _params("cells int 2 256, dist_scale float 1 64, dist_amp float 0 0.5")),
        Pattern("CHECKER", _params(f"cells int 2 512, angle_deg float {DEGREES}"), _checker()),
        Pattern("COMPOSITE", _params("base_id int 0 5, warp_id int 0 3, mask_id int 0 3, pal_id int 0 2, base_q float 0 1, warp_q float 0 1, mask_q float 0 1, pal_q float 0 1")),
        Pattern("CONCENTRIC_SQUARES", _params("freq float 1 64, phase float 0 6.28318"), f"sin({TURN} * freq * {BOX} + phase)"),
        Pattern("DIAMOND_GRID", _params("cells int 2 256, thick float 0.005 0.2"), _where(f"{_off_centre(CX)} + {_off_centre(CY)} <= thick")),
        Pattern("DOTS", _params("cells int 2 256, radius float 0.01 0.5"), _where(f"sqrt({_off_centre(CX)} * {_off_centre(CX)} + {_off_centre(CY)} * {_off_centre(CY)}) <= radius")),
        Pattern("FBM_RIDGED", _params("scale float 1 256, octaves int 1 6, gain float 0.3 1")),
        Pattern("GABOR", _params(f"freq float 0.5 64, angle_deg float {DEGREES}, sigma float 0.1 1, phase float 0 6.28318"), _clamp(_gabor(_along("angle_deg"), "(y * cos(radians(angle_deg)) - x * sin(radians(angle_deg)))", "phase"))),
        Pattern("GABOR_BANK", _params("freq float 0.5 64, sigma float 0.05 1, bands int 1 6"), _gabor_bank()),
        Pattern("GABOR_NOISE", _params("freq float 0.5 64, sigma float 0.05 1, dist_scale float 1 64, dist_amp float 0 0.5")),
        Pattern("GAUSSIAN_SPOTS", _params("cells int 4 256, sigma float 0.01 0.2, density float 0.1 1")),
        Pattern("GRADIENT_LINEAR", _params(f"angle_deg float {DEGREES}, bias float -1 1, scale float 0.1 2"), _clamp(f"{_along('angle_deg')} * scale + bias")),
        Pattern("GRADIENT_RADIAL", _params("cx float -1 1, cy float -1 1, scale float 0.1 3"), _clamp(f"1 - {_between_centre('cx', 'cy')} * scale")),
        Pattern("HERRINGBONE", _params("cells int 2 256, thick float 0.003 0.2"), _where(f"{_off_centre(CX)} < thick")),
        Pattern("HEX_GRID", _params("cells int 2 256, thick float 0.003 0.2"), _hex_grid()),
        Pattern("ISOBANDS", _params("scale float 1 256, levels int 2 32")),
        Pattern("KALEIDOSCOPE", _params("sectors int 3 64, freq float 4 128"), _kaleidoscope()),
        Pattern("LATTICE", _params("cells int 2 256, thick float 0.005 0.1"), _where(f"{_off_centre(CX)} < thick OR {_off_centre(CY)} < thick")),
        Pattern("MARBLE", _params(f"freq float 1 64, noise_scale float 2 128, noise_amp float 0.1 2, angle_deg float {DEGREES}")),
        Pattern("MOIRE", _params("f1 float 0.5 64, f2 float 0.5 64, delta_deg float -10 10"), f"0.5 * (sin({TURN} * (f1 * x)) + sin({TURN} * (f2 * (x * cos(radians(delta_deg)) - y * sin(radians(delta_deg))))))"),
        Pattern("PEBBLES", _params("scale int 16 256, smooth float 0.5 5")),
        Pattern("PERLIN", _params("scale float 1 256, octaves int 1 6, persistence float 0.3 1")),
        Pattern("PLAID", _params("fx float 0.5 64, fy float 0.5 64, amp float 0.1 1, phase float 0 6.28318"), f"(sin({TURN} * fx * x + phase) + sin({TURN} * fy * y + phase)) * 0.5 * amp"),
        Pattern("POLAR_CHECKER", _params("radial int 2 256, angular int 2 256"), f"-1 * {_where(_odd(f'floor(least({RADIUS}, 1e0) * radial) + floor({ANGLE} / {TURN} * angular)'))}"),
        Pattern("RINGS", _params("freq float 0.5 128, cx float -1 1, cy float -1 1, phase float 0 6.28318"), f"sin({TURN} * freq * {_between_centre('cx', 'cy')} + phase)"),
        Pattern("RIPPLE", _params("freq float 1 128, decay float 0 3, phase float 0 6.28318"), f"sin({TURN} * freq * {RADIUS} + phase) / (1 + decay * {RADIUS})"),
        Pattern("SPIRAL", _params("turns float 0.5 32, tight float 0.1 5"), f"sin(tight * ({RADIUS} + 1e-6) + turns * {ANGLE})"),
        Pattern("SPIRAL_SQUARE", _params("turns float 0.5 32, tight float 0.1 5"), f"sin(tight * {BOX} + turns * {ANGLE})"),
        Pattern("STARFIELD", _params("cells int 32 512, density float 0.05 1, sigma float 0.005 0.1")),
        Pattern("STRIPES", _params(f"freq float 0.5 64, angle_deg float {DEGREES}, phase float 0 6.28318"), f"sin({TURN} * freq * {_along('angle_deg')} + phase)"),
        Pattern("STRIPES_MULTISCALE", _params(f"f1 float 0.5 64, f2 float 0.5 64, angle1_deg float {DEGREES}, angle2_deg float {DEGREES}"), f"0.5 * (sin({TURN} * f1 * {_along('angle1_deg')}) + sin({TURN} * f2 * {_along('angle2_deg')}))"),
        Pattern("SUNBURST", _params("rays int 2 256, gamma float 0.5 3"), f"(1 - power(2 * {_off_centre(f'{ANGLE} / {TURN} * rays')}, gamma)) * 2 - 1"),
        Pattern("SWIRL", _params("k float 0 10, freq float 0.5 64"), f"sin({TURN} * freq * (x * {SWIRLED.format('cos')} - y * {SWIRLED.format('sin')}))"),
        Pattern("TRI_TILING", _params("cells int 2 256, line float 0.003 0.2"), _where(f"least({_off_centre(CX)}, {_off_centre(f'{CY} * sqrt(3e0) / 2')}) < line")),
        Pattern("TURBULENCE", _params("scale float 1 256, octaves int 1 6, gain float 0.3 1")),
        Pattern("VALUE_NOISE", _params("scale float 1 256, octaves int 1 6, persistence float 0.3 1")),
        Pattern("VORONOI_CELLS", _params("scale int 16 256, contrast float 0.5 5")),
        Pattern("VORONOI_EDGES", _params("scale int 16 256, sharp float 0.5 10")),
        Pattern("WAVES_BEND", _params("freq float 0.5 64, bend float 0 0.5, bend_freq float 0.5 32"), f"sin({TURN} * freq * (x + bend * sin({TURN} * bend_freq * y)))"),
        Pattern("WAVES_CIRC", _params("freq float 0.5 128, amp float 0.1 1, phase float 0 6.28318"), f"sin({TURN} * freq * {RADIUS} + phase) * amp"),
        Pattern("WAVES_DIR", _params(f"freq float 0.5 64, angle_deg float {DEGREES}, amp float 0.1 1, phase float 0 6.28318"), f"sin({TURN} * freq * {_along('angle_deg')} + phase) * amp"),
        Pattern("WEAVE", _params("cells int 2 256, thick float 0.01 0.3, contrast float 0.5 2"), f"{_clamp(f'({WARP} + {WEFT} - {WARP} * {WEFT}) * contrast', '0e0', '1e0')} * 2 - 1"),
        Pattern("WOOD", _params("rings float 2 128, noise_scale float 2 128, noise_amp float 0 1")),
        Pattern("WORLEY", _params("scale float 1 256, metric enum euclidean|manhattan|chebyshev, invert bool")),
    )
}


class UnknownPatternError(KeyError):
    """No pattern has this name."""


class InvalidParamsError(ValueError):
    """Parameters that a pattern doesn't take."""


def get(name: str) -> Pattern:
    if name not in PATTERNS:
        raise UnknownPatternError(name)
    return PATTERNS[name]


def register(pattern: Pattern) -> None:
    """Adds a pattern, or replaces the one of its name.  A pattern without a formula needs a kernel in ``noise``."""
    PATTERNS[pattern.name] = pattern


def names() -> list[str]:
    return sorted(PATTERNS)


def discover(package: str) -> list[str]:
    """Registers what the modules of a package name ``PATTERN`` (and ``KERNEL``, where it isn't a formula); their names.

    The package must be importable on executors too (ship it with the job) if it holds kernels.
    """
    from .noise import KERNELS

    found = []
    home = importlib.import_module(package)
    for info in pkgutil.iter_modules(home.__path__):
        module = importlib.import_module(f"{package}.{info.name}")
        pattern = getattr(module, "PATTERN", None)
        if isinstance(pattern, Pattern):
            register(pattern)
            if pattern.noise:
                KERNELS[pattern.name] = module.KERNEL
            found.append(pattern.name)
    return sorted(found)


def rendered(pattern: Pattern) -> Column:
    """The value of a pattern, from the columns x, y and its parameters."""
    if pattern.formula is None:
        raise InvalidParamsError(f"{pattern.name} is a kernel")
    return F.expr(pattern.formula).cast("double")


def pixels(frame: DataFrame, height: int, width: int) -> DataFrame:
    """Every row of ``frame`` with the pixels of an image: py, px, x, y.  An explode, so rows are dealt as they are."""
    at = F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))).alias("_at")
    out = frame.select("*", at)
    out = out.withColumns({"py": F.floor(F.col("_at") / width).cast("int"), "px": (F.col("_at") % width).cast("int")}).drop("_at")
    unit = lambda c, n: (F.lit(-1.0) + 2.0 * F.col(c) / (n - 1)) if n > 1 else F.lit(-1.0)
    return out.withColumns({"x": unit("px", width), "y": unit("py", height)})
