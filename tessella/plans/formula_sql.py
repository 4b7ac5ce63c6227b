"""DuckDB SQL of the patterns that are formulas, stated anew from what each pattern is (not from the strings that Spark
runs), over pixels with radius r, box distance q and angle t, and the two numbers of each of their cells."""

from __future__ import annotations

from .common import sql_tidy

W = "(2 * pi())"
#: The angle of a pixel as 0..2 pi.
POSITIVE = "(t + pi())"


def _turned(angle: str) -> str:
    """The coordinate along a direction, as the radius times the cosine of what lies between."""
    return f"(r * cos(t - radians({angle})))"


def _part(value: str) -> str:
    return f"fmod({value}, 1.0::DOUBLE)"


def _middle(value: str) -> str:
    return f"abs({_part(value)} - 0.5)"


def _yes(condition: str) -> str:
    return f"if({condition}, 1.0, -1.0)"


def _bell(turn: str, phase: str = "0") -> str:
    """A wave along the direction under a bell of the radius: the squares of both coordinates are that of the radius."""
    return f"sin({W} * freq * r * cos(t - {turn}) + {phase}) * exp(-(r * r) / (2 * sigma * sigma))"


def _within(value: str, low: str = "-1", high: str = "1") -> str:
    return f"greatest({low}, least({high}, {value}))"


def _bricks() -> str:
    across = "((x + 1) * cols / 2 + 0.5 * (floor((y + 1) * rows / 2)::BIGINT & 1))"
    return _yes(f"least({_middle(across)}, {_middle('((y + 1) * rows / 2)')}) > mortar")


CX, CY = "((x + 1) * cells / 2)", "((y + 1) * cells / 2)"
HEX_U, HEX_V = f"{_part('((x + 1) * (cells / 2) - (y + 1) * (cells / 2) / 2)')}", f"{_part('((y + 1) * (cells / 2))')}"
SECTOR = f"({W} / sectors)"
FORMULAS = {
    "ANGLE_GRADIENT": _within(f"r * cos(t - radians(angle_start_deg + (angle_end_deg - angle_start_deg) * (y + 1) / 2))"),
    "BRICK": _bricks(),
    "CHECKER": _yes("(floor((x * cos(radians(angle_deg)) - y * sin(radians(angle_deg)) + 1) * cells / 2)::BIGINT + floor((x * sin(radians(angle_deg)) + y * cos(radians(angle_deg)) + 1) * cells / 2)::BIGINT) & 1 = 1"),
    "CONCENTRIC_SQUARES": f"sin({W} * freq * q + phase)",
    "DIAMOND_GRID": _yes(f"{_middle(CX)} + {_middle(CY)} <= thick"),
    "DOTS": _yes(f"pow({_middle(CX)}, 2) + pow({_middle(CY)}, 2) <= radius * radius"),
    "GABOR": _within(_bell("radians(angle_deg)", "phase")),
    "GABOR_BANK": _within(f"list_sum(list_transform(range(bands::BIGINT), lambda k: {_bell('pi() * k / (2 * bands + 1e-6)')})) / (bands + 1e-6)"),
    "GRADIENT_LINEAR": _within(f"{_turned('angle_deg')} * scale + bias"),
    "GRADIENT_RADIAL": _within("1 - scale * sqrt(pow(x - cx, 2) + pow(y - cy, 2))"),
    "HERRINGBONE": _yes(f"{_middle(CX)} < thick"),
    "HEX_GRID": _yes(f"list_min([{HEX_U}, {HEX_V}, fmod(2 - {HEX_U} - {HEX_V}, 1.0::DOUBLE)]) < thick"),
    "KALEIDOSCOPE": f"cos(freq * ({SECTOR} / 2 - abs(fmod(t + {W}, {SECTOR}) - {SECTOR} / 2)))",
    "LATTICE": _yes(f"least({_middle(CX)}, {_middle(CY)}) < thick"),
    "MOIRE": f"(sin({W} * f1 * x) + sin({W} * f2 * r * cos(t + radians(delta_deg)))) / 2",
    "PLAID": f"amp * sin(pi() * (fx * x + fy * y) + phase) * cos(pi() * (fx * x - fy * y))",
    "POLAR_CHECKER": _yes(f"(floor(least(r, 1) * radial)::BIGINT + floor({POSITIVE} / {W} * angular)::BIGINT) & 1 = 0"),
    "RINGS": f"sin({W} * freq * sqrt(pow(x - cx, 2) + pow(y - cy, 2)) + phase)",
    "RIPPLE": f"sin({W} * freq * r + phase) / (1 + decay * r)",
    "SPIRAL": f"sin(tight * (r + 1e-6) + turns * {POSITIVE})",
    "SPIRAL_SQUARE": f"sin(tight * q + turns * {POSITIVE})",
    "STRIPES": f"sin({W} * freq * {_turned('angle_deg')} + phase)",
    "STRIPES_MULTISCALE": f"(sin({W} * f1 * {_turned('angle1_deg')}) + sin({W} * f2 * {_turned('angle2_deg')})) / 2",
    "SUNBURST": f"1 - 2 * pow(2 * {_middle(f'({POSITIVE} / {W} * rays)')}, gamma)",
    "SWIRL": f"sin({W} * freq * r * cos(t + k * r * r))",
    "TRI_TILING": _yes(f"least({_middle(CX)}, {_middle(f'({CY} * sqrt(3) / 2)')}) < line"),
    "WAVES_BEND": f"sin({W} * freq * (x + bend * sin({W} * bend_freq * y)))",
    "WAVES_CIRC": f"amp * sin({W} * freq * r + phase)",
    "WAVES_DIR": f"amp * sin({W} * freq * {_turned('angle_deg')} + phase)",
    "WEAVE": f"2 * {_within(f'if(least({_middle(CX)}, {_middle(CY)}) < thick, contrast, 0)', '0')} - 1",
}


def formula_sql(name: str, samples: list[dict], height: int, width: int, digits: int = 6) -> str:
    """SQL for sample_id, py, px, v of a pattern at several points of its parameters."""
    values = lambda p: ", ".join(f"{float(v)!r}::DOUBLE AS {k}" for k, v in p.items())
    rows = " UNION ALL ".join(f"SELECT {n} AS sample_id, {values(p)}" for n, p in enumerate(samples))
    return f"""WITH p AS ({rows}), g AS (
  SELECT (i // {width})::INT AS py, (i % {width})::INT AS px, 2.0::DOUBLE * (i % {width}) / {width - 1} - 1 AS x, 2.0::DOUBLE * (i // {width}) / {height - 1} - 1 AS y FROM range({height * width}) r(i)
), a AS (SELECT *, sqrt(x * x + y * y) AS r, greatest(abs(x), abs(y)) AS q, atan2(y, x) AS t FROM g
), o AS (SELECT sample_id, py, px, ({FORMULAS[name]})::DOUBLE AS v FROM a, p)
SELECT sample_id::INT AS sample_id, py, px, {sql_tidy('v', digits)} AS v FROM o"""
