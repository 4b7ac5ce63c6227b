"""DuckDB SQL of the kernel patterns: cell hashes with 64-bit wrap-around by way of 128-bit integers, lattice noise by
joins of pixels with the corners or neighbours of their cell."""

from __future__ import annotations

from .common import sql_tidy

WRAP, HALF = 1 << 64, 1 << 63
GOLDEN = -0x61C8864680B583EB
CORNERS = "(VALUES (0, 0), (1, 0), (0, 1), (1, 1)) k(i, j)"
NINE = "(VALUES (-1, -1), (0, -1), (1, -1), (-1, 0), (0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)) k(i, j)"


def _wrapped(product: str) -> str:
    return f"((({product} % {WRAP} + {WRAP + HALF}) % {WRAP}) - {HALF})::BIGINT"


def _hash(x: str, y: str, seed: str) -> str:
    """Column definitions that end in h, the hash of a cell, and j1, j2, two numbers in 0..1 from it."""
    return f"""xor(xor({seed}, {x} * {0x27D4EB2D}), {y} * {0x9E3779B1}) AS n0,
    {_wrapped(f'(xor(n0, n0 >> 15)::HUGEINT * {0x85EBCA6B})')} AS n1, {_wrapped(f'(xor(n1, n1 >> 13)::HUGEINT * {0xC2B2AE35})')} AS n2, xor(n2, n2 >> 16) AS h,
    ((h & 4294967295)::FLOAT / 4294967296::FLOAT)::DOUBLE AS j1, ((xor(h, {GOLDEN}) & 4294967295)::FLOAT / 4294967296::FLOAT)::DOUBLE AS j2"""


def _ease(t: str) -> str:
    return f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"


def _corner_noise(name: str, value: str, x: str, y: str, scale: str, seed: str, octaves: int = 1) -> str:
    """CTEs that end in ``name`` (s, py, px, o, n): noise of octave o, from the corners' values."""
    u, v = _ease("u"), _ease("v")
    at = lambda i, j: f"max(CASE WHEN i = {i} AND j = {j} THEN d END)"
    low, high = (f"({at(0, j)} + {u} * ({at(1, j)} - {at(0, j)}))" for j in (0, 1))
    return f"""{name}_c AS (
  SELECT s, py, px, o, ({seed} + o)::BIGINT AS os, ({x} + 1) * ({scale} * pow(2, o) / 2) AS fx, ({y} + 1) * ({scale} * pow(2, o) / 2) AS fy,
    floor(fx)::BIGINT AS ix, floor(fy)::BIGINT AS iy, fx - ix AS u, fy - iy AS v FROM g, range({octaves}) r(o)
), {name}_k AS (SELECT s, py, px, o, u, v, i, j, {_hash('(ix + i)', '(iy + j)', 'os')}, {value} AS d FROM {name}_c, {CORNERS}
), {name} AS (SELECT s, py, px, o, {low} + {v} * ({high} - {low}) AS n FROM {name}_k GROUP BY s, py, px, o, u, v)"""


GRADIENT = "cos(2 * pi() * j1) * (u - i) + sin(2 * pi() * j1) * (v - j)"


def _clamp(v: str, low: str = "-1", high: str = "1") -> str:
    return f"least(greatest({v}, {low}), {high})"


def _signed(v: str) -> str:
    return _clamp(f"2 * ({v}) - 1")


def _gradient(name: str, x: str, y: str, scale: str, seed: str = "seed") -> str:
    return _corner_noise(name, GRADIENT, x, y, scale, seed)


def _octave_sum(p: dict, gain: float, layer: str, value: str) -> tuple[str, str]:
    norm = (1 - gain ** p["octaves"]) / (1 - gain + 1e-6) + 1e-6
    ctes = _corner_noise("q", value, "x", "y", repr(p["scale"]), "seed", p["octaves"])
    return ctes + f", t AS (SELECT s, py, px, sum({layer} * pow({gain!r}, o)) / {norm!r} AS v FROM q GROUP BY s, py, px)", "t"


def _sites(scale) -> str:
    """CTEs that end in ``w``: the nine sites of a pixel; a, b are the distances from its cell's lower corner."""
    return f"""w_c AS (SELECT s, py, px, seed, (x + 1) * ({scale} / 2.0) AS fx, (y + 1) * ({scale} / 2.0) AS fy, floor(fx)::BIGINT AS ix, floor(fy)::BIGINT AS iy, fx - ix AS u, fy - iy AS v FROM g
), w AS (SELECT s, py, px, {_hash('(ix + i)', '(iy + j)', 'seed')}, i - u AS a, j - v AS b FROM w_c, {NINE})"""


def _per_pixel(value: str) -> str:
    return f", t AS (SELECT s, py, px, {value} AS v FROM w GROUP BY s, py, px)"


def _square(shift: float) -> str:
    return f"((a + j1 - {shift}) * (a + j1 - {shift}) + (b + j2 - {shift}) * (b + j2 - {shift}))"


#: Distances of a pixel from a site.
_apart = {"euclidean": f"sqrt({_square(0.0)})", "manhattan": "abs(a + j1) + abs(b + j2)", "chebyshev": "greatest(abs(a + j1), abs(b + j2))"}


def _displaced(p: dict, dx: int, dy: int, other: int, value: str) -> str:
    return (
        _gradient("nx", "x", "y", repr(p["dist_scale"]))
        + ", "
        + _corner_noise("ny", GRADIENT, f"(x + {dx})", f"(y + {dy})", repr(p["dist_scale"]), f"xor(seed, {other})")
        + f""", m AS (SELECT g.s, g.py, g.px, {_clamp(f"x + {p['dist_amp']!r} * {_clamp('nx.n')}")} AS a, {_clamp(f"y + {p['dist_amp']!r} * {_clamp('ny.n')}")} AS b
  FROM g JOIN nx USING (s, py, px) JOIN ny USING (s, py, px)), t AS (SELECT s, py, px, {value} AS v FROM m)"""
    )


def _with_field(scale, value: str) -> str:
    return _gradient("q", "x", "y", repr(scale)) + f", t AS (SELECT g.s, g.py, g.px, {value} AS v FROM g JOIN (SELECT s, py, px, {_clamp('n')} AS n FROM q) q USING (s, py, px))"


def _brick(p: dict) -> str:
    return f"""w_c AS (SELECT *, (y + 1) * {p['rows']} / 2 AS fy, floor(fy)::BIGINT AS row, (x + 1) * {p['cols']} / 2 + 0.5 * (row % 2) AS fx, floor(fx)::BIGINT AS col FROM g
), w AS (SELECT *, {_hash('col', 'row', 'seed')} FROM w_c
), t AS (SELECT s, py, px, CASE WHEN abs(fx - col - 0.5) <= {p['mortar']!r} OR abs(fy - row - 0.5) <= {p['mortar']!r} THEN -1.0 ELSE 2 * {_clamp(f"(j1 - 0.5) * {p['contrast']!r} + 0.5", '0')} - 1 END AS v FROM w)"""


def kernel_sql(name: str, p: dict, height: int, width: int, seeds: tuple[int, ...], digits: int = 6) -> str | None:
    """SQL for sample_id, py, px, v of a kernel pattern; None for the composite."""
    turn = "2 * pi()"
    lists = {
        "PERLIN": lambda: _octave_sum(p, p["persistence"], _clamp("n"), GRADIENT)[0],
        "VALUE_NOISE": lambda: _octave_sum(p, p["persistence"], _clamp("n", "0"), "j1")[0],
        "FBM_RIDGED": lambda: _octave_sum(p, p["gain"], f"(1 - abs({_clamp('n')}))", GRADIENT)[0],
        "TURBULENCE": lambda: _octave_sum(p, p["gain"], f"abs({_clamp('n')})", GRADIENT)[0],
        "MARBLE": lambda: _with_field(p["noise_scale"], f"sin({turn} * {p['freq']!r} * (x * cos(radians({p['angle_deg']!r})) + y * sin(radians({p['angle_deg']!r}))) + {p['noise_amp']!r} * n)"),
        "WOOD": lambda: _with_field(p["noise_scale"], f"sin({turn} * {p['rings']!r} * (sqrt(x * x + y * y) + {p['noise_amp']!r} * n))"),
        "ISOBANDS": lambda: _with_field(p["scale"], f"len(list_filter(range(1, {p['levels']}), lambda l: (n + 1) / 2 > l / {p['levels']}.0)) / ({p['levels']} + 1e-6) * 2 - 1"),
        "CHECKER_DISTORTED": lambda: _displaced(p, 10, -7, 1234, f"CASE WHEN (floor((a + 1) * {p['cells']} / 2) + floor((b + 1) * {p['cells']} / 2))::BIGINT % 2 = 1 THEN 1.0 ELSE -1.0 END"),
        "GABOR_NOISE": lambda: _displaced(p, 3, -5, 5678, f"sin({turn} * {p['freq']!r} * a) * exp(-0.5 * (pow(a / {p['sigma']!r}, 2) + pow(b / {p['sigma']!r}, 2)))"),
        "BRICK_NOISE": lambda: _brick(p),
        "PEBBLES": lambda: _sites(p["scale"]) + _per_pixel(f"exp(-min({_square(0.5)}) / pow({p['smooth']!r}, 2))"),
        "VORONOI_CELLS": lambda: _sites(p["scale"]) + _per_pixel(f"exp(-{p['contrast']!r} * sqrt(min({_square(0.0)})))"),
        "VORONOI_EDGES": lambda: _sites(p["scale"]) + _per_pixel(f"1 - exp(-{p['sharp']!r} * (list_sort(list({_square(0.0)}))[2] - min({_square(0.0)})))"),
        "WORLEY": lambda: _sites(p["scale"]) + _per_pixel(f"{'1 - ' if p['invert'] else ''}{_clamp(f'min({_apart[p["metric"]]}) / 1.5', '0')}"),
        "STARFIELD": lambda: _sites(p["cells"]) + _per_pixel(f"max(CASE WHEN j1 < {p['density']!r} THEN exp(-{_square(0.5)} / (2 * pow({p['sigma']!r}, 2))) ELSE -1.0 END)"),
        "GAUSSIAN_SPOTS": lambda: _sites(p["cells"]) + f""", e AS (SELECT s, py, px, sum(CASE WHEN j1 < {p['density']!r} THEN exp(-0.5 * {_square(0.0)} / pow({p['sigma']!r}, 2)) ELSE 0 END) AS e FROM w GROUP BY s, py, px
), t AS (SELECT s, py, px, e / greatest(max(e) OVER (PARTITION BY s), 1e-6) AS v FROM e)""",
    }
    if name not in lists:
        return None
    ending = {"PERLIN": _clamp("v"), **{n: _signed("v") for n in ("VALUE_NOISE", "FBM_RIDGED", "TURBULENCE", "PEBBLES", "VORONOI_CELLS", "VORONOI_EDGES", "WORLEY", "GAUSSIAN_SPOTS")}}
    rows = ", ".join(f"({n}, {s}::BIGINT)" for n, s in enumerate(seeds))
    return f"""WITH g AS (
  SELECT s, seed, (i // {width})::INT AS py, (i % {width})::INT AS px, -1.0::DOUBLE + 2.0::DOUBLE * (i % {width}) / {width - 1} AS x, -1.0::DOUBLE + 2.0::DOUBLE * (i // {width}) / {height - 1} AS y
  FROM range({height * width}) r(i), (VALUES {rows}) k(s, seed)
), {lists[name]()} SELECT s::INT AS sample_id, py, px, {sql_tidy(f"({ending.get(name, 'v')})::DOUBLE", digits)} AS v FROM t"""
