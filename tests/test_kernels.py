"""Pattern kernels, seeds and parameters against plain scalar versions; invariants of all patterns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import composite, noise, params, patterns, seeds
from tessella.functions.noise import KERNELS
from tessella.functions.params import at_share
from tessella.functions.patterns import PATTERNS, InvalidParamsError, Param, Pattern, UnknownPatternError, get, register
from tessella.operators import rendering

LOW = (1 << 64) - 1


def wrap(x):
    return seeds.signed(x)


def plain_hash(x, y, seed):
    n = wrap(seed ^ wrap(x * 0x27D4EB2D) ^ wrap(y * 0x9E3779B1))
    n = wrap((n ^ (n >> 15)) * 0x85EBCA6B)
    n = wrap((n ^ (n >> 13)) * 0xC2B2AE35)
    return n ^ (n >> 16)


def plain_unit(h):
    return float(np.float32(np.float32(h & 0xFFFFFFFF) / np.float32(2**32)))


def test_cell_hash():
    for x, y, s in [(0, 0, 0), (1, -1, 42), (-5, 7, -(2**63)), (123456, -987654, 2**62), (-1, -1, -1)]:
        assert int(noise.cell_hash(np.array([x]), np.array([y]), s)[0]) == plain_hash(x, y, s)
        assert float(noise.unit(np.array([plain_hash(x, y, s)]))[0]) == plain_unit(plain_hash(x, y, s))


def plain_gradient(x, y, scale, seed):
    fx, fy = (x + 1) * scale / 2, (y + 1) * scale / 2
    ix, iy = math.floor(fx), math.floor(fy)
    u, v = fx - ix, fy - iy

    def corner(i, j):
        a = 2 * math.pi * plain_unit(plain_hash(ix + i, iy + j, seed))
        return math.cos(a) * (u - i) + math.sin(a) * (v - j)

    ease = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    lerp = lambda a, b, t: a + (b - a) * t
    out = lerp(lerp(corner(0, 0), corner(1, 0), ease(u)), lerp(corner(0, 1), corner(1, 1), ease(u)), ease(v))
    return max(-1.0, min(1.0, out))


def plain_sites(x, y, scale, seed):
    fx, fy = (x + 1) * scale / 2, (y + 1) * scale / 2
    ix, iy = math.floor(fx), math.floor(fy)
    for oy in (-1, 0, 1):
        for ox in (-1, 0, 1):
            h = plain_hash(ix + ox, iy + oy, seed)
            yield plain_unit(h), plain_unit(h ^ wrap(0x9E3779B97F4A7C15)), ix + ox - fx, iy + oy - fy


POINTS = [(-1.0, -1.0), (0.31, -0.77), (0.999, 0.5), (-0.2, 0.11), (1.0, 1.0)]


def each(function, *more):
    x, y = (np.array(c) for c in zip(*POINTS))
    return function(x, y, *more)


def test_lattice_noise():
    assert each(noise.gradient_noise, 7.3, 99) == pytest.approx([plain_gradient(x, y, 7.3, 99) for x, y in POINTS])
    for metric, length in (("euclidean", math.hypot), ("manhattan", lambda a, b: abs(a) + abs(b)), ("chebyshev", lambda a, b: max(abs(a), abs(b)))):
        want = [min(1.0, min(length(dx + jx, dy + jy) for jx, jy, dx, dy in plain_sites(x, y, 9.5, 5)) / 1.5) for x, y in POINTS]
        assert each(noise.nearest_site, 9.5, 5, metric) == pytest.approx(want)


def test_cell_patterns():
    p = {"scale": 20, "sharp": 3.0, "contrast": 2.0, "smooth": 1.5}
    for x, y in POINTS:
        d = sorted((dx + jx) ** 2 + (dy + jy) ** 2 for jx, jy, dx, dy in plain_sites(x, y, 20, 8))
        c = min((dx + jx - 0.5) ** 2 + (dy + jy - 0.5) ** 2 for jx, jy, dx, dy in plain_sites(x, y, 20, 8))
        one = np.array([x]), np.array([y])
        assert noise.voronoi_cells(*one, p, 8)[0] == pytest.approx(max(-1, 2 * math.exp(-2 * math.sqrt(d[0])) - 1))
        assert noise.voronoi_edges(*one, p, 8)[0] == pytest.approx(2 * (1 - math.exp(-3 * (d[1] - d[0]))) - 1)
        assert noise.pebbles(*one, p, 8)[0] == pytest.approx(2 * math.exp(-c / 2.25) - 1)


def test_octaves():
    p = {"scale": 3.0, "octaves": 3, "persistence": 0.6, "gain": 0.6}
    total = (1 - 0.6**3) / (0.4 + 1e-6) + 1e-6
    layers = [[plain_gradient(x, y, 3.0 * 2**k, 11 + k) * 0.6**k for k in range(3)] for x, y in POINTS]
    assert each(noise.perlin, p, 11) == pytest.approx([max(-1, min(1, sum(v) / total)) for v in layers])
    assert each(noise.turbulence, p, 11) == pytest.approx([max(-1, min(1, 2 * sum(map(abs, v)) / total - 1)) for v in layers])


def test_gain_of_one_saturates():
    v = each(noise.turbulence, {"scale": 3.0, "octaves": 2, "gain": 1.0}, 1)
    assert set(np.round(v, 6)) <= {-1.0, 1.0}


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_every_pattern_is_finite_bounded_and_repeatable(spark, name):
    pattern = PATTERNS[name]
    for share in (0.0, 0.5, 1.0):
        values = params.at_share(pattern, share)
        if pattern.noise:
            x, y = noise.grid(24, 20)
            a, b = (np.asarray(noise.KERNELS[name](x, y, values, np.int64(42))) for _ in range(2))
            assert np.isfinite(a).all() and abs(a).max() <= 1 and (a == b).all()
        elif share == 0.5:
            drawn = rendering.render_formula(pattern, values, spark.range(1).select(), 24, 20).collect()
            v = np.array([r["v"] for r in drawn])
            assert len(v) == 480 and np.isfinite(v).all() and abs(v).max() <= 1 + 1e-12


def test_composite_slots():
    x, y = noise.grid(32, 32)
    p = {"base_id": 2, "warp_id": 0, "mask_id": 0, "pal_id": 0, "base_q": 0.5, "warp_q": 0.5, "mask_q": 0.5, "pal_q": 0.5}
    base = noise.perlin(x, y, params.at_share(PATTERNS["PERLIN"], 0.5), composite.slot_seed(3, 1))
    assert np.array_equal(composite.composite(x, y, p, np.int64(3)), base)
    seen = {composite.composite(x, y, p | {"warp_id": w, "mask_id": m, "pal_id": t}, np.int64(3)).tobytes() for w in range(4) for m in range(4) for t in range(3)}
    assert len(seen) == 48
    assert np.allclose(composite.bilinear(base, x, y), base)


def test_seeds(spark):
    rows = spark.range(200).select("id", seeds.tile_seed(F.lit(1234567890123), F.col("id")).alias("s")).collect()
    for r in rows:
        x = (1234567890123 & 0xFFFFFFFF) ^ (0x9E3779B1 * r["id"])
        x = ((x ^ x >> 16) * 0x85EBCA6B) & 0xFFFFFFFF
        x = ((x ^ x >> 13) * 0xC2B2AE35) & 0xFFFFFFFF
        assert r["s"] == x ^ x >> 16
    assert len({seeds.wide_tile_seed(1234, t) for t in range(16)}) == 16
    assert seeds.split_mix(0) == 0xE220A8397B1DCDAF and seeds.derived(1, 2) != seeds.derived(2, 1)
    assert seeds.signed((1 << 64) - 1) == -1


def test_params():
    worley = get("WORLEY")
    vector = params.to_vector(worley, {"scale": 12.5, "metric": "chebyshev", "invert": True})
    assert vector == [12.5, 2.0, 1.0] and params.from_vector(worley, vector) == {"scale": 12.5, "metric": "chebyshev", "invert": True}
    assert params.from_vector(get("WEAVE"), [2.5, 0.1, 1.0])["cells"] == 2
    for bad in ({"scale": 0.5, "metric": "euclidean", "invert": False}, {"scale": 2, "metric": "other", "invert": False}, {"scale": 2, "metric": "euclidean"}, {"scale": 2, "metric": "euclidean", "invert": 0, "more": 1}):
        with pytest.raises(InvalidParamsError):
            params.validate(worley, bad)
    with pytest.raises(UnknownPatternError):
        get("NOTHING")
    assert len(PATTERNS) == 47 and sum(not p.noise for p in PATTERNS.values()) == 30
    assert params.coarse(get("BRICK"))[1]["rows"] == 2


def test_own_pattern(spark):
    register(Pattern("MINE", (Param("a", "float", 0.0, 1.0),), "x * a"))
    try:
        drawn = rendering.render_formula(get("MINE"), {"a": 0.5}, spark.range(1).select(), 1, 3).collect()
        assert [r["v"] for r in drawn] == [-0.5, 0.0, 0.5]
    finally:
        del PATTERNS["MINE"]


def test_seed_columns_equal_the_scalars(spark):
    draw = random.Random(5)
    rows = [(draw.getrandbits(63) - draw.getrandbits(63), draw.getrandbits(40), draw.getrandbits(32)) for _ in range(300)] + [(0, 0, 0), (-1, -1, 2**32 - 1), (2**63 - 1, -(2**63), 1)]
    df = spark.createDataFrame(rows, "a long, b long, t long")
    found = df.select("a", "b", "t", seeds.split_mix_column(F.col("a")).alias("mix"), seeds.derived_column(F.col("a"), F.col("b")).alias("two"), seeds.wide_tile_seed_column(F.col("b"), F.col("t")).alias("wide"), seeds.seed_array(F.col("a"), 3).alias("some"))
    for r in found.collect():
        assert r["mix"] == seeds.signed(seeds.split_mix(r["a"] & seeds.LOW_64))
        assert r["two"] == seeds.signed(seeds.derived(r["a"], r["b"]))
        assert r["wide"] == seeds.wide_tile_seed(r["b"] & seeds.LOW_64, r["t"])
        assert r["some"] == [seeds.signed(seeds.derived(r["a"], k)) for k in range(3)]


def test_patterns_are_found_in_a_package(tmp_path, monkeypatch):
    package = tmp_path / "found_patterns"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "plain.py").write_text("from tessella.functions.patterns import Param, Pattern\nPATTERN = Pattern('HALVES', (Param('at', 'float', -1.0, 1.0),), 'CASE WHEN x < at THEN -1.0 ELSE 1.0 END')\n")
    (package / "kernel.py").write_text("import numpy as np\nfrom tessella.functions.patterns import Pattern\nPATTERN = Pattern('FLAT', ())\ndef KERNEL(x, y, p, seed):\n    return np.zeros(x.shape)\n")
    (package / "other.py").write_text("PATTERN = 'not one'\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    before = set(PATTERNS)
    try:
        assert patterns.discover("found_patterns") == ["FLAT", "HALVES"]
        assert set(PATTERNS) - before == {"FLAT", "HALVES"} and "FLAT" in KERNELS
        assert "HALVES" in patterns.names() and patterns.discover("tessella.streaming") == []
    finally:
        for n in ("FLAT", "HALVES"):
            PATTERNS.pop(n, None)
            KERNELS.pop(n, None)


def test_every_tile_with_every_sample(spark):
    tiles = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "img long, tile_id int")
    pattern = patterns.get("PERLIN")
    samples = [at_share(pattern, s) for s in (0.2, 0.3)]
    rows = rendering.render_tiles(tiles, "PERLIN", samples, [5, 6], 6, 8).collect()
    assert len(rows) == 6 and {(r["img"], r["tile_id"], r["sample_id"]) for r in rows} == {(i, t, n) for i, t in ((1, 0), (1, 1), (2, 0)) for n in (0, 1)}
    alone = {r["sample_id"]: r["data"] for r in rendering.render_images(rendering.jobs(spark, "PERLIN", samples, [5, 6]), 6, 8).collect()}
    assert all(r["data"] == alone[r["sample_id"]] for r in rows)
