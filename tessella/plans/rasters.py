"""Queries on rasters: grids, windows, search, metrics, blend.  Images are the vectors of ``embeddings``, 64 to an image."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from ..functions.seeds import derived_column, tile_seed
from ..operators import codec, metrics, search, tiling
from ..sources import raster
from .common import PAIRS, PIXELS, dims, pairs, pixels, sql_tidy, tidy

SIZE, OVERLAP = 32, 8
QUERIES, SQL = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _starts(length: str, clipped: bool) -> str:
    stride = SIZE - OVERLAP
    if clipped:
        return f"range(0, greatest({length} - {OVERLAP}, 1), {stride})"
    last = f"greatest({length} - {SIZE}, 0)"
    return f"list_sort(list_distinct(list_concat(range(0, {last} + 1, {stride}), [{last}])))"


def _grid(clipped: bool) -> str:
    return f""", starts AS (
  SELECT img, h, w, {_starts('h', clipped)} AS ys, {_starts('w', clipped)} AS xs FROM dims
), tiles AS (
  SELECT img, h, w, ((iy - 1) * len(xs) + ix - 1)::INT AS tile_id, ys[iy]::INT AS y0, xs[ix]::INT AS x0, least(ys[iy] + {SIZE}, h)::INT AS y1, least(xs[ix] + {SIZE}, w)::INT AS x1
  FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS ix FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS iy FROM starts))
)"""


@query
def tile_grid_clamped(spark, sf_dir):
    return tiling.tiles(dims(spark, sf_dir), SIZE, OVERLAP)


@query
def tile_grid_rects(spark, sf_dir):
    return tiling.tiles(dims(spark, sf_dir), SIZE, OVERLAP, clipped=True)


for _name, _clipped in (("tile_grid_clamped", False), ("tile_grid_rects", True)):
    SQL[_name] = f"WITH {PIXELS}{_grid(_clipped)} SELECT * FROM tiles"


@query
def tile_pixels(spark, sf_dir):
    """Pixels and mean of each tile."""
    rows = tiling.tile_pixels(pixels(spark, sf_dir), dims(spark, sf_dir), SIZE, OVERLAP)
    return rows.groupBy("img", "tile_id").agg(F.count("*").alias("n"), tidy(F.avg("v")).alias("mean"), F.max("ty").alias("last_y"), F.max("tx").alias("last_x"))


_IN_TILE = "JOIN pix ON pix.img = t.img AND pix.y >= t.y0 AND pix.y < t.y1 AND pix.x >= t.x0 AND pix.x < t.x1"
SQL["tile_pixels"] = f"""WITH {PIXELS}{_grid(False)}
SELECT t.img, tile_id, count(*) AS n, {sql_tidy('avg(v)')} AS mean, max(y - y0) AS last_y, max(x - x0) AS last_x FROM tiles t {_IN_TILE} GROUP BY ALL"""


def _weighed(spark, sf_dir, weight):
    """The tiles of the decoder's grid: the sum of a weight over their pixels, and of the weighed values."""
    rows = tiling.tile_pixels(pixels(spark, sf_dir), dims(spark, sf_dir), SIZE, OVERLAP).withColumn("w", weight)
    return rows.groupBy("img", "tile_id").agg(tidy(F.sum("w")).alias("w"), tidy(F.sum(F.col("w") * F.col("v"))).alias("wv"))


def _weighed_sql(weight: str) -> str:
    return f"""WITH {PIXELS}{_grid(False)}, t AS (SELECT t.img, tile_id, (pix.y - y0)::INT AS y, (pix.x - x0)::INT AS x, v FROM tiles t {_IN_TILE}), u AS (SELECT img, tile_id, v, {weight} AS w FROM t)
SELECT img, tile_id, {sql_tidy('sum(w)')} AS w, {sql_tidy('sum(w * v)')} AS wv FROM u GROUP BY ALL"""


_EDGE = f"least(y, x, {SIZE - 1} - y, {SIZE - 1} - x)"


@query
def border_mask(spark, sf_dir):
    return _weighed(spark, sf_dir, tiling.border_mask(F.col("ty"), F.col("tx"), SIZE, SIZE, 8))


@query
def seam_mask(spark, sf_dir):
    return _weighed(spark, sf_dir, tiling.seam_mask(F.col("ty"), F.col("tx"), SIZE, OVERLAP, 1.5))


@query
def window_hann(spark, sf_dir):
    return _weighed(spark, sf_dir, tiling.window("hann", F.col("ty"), F.col("tx"), SIZE, OVERLAP))


@query
def window_tukey(spark, sf_dir):
    return _weighed(spark, sf_dir, tiling.window("tukey", F.col("ty"), F.col("tx"), SIZE, OVERLAP))


@query
def window_kaiser(spark, sf_dir):
    return _weighed(spark, sf_dir, tiling.window("kaiser", F.col("ty"), F.col("tx"), SIZE, OVERLAP))


_HANN = f"(CASE WHEN {{0}} < {OVERLAP} THEN 0.5 * (1 - cos(pi() * {{0}} / {OVERLAP - 1})) WHEN {{0}} > {SIZE - 1 - OVERLAP} THEN 0.5 * (1 - cos(pi() * ({SIZE - 1} - {{0}}) / {OVERLAP - 1})) ELSE 1.0 END)"
_ALPHA = 2 * OVERLAP / SIZE
_TUKEY = f"(CASE WHEN {{0}} / {SIZE - 1}.0 < {_ALPHA / 2} THEN 0.5 * (1 + cos(pi() * (2 * ({{0}} / {SIZE - 1}.0) / {_ALPHA} - 1))) WHEN {{0}} / {SIZE - 1}.0 > {1 - _ALPHA / 2} THEN 0.5 * (1 + cos(pi() * (2 * ({{0}} / {SIZE - 1}.0) / {_ALPHA} - 2 / {_ALPHA} + 1))) ELSE 1.0 END)"
#: The series of the Bessel function, for each place of a line.
_KAISER = "list_sum(list_transform(range(40), lambda k: pow(6.5 * sqrt(greatest(1 - pow(2 * {0} / %s.0 - 1, 2), 0)) / 2, 2 * k) / pow(gamma(k + 1), 2))) / list_sum(list_transform(range(40), lambda k: pow(3.25, 2 * k) / pow(gamma(k + 1), 2)))" % (SIZE - 1)
SQL["border_mask"] = _weighed_sql(f"CASE WHEN {_EDGE} < 8 THEN 1.0 ELSE 0.0 END::DOUBLE")
SQL["seam_mask"] = _weighed_sql(f"pow(greatest(1 - {_EDGE} / {OVERLAP}.0, 0), 1.5)")
SQL["window_hann"] = _weighed_sql(_HANN.format("y") + " * " + _HANN.format("x"))
SQL["window_tukey"] = _weighed_sql(_TUKEY.format("y") + " * " + _TUKEY.format("x"))
SQL["window_kaiser"] = _weighed_sql(f"({_KAISER.format('y')}) * ({_KAISER.format('x')})")

_CAND = "cand AS (SELECT (f * 24 + a * 4 + p)::INT AS cand_id, f::INT AS i_f, a::INT AS i_a, p::INT AS i_p, [4, 7, 10][f + 1]::INT AS freq, (a * 30)::INT AS ang, (p * 90)::INT AS phase FROM range(3) r(f), range(6) s(a), range(4) t(p))"


@query
def candidate_grid(spark, sf_dir):
    """Each image with its candidates."""
    return search.with_candidates(dims(spark, sf_dir).select("img"))


SQL["candidate_grid"] = f"WITH {PIXELS}, {_CAND} SELECT img, cand.* FROM dims, cand"


@query
def grid_linspace(spark, sf_dir):
    """A grid over the range of each image's values."""
    ranges = pixels(spark, sf_dir).groupBy("img").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    grid = search.parameter_grid(ranges, {"a": (0.0, 1.0), "b": (0.0, 10.0)}, {"a": 9, "b": 5})
    return grid.select("img", tidy(F.col("low") + (F.col("high") - F.col("low")) * F.col("a")).alias("a"), tidy(F.col("b")).alias("b"))


def _means():
    """Two numbers of an image to look for: the means of its left and right columns, four times as large."""
    return [(4 * F.avg(F.when(at, F.col("v")))).alias(n) for n, at in (("to_a", F.col("x") < 32), ("to_b", F.col("x") >= 32))]


@query
def local_refine(spark, sf_dir):
    """For each image the point of a coarse grid nearest to its numbers, and the best of a finer grid around it."""
    targets = pixels(spark, sf_dir).groupBy("img").agg(*_means())
    distance = lambda a, b: F.sqrt((F.col(a) - F.col("to_a")) ** 2 + (F.col(b) - F.col("to_b")) ** 2)
    coarse = search.parameter_grid(targets, {"a": (-1.0, 1.0), "b": (-1.0, 1.0)}, {"a": 9, "b": 9})
    nearest = coarse.groupBy("img", "to_a", "to_b").agg(F.min(F.struct(distance("a", "b").alias("d"), "a", "b")).alias("n")).select("img", "to_a", "to_b", "n.*")
    fine = search.refine(nearest, {"a": 0.3, "b": 0.3}, 7).withColumn("fine_d", distance("fine_a", "fine_b"))
    best = fine.groupBy("img", "d").agg(F.min("fine_d").alias("fine_d"))
    return best.select("img", tidy(F.col("d")).alias("coarse"), tidy(F.col("fine_d")).alias("fine"))


SQL["grid_linspace"] = f"""WITH {PIXELS}, r AS (SELECT img, min(v) AS low, max(v) AS high FROM pix GROUP BY img)
SELECT img, {sql_tidy('low + (high - low) * a / 8.0')} AS a, {sql_tidy('b * 2.5')} AS b FROM r, range(9) s(a), range(5) t(b)"""
SQL["local_refine"] = f"""WITH {PIXELS}, g AS (SELECT img, 4 * avg(CASE WHEN x < 32 THEN v END) AS ta, 4 * avg(CASE WHEN x >= 32 THEN v END) AS tb FROM pix GROUP BY img
), c AS (
  SELECT img, ta, tb, -1 + a / 4.0 AS a, -1 + b / 4.0 AS b FROM g, range(9) r(a), range(9) s(b)
), n AS (SELECT *, sqrt(pow(a - ta, 2) + pow(b - tb, 2)) AS d FROM c QUALIFY row_number() OVER (PARTITION BY img ORDER BY d, a, b) = 1)
SELECT img, {sql_tidy('any_value(d)')} AS coarse, {sql_tidy('min(sqrt(pow(a - 0.3 + i * 0.1 - ta, 2) + pow(b - 0.3 + j * 0.1 - tb, 2)))')} AS fine FROM n, range(7) r(i), range(7) s(j) GROUP BY img"""


def _scores(spark, sf_dir, seam: float = 0.0):
    rows = tiling.tile_pixels(pixels(spark, sf_dir), dims(spark, sf_dir), SIZE, OVERLAP, clipped=True)
    return search.scores(rows, seam, SIZE, OVERLAP)


@query
def rd_search_mse(spark, sf_dir):
    """The candidate stripes of least distortion and rate for each tile (a rate of 304 bits for each)."""
    best = search.best(_scores(spark, sf_dir), F.lit(304.0), 0.02)
    return best.select("img", "tile_id", "cand_id", "freq", "ang", "phase", tidy(F.col("d")).alias("d"))


@query
def rd_topk(spark, sf_dir):
    return search.top(_scores(spark, sf_dir), 3).select("img", "tile_id", "rank", "cand_id", tidy(F.col("d")).alias("d"))


@query
def rd_seam(spark, sf_dir):
    best = search.best(_scores(spark, sf_dir, 0.5), F.lit(0.0), 0.0)
    return best.select("img", "tile_id", "cand_id", tidy(F.col("d")).alias("d"))


def _scored(seam: float) -> str:
    unit = lambda at, first, last: f"CASE WHEN {last} - {first} > 1 THEN -1.0 + 2.0 * ({at} - {first}) / ({last} - {first} - 1) ELSE -1.0 END"
    mask = f"greatest(1 - least(y - y0, x - x0, {SIZE - 1} - y + y0, {SIZE - 1} - x + x0) / {OVERLAP}.0, 0)"
    return f"""WITH {PIXELS}{_grid(True)}, {_CAND}, u AS (
  SELECT t.img, tile_id, v, {unit('x', 'x0', 'x1')} AS ux, {unit('y', 'y0', 'y1')} AS uy, {mask} AS m FROM tiles t {_IN_TILE}
), e AS (
  SELECT img, tile_id, cand_id, freq, ang, phase, m, pow(v - cos(2 * pi() * freq * (ux * cos(radians(ang)) + uy * sin(radians(ang))) + radians(phase)), 2) AS e FROM u, cand
), s AS (SELECT img, tile_id, cand_id, freq, ang, phase, avg(e) + {seam} * avg(e * m) AS d FROM e GROUP BY ALL
), r AS (SELECT *, (row_number() OVER (PARTITION BY img, tile_id ORDER BY round(d, 9), cand_id))::INT AS rank FROM s)"""


SQL["rd_search_mse"] = f"{_scored(0.0)} SELECT img, tile_id, cand_id, freq, ang, phase, {sql_tidy('d')} AS d FROM r WHERE rank = 1"
SQL["rd_topk"] = f"{_scored(0.0)} SELECT img, tile_id, rank, cand_id, {sql_tidy('d')} AS d FROM r WHERE rank <= 3"
SQL["rd_seam"] = f"{_scored(0.5)} SELECT img, tile_id, cand_id, {sql_tidy('d')} AS d FROM r WHERE rank = 1"


@query
def mse(spark, sf_dir):
    return metrics.mse(pairs(spark, sf_dir)).select("img", tidy(F.col("mse"), 9).alias("mse"))


@query
def psnr(spark, sf_dir):
    return metrics.psnr(pairs(spark, sf_dir)).select("img", tidy(F.col("psnr")).alias("psnr"))


@query
def ssim_window(spark, sf_dir):
    return metrics.ssim(pairs(spark, sf_dir)).select("img", tidy(F.col("ssim")).alias("ssim"))


SQL["mse"] = f"WITH {PAIRS} SELECT img, {sql_tidy('avg(pow(a - b, 2))', 9)} AS mse FROM pairs GROUP BY img"
SQL["psnr"] = f"WITH {PAIRS} SELECT img, {sql_tidy('10 * log10(1 / greatest(avg(pow(a - b, 2)), 1e-12))')} AS psnr FROM pairs GROUP BY img"
_TAPS = "taps AS (SELECT k - 5 AS k, exp(-pow(k - 5, 2) / 4.5) / sum(exp(-pow(k - 5, 2) / 4.5)) OVER () AS g FROM range(11) r(k))"
_BLUR = ", ".join(f"sum(g * {c}) AS {c}" for c in ("a", "b", "aa", "bb", "ab"))
SSIM_VALUE = "avg(least(greatest((2 * r.a * r.b + 1e-4) * (2 * (ab - r.a * r.b) + 9e-4) / ((r.a * r.a + r.b * r.b + 1e-4) * (aa - r.a * r.a + bb - r.b * r.b + 9e-4)), 0), 1))"
SSIM_START = f"""WITH {PAIRS}, {_TAPS}, p AS (SELECT *, a * a AS aa, b * b AS bb, a * b AS ab FROM pairs
), q AS (SELECT img, y, x - k AS x, {_BLUR} FROM p, taps GROUP BY img, y, x - k
), r AS (SELECT img, y - k AS y, x, {_BLUR} FROM q, taps GROUP BY img, y - k, x)"""
SQL["ssim_window"] = f"{SSIM_START} SELECT img, {sql_tidy(SSIM_VALUE)} AS ssim FROM r JOIN pairs USING (img, y, x) GROUP BY img"


def _tile_waves(spark, sf_dir, kind: str):
    """Each tile of the decoder's grid as the pixels of its image, brighter by its number, blended."""
    rows = tiling.tile_pixels(pixels(spark, sf_dir), dims(spark, sf_dir), SIZE, OVERLAP)
    return tiling.blend(rows.withColumn("v", F.col("v") + F.col("tile_id") / 100), SIZE, OVERLAP, kind).select("img", "y", "x", tidy(F.col("v")).alias("v"))


@query
def blend_hann(spark, sf_dir):
    return _tile_waves(spark, sf_dir, "hann")


@query
def blend_tukey(spark, sf_dir):
    return _tile_waves(spark, sf_dir, "tukey")


@query
def blend_kaiser(spark, sf_dir):
    return _tile_waves(spark, sf_dir, "kaiser")


for _name, _window in (("blend_hann", _HANN), ("blend_tukey", _TUKEY), ("blend_kaiser", f"({_KAISER})")):
    SQL[_name] = f"""WITH {PIXELS}{_grid(False)}, t AS (
  SELECT t.img, pix.y, pix.x, v + tile_id / 100.0 AS v, {_window.format('(pix.y - y0)')} * {_window.format('(pix.x - x0)')} AS w FROM tiles t {_IN_TILE}
) SELECT img, y, x, {sql_tidy('sum(w * v) / (sum(w) + 1e-8)')} AS v FROM t GROUP BY img, y, x"""


@query
def montage(spark, sf_dir):
    """All images in rows of three: the canvas' lines, summed."""
    canvas = tiling.montage(pixels(spark, sf_dir), raster.ROWS, 64, 3)
    return canvas.groupBy("y").agg(F.count("*").alias("n"), F.max("x").alias("last"), tidy(F.sum(F.col("v") * F.col("x")), 4).alias("s"))


@query
def quantize_u8(spark, sf_dir):
    return pixels(spark, sf_dir).select("img", raster.to_u8(F.col("v")).alias("u8")).groupBy("img", "u8").agg(F.count("*").alias("n"))


SQL["montage"] = f"WITH {PIXELS}, c AS (SELECT (img // 3) * 64 + y AS y, (img % 3) * 64 + x AS x, v FROM pix) SELECT y, count(*) AS n, max(x) AS last, {sql_tidy('sum(v * x)', 4)} AS s FROM c GROUP BY y"
SQL["quantize_u8"] = f"WITH {PIXELS} SELECT img, floor((least(greatest(v, -1), 1) + 1) * 127.5)::INT AS u8, count(*) AS n FROM pix GROUP BY ALL"


@query
def tile_seeds(spark, sf_dir):
    tiles = tiling.tiles(dims(spark, sf_dir), SIZE, OVERLAP)
    return tiles.select("img", "tile_id", tile_seed(F.col("img") * 1000 + 1337, F.col("tile_id")).alias("seed"))


SQL["tile_seeds"] = f"""WITH {PIXELS}{_grid(False)}, a AS (
  SELECT img, tile_id, xor((img * 1000 + 1337)::HUGEINT, 2654435769 * tile_id::HUGEINT) AS x FROM tiles
), b AS (SELECT img, tile_id, (xor(x, x >> 16) * 2246822507) & 4294967295::HUGEINT AS x FROM a
), c AS (SELECT img, tile_id, (xor(x, x >> 13) * 3266489909) & 4294967295::HUGEINT AS x FROM b)
SELECT img, tile_id, xor(x, x >> 16)::BIGINT AS seed FROM c""".replace("2654435769", str(0x9E3779B1))


@query
def derived_seeds(spark, sf_dir):
    """A 64-bit seed of each tile, derived from image and tile."""
    tiles = tiling.tiles(dims(spark, sf_dir), SIZE, OVERLAP)
    return tiles.select("img", "tile_id", derived_column(F.col("img"), F.col("tile_id")).alias("seed"))


def _sql_mix(x: str, n: int) -> str:
    """CTE columns z{n}a.. of a 64-bit mix, unsigned, by products with the halves of its factors."""
    word = 1 << 64
    times = lambda v, f: f"(((({v}) * {f >> 32}) % {1 << 32}) * {1 << 32} + ({v}) * {f & 0xFFFFFFFF}) % {word}"
    z = f"z{n}"
    return f"""(({x}) + {0x9E3779B97F4A7C15}) % {word} AS {z}a, {times(f'xor({z}a, {z}a >> 30)', 0xBF58476D1CE4E5B9)} AS {z}b, {times(f'xor({z}b, {z}b >> 27)', 0x94D049BB133111EB)} AS {z}c, xor({z}c, {z}c >> 31) AS {z}"""


SQL["derived_seeds"] = f"""WITH {PIXELS}{_grid(False)}, a AS (
  SELECT img, tile_id, {_sql_mix(f'xor({0x1234ABCD9876EF01}::HUGEINT, img::HUGEINT)', 1)}, {_sql_mix('xor(z1, tile_id::HUGEINT)', 2)} FROM tiles
) SELECT img, tile_id, CASE WHEN z2 >= {1 << 63} THEN z2 - {1 << 64} ELSE z2 END::BIGINT AS seed FROM a"""


@query
def rd_bits(spark, sf_dir):
    """The best candidate of each tile where rates are known in part: bits, or a payload's length, or neither."""
    scored = _scores(spark, sf_dir)
    c = F.col("cand_id")
    bits = F.when(c % 3 == 0, 200.0 + c)
    payload = F.when(c % 3 == 1, F.repeat(F.lit("x"), (c + 20).cast("int")).cast("binary"))
    best = search.best(scored, search.rate(bits, payload), 0.001)
    return best.select("img", "tile_id", "cand_id", tidy(F.col("rd")).alias("rd"), tidy(F.col("d")).alias("d"))


SQL["rd_bits"] = f"""{_scored(0.0)}, w AS (
  SELECT img, tile_id, cand_id, d, round(d + 0.001 * CASE cand_id % 3 WHEN 0 THEN 200 + cand_id WHEN 1 THEN 8 * (cand_id + 20) ELSE 1 END, 9) AS rd FROM s
), x AS (SELECT *, row_number() OVER (PARTITION BY img, tile_id ORDER BY rd, cand_id) AS place FROM w)
SELECT img, tile_id, cand_id, {sql_tidy('rd')} AS rd, {sql_tidy('d')} AS d FROM x WHERE place = 1"""


CONFIG = codec.CodecConfig(tile=SIZE, overlap=OVERLAP, seed=1337)


@query
def encode_images(spark, sf_dir):
    """Every image coded: records, size and rate."""
    coded = codec.encode(raster.wide(pixels(spark, sf_dir)), CONFIG)
    return coded.select("img", "tiles", F.octet_length("blob").alias("bytes"), tidy(F.col("bpp")).alias("bpp"), F.sha2("blob", 256).alias("sha256"))


@query
def decode_images(spark, sf_dir):
    """Every image coded and drawn again from its seeds: the lines of the result."""
    coded = codec.encode(raster.wide(pixels(spark, sf_dir)), CONFIG)
    return codec.decode(coded).groupBy("img", "y").agg(F.count("*").alias("n"), tidy(F.avg("v")).alias("mean"))


@query
def decode_symbols(spark, sf_dir):
    """The same from the steps that the encoder chose."""
    coded = codec.encode(raster.wide(pixels(spark, sf_dir)), CONFIG)
    return codec.decode(coded, by="symbols").groupBy("img", "y").agg(F.count("*").alias("n"), tidy(F.avg("v")).alias("mean"))


@query
def rd_mixed(spark, sf_dir):
    """The best candidates by a mix of structure and error: the kernel of the search."""
    config = codec.CodecConfig(tile=SIZE, overlap=OVERLAP, seed=1337, metric="mixed")
    found = codec.search_tiles(raster.wide(pixels(spark, sf_dir)), config)
    return found.select("img", "tile_id", "cand_id", tidy(F.col("d")).alias("d"), "bits")


@query
def rd_ssim(spark, sf_dir):
    found = codec.search_tiles(raster.wide(pixels(spark, sf_dir)), CONFIG)
    return found.select("img", "tile_id", "cand_id", tidy(F.col("d")).alias("d"), "bits")


@query
def clamp_params(spark, sf_dir):
    """The pixels of a line as parameters, clamped to bounds that depend on their place."""
    lines = pixels(spark, sf_dir).groupBy("img", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"]).alias("p"))
    low = F.transform("p", lambda _, k: -0.05 * (1 + k % 3))
    high = F.transform("p", lambda _, k: 0.05 * (1 + k % 4))
    return lines.select("img", "y", F.posexplode(search.clamp(F.col("p"), low, high)).alias("x", "v")).select("img", "y", "x", tidy(F.col("v")).alias("v"))


SQL["clamp_params"] = f"WITH {PIXELS}, held AS (SELECT img, y, x, least(greatest(v, -0.05 * (1 + x % 3)), 0.05 * (1 + x % 4)) AS v FROM pix) SELECT img, y, x, {sql_tidy('v')} AS v FROM held"


#: The structural similarity of each candidate: tiles as images of their own, blurred by both axes.
_SSIM_TILES = f"""{_scored(0.0).partition(', s AS (')[0].replace('SELECT t.img, tile_id, v, ', 'SELECT t.img, tile_id, y - y0 AS ty, x - x0 AS tx, v, ').replace('SELECT img, tile_id, cand_id, freq, ang, phase, m, pow(', 'SELECT img, tile_id, ty, tx, cand_id, v AS a, least(greatest(CAST_B, -1), 1) AS b, pow(')}"""


def _by_ssim(mix: float) -> str:
    wave = "cos(2 * pi() * freq * (ux * cos(radians(ang)) + uy * sin(radians(ang))) + radians(phase))"
    start = _SSIM_TILES.replace("CAST_B", wave)
    like = "(2 * r.a * r.b + 1e-4) * (2 * (r.ab - r.a * r.b) + 9e-4) / ((r.a * r.a + r.b * r.b + 1e-4) * (r.aa - r.a * r.a + r.bb - r.b * r.b + 9e-4))"
    key = "img, tile_id, cand_id"
    return f"""{start}, {_TAPS}, p AS (SELECT *, a * a AS aa, b * b AS bb, a * b AS ab FROM e
), q AS (SELECT {key}, ty, tx - k AS tx, {_BLUR} FROM p, taps GROUP BY {key}, ty, tx - k
), r AS (SELECT {key}, ty - k AS ty, tx, {_BLUR} FROM q, taps GROUP BY {key}, ty - k, tx
), d AS (
  SELECT {key}, {mix} * (1 - avg(least(greatest({like}, 0), 1))) + {1 - mix} * avg(pow(p.a - p.b, 2)) AS d FROM r JOIN p USING (img, tile_id, cand_id, ty, tx) GROUP BY {key}
), w AS (SELECT *, row_number() OVER (PARTITION BY img, tile_id ORDER BY round(d, 9), cand_id) AS rank FROM d)
SELECT img, tile_id, cand_id, {sql_tidy('d')} AS d, 304.0::DOUBLE AS bits FROM w WHERE rank = 1"""


SQL["rd_ssim"] = _by_ssim(1.0)
SQL["rd_mixed"] = _by_ssim(0.7)


def _drawn(choice: str) -> str:
    """Tiles drawn and blended again: the lines of each image.  ``choice``: tables that end in c (img, tile_id, freq, ang, phase)."""
    unit = lambda c: f"(-1.0 + 2.0 * {c} / {SIZE - 1})"
    return f"""{choice}, dec AS ({_grid(False).partition('starts AS (')[2].partition('), tiles')[0].replace('SELECT img, h, w,', 'SELECT img, h, w,')}
), dtiles AS (
  SELECT img, ((iy - 1) * len(xs) + ix - 1)::INT AS tile_id, ys[iy]::INT AS y0, xs[ix]::INT AS x0, least(ys[iy] + {SIZE}, h)::INT AS y1, least(xs[ix] + {SIZE}, w)::INT AS x1
  FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS ix FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS iy FROM dec))
), px AS (
  SELECT t.img, y0 + ty AS y, x0 + tx AS x, {_HANN.format('ty')} * {_HANN.format('tx')} AS wgt,
         cos(2 * pi() * freq * ({unit('tx')} * cos(radians(ang)) + {unit('ty')} * sin(radians(ang))) + radians(phase)) AS v
  FROM dtiles t JOIN c USING (img, tile_id), range({SIZE}) a(ty), range({SIZE}) b(tx) WHERE y0 + ty < y1 AND x0 + tx < x1
), bl AS (SELECT img, y, x, sum(wgt * v) / (sum(wgt) + 1e-8) AS v FROM px GROUP BY img, y, x)
SELECT img, y::INT AS y, count(*) AS n, {sql_tidy('avg(v)')} AS mean FROM bl GROUP BY img, y"""


_SEEDED = f"""WITH {PIXELS}{_grid(True)}, sa AS (
  SELECT img, tile_id, xor(1337::HUGEINT, {0x9E3779B1} * tile_id::HUGEINT) AS x FROM tiles
), sb AS (SELECT img, tile_id, (xor(x, x >> 16) * 2246822507) & 4294967295::HUGEINT AS x FROM sa
), sc AS (SELECT img, tile_id, (xor(x, x >> 13) * 3266489909) & 4294967295::HUGEINT AS x FROM sb
), sd AS (SELECT img, tile_id, xor(x, x >> 16)::BIGINT AS seed FROM sc
), c AS (SELECT img, tile_id, 3 + seed % 9 AS freq, (seed // 7) % 180 AS ang, (seed >> 8) % 360 AS phase FROM sd)"""
SQL["decode_images"] = _drawn(_SEEDED)
SQL["decode_symbols"] = _drawn(f"{_by_ssim(1.0).rpartition('SELECT img, tile_id, cand_id')[0]}, c AS (SELECT w.img, w.tile_id, freq, ang, phase FROM w JOIN cand USING (cand_id) WHERE rank = 1)")


#: The first grid of the search from coarse to fine: bounds, steps, and how far the first round goes around a point.
BOUNDS = {"freq": (2.0, 14.0), "ang": (0.0, 150.0), "phase": (0.0, 270.0)}
STEPS, DELTAS, ROUNDS, BEAM = {"freq": 4, "ang": 6, "phase": 4}, {"freq": 2.0, "ang": 15.0, "phase": 45.0}, 2, 2


@query
def rd_refine(spark, sf_dir):
    """The stripes of least error for each tile, from a coarse grid to finer ones around the best."""
    cut = tiling.tile_data(raster.wide(pixels(spark, sf_dir)), SIZE, OVERLAP, clipped=True)
    found = search.refine_tiles(cut, search.Refinement(BOUNDS, STEPS, DELTAS, beam=BEAM, rounds=ROUNDS))
    return found.select("img", "tile_id", *[tidy(F.col(c)).alias(c) for c in ("coarse", "freq", "ang", "phase", "d")], "rounds")


def _refined() -> str:
    key, point = "img, tile_id", "freq, ang, phase"
    line = lambda n: f"range({STEPS[n]}) {n}_(k_{n})"
    at = lambda n: f"({BOUNDS[n][0]} + {BOUNDS[n][1] - BOUNDS[n][0]} * k_{n} / {STEPS[n] - 1})::DOUBLE AS {n}"
    errors = lambda points: f"SELECT {key}, {point}, round(avg(pow(v - cos(2 * pi() * freq * (ux * cos(radians(ang)) + uy * sin(radians(ang))) + radians(phase)), 2)), 9) AS d FROM u JOIN {points} USING ({key}) GROUP BY ALL"
    best = lambda rows: f"SELECT {key}, {point}, d FROM {rows} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY d, {point}) <= {BEAM}"
    sql = f"""{_scored(0.0).partition(', e AS (')[0]}, q0 AS (SELECT {key}, {', '.join(map(at, STEPS))} FROM tiles, {', '.join(map(line, STEPS))}
), s0 AS ({errors('q0')}), b0 AS ({best('s0')}), g0 AS (SELECT {key}, 0 AS rounds, 1.0::DOUBLE AS wide FROM tiles)"""
    for n in range(ROUNDS):
        around = [f"least(greatest({p} - {d} / wide + 2 * {d} / wide * k_{p} / 2, {BOUNDS[p][0]}), {BOUNDS[p][1]})::DOUBLE AS {p}" for p, d in DELTAS.items()]
        sql += f""", q{n + 1} AS (
  SELECT DISTINCT {key}, {', '.join(around)} FROM (SELECT b{n}.*, wide FROM b{n} JOIN g{n} USING ({key})), range(3) f_(k_freq), range(3) a_(k_ang), range(3) p_(k_phase)
), s{n + 1} AS ({errors(f'q{n + 1}')}), b{n + 1} AS ({best(f'(SELECT * FROM s{n + 1} UNION SELECT * FROM b{n})')}
), g{n + 1} AS (
  SELECT {key}, g{n}.rounds + (c.n IS NOT NULL)::INT AS rounds, CASE WHEN c.n IS NULL THEN 2 * wide ELSE wide END AS wide
  FROM g{n} LEFT JOIN (SELECT {key}, count(*) AS n FROM (SELECT * FROM b{n + 1} EXCEPT SELECT * FROM b{n}) GROUP BY ALL) c USING ({key})
)"""
    return f"""{sql} SELECT {key}, {sql_tidy('c.d')} AS coarse, {', '.join(f'{sql_tidy(p)} AS {p}' for p in DELTAS)}, {sql_tidy('b.d')} AS d, rounds FROM (SELECT * FROM b{ROUNDS} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY d, {point}) = 1) b
JOIN (SELECT {key}, min(d) AS d FROM s0 GROUP BY ALL) c USING ({key}) JOIN g{ROUNDS} USING ({key})"""


SQL["rd_refine"] = _refined()


@query
def sql_tile_rects(spark, sf_dir):
    """The tiles of both grids by a table function, in SQL."""
    table_functions.register(spark)
    return spark.sql(
        f"""SELECT d.img, true AS clipped, t.* FROM {{dims}} d, LATERAL tile_rects(d.h, d.w, {SIZE}, {OVERLAP}, true) t
            UNION ALL SELECT d.img, false, t.* FROM {{dims}} d, LATERAL tile_rects(d.h, d.w, {SIZE}, {OVERLAP}) t""", dims=dims(spark, sf_dir),
    )


SQL["sql_tile_rects"] = " UNION ALL ".join(f"SELECT img, {str(c).lower()} AS clipped, tile_id, y0, x0, y1, x1 FROM (WITH {PIXELS}{_grid(c)} SELECT * FROM tiles)" for c in (True, False))


@query
def metric_values(spark, sf_dir):
    """Metrics by name: those of columns in one aggregate, and the structural similarity by arrays."""
    names = ["mse", "mae", "worst", "psnr", "ssim"]
    return metrics.measure(pairs(spark, sf_dir), names).select("img", *[tidy(F.col(n)).alias(n) for n in names])


SQL["metric_values"] = f"""SELECT p.img, {sql_tidy('avg(pow(a - b, 2))')} AS mse, {sql_tidy('avg(abs(a - b))')} AS mae, {sql_tidy('max(abs(a - b))')} AS worst, {sql_tidy('10 * log10(1 / greatest(avg(pow(a - b, 2)), 1e-12))')} AS psnr, any_value(s.ssim) AS ssim
FROM (WITH {PAIRS} SELECT * FROM pairs) p JOIN ({SQL['ssim_window']}) s USING (img) GROUP BY p.img"""


@query
def rd_search_mae(spark, sf_dir):
    """The stripes of least mean absolute error for each tile: the search by another metric."""
    rows = tiling.tile_pixels(pixels(spark, sf_dir), dims(spark, sf_dir), SIZE, OVERLAP, clipped=True)
    best = search.best(search.scores(rows, metric="mae"), F.lit(0.0), 0.0)
    return best.select("img", "tile_id", "cand_id", tidy(F.col("d")).alias("d"))


SQL["rd_search_mae"] = SQL["rd_seam"].replace("avg(e) + 0.5 * avg(e * m) AS d", "avg(sqrt(e)) AS d")


@query
def warp_images(spark, sf_dir):
    """Every image twisted around its middle, more from image to image."""
    all_ = pixels(spark, sf_dir)
    places = all_.select("img", "y", "x").join(dims(spark, sf_dir), "img").withColumns({"ux": search.unit(F.col("x"), F.col("w")), "uy": search.unit(F.col("y"), F.col("h"))})
    turn = 0.1 * (F.col("img") % 10 + 1) * (1.5 - F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")))
    gx, gy = F.col("ux") * F.cos(turn) - F.col("uy") * F.sin(turn), F.col("ux") * F.sin(turn) + F.col("uy") * F.cos(turn)
    warped = tiling.resample(all_, places.withColumns({"gx": gx, "gy": gy}))
    return warped.select("img", "y", "x", tidy(F.col("v")).alias("v"))


SQL["warp_images"] = f"""WITH {PIXELS}, u AS (
  SELECT img, y, x, h, w, -1.0 + 2.0 * x / (w - 1) AS ux, -1.0 + 2.0 * y / (h - 1) AS uy FROM pix JOIN dims USING (img)
), t AS (SELECT *, 0.1 * (img % 10 + 1) * (1.5 - sqrt(ux * ux + uy * uy)) AS a FROM u
), g AS (
  SELECT img, y, x, h, w, least(greatest((ux * cos(a) - uy * sin(a) + 1) / 2 * (w - 1), 0), w - 1) AS sx, least(greatest((ux * sin(a) + uy * cos(a) + 1) / 2 * (h - 1), 0), h - 1) AS sy FROM t
), f AS (SELECT img, y, x, floor(sx)::INT AS x0, floor(sy)::INT AS y0, least(floor(sx) + 1, w - 1)::INT AS x1, least(floor(sy) + 1, h - 1)::INT AS y1, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM g)
SELECT f.img, f.y, f.x, {sql_tidy('(1 - fy) * ((1 - fx) * a.v + fx * b.v) + fy * ((1 - fx) * c.v + fx * d.v)')} AS v
FROM f JOIN pix a ON a.img = f.img AND a.y = y0 AND a.x = x0 JOIN pix b ON b.img = f.img AND b.y = y0 AND b.x = x1 JOIN pix c ON c.img = f.img AND c.y = y1 AND c.x = x0 JOIN pix d ON d.img = f.img AND d.y = y1 AND d.x = x1"""
