"""Queries on procedural patterns: each pattern held against the images of ``embeddings``, the catalogue, an audit of all."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.params import at_share, at_shares, catalogue, decoded, encoded, to_vector, violations
from ..functions.patterns import PATTERNS
from ..operators import rendering, search, tiling
from ..sources import raster
from .common import PIXELS, pixels, sql_tidy, table, tidy
from .formula_sql import formula_sql
from .noise_sql import kernel_sql

#: The size of the images, and two lines more: so no pixel of a square lies on the edge of a cell by both its coordinates.
HEIGHT, WIDTH = 66, 64
#: Off the middle, so that no pixel lies on the edge of a cell.
SHARES = (0.2186, 0.588)
SEEDS = (42, -7)
QUERIES, SQL = {}, {}


def _points(pattern) -> list[dict]:
    """Two points of the parameters; where there are choices, each with either truth value."""
    points = [at_share(pattern, share) for share in SHARES]
    for p in pattern.params:
        if p.type in ("enum", "bool"):
            points = [q | {p.name: v} for q in points[:1] if p.type == "enum" for v in p.choices] or [q | {p.name: v} for q in points for v in (False, True)]
    return points


def _formula(pattern):
    def run(spark, sf_dir):
        drawn = None
        for n, values in enumerate(_points(pattern)):
            one = rendering.render_formula(pattern, values, spark.range(1).select(F.lit(n).alias("sample_id")), HEIGHT, WIDTH)
            drawn = one if drawn is None else drawn.union(one)
        return _against(spark, sf_dir, drawn)

    return run


def _against(spark, sf_dir, drawn):
    """How far each image of the table is from a pattern's samples."""
    of = drawn.select("sample_id", F.col("py").alias("y"), F.col("px").alias("x"), F.col("v").alias("p"))
    met = pixels(spark, sf_dir).join(of, ["y", "x"]).groupBy("img", "sample_id")
    return met.agg(F.count("*").alias("n"), tidy(F.avg((F.col("v") - F.col("p")) ** 2)).alias("error"))


def _against_sql(drawn: str) -> str:
    return f"WITH {PIXELS}, d AS ({drawn}) SELECT img, sample_id, count(*) AS n, {sql_tidy('avg(pow(pix.v - d.v, 2))')} AS error FROM pix JOIN d ON y = py AND x = px GROUP BY ALL"


def _kernel(pattern):
    def run(spark, sf_dir):
        samples = [(p, s) for p in _points(pattern) for s in SEEDS]
        jobs = rendering.jobs(spark, pattern.name, *map(list, zip(*samples)))
        drawn = rendering.narrow(rendering.render_images(jobs, HEIGHT, WIDTH), WIDTH)
        return _against(spark, sf_dir, drawn)

    return run


for _p in PATTERNS.values():
    _name = f"gen_{_p.name.lower()}"
    QUERIES[_name] = _kernel(_p) if _p.noise else _formula(_p)
    if not _p.noise:
        SQL[_name] = _against_sql(formula_sql(_p.name, _points(_p), HEIGHT, WIDTH, 12))
    elif kernel_sql(_p.name, at_share(_p, SHARES[0]), HEIGHT, WIDTH, SEEDS):
        SQL[_name] = _against_sql(" UNION ALL ".join(f"SELECT sample_id + {n * len(SEEDS)} AS sample_id, py, px, v FROM ({kernel_sql(_p.name, q, HEIGHT, WIDTH, SEEDS, 12)})" for n, q in enumerate(_points(_p))))


def _dealt(spark, sf_dir):
    """sample_id, name, params, seed: each vector as parameters of a pattern, the patterns in turn; a number of the vector
    is a share of a parameter's range."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "embedding")
    names = F.array(*map(F.lit, sorted(PATTERNS)))
    rows = own.select("sample_id", F.get(names, F.pmod("sample_id", F.lit(len(PATTERNS))).cast("int")).alias("name"), F.transform("embedding", lambda x: F.least(F.greatest(x.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0))).alias("shares"))
    return rows.select("sample_id", "name", at_shares(F.col("name"), F.col("shares")).alias("params"), F.col("sample_id").alias("seed"))


def gen_catalog(spark, sf_dir):
    """Patterns, their parameters, and how many vectors are dealt to each."""
    names = F.sort_array(F.collect_list("param")).cast("string").alias("names")
    rows = catalogue(spark).groupBy("name", "noise").agg(F.count("*").alias("params"), names)
    dealt = _dealt(spark, sf_dir).groupBy("name").agg(F.count("*").alias("vectors"))
    return rows.join(dealt, "name", "left").select("name", "noise", "params", "names", F.coalesce("vectors", F.lit(0)).alias("vectors"))


#: Height and width of the audit's images.
AUDIT = 64


def gen_audit(spark, sf_dir):
    """Every pattern with the parameters and seeds of its vectors: range, soundness, and whether a rerun is equal."""
    drawn = lambda: rendering.render(_dealt(spark, sf_dir), AUDIT, AUDIT)
    again = drawn().groupBy("name").agg(F.bit_xor(F.xxhash64("sample_id", "data")).alias("again"))
    same = F.col("digest") == F.col("again")
    return rendering.audit(drawn()).join(again, "name").select("name", "images", tidy(F.col("low")).alias("low"), tidy(F.col("high")).alias("high"), tidy(F.col("mean")).alias("mean"), "sound", same.alias("repeats"))


#: Candidates of the search over the catalogue: every pattern but the composite, which SQL can't draw, at two points.
TILE, OVERLAP, SEED = 32, 8, 42
CANDIDATES = [(name, at_share(PATTERNS[name], share)) for name in sorted(PATTERNS) if name != "COMPOSITE" for share in SHARES]


def candidates(spark):
    """cand_id, name and data: the candidates' images."""
    rows = [(n, name, to_vector(PATTERNS[name], values), SEED) for n, (name, values) in enumerate(CANDIDATES)]
    return rendering.render(spark.createDataFrame(rows, "cand_id int, name string, params array<double>, seed long"), TILE, TILE)


def rd_catalogue(spark, sf_dir):
    """The pattern of the catalogue of least error for each tile, over the pixels that the tile has, and how many candidates'
    bounds are not above that error: for a whole tile, how many had to be compared in full."""
    images = raster.vector_images(table(spark, sf_dir, "embeddings"), least=TILE)
    tiles = tiling.tile_data(images, TILE, OVERLAP).filter(F.exists("data", lambda v: v.isNotNull()))
    found = search.best_patterns(tiles, candidates(spark), TILE, TILE)
    return found.select("img", "tile_id", "cand_id", tidy(F.col("d")).alias("d"), "tried", F.lit(len(CANDIDATES)).alias("candidates"))


def _drawn(n: int, name: str, values: dict) -> str:
    sql = kernel_sql(name, values, TILE, TILE, (SEED,), 12) if PATTERNS[name].noise else formula_sql(name, [values], TILE, TILE, 12)
    return f"SELECT {n} AS cand_id, py, px, v FROM ({sql})"


STARTS = f"list_sort(list_distinct(list_concat(range(0, greatest({{0}} - {TILE}, 0) + 1, {TILE - OVERLAP}), [greatest({{0}} - {TILE}, 0)])))"
#: All candidates compared with all tiles, and for each its bound by the means of blocks of four by four.
SQL["rd_catalogue"] = f"""WITH {PIXELS}, starts AS (
  SELECT img, h, w, {STARTS.format('h')} AS ys, {STARTS.format('w')} AS xs FROM dims
), tiles AS (
  SELECT img, ((iy - 1) * len(xs) + ix - 1)::INT AS tile_id, ys[iy]::INT AS y0, xs[ix]::INT AS x0 FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS ix FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS iy FROM starts))
), c AS ({' UNION ALL '.join(_drawn(n, *c) for n, c in enumerate(CANDIDATES))}
), t AS (SELECT t.img, tile_id, y - y0 AS py, x - x0 AS px, v FROM tiles t JOIN pix ON pix.img = t.img AND y >= y0 AND y < y0 + {TILE} AND x >= x0 AND x < x0 + {TILE}
), cm AS (SELECT cand_id, py // 4 AS gy, px // 4 AS gx, avg(v) AS m, sum(v * v) AS q FROM c GROUP BY ALL
), tm AS (SELECT img, tile_id, py // 4 AS gy, px // 4 AS gx, avg(v) AS m, sum(v * v) AS q FROM t GROUP BY ALL
), cw AS (SELECT cand_id, sqrt(greatest(sum(q - 16 * m * m), 0)) AS w FROM cm GROUP BY ALL), tw AS (SELECT img, tile_id, sqrt(greatest(sum(q - 16 * m * m), 0)) AS w FROM tm GROUP BY ALL
), bounds AS (
  SELECT img, tile_id, cand_id, (16 * sum(pow(tm.m - cm.m, 2)) + pow(any_value(tw.w) - any_value(cw.w), 2)) / {TILE * TILE} AS bound
  FROM tm JOIN cm USING (gy, gx) JOIN tw USING (img, tile_id) JOIN cw USING (cand_id) GROUP BY ALL
), e AS (SELECT img, tile_id, cand_id, round(avg(pow(t.v - c.v, 2)), 9) AS d FROM t JOIN c USING (py, px) GROUP BY ALL
), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY img, tile_id ORDER BY d, cand_id) = 1)
SELECT img, tile_id, b.cand_id::BIGINT AS cand_id, {sql_tidy('d')} AS d, count(*) FILTER (WHERE bound <= d + 1e-9) AS tried, {len(CANDIDATES)} AS candidates
FROM b JOIN (SELECT img, tile_id, bound FROM bounds) USING (img, tile_id) GROUP BY ALL"""
QUERIES["rd_catalogue"] = rd_catalogue
def _given(spark, sf_dir):
    """id, name, params: each vector as the texts of a pattern's parameters.  Some leave their range, and some vectors name
    no pattern, leave a parameter out or add one."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    named = own.withColumn("name", F.get(F.array(*map(F.lit, sorted(PATTERNS))), F.pmod("id", F.lit(len(PATTERNS))).cast("int")))
    each = named.join(catalogue(spark), "name").filter((F.col("id") % 5 != 0) | (F.col("ord") > 0))
    number = F.round(F.col("low") + (F.col("high") - F.col("low")) * (0.5 + 1.5 * F.get("embedding", F.col("ord")).cast("double")), 3).cast("decimal(18,3)").cast("string")
    choice = F.coalesce(F.get("choices", F.pmod(F.floor(F.col("id") / len(PATTERNS)), F.lit(4)).cast("int")), F.lit("none"))
    value = F.when(F.col("type") == "enum", choice).when(F.col("type") == "bool", F.when(F.col("id") % 2 == 0, "true").otherwise("maybe")).otherwise(number)
    texts = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("param", value.alias("value")))).alias("own"))
    params = F.coalesce("own", F.create_map().cast("map<string,string>"))
    more = F.when(F.col("id") % 7 == 0, F.create_map(F.lit("zzz"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    return named.join(texts, "id", "left").select("id", F.when(F.col("id") % 11 == 0, "NOTHING").otherwise(F.col("name")).alias("name"), F.map_concat(params, more).alias("params"))


def params_violations(spark, sf_dir):
    """What is wrong with the parameters of each vector."""
    return violations(_given(spark, sf_dir))


def params_codes(spark, sf_dir):
    """The parameters of the vectors with nothing wrong, as numbers and back."""
    rows = _given(spark, sf_dir)
    good = rows.join(violations(rows).select("id").distinct(), "id", "left_anti")
    back = decoded(encoded(good)).select("id", F.posexplode("values").alias("ord", "v"), "codes")
    return back.select("id", "ord", "v.param", tidy(F.get("codes", F.col("ord"))).alias("code"), tidy(F.col("v.number")).alias("number"), "v.choice")


_PARAMS = ", ".join(f"('{p.name}', {n}, '{q.name}', '{q.type}', {q.low or 0.0}::DOUBLE, {q.high or 0.0}::DOUBLE, [{', '.join(repr(c) for c in q.choices)}]::VARCHAR[])" for p in PATTERNS.values() for n, q in enumerate(p.params))
_GIVEN = f"""cat AS (SELECT * FROM (VALUES {_PARAMS}) c(name, ord, param, type, low, high, choices)
), named AS (SELECT vec_id AS id, embedding AS e, (SELECT list_sort(list(DISTINCT name)) FROM cat)[vec_id % {len(PATTERNS)} + 1] AS own FROM embeddings
), own AS (
  SELECT id, own, param, CASE type WHEN 'enum' THEN coalesce(choices[(id // {len(PATTERNS)}) % 4 + 1], 'none') WHEN 'bool' THEN CASE WHEN id % 2 = 0 THEN 'true' ELSE 'maybe' END
    ELSE round(low + (high - low) * (0.5 + 1.5 * e[ord + 1]::DOUBLE), 3)::DECIMAL(18, 3)::VARCHAR END AS value
  FROM named JOIN cat ON cat.name = own WHERE id % 5 <> 0 OR ord > 0
  UNION ALL SELECT id, own, 'zzz', '1' FROM named WHERE id % 7 = 0
), given AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'NOTHING' ELSE own END AS name, param, value FROM own
), rows AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'NOTHING' ELSE own END AS name FROM named
), bad AS (
  SELECT id, g.name, g.param, CASE WHEN type IS NULL THEN 'unknown parameter' WHEN type IN ('float', 'int') AND NOT value::DOUBLE BETWEEN low AND high THEN 'out of range'
    WHEN type = 'enum' AND NOT list_contains(choices, value) THEN 'no such choice' WHEN type = 'bool' AND value = 'maybe' THEN 'neither true nor false' END AS problem
  FROM given g LEFT JOIN cat ON cat.name = g.name AND cat.param = g.param WHERE g.name <> 'NOTHING'
  UNION ALL SELECT id, r.name, cat.param, 'missing' FROM rows r JOIN cat ON cat.name = r.name WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.id = r.id AND g.param = cat.param)
  UNION ALL SELECT id, name, NULL, 'unknown pattern' FROM rows WHERE name = 'NOTHING'
)"""
SQL["params_violations"] = f"WITH {_GIVEN} SELECT id, name, param, problem FROM bad WHERE problem IS NOT NULL"
SQL["params_codes"] = f"""WITH {_GIVEN}, codes AS (
  SELECT id, ord, g.param, type, choices, CASE type WHEN 'bool' THEN (value = 'true')::INT WHEN 'enum' THEN list_position(choices, value) - 1 WHEN 'int' THEN trunc(value::DOUBLE) ELSE value::DOUBLE END::DOUBLE AS code
  FROM given g JOIN cat ON cat.name = g.name AND cat.param = g.param WHERE id NOT IN (SELECT id FROM bad WHERE problem IS NOT NULL)
) SELECT id, ord::INT AS ord, param, {sql_tidy('code')} AS code, {sql_tidy('code')} AS number, CASE WHEN type = 'enum' THEN choices[code::INT + 1] END AS choice FROM codes"""
QUERIES |= {"params_violations": params_violations, "params_codes": params_codes}
QUERIES |= {"gen_catalog": gen_catalog, "gen_audit": gen_audit}
#: The catalogue stated anew: each pattern's parameters, and whether it needs noise.
CATALOGUE = """ANGLE_GRADIENT angle_start_deg angle_end_deg; BRICK rows cols mortar; BRICK_NOISE* rows cols mortar contrast; CHECKER_DISTORTED* cells dist_scale dist_amp; CHECKER cells angle_deg;
COMPOSITE* base_id warp_id mask_id pal_id base_q warp_q mask_q pal_q; CONCENTRIC_SQUARES freq phase; DIAMOND_GRID cells thick; DOTS cells radius; FBM_RIDGED* scale octaves gain; GABOR freq angle_deg sigma phase;
GABOR_BANK freq sigma bands; GABOR_NOISE* freq sigma dist_scale dist_amp; GAUSSIAN_SPOTS* cells sigma density; GRADIENT_LINEAR angle_deg bias scale; GRADIENT_RADIAL cx cy scale; HERRINGBONE cells thick; HEX_GRID cells thick;
ISOBANDS* scale levels; KALEIDOSCOPE sectors freq; LATTICE cells thick; MARBLE* freq noise_scale noise_amp angle_deg; MOIRE f1 f2 delta_deg; PEBBLES* scale smooth; PERLIN* scale octaves persistence; PLAID fx fy amp phase;
POLAR_CHECKER radial angular; RINGS freq cx cy phase; RIPPLE freq decay phase; SPIRAL turns tight; SPIRAL_SQUARE turns tight; STARFIELD* cells density sigma; STRIPES freq angle_deg phase;
STRIPES_MULTISCALE f1 f2 angle1_deg angle2_deg; SUNBURST rays gamma; SWIRL k freq; TRI_TILING cells line; TURBULENCE* scale octaves gain; VALUE_NOISE* scale octaves persistence; VORONOI_CELLS* scale contrast;
VORONOI_EDGES* scale sharp; WAVES_BEND freq bend bend_freq; WAVES_CIRC freq amp phase; WAVES_DIR freq angle_deg amp phase; WEAVE cells thick contrast; WOOD* rings noise_scale noise_amp; WORLEY* scale metric invert"""
_ROWS = ", ".join(f"('{n.rstrip('*')}', {n.endswith('*')}, {len(ps)}, '[{', '.join(sorted(ps))}]')" for n, *ps in (x.split() for x in CATALOGUE.split(";")))
SQL["gen_catalog"] = f"""SELECT name, noise, params::BIGINT AS params, names, count(vec_id) AS vectors FROM (VALUES {_ROWS}) c(name, noise, params, names)
LEFT JOIN embeddings ON (SELECT list_sort(list(n)) FROM (VALUES {_ROWS}) d(n, a, b, e))[vec_id % {len(PATTERNS)} + 1] = name GROUP BY ALL"""
