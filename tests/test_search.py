"""The searches from coarse to fine and over the catalogue, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.params import at_share, to_vector
from tessella.functions.patterns import PATTERNS
from tessella.operators import rendering, search

BOUNDS = {"freq": (1.0, 9.0), "ang": (0.0, 180.0), "phase": (0.0, 360.0)}


def drawn(h, w, freq, ang, phase):
    x, y = np.meshgrid(np.linspace(-1, 1, w), np.linspace(-1, 1, h))
    a = np.radians(ang)
    return np.cos(2 * np.pi * freq * (x * np.cos(a) + y * np.sin(a)) + np.radians(phase))


def tile_rows(spark, tiles):
    return spark.createDataFrame([(0, n, t.shape[0], t.shape[1], [float(v) for v in t.ravel()]) for n, t in enumerate(tiles)], "img long, tile_id int, th int, tw int, data array<double>")


def test_errors_by_products_are_those_of_drawn_stripes():
    deal = np.random.default_rng(0)
    for h, w in ((32, 32), (7, 19), (1, 5), (5, 1)):
        tile, (f, a, p) = deal.normal(size=(h, w)), deal.uniform(0, 100, size=(3, 20))
        x, y = (np.linspace(-1, 1, n) if n > 1 else np.array([-1.0]) for n in (w, h))
        made = [np.cos(2 * np.pi * f[i] * (x[None] * np.cos(np.radians(a[i])) + y[:, None] * np.sin(np.radians(a[i]))) + np.radians(p[i])) for i in range(20)]
        assert np.allclose(search.stripe_errors(tile, f, a, p), [((tile - m) ** 2).mean() for m in made], atol=1e-9)


def test_refining_finds_stripes_off_the_grid(spark):
    tiles = [drawn(24, 24, 3.3, 41.0, 100.0), drawn(24, 20, 6.2, 130.0, 300.0), np.zeros((24, 24))]
    found = search.refine_tiles(tile_rows(spark, tiles), search.Refinement(BOUNDS, {"freq": 17, "ang": 13, "phase": 5}, {"freq": 0.5, "ang": 15.0, "phase": 90.0}, beam=3))
    rows = sorted(found.collect(), key=lambda r: r["tile_id"])
    for r, t in zip(rows[:2], tiles):
        assert r["d"] < 1e-3 < 0.05 < r["coarse"] and r["rounds"] > 4
        assert abs(((drawn(*t.shape, r["freq"], r["ang"], r["phase"]) - t) ** 2).mean() - r["d"]) < 1e-6
    assert all(r["d"] <= r["coarse"] for r in rows)
    for r in rows:
        assert all(low <= r[n] <= high for n, (low, high) in BOUNDS.items())
    assert found.filter("false").count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan.replace("ExistingRDD", "")  # a tile stays where it lies


def test_a_tile_stops_when_its_beam_stays(spark):
    exact = drawn(16, 16, 5.0, 90.0, 90.0)  # a point of the grid
    row = search.refine_tiles(tile_rows(spark, [exact]), search.Refinement(BOUNDS, {"freq": 3, "ang": 3, "phase": 5}, {"freq": 0.5, "ang": 5.0, "phase": 9.0}, beam=1)).first()
    assert (row["freq"], row["ang"], row["phase"], row["d"], row["rounds"]) == (5.0, 90.0, 90.0, 0.0, 0)


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(n, name, to_vector(PATTERNS[name], at_share(PATTERNS[name], 0.13)), 7) for n, name in enumerate(sorted(PATTERNS))]
    return rendering.render(spark.createDataFrame(rows, "cand_id int, name string, params array<double>, seed long"), 24, 24).cache()


def test_every_pattern_is_rendered(spark, candidates):
    images = {r["name"]: np.array(r["data"]) for r in candidates.collect()}
    assert images.keys() == PATTERNS.keys() and all(i.shape == (576,) and np.isfinite(i).all() for i in images.values())
    alone = rendering.render_formula(PATTERNS["RINGS"], at_share(PATTERNS["RINGS"], 0.13), spark.range(1).select(F.lit(0).alias("n")), 24, 24)
    assert [r["v"] for r in alone.orderBy("py", "px").collect()] == images["RINGS"].tolist()
    some = rendering.render_tiles(spark.range(2), "WEAVE", [at_share(PATTERNS["WEAVE"], 0.13)], [7], 24, 24).collect()
    assert len(some) == 2 and all(r["data"] == images["WEAVE"].tolist() for r in some)


@pytest.mark.parametrize("chunk", [16_384, 9])
def test_best_patterns_are_those_of_all_comparisons(spark, candidates, chunk):
    """With bounds the same is found as without, and most candidates are never compared in full."""
    deal, images = np.random.default_rng(1), {r["cand_id"]: np.array(r["data"]) for r in candidates.collect()}
    tiles = [images[c].reshape(24, 24) * s + deal.normal(size=(24, 24)) * e for c in (3, 11, 20, 33, 41) for s, e in ((1, 0.0), (0.8, 0.1), (0.4, 0.5))]
    found = search.best_patterns(tile_rows(spark, [*tiles, np.zeros((5, 5))]), candidates, 24, 24, chunk).orderBy("tile_id").collect()
    for r, t in zip(found, tiles):
        d, c = min((round(float(((t.ravel() - i) ** 2).mean()), 9), c) for c, i in images.items())
        assert (r["cand_id"], r["d"]) == (c, d)
    assert (found[-1]["cand_id"], found[-1]["d"]) == (None, None)
    if chunk > len(images):
        assert sum(r["tried"] for r in found) < 0.3 * len(tiles) * len(images)


def test_bounds_hold(candidates):
    import pyarrow as pa

    rows = candidates.collect()
    held = search.BoundedPatterns(pa.array([r["cand_id"] for r in rows]), pa.array([r["data"] for r in rows]), 24, 24)
    tiles = np.random.default_rng(5).normal(size=(30, 576)) * 0.7
    errors = ((tiles[:, None] - held.images) ** 2).mean(axis=2)
    assert (held.bounds(tiles) <= errors + 1e-12).all() and (held.bounds(tiles) > 0.5 * errors).any()


def test_generators_are_selected(spark):
    df = spark.createDataFrame([(list("abcdefghij"),), (["a"],)], "g array<string>")
    taken = lambda most: [r[0] for r in df.select(search.select_generators(F.col("g"), most)).collect()]
    assert taken(8) == [list("abcdefgh"), ["a"]] and taken(None) == [list("abcdefghij"), ["a"]]


def test_resampling(spark):
    """Bilinear, held at the border, against arrays; the identity gives the image back."""
    from tessella.operators import tiling

    deal = np.random.default_rng(8)
    image = deal.normal(size=(7, 9))
    pixels = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(7) for x in range(9)], "img long, y int, x int, v double")
    same = [(0, 7, 9, y, x, -1 + 2 * y / 6, -1 + 2 * x / 8) for y in range(7) for x in range(9)]
    odd = [(0, 7, 9, 100 + n, n, *g) for n, g in enumerate(deal.uniform(-1.5, 1.5, size=(60, 2)).tolist())]
    places = spark.createDataFrame(same + odd, "img long, h int, w int, y int, x int, gy double, gx double")
    got = {(r["y"], r["x"]): r["v"] for r in tiling.resample(pixels, places).collect()}
    assert len(got) == len(same) + len(odd)
    for _, h, w, y, x, gy, gx in same + odd:
        sy, sx = np.clip((gy + 1) / 2 * (h - 1), 0, h - 1), np.clip((gx + 1) / 2 * (w - 1), 0, w - 1)
        y0, x0 = int(sy), int(sx)
        y1, x1, fy, fx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), sy - y0, sx - x0
        want = (1 - fy) * ((1 - fx) * image[y0, x0] + fx * image[y0, x1]) + fy * ((1 - fx) * image[y1, x0] + fx * image[y1, x1])
        assert abs(got[y, x] - want) < 1e-9
    assert tiling.resample(pixels, places.limit(0)).count() == 0


def test_formulas_are_drawn_where_their_rows_lie(spark):
    rows = rendering.jobs(spark, "RINGS", [at_share(PATTERNS["RINGS"], 0.13)], [1])
    drawn = rendering.render_formulas(rows, 24, 20)
    assert "Exchange" not in drawn._jdf.queryExecution().executedPlan().toString()
    alone = rendering.render_formula(PATTERNS["RINGS"], at_share(PATTERNS["RINGS"], 0.13), spark.range(1).select(), 24, 20)
    assert drawn.first()["data"] == [r["v"] for r in alone.orderBy("py", "px").collect()]


def test_catalogue_and_its_sql_agree_on_an_image_smaller_than_a_tile(spark, small, tmp_path):
    import duckdb
    from tessella.plans import registry

    spark.read.parquet(f"{small}/embeddings.parquet").filter("vec_id < 80").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = registry.QUERIES["rd_catalogue"](spark, str(tmp_path))
    want = duck.sql(registry.SQL["rd_catalogue"])
    assert found.columns == list(want.columns)
    got = {tuple(r) for r in found.collect()}
    assert got == {tuple(r) for r in want.fetchall()} and len(got) == 12
    assert {r[2:5] for r in got if r[0] == 1} == {(None, None, 0)}


@pytest.mark.parametrize("chunk", [16_384, 9])
def test_tiles_that_lack_pixels_are_compared_over_those_they_have(spark, candidates, chunk):
    deal, images = np.random.default_rng(2), {r["cand_id"]: np.array(r["data"]).reshape(24, 24) for r in candidates.collect()}
    parts = [np.s_[:16, :], np.s_[:, :7], np.s_[:18, :18], np.s_[5:6, 3:4], np.s_[::2, 1:]]
    tiles = [(c, part, images[c] * s + deal.normal(size=(24, 24)) * e) for c, part in zip((3, 11, 20, 33, 41), parts) for s, e in ((1, 0.0), (0.4, 0.5))]
    has = np.zeros((len(tiles), 24, 24), dtype=bool)
    for n, (_, part, _) in enumerate(tiles):
        has[n][part] = True
    rows = [(0, n, [float(v) if h else None for v, h in zip(t.ravel(), has[n].ravel())]) for n, (_, _, t) in enumerate(tiles)]
    rows += [(0, len(tiles), [None] * 576), (0, len(tiles) + 1, [float("nan"), None] + [0.0] * 574)]
    found = search.best_patterns(spark.createDataFrame(rows, "img long, tile_id int, data array<double>"), candidates, 24, 24, chunk).orderBy("tile_id").collect()
    for r, (_, _, t), h in zip(found, tiles, has):
        assert (r["d"], r["cand_id"]) == min((round(float(((t - i)[h] ** 2).mean()), 9), c) for c, i in images.items())
        assert 0 <= r["tried"] <= len(images)
    assert {(r["cand_id"], r["d"], r["tried"]) for r in found[-2:]} == {(None, None, 0)}


def test_catalogue_gives_every_tile_of_cut_and_broken_images_its_pattern(spark, small, tmp_path):
    """Images of 16 and of 18 rows, of 20 columns, without some rows, with null rows and with null pixels, against the SQL."""
    import duckdb
    from tessella.plans import registry

    given = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    img, y = F.expr("vec_id div 64"), F.col("vec_id") % 64
    kept = given.filter((img == 0) | (img == 1) & (y < 16) | (img == 2) & (y < 18) | (img == 3) | (img == 4) & ~y.between(5, 9) | (img == 5) | (img == 6) & (y == 33))
    holes = F.when(img == 3, F.slice("embedding", 1, 20)).when((img == 5) & (y == 60), F.lit(None)).when(img == 5, F.transform("embedding", lambda v, i: F.when(i % 5 != y % 7, v))).otherwise(F.col("embedding"))
    kept.select("vec_id", holes.alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = registry.QUERIES["rd_catalogue"](spark, str(tmp_path))
    want = duck.sql(registry.SQL["rd_catalogue"])
    assert found.columns == list(want.columns)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted(tuple(r) for r in want.fetchall())
    tiles = {i: [r for r in got if r[0] == i] for i in range(7)}
    assert [len(tiles[i]) for i in range(7)] == [9, 3, 3, 3, 9, 9, 3]
    assert all(r[2] is not None and r[3] is not None for r in got)
