"""Metrics by name in measures and searches, and table functions in SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import table_functions
from tessella.operators import bitstream, codec, metrics, search, tiling
from tessella.plans.common import dims, pairs, pixels
from tessella.sources import raster


@pytest.fixture
def registered():
    known = dict(metrics.METRICS)
    metrics.register(metrics.Metric("cube", lambda a, b: F.avg(F.abs(a - b) ** 3), lambda a, b: (np.abs(a - b) ** 3).mean(axis=(-1, -2))))
    metrics.register(metrics.Metric("edges", arrays=lambda a, b: np.exp(-np.abs(np.diff(a - b, axis=-1)).mean(axis=(-1, -2))), alike=True))
    yield
    metrics.METRICS.clear()
    metrics.METRICS.update(known)


def test_measures_by_name(spark, small, registered):
    names = ["edges", "cube", "psnr", "ssim"]
    found = metrics.measure(pairs(spark, small), names)
    assert found.columns == ["img", *names]
    for row in found.collect():
        rows = pairs(spark, small).filter(F.col("img") == row["img"]).collect()
        a, b = np.zeros((2, max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1))
        for r in rows:
            a[r["y"], r["x"]], b[r["y"], r["x"]] = r["a"], r["b"]
        for n in names:
            assert row[n] == pytest.approx(float(metrics.get(n).arrays(a, b)), rel=1e-9)
        break
    assert metrics.measure(pairs(spark, small).limit(0), names).count() == 0


def test_search_by_a_registered_metric(spark, small, registered):
    """Both searches take the metric by its name, and agree."""
    rows = tiling.tile_pixels(pixels(spark, small), dims(spark, small), 32, 8, clipped=True)
    by_columns = {(r["img"], r["tile_id"]): (r["cand_id"], round(r["d"], 9)) for r in search.best(search.scores(rows, metric="cube"), F.lit(0.0), 0.0).collect()}
    config = codec.CodecConfig(tile=32, overlap=8, seed=1, metric="cube", rate_weight=0.0)
    by_arrays = {(r["img"], r["tile_id"]): (r["cand_id"], round(r["d"], 9)) for r in codec.search_tiles(raster.wide(pixels(spark, small)), config).collect()}
    assert by_columns == by_arrays
    other = codec.search_tiles(raster.wide(pixels(spark, small)), codec.CodecConfig(tile=32, overlap=8, seed=1, metric="edges"))
    assert 0 <= other.agg(F.min("d")).first()[0] < 1


def test_metrics_that_do_not_fit(registered):
    with pytest.raises(metrics.UnknownMetricError):
        codec.CodecConfig(metric="nothing")
    with pytest.raises(ValueError, match="form for columns"):
        metrics.get("edges").distortion(F.lit(1), F.lit(2))
    with pytest.raises(ValueError, match="has a form"):
        metrics.Metric("empty")
    assert metrics.get("psnr").distance(np.zeros((2, 2)), np.array([np.zeros((2, 2)), np.ones((2, 2))])).argmin() == 0


def test_tile_rects_are_those_of_the_grid(spark):
    table_functions.register(spark)
    sizes = spark.createDataFrame([(64, 48), (1, 1), (33, 7), (100, 65), (None, 5), (0, 4)], "h int, w int")
    for clipped in (True, False):
        got = spark.sql(f"SELECT s.h, s.w, t.* FROM {{s}} s, LATERAL tile_rects(s.h, s.w, 32, 8, {clipped}) t", s=sizes).collect()
        want = tiling.tiles(sizes.filter("h > 0"), 32, 8, clipped).select("h", "w", "tile_id", "y0", "x0", "y1", "x1").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    for bad in ("tile_rects(3, 3, 8, 8)", "tile_rects('a', 3, 8, 0)", "tile_rects(3, 3, 8, cast(rand() * 3 as int))"):
        with pytest.raises(Exception, match="overlap|whole number"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_unpack_records_in_sql(spark):
    table_functions.register(spark)
    records = [bitstream.Record(0, 3, 1, 77, 0, bitstream.RAW, b"abc"), bitstream.Record(1, 4, 0, 5)]
    good = bitstream.pack_header({"width": 9, "height": 8, "tile": 4, "overlap": 1}) + bitstream.pack_records(records)
    old = bitstream.pack_old(9, 8, 4, 1, records)
    blobs = spark.createDataFrame([(1, good), (2, good[:-1]), (3, None), (4, old)], "k int, blob binary")
    rows = spark.sql("SELECT b.k, r.* FROM {b} b, LATERAL unpack_records(b.blob) r", b=blobs).collect()
    assert sorted((r["k"], r["tile_id"], r["error"] is None) for r in rows if r["k"] == 1) == [(1, 0, True), (1, 1, True)]
    assert all(r["error"] and r["width"] is None for r in rows if r["k"] > 1) and {r["k"] for r in rows} == {1, 2, 3, 4}
    again = spark.sql("SELECT r.* FROM {b} b, LATERAL unpack_records(b.blob, true) r WHERE b.k = 4", b=blobs).collect()
    assert [(r["tile_id"], r["seed"], bytes(r["payload"])) for r in again] == [(0, 77, b"abc"), (1, 5, b"")]
    with pytest.raises(Exception, match="binary"):
        spark.sql("SELECT * FROM unpack_records('text')").collect()
