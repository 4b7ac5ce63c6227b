"""Plans: columns are pruned at the scan, nothing is a cross join, hot paths stay out of Python."""

import re

import pytest

from tessella.plans import registry
from tessella.plans.common import pixels
from tessella.operators import search, tiling
from tessella.plans.common import dims


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def schemas(plan):
    return re.findall(r"ReadSchema: struct<(.*)>", plan)


def test_scans_read_what_they_need(spark, small):
    assert set(schemas(plan_of(registry.QUERIES["byte_histogram"](spark, small)))) == {"text:string"}
    assert set(schemas(plan_of(registry.QUERIES["plan_manifest"](spark, small)))) == {"page_id:bigint"}
    assert all("label" not in s for s in schemas(plan_of(registry.QUERIES["mse"](spark, small))))


@pytest.mark.parametrize("name", ["rd_search_mse", "rd_topk", "blend_hann", "ssim_window", "vq_lloyd_step", "tile_pixels"])
def test_no_python_and_no_cross_join(spark, small, name):
    plan = plan_of(registry.QUERIES[name](spark, small))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Arrow", plan)


def test_search_sums_before_its_shuffle(spark, small):
    """Scores are partial sums in each task: the shuffle carries a row per tile and candidate, not per pixel."""
    rows = tiling.tile_pixels(pixels(spark, small), dims(spark, small), 32, 8, clipped=True)
    plan = plan_of(search.scores(rows))
    assert "partial_avg" in plan


#: Queries that read their table before they return a frame of what they found.
READ_BEFORE = {"rans_table"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - READ_BEFORE))
def test_every_query_reads_a_given_table(spark, small, name):
    assert any(small in f for f in registry.QUERIES[name](spark, small).inputFiles())
