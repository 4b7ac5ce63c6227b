"""Queries on batch work: manifests, what is left to do, names, summaries.  Items are the rows of ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, workflow
from . import rasters
from .common import pairs, table, tidy

QUERIES, SQL = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _plan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    files = pages.select(F.format_string("/data/in/page_%d.png", "page_id").alias("path"))
    return workflow.plan(files, "/data/out/")


_PLAN = "m AS (SELECT page_id, 'page_' || page_id AS id, '/data/in/page_' || page_id || '.png' AS \"in\", '/data/out/page_' || page_id || '.img' AS out, 'todo' AS state FROM pages)"


@query
def plan_manifest(spark, sf_dir):
    return _plan(spark, sf_dir)


@query
def resume_antijoin(spark, sf_dir):
    """What is left when every third item has been written."""
    manifest = _plan(spark, sf_dir)
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    return workflow.left_to_do(manifest, manifest.filter(number % 3 == 0).select("out"))


def _work(row: dict) -> bytes:
    html = row["html"] or ""
    if row["page_id"] % 10 == 7:
        raise ValueError("this item fails")
    return html.encode()


def _run(spark, sf_dir):
    items = table(spark, sf_dir, "pages").select(F.format_string("page_%d", "page_id").alias("id"), "page_id", "html")
    return workflow.run(items, _work, lambda row: 64 * 64)


@query
def run_items(spark, sf_dir):
    """Each item's result; one in ten fails, and its error is its row."""
    return _run(spark, sf_dir).select("id", "state", "size", "sha256", tidy(F.col("bpp")).alias("bpp"), "error")


@query
def run_summary(spark, sf_dir):
    return workflow.summary(_run(spark, sf_dir))


@query
def output_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    bpp = F.col("page_id") / 8.0
    return pages.select("page_id", workflow.output_name(F.lit("pages"), F.col("page_id").cast("string"), F.lit("stripes"), F.col("page_id") % 5, bpp, F.col("page_id") * 3).alias("name"))


@query
def rd_csv(spark, sf_dir):
    """The text rows of a metrics file, one per image: quality of its values in eighths, and the rate of these as bytes."""
    both = pairs(spark, sf_dir)
    rate = both.groupBy("img", "b").agg(F.count("*").alias("n"))
    total = rate.groupBy("img").agg(F.sum("n").alias("total"))
    bits = rate.join(total, "img").groupBy("img").agg((-F.sum(F.col("n") * F.log2(F.col("n") / F.col("total"))) / F.max("total")).alias("bpp"))
    rows = metrics.psnr(both).join(metrics.ssim(both), "img").join(bits, "img")
    named = rows.select(F.format_string("%d.png", "img").alias("ref"), F.format_string("%d_recon.png", "img").alias("hat"), "psnr", "ssim", "bpp")
    return workflow.metrics_rows(named)


SQL["plan_manifest"] = f'WITH {_PLAN} SELECT id, "in", out, state FROM m'
SQL["resume_antijoin"] = f'WITH {_PLAN} SELECT id, "in", out, state FROM m WHERE page_id % 3 <> 0'
SQL["run_items"] = """SELECT 'page_' || page_id AS id, CASE WHEN page_id % 10 = 7 THEN 'error' ELSE 'done' END AS state,
  CASE WHEN page_id % 10 <> 7 THEN octet_length(encode(coalesce(html, ''))) END AS size, CASE WHEN page_id % 10 <> 7 THEN sha256(coalesce(html, '')) END AS sha256,
  CASE WHEN page_id % 10 <> 7 THEN round(8.0 * octet_length(encode(coalesce(html, ''))) / 4096, 6)::DOUBLE END AS bpp, CASE WHEN page_id % 10 = 7 THEN 'ValueError: this item fails' END AS error FROM pages"""
SQL["run_summary"] = "SELECT count(*) AS total, count(*) FILTER (WHERE page_id % 10 <> 7) AS done, count(*) FILTER (WHERE page_id % 10 = 7) AS errors FROM pages"
SQL["output_names"] = "SELECT page_id, 'pages_' || page_id || '_stripes__v15__q' || (page_id % 5) || '__' || printf('%.3f', page_id / 8.0) || '__s' || (page_id * 3) || '.img' AS name FROM pages"
SQL["rd_csv"] = f"""{rasters.SSIM_START}, ss AS (SELECT img, {rasters.SSIM_VALUE} AS ssim FROM r JOIN pairs USING (img, y, x) GROUP BY img
), ps AS (SELECT img, 10 * log10(1 / greatest(avg(pow(a - b, 2)), 1e-12)) AS psnr FROM pairs GROUP BY img
), cnt AS (SELECT img, b, count(*) AS n, sum(count(*)) OVER (PARTITION BY img) AS total FROM pairs GROUP BY img, b
), rt AS (SELECT img, -sum(n * log2(n / total)) / max(total) AS bpp FROM cnt GROUP BY img)
SELECT img || '.png' AS ref, img || '_recon.png' AS hat, printf('%.3f', psnr) AS psnr, printf('%.5f', ssim) AS ssim, printf('%.4f', bpp) AS bpp FROM ss JOIN ps USING (img) JOIN rt USING (img)"""
