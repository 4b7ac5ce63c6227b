"""The queries of this subpackage: name to function of (spark, sf_dir), and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers

from . import alignment, bpe, chat, divergence, fingerprints, mixing, quality, records, secrets, simhash, topk, urlfilter, warc
from .common import table
from .sql import op1, op2, op7, op8, op12, op13

QUERIES = {}
SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


SQL["op1_quality_rules"] = op1.SQL


@query
def op2_secret_scans(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


SQL["op2_secret_scans"] = op2.SQL


@query
def op7_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


SQL["op7_mixing"] = op7.SQL


@query
def op3_byte_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


@query
def op4_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


@query
def op5_binary_records(spark, sf_dir):
    return records.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_chat_formatting(spark, sf_dir):
    return chat.report(table(spark, sf_dir, "conversations"))


@query
def op8_url_filters(spark, sf_dir):
    return urlfilter.report(table(spark, sf_dir, "pages"))


SQL["op8_url_filters"] = op8.SQL


@query
def op10_document_fingerprints(spark, sf_dir):
    return fingerprints.report(table(spark, sf_dir, "documents"))


@query
def op12_source_divergence(spark, sf_dir):
    return divergence.report(table(spark, sf_dir, "documents"))


SQL["op12_source_divergence"] = op12.SQL


@query
def op13_exact_topk(spark, sf_dir):
    return topk.report(table(spark, sf_dir, "embeddings"))


SQL["op13_exact_topk"] = op13.SQL


@query
def op11_cross_tokenizer_alignment(spark, sf_dir):
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.report(table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN)
