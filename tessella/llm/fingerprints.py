"""Document fingerprints: SimHash with weighted terms, and a search by permuted block tables.

Method: the terms of a text are its shingles of five words (the whole sequence if it is shorter), A-Z lower-cased; a
term that occurs n times weighs 1 + floor(log2 n).  The hash of a term votes with its weight for or against each bit.
For the search, a fingerprint is cut into blocks.  Fingerprints within the radius R agree on at least blocks - R of
the blocks, so there is a table for each choice of that many blocks (a permutation that brings them to the front);
rows that agree on the chosen blocks meet, and their distance is checked.

Defined results
* null text: the empty text.  A text without words: the fingerprint of no votes, all bits 0.
* equal texts have equal fingerprints; repeated rows get equal results.
* next document: by descending doc_id, null last, ties by a hash of the text; after the last comes the first, so a
  single document is its own next.  Empty table: no rows.
* very long texts are voted on in parts of bounded size.  doc_id has the type of the input's.  Extra columns of the input
  are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

BITS = 128
WORDS = 5
#: Odd multipliers that tell apart the places of a shingle, and the two halves of a term's hash.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
HALVES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _mixed(h: np.ndarray, factor: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * factor
    h = (h ^ (h >> np.uint64(29))) * factor
    return h ^ (h >> np.uint64(32))


def fingerprint(text: str) -> bytes:
    """The 16 bytes of a text's fingerprint."""
    words = text.encode().lower().split()
    if not words:
        return bytes(BITS // 8)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(hashes) - WORDS + 1)
    term = np.full(n, min(len(hashes), WORDS), dtype=np.uint64)
    for k in range(min(WORDS, len(hashes))):
        term = term + _mixed(hashes[k : k + n], PLACES[k])
    term, count = np.unique(term, return_counts=True)
    weight = np.frexp(count.astype(np.float64))[1].astype(np.float32)  # 1 + floor(log2 n)
    votes = np.zeros(BITS, dtype=np.float64)
    for at in range(0, len(term), 32_768):
        some = term[at : at + 32_768]
        halves = np.stack([_mixed(some, f) for f in HALVES], axis=1).astype(">u8")
        bits = np.unpackbits(halves.view(np.uint8).reshape(len(some), BITS // 8), axis=1).astype(np.float32)
        votes += weight[at : at + 32_768] @ bits
    return np.packbits(2 * votes > weight.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (32 hex digits): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "").hex() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    schema = T.StructType([documents.schema["doc_id"], T.StructField("fingerprint", T.StringType())])
    return documents.select("doc_id", "text").mapInArrow(run, schema)


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, own: bytes, following: str, next_own: bytes) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    return (len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, next_own))


def compare_with_next(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, the fingerprints of each text and its edited text, and their likenesses.

    The texts move once, in a range shuffle by descending doc_id; each task walks its rows in order.  The last row of
    a task waits for the first row of the next one: these rows, at most two per task, are paired afterwards.
    """
    ordered = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_key")]
    ranged = ordered.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    fields = T._parse_datatype_string(_RESULT).fields
    schema = T.StructType([documents.schema["doc_id"], *fields, T.StructField("task", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                own = fingerprint(text)
                if last is None:
                    rows.append((doc_id, None, None, own.hex(), None, None, None, task, "first", text))
                else:
                    rows.append((last[0], *_compared(last[1], last[2], text, own), task, "row", None))
                last = doc_id, text, own
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)] if rows else [pa.array([], t) for t in types.types], schema=types)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((last[0], None, None, last[2].hex(), None, None, None, task, "last", last[1]), types.types)], schema=types)

    found = written(ranged.mapInArrow(run, schema), "document-fingerprints")
    result = ["doc_id", *[f.name for f in fields]]
    # One row for each task that had rows, without its text: the task that follows, in a circle.
    tasks = found.filter("kind = 'first'").select("task")
    circle = tasks.select("task", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(Window.partitionBy())).alias("following"))
    first = found.filter("kind = 'first'").select(F.col("task").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = found.filter("kind = 'last'").select("doc_id", "task", "text", "fingerprint")
    # The circle has two numbers a task; the texts meet by a shuffle, and of the next one only what the edit takes goes on.
    pairs = last.join(F.broadcast(circle), "task").hint("merge").join(first.hint("merge"), "following")
    needed = F.expr("substring(next_text, 1, length(text) div 2)").alias("next_text")
    pairs = pairs.select("doc_id", "text", "fingerprint", needed, "next_fingerprint")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["doc_id"], *_compared(r["text"], bytes.fromhex(r["fingerprint"]), r["next_text"], bytes.fromhex(r["next_fingerprint"]))) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], names=types.names[:7])

    closing = pairs.mapInArrow(finish, T.StructType([documents.schema["doc_id"], *fields]))
    return found.filter("kind = 'row'").select(*result).union(closing.select(*result))


def _halves(fingerprint_: Column) -> list[Column]:
    """The fingerprint's two halves as longs."""
    return [F.conv(F.substring(fingerprint_, start, 16), 16, -10).cast("long").alias(name) for start, name in ((1, "hi"), (17, "lo"))]


def _hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(half), 16, "0") for half in (hi, lo)]))


def blocks_to_agree(count: int, radius: int) -> int:
    """The fewest agreeing blocks whose bits tell apart so many fingerprints, within a factor of four."""
    return next(a for a in range(1, BITS) if a * (BITS // (radius + a)) + 2 >= count.bit_length())


def _tables(fingerprints_: DataFrame, radius: int, agree: int) -> DataFrame:
    """hi, lo and, for each block table, a key of its number and the bits of the blocks it chooses."""
    blocks = radius + agree
    cuts = [BITS * k // blocks for k in range(blocks + 1)]

    def block(start: int, end: int) -> Column:
        # Bits start to end of the 128; a block may lie in both halves.
        parts = []
        for half, base in (("hi", 0), ("lo", 64)):
            first, last = max(start - base, 0), min(end - base, 64)
            if first < last:
                mask = ((1 << (last - first)) - 1) << (64 - last)
                parts.append(F.col(half).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        return F.struct(*parts) if len(parts) > 1 else parts[0]

    block_of = [block(cuts[k], cuts[k + 1]) for k in range(blocks)]
    keys = F.array(*[F.xxhash64(F.lit(n), *[block_of[k] for k in chosen]) for n, chosen in enumerate(combinations(range(blocks), agree))])
    return fingerprints_.select(*_halves(F.col("fingerprint"))).distinct().select("hi", "lo", F.explode(keys).alias("key"))


def search(queries: DataFrame, corpus: DataFrame, radius: int = 6, agree: int | None = None) -> DataFrame:
    """query, fingerprint, distance: all distinct fingerprints of ``corpus`` within the radius of one of ``queries``.

    Both have a column ``fingerprint``.  Equal fingerprints count once, so copies don't multiply; documents of a
    fingerprint are had by a join.  ``agree`` blocks of radius + agree form the key of a table, so every pair within
    the radius meets in at least one table: nothing is missed and no bucket is capped.  Without ``agree``, keys get
    longer as the corpus grows, so that few rows share one.
    """
    agree = agree or blocks_to_agree(corpus.count(), radius)
    asked = _tables(queries, radius, agree).select("key", F.col("hi").alias("query_hi"), F.col("lo").alias("query_lo"))
    distance = F.bit_count(F.col("hi").bitwiseXOR(F.col("query_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("query_lo")))
    met = _tables(corpus, radius, agree).join(asked, "key").withColumn("distance", distance).filter(F.col("distance") <= radius)
    found = met.select("query_hi", "query_lo", "hi", "lo", "distance").distinct()
    return found.select(_hex(F.col("query_hi"), F.col("query_lo")).alias("query"), _hex(F.col("hi"), F.col("lo")).alias("fingerprint"), "distance")


def report(documents: DataFrame, query_every: int = 50, radius: int = 6) -> DataFrame:
    """``compare_with_next``, and for each document whose doc_id is divisible by ``query_every`` the number of
    documents (itself included) within the radius, from the block tables; null for the others."""
    found = written(compare_with_next(documents), "document-fingerprints")
    queries = found.filter(F.col("doc_id") % query_every == 0).select("fingerprint").distinct()
    counts = found.groupBy("fingerprint").agg(F.count("*").alias("n"))
    near = search(queries, found, radius).join(counts, "fingerprint").groupBy("query").agg(F.sum("n").alias("n_near"))
    joined = found.join(near, found["fingerprint"] == near["query"], "left").drop("query")
    return joined.withColumn("n_near", F.when(F.col("doc_id") % query_every == 0, F.col("n_near")))
