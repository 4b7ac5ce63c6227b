"""Cross-tokenizer alignment: which tokens of one tokenizer cover which tokens of another, and how often.

Method: elementary intervals.  The byte ends of both token sequences are united; each interval between neighbours of the
union lies in one token of either sequence, which a binary search finds, and so is one overlap.  Ends that both sequences
share close a group.  Overlaps are counted over the corpus; ``group_products`` expands the groups into all their pairs.

Spark deals the documents, and a document's tokens never leave its task; only its distinct pairs with their numbers are
written.  Tasks add pairs up before they are shuffled.  The counts go to a table in the shared folder, cut into slices of
``SLICE`` pairs at most on the average.  A task loads one slice at a time: with one slice documents stay where they lie,
with more the parts of a document move to the tasks of their slices, and the sums come together by document.

Tokenizer A is a byte-level BPE of the tokenizers library; its vocabulary and merges are read from the file and run by the
tiktoken library, which gives the same ids in a quarter of the time (``tests/llm/test_alignment.py`` compares).  B is
sentencepiece.  A long text is cut between a letter and a blank with a letter, where neither has a token across; stretches
without such a place, of over ``RUN`` characters, are encoded by ``bpe``.

Defined results
* null and empty texts, and texts of which the tokens don't spell the text (B may normalise): no tokens, zeros, ''.
* null doc_id, repeated rows: each row gets its own result and counts.  Ties for the highest count are all best.
* very long texts: encoded whole, in stretches.  Empty table: no rows.  Extra columns are ignored (``aligned`` carries
  them; input columns of the names that it adds are replaced).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import open_store, shared_folder, slices, tasks, written

#: Characters after which a long text is cut at the next place.
STRETCH = 500_000
#: Characters without a blank, or all blank, from which on A's library would take time that grows with the square.
RUN = 5_000
#: Pairs of a slice of the table of counts, and pairs that a task holds before it gives them away.
SLICE, HELD = 4_000_000, 1_000_000

_PLACE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_LONG_RUN = re.compile(rf"\S{{{RUN}}}|\s{{{RUN}}}")


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Alignment(NamedTuple):
    """Tokens of both sequences, the groups that they are in, and the overlaps as positions in the sequences."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(a: np.ndarray, b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray) -> Alignment:
    """Aligns tokens of these byte lengths that spell the same text."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    ends = np.union1d(ends_a, ends_b)
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return Alignment(a, b, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b), np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends))


NO_TOKENS = Alignment(*[np.zeros(0, dtype=np.int64)] * 6)


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            found = json.load(file)
        pre = found["pre_tokenizer"] or {}
        if found["model"]["type"] != "BPE" or found["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path_a} isn't a plain byte-level BPE")
        letters, special = byte_of_letter(), {t["content"] for t in found["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in found["model"]["vocab"].items() if token not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in found["model"]["merges"]]
        order = [found["model"]["vocab"][m] for m in merged]
        if order != sorted(order):
            raise ValueError(f"{path_a} doesn't number its tokens in the order of its merges")
        self.fast = tiktoken.Encoding("alignment", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.safe = bpe.Encoder(bpe.Vocabulary(ranks, pattern))
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)
        self.bytes_a = [b""] * (max(found["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in some], dtype=np.int64) for some in (self.bytes_a, self.bytes_b))
        # A token and what follows it in the text of groups, for tokens that don't end their part of a group and that do.
        self.shown = [f"{i}{mark}".encode() for i in range(len(self.bytes_a)) for mark in ",|"] + [f"{i}{mark}".encode() for i in range(len(self.bytes_b)) for mark in ",;"]
        self.dtype = np.dtype("<u4" if len(self.bytes_a) * len(self.bytes_b) < 2**32 else "<u8")

    def stretches(self, text: str) -> Iterator[str]:
        """A text in parts that are encoded alone; the blank between two parts is left out, as B adds one and A gets one."""
        at = 0
        while self.cuts and len(text) - at > STRETCH and (place := _PLACE.search(text, at + STRETCH)):
            yield text[at : place.start()]
            at = place.end()
        yield text[at:]

    def encode_a(self, text: str) -> np.ndarray:
        if len(text) >= RUN and _LONG_RUN.search(text):
            return np.frombuffer(b"".join(self.safe.encode([text])), dtype="<u4").astype(np.int64)
        return np.asarray(self.fast.encode_ordinary(text), dtype=np.int64)

    def aligned(self, text: str | None) -> Alignment:
        if not text:
            return NO_TOKENS
        parts = list(self.stretches(text))
        a = np.concatenate([self.encode_a(" " + p) for p in parts])
        b = np.concatenate([np.asarray(self.pieces.encode(p, num_threads=1), dtype=np.int64) for p in parts])
        whole = b" " + text.encode()
        if any(b"".join(map(table.__getitem__, ids.tolist())) != whole for table, ids in ((self.bytes_b, b), (self.bytes_a, a))):
            return NO_TOKENS
        return align(a, b, self.lengths_a[a], self.lengths_b[b])

    def keys(self, found: Alignment) -> np.ndarray:
        """The overlaps as numbers a * |B| + b, in the order of the text."""
        return (found.a[found.link_a] * len(self.bytes_b) + found.b[found.link_b]).astype(self.dtype)

    def groups_text(self, found: Alignment) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the groups with the ids of A and B."""
        if not len(found.a):
            return b""
        ends_a, ends_b = (np.append(g[1:] != g[:-1], True) for g in (found.group_a, found.group_b))
        shown = np.empty(len(found.a) + len(found.b), dtype=np.int64)
        shown[np.arange(len(found.a)) + np.searchsorted(found.group_b, found.group_a, side="left")] = 2 * found.a + ends_a
        shown[np.arange(len(found.b)) + np.searchsorted(found.group_a, found.group_b, side="right")] = 2 * (len(self.bytes_a) + found.b) + ends_b
        return b"".join(map(self.shown.__getitem__, shown.tolist()))[:-1]


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str, pattern: str) -> Pair:
    return Pair(path_a, path_b, pattern)


def _lists(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]).astype(np.int32)), pa.array(values, kind))


def aligned(documents: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """``documents`` with groups (array of (a, b): the ids of either tokenizer) and links (array of (a, b): the ids of
    tokens that overlap, in the order of the text)."""
    added = T._parse_datatype_string("groups array<struct<a:array<int>,b:array<int>>>, links array<struct<a:int,b:int>>").fields
    columns = [c for c in documents.columns if c not in {f.name for f in added}]
    schema = T.StructType([*documents.select(columns).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path_a, path_b, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                found = [own.aligned(t.as_py()) for t in part.column("text")]
                flat = lambda i, j: np.concatenate([f[i][f[j]] if j is not None else f[i] for f in found]).astype(np.int32)
                sizes = [[n for f in found for n in np.bincount(f[k]).tolist()] for k in (2, 3)]
                groups = pa.StructArray.from_arrays([_lists(flat(k, None), sizes[k], pa.int32()) for k in (0, 1)], names=["a", "b"])
                links = pa.StructArray.from_arrays([pa.array(flat(0, 4)), pa.array(flat(1, 5))], names=["a", "b"])
                ends = lambda lengths: pa.array(np.cumsum([0, *lengths]).astype(np.int32))
                new = [
                    pa.ListArray.from_arrays(ends([int(f.group_a[-1]) + 1 if len(f.a) else 0 for f in found]), groups),
                    pa.ListArray.from_arrays(ends([len(f.link_a) for f in found]), links),
                ]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *new], names=schema.names)

    return documents.select(columns).mapInArrow(run, schema)


def group_products(found: DataFrame) -> DataFrame:
    """a, b, n: how often A's token a and B's token b are in one group, of what ``aligned`` gives."""
    groups = found.select(F.explode("groups").alias("g"))
    return groups.select(F.explode("g.a").alias("a"), F.col("g.b").alias("_b")).select("a", F.explode("_b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def digests(documents: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys and times (the distinct pairs of the document, ascending,
    and how often it links them, as bytes)."""
    schema = T.StructType([documents.schema["doc_id"], *T._parse_datatype_string("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path_a, path_b, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                rows = []
                for text in part.column("text"):
                    found = own.aligned(text.as_py())
                    keys, times = np.unique(own.keys(found), return_counts=True)
                    groups = own.groups_text(found)
                    numbers = len(found.a), len(found.b), int(found.group_a[-1]) + 1 if len(found.a) else 0, len(found.link_a)
                    rows.append((*numbers, hashlib.sha256(groups).hexdigest() if groups else "", keys.tobytes(), times.astype("<u4").tobytes()))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


_ARROW = [pa.field(n, t) for n, t in [*[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("keys", pa.binary()), ("times", pa.binary())]]


def pair_counts(found: DataFrame, dtype: str) -> DataFrame:
    """key, n: how often the corpus links each pair, of rows (keys, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "keys", 4_000_000):
                keys = np.concatenate([held, *[np.frombuffer(k, dtype=dtype).astype(np.int64) for k in part.column("keys").to_pylist()]])
                times = np.concatenate([counts, *[np.frombuffer(k, dtype="<u4").astype(np.int64) for k in part.column("times").to_pylist()]])
                order = np.argsort(keys, kind="stable")
                keys, times = keys[order], times[order]
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
                held, counts = keys[first], np.add.reduceat(times, first) if len(first) else times
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["key", "n"])
                    held, counts = held[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["key", "n"])

    return found.select("keys", "times").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=1)
def _slice(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys (ascending), counts, whether they are their B token's highest, of a slice of the table of counts."""
    import pyarrow.dataset as ds

    store, place = open_store(path)
    table = ds.dataset(place, filesystem=store, format="parquet").to_table(columns=["key", "n", "best"])
    keys, n, best = (table.column(c).to_numpy() for c in ("key", "n", "best"))
    order = np.argsort(keys)
    return keys[order], n[order], best[order]


def scored(found: DataFrame, vocabulary_b: int, dtype: str, slice_pairs: int = SLICE) -> DataFrame:
    """row, n_best, count_sum for rows (row, keys, times): the links whose pair is the most frequent one of its B token,
    and the sum of the counts of all links."""
    counts = written(pair_counts(found, dtype), "pair-counts")
    number = max(1, -(-counts.count() // slice_pairs))
    spark = found.sparkSession
    of_b = F.pmod("key", F.lit(vocabulary_b)).alias("b")
    highest = counts.groupBy(of_b).agg(F.max("n").alias("highest"))
    ranked = counts.withColumn("b", of_b).join(highest, "b").select("key", "n", (F.col("n") == F.col("highest")).alias("best"), F.pmod("key", F.lit(number)).alias("slice"))
    path = shared_folder(spark, "pair-slices")
    ranked.repartition(number, "slice").write.partitionBy("slice").parquet(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "keys", 4_000_000):
                out: list[tuple] = []
                for row, keys, times in zip(part.column("row").to_pylist(), part.column("keys").to_pylist(), part.column("times").to_pylist()):
                    keys, times = np.frombuffer(keys, dtype=dtype), np.frombuffer(times, dtype="<u4")
                    of = keys % number
                    order = np.argsort(of, kind="stable")
                    at = np.flatnonzero(np.append(True, np.diff(of[order].astype(np.int64)) > 0)[: len(order)])
                    out += [(row, int(of[i[0]]), keys[i].tobytes(), times[i].tobytes()) for i in np.split(order, at[1:]) if len(i)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["row", "slice", "keys", "times"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "keys", 4_000_000):
                out = []
                for of, keys, times in zip(part.column("slice").to_pylist(), part.column("keys").to_pylist(), part.column("times").to_pylist()):
                    keys, times = np.frombuffer(keys, dtype=dtype), np.frombuffer(times, dtype="<u4")
                    if not len(keys):
                        out.append((0, 0))
                        continue
                    known, n, best = _slice(f"{path}/slice={of}")
                    at = np.searchsorted(known, keys.astype(np.int64))
                    each = n[at]
                    exact = each * times.astype(np.int64) if float(each.max()) * float(times.sum()) < 2**62 else each.astype(object) * times
                    out.append((int(times[best[at]].sum()), min(int(exact.sum()), 2**63 - 1)))
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(c, pa.int64()) for c in zip(*out)]], names=["row", "n_best", "count_sum"])

    schema = "row long, n_best long, count_sum long"
    rows = found.select("row", "keys", "times")
    if number == 1:
        return rows.select("row", F.lit(0).cast("long").alias("slice"), "keys", "times").mapInArrow(score, schema)
    parts = rows.mapInArrow(cut, "row long, slice long, keys binary, times binary").withColumn("salt", F.pmod("row", F.lit(tasks(rows))))
    parts = parts.repartition(tasks(rows), "slice", "salt").sortWithinPartitions("slice")
    return parts.select("row", "slice", "keys", "times").mapInArrow(score, schema).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def report(documents: DataFrame, path_a: str, path_b: str, pattern: str, slice_pairs: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document."""
    own = load(path_a, path_b, pattern)
    found = written(digests(documents, path_a, path_b, pattern).withColumn("row", F.monotonically_increasing_id()), "alignments")
    sums = scored(found, len(own.bytes_b), own.dtype.str, slice_pairs)
    joined = found.drop("keys", "times").join(sums, "row", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
