"""Exact search for the k best inner products, by aggregation of sorted lists without random access.

Method: in a block of vectors each component is a list sorted by value; a query reads the lists of its components from the
end that its sign favours, all to the same depth.  What it has read of a vector, with the next value of each list in which
the vector hasn't come up, bounds the score from above, and with the last value of each such list from below.  Vectors
whose upper bound is below the k-th lower bound drop out.  When no vector that hasn't been seen can qualify and few are
left, reading stops and the final scores of these few are resolved.

Spark deals the vectors into blocks by their row numbers, so repeated vectors don't meet in one block.  Each query first
asks one block, the queries being dealt over the blocks; its k-th score there is a lower bound from real candidates, with
which it then asks the other blocks, so reading stops before the ends of the lists (after some four fifths for vectors
without a common direction).  A task holds one block and
streams the queries through it, however many they are, so only queries are repeated, once for each block; the k best of
all blocks are the answer.

Components are whole numbers, floor(``SCALE`` * x), and all sums are exact: sums of doubles below 2^53, of Python's
integers beyond.

Defined results
* vectors that are null, or hold null, NaN or infinity, take no part.  Components beyond a long are clamped to it, scores
  too.  Missing components of a shorter vector, or all of an empty one, count as 0.
* a null vec_id is never a query; as a candidate it comes last among ties.
* repeated rows: a query that is repeated (same id, same vector) is asked once; each row but those of the query's vec_id is
  a candidate, so copies come one after the other.  Different vectors of one id are queries of their own.
* ties go to the smaller vec_id.  Fewer than k candidates: all of them.  Empty table: no rows.
* very long vectors: a block holds some ``BLOCK`` vectors whatever their length.  Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tasks, written

SCALE = 1024
#: Vectors of a block, on the average.
BLOCK = 4_096
#: A list is read to 1, 2, 4, 8 of so many parts, and then part by part.
STEPS = 16
_LONG = 2**63


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """The rows of a list array as a matrix, zeros where a row is shorter than the longest."""
    values, lengths = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


class SortedLists:
    """The vectors of a block, and for each component its values in descending order and whose they are."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, vectors: np.ndarray):
        self.ids, self.missing, self.vectors = ids, missing, vectors
        n = len(vectors)
        self.depths = sorted({-(-n * part // STEPS) for part in (1, 2, 4, *range(STEPS // 2, STEPS + 1))})
        self.owners = np.argsort(-vectors.astype(np.float64), axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(vectors.T, self.owners, axis=1).astype(np.float64)
        self.places = np.empty(vectors.shape, dtype=np.int32)
        np.put_along_axis(self.places, self.owners.T, np.arange(len(vectors), dtype=np.int32)[:, None], axis=0)
        self.largest = max(map(abs, (int(vectors.max(initial=0)), int(vectors.min(initial=0)))))

    def best(self, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best candidates but those of id ``own``, and of those only such as reach ``least``."""
        width = min(len(query), self.vectors.shape[1])
        query = query[:width]
        candidates = self.missing | (self.ids != own)
        if self.largest * int(np.abs(query.astype(np.float64)).max(initial=0)) * width >= 2**52:
            rows = np.flatnonzero(candidates)
            scores = np.array([min(_LONG - 1, max(-_LONG, sum(a * b for a, b in zip(query.tolist(), v)))) for v in self.vectors[rows][:, :width].tolist()], dtype=np.int64)
        else:
            rows = self._read(query, candidates, k, least)
            scores = self.vectors[rows][:, :width] @ query
        order = np.lexsort((self.ids[rows], self.missing[rows], -scores.astype(np.float64) if self.largest < 2**20 else [-s for s in scores.tolist()]))[:k]
        order = order[scores[order] >= least]
        return rows[order], scores[order]

    def _read(self, query: np.ndarray, candidates: np.ndarray, k: int, least: float) -> np.ndarray:
        """The rows that can still be among the k best when reading stops."""
        n = len(self.vectors)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        lists = np.concatenate([up, down])
        weights = query[lists].astype(np.float64)
        last = np.zeros(len(query))
        last[lists] = np.concatenate([self.values[up, n - 1], self.values[down, 0]]) * weights
        read = np.zeros(n)
        live = np.flatnonzero(candidates)
        # How deep a vector lies in each list, from the end at which the query reads.
        places = self.places[:, : len(query)] * np.where(query < 0, -1, 1).astype(np.int32) + np.where(query < 0, n - 1, 0).astype(np.int32)
        places = places if len(live) == n else places[live]
        few, depth = max(2 * k, n // 64), 0
        for end in self.depths:
            owners = np.concatenate([self.owners[up, depth:end], self.owners[down, n - end : n - depth]])
            values = np.concatenate([self.values[up, depth:end], self.values[down, n - end : n - depth]])
            values *= weights[:, None]
            read += np.bincount(owners.ravel(), weights=values.ravel(), minlength=n)
            depth = end
            following = np.zeros(len(query))
            if depth < n:
                following[lists] = np.concatenate([self.values[up, depth], self.values[down, n - 1 - depth]]) * weights
            outside = following.sum()  # the most that a vector can reach that has come up in no list
            if outside >= least and 4 * depth < 3 * n:
                continue
            unseen = (places >= depth).astype(np.float64)
            known = read[live]
            lower = known + unseen @ last
            if len(live) > k:
                least = max(least, np.partition(lower, len(live) - k)[len(live) - k])
            stay = known + unseen @ following >= least
            live, places = live[stay], places[stay]
            if outside < least and len(live) <= few:
                break
        return live


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """row (its number), id, z (floor(scale * x) of each component) of the vectors that take part."""
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    z = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.filter(sound).select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), z.alias("z"))


def meet(candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, query_id, id, score: for each row of ``asked`` (block, query, id, z, least) the k best of its block of
    ``candidates`` (block, id, z), of those that reach ``least`` where it isn't null."""
    schema = "query long, query_id long, id long, score long"
    both = candidates.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query"), "id", "z", F.lit(None).cast("double").alias("least"))
    both = both.union(asked.select("block", F.lit(1), "query", "id", "z", F.col("least").cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, lists = None, [], None
        for batch in batches:
            block, kind, query, ids, z, least = batch.columns
            block, kind = block.to_numpy(), kind.to_numpy()
            if not len(block):
                continue
            cuts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]))).tolist()
            for start, end in zip(cuts, [*cuts[1:], len(block)]):
                if block[start] != current:
                    current, parts, lists = block[start], [], None
                rows = slice(start, end)
                own, vectors = ids[rows], _matrix(z[rows])
                if kind[start] == 0:
                    parts.append((own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), vectors))
                    continue
                if not parts:
                    continue
                if lists is None:
                    lists = SortedLists(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)), _stacked([p[2] for p in parts]))
                bounds = least[rows].fill_null(-np.inf).to_numpy()
                found = [lists.best(v, i, k, b) for v, i, b in zip(vectors, own.to_pylist(), bounds.tolist())]
                times = [len(r) for r, _ in found]
                at, scores = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                columns = [
                    pa.array(np.repeat(query[rows].to_numpy(), times)),
                    pa.array(np.repeat(own.to_numpy(), times)),
                    pa.array(lists.ids[at], mask=lists.missing[at]),
                    pa.array(scores.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "id", "score"])

    return both.repartition(tasks(both), "block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def search(vectors: DataFrame, every: int = 100, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score: the k best candidates of each query, the rows whose id is divisible by ``every``.

    ``vectors``: (row, id, z), as of ``whole_vectors``.
    """
    rows = written(vectors, "whole-vectors")
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int"))
    queries = rows.filter(F.col("id") % every == 0).groupBy("id", "z").agg(F.min("row").alias("query"))
    queries = written(queries.withColumn("home", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), "queries")
    at_home = written(meet(dealt, queries.select(F.col("home").alias("block"), "query", "id", "z", F.lit(None).alias("least")), k), "best-at-home")
    least = at_home.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = queries.join(least, "query", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter("block != home")
    found = at_home.union(meet(dealt, others, k)) if blocks > 1 else at_home
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def report(embeddings: DataFrame, every: int = 100, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return search(whole_vectors(embeddings), every, k, block).withColumnRenamed("id", "vec_id")
