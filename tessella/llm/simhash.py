"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Method: two fingerprints within the radius R share a variant within R // 2 (rounded up on one side) of each.  Every
distinct fingerprint emits its variants within half the radius; variants meet by a shuffle; the fingerprints that
meet are linked to the least of them, which the triangle inequality puts within R (for an odd R, to the least of those
that needed less than the half radius rounded up), and links are deduplicated and verified.  Components of the links
come from alternating large-star and small-star steps.

What moves: a variant is addressed by its leading bits.  The shuffle carries a fingerprint once to each leading
value that its variants have (79 for 12 bits and half radius 2), and the receiving task spells out the other bits
(2,081 variants in all).  So 16 bytes move 79 times instead of 2,081 times.  The number of leading bits grows with
the number of fingerprints, so a group of variants keeps its size; a group that is larger all the same is split by
further bits within its task.

Defined results
* null text or no word: fingerprint 0, linked like any other.  null doc_id: never a component id, unless a
  component has no other.
* exact copies and repeated rows have one fingerprint, which counts once; each row gets its own output row.
* no caps: a fingerprint with any number of partners gets all the links that its components need.
* empty table: no rows.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

BITS = 64
#: Variants that a task spells out at a time.
AT_A_TIME = 4_000_000
#: Fingerprints of which all pairs that share a variant are links.
FEW = 8
LEAST_LEADING_BITS = 12


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, A-Z lower-cased; of the whole sequence if it is shorter."""
    parts = (text or "").encode().lower().split()
    n = len(parts)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined, seed)] if n else [], dtype=np.uint64)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(ends))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half of the hashes; 0 if there are none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        some = hashes[at : at + 65_536].astype(">u8")
        ones += np.unpackbits(some.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t.as_py(), words, seed)) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    schema = T.StructType([documents.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])
    return documents.select("doc_id", _text_key(documents).alias("text_key"), "text").mapInArrow(run, schema)


def _text_key(documents: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(documents["text"], F.lit("")))


def masks(bits: int, radius: int) -> list[int]:
    """All values of ``bits`` bits of which at most ``radius`` are set."""
    return [sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(range(bits), k)]


def leading_bits(count: int, radius: int) -> int:
    """So many leading bits that a group has about ``AT_A_TIME`` variants."""
    variants = count * len(masks(BITS, radius))
    return min(32, max(LEAST_LEADING_BITS, (variants // AT_A_TIME).bit_length()))


def _links(
    fps: np.ndarray, labels: np.ndarray, rest: np.ndarray, bits: int, cache: dict, odd: bool = False, few: int = 0, at_a_time: int = AT_A_TIME, alike: Callable[[np.ndarray], np.ndarray] | None = None
) -> list[np.ndarray]:
    """Links among fingerprints of one group: the variants' leading bits are those of the group, which took them
    ``rest`` short of the half radius; ``bits`` bits follow.

    Rows (label, least label that shares a variant, in how many).  ``odd``: of the labels that share a variant only
    those that are still short of the half radius are linked to, so all links are within twice that radius less one.
    ``few``: variants of so many labels or fewer give all pairs, of which those stay that are ``alike``; others also link
    to the next lower label that shares it.
    """
    if len(fps) < 2:
        return []
    radii = np.unique(rest)
    for r in radii.tolist():
        if (bits, r) not in cache:
            cache[bits, r] = np.array(masks(bits, r), dtype=np.uint64)
    total = sum(len(cache[bits, r]) * int((rest == r).sum()) for r in radii.tolist())
    if total > at_a_time and bits > 4:
        found, lead = [], (fps >> np.uint64(bits - 4)) & np.uint64(15)
        for value in range(16):
            left = rest - np.bitwise_count(lead ^ np.uint64(value)).astype(np.int64)
            some = left >= 0
            found += _links(fps[some], labels[some], left[some], bits - 4, cache, odd, few, at_a_time, alike)
        return found
    low = np.uint64((1 << bits) - 1)
    keys, owners, far = [], [], []
    for r in radii.tolist():
        own, mask = rest == r, cache[bits, r]
        keys.append(((fps[own] & low)[:, None] ^ mask[None, :]).ravel())
        owners.append(np.repeat(labels[own], len(mask)))
        if odd:
            far.append(np.tile(np.bitwise_count(mask) == r, int(own.sum())))
    key = np.concatenate(keys)
    in_order = np.sort(key)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(twice):
        return []
    hit = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
    key, owner = key[hit], np.concatenate(owners)[hit]
    outer = np.concatenate(far)[hit] if odd else np.zeros(len(key), dtype=bool)
    order = np.lexsort((owner, outer, key))
    key, owner, outer = key[order], owner[order], outer[order]
    first = np.append(True, key[1:] != key[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, len(key)))
    number = np.repeat(sizes, sizes)
    place = np.arange(len(key)) - start
    pairs = []
    for k in range(1, few) if few else (1,):  # with the first of a group (k = 1), and with the k - 1 rows before
        some = np.flatnonzero(~first & ~outer[start]) if k == 1 else np.flatnonzero((place >= k) & ((number <= few) | (k == 2)))
        both = np.stack([owner[some], owner[start[some] if k == 1 else some - (k - 1)]], axis=1)
        if alike is not None:
            both = both[(number[some] > few) | alike(both)]
        pairs.append(both)
    return [_counted(np.concatenate(pairs))]


def _counted(pairs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Rows (a, b, number of times) of the pairs whose sides differ."""
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))[: len(pairs)])
    times = np.diff(np.append(first, len(pairs))) if weights is None else np.add.reduceat(weights[order], first) if len(first) else weights[:0]
    return np.column_stack([pairs[first], times])


def _forest(links_: np.ndarray, few: int) -> np.ndarray:
    """Of links (a, b, times) those that connect what all connect, the nearest first (which share most variants): as
    many as there are labels at most, however many variants a group shares.  Where no more than ``few`` labels are
    connected, all links.  Rows (a, b, whether some were left out)."""
    parent: dict[int, int] = {}
    size: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    order = np.argsort(-links_[:, 2], kind="stable")
    ends = links_[order, :2].tolist()
    tree = []
    for a, b in ends:
        x, y = root(a), root(b)
        tree.append(x != y)
        if x != y:
            parent[x] = y
            size[y] = size.get(x, 1) + size.get(y, 1)
    large = np.array([size[root(a)] > few for a, _ in ends], dtype=bool)
    kept = np.array(tree, dtype=bool) | ~large
    return np.column_stack([links_[order, :2], large])[kept]


def _spread(rows: DataFrame, bits: int, lead: int, half: int) -> DataFrame:
    """Rows (table, fp, label) once for each leading value that variants of fp have."""
    near = F.array(*[F.lit(m) for m in masks(lead, half)])
    mine = F.shiftrightunsigned("fp", bits - lead)
    many = rows.select("*", F.explode(near).alias("mask"))
    return many.select("table", mine.bitwiseXOR(F.col("mask").cast("long")).cast("long").alias("lead"), *[c for c in rows.columns if c != "table"])


def _meetings(rows: DataFrame, bits: int, lead: int, radius: int, few: int = 0, at_a_time: int = AT_A_TIME, most: int | None = None) -> DataFrame:
    """a, b (b < a), large: labels of fingerprints that share a variant, as of ``_links``; of each group what ``_forest``
    keeps.  Each task takes its groups one by one.  ``most``: pairs are alike if no more than so many bits of the columns
    of ``rows`` beyond (table, fp, label) differ."""
    half, shift = (radius + 1) // 2, bits - lead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}

        def close(group: tuple[int, int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            both = np.concatenate(parts, axis=1)
            fps = both[0].view(np.uint64)
            rest = half - np.bitwise_count((fps >> np.uint64(shift)) ^ np.uint64(group[1])).astype(np.int64)
            labels, alike = both[1], None
            if most is not None:
                order = np.argsort(labels)

                def alike(pairs: np.ndarray) -> np.ndarray:
                    a, b = (order[np.searchsorted(labels, pairs[:, i], sorter=order)] for i in (0, 1))
                    return sum(np.bitwise_count((c[a] ^ c[b]).view(np.uint64)).astype(np.int64) for c in both[2:]) <= most

            found = _links(fps, labels, rest, shift, cache, bool(radius % 2), few, at_a_time, alike)
            if found:
                every = np.concatenate(found)
                kept = _forest(_counted(every[:, :2], every[:, 2]), few)
                columns = [kept[:, :2].max(axis=1), kept[:, :2].min(axis=1), kept[:, 2].astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "large"])

        current, parts = None, []
        for batch in batches:
            table, lead_, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(table):
                continue
            change = (table[1:] != table[:-1]) | (lead_[1:] != lead_[:-1])
            cuts = np.flatnonzero(np.append(True, change)).tolist()
            for start, end in zip(cuts, [*cuts[1:], len(table)]):
                group = int(table[start]), int(lead_[start])
                if group != current:
                    if parts:
                        yield from close(current, parts)
                    current, parts = group, []
                parts.append(np.stack([v[start:end] for v in values]))
        if parts:
            yield from close(current, parts)

    groups = _spread(rows, bits, lead, half).repartition("table", "lead").sortWithinPartitions("table", "lead")
    return groups.mapInArrow(run, "a long, b long, large boolean").groupBy("a", "b").agg(F.bool_or("large").alias("large"))


def links(nodes: DataFrame, radius: int = 4, at_a_time: int = AT_A_TIME) -> DataFrame:
    """a, b (b < a): links within the radius that connect the distinct fingerprints ``fp`` of ``nodes``."""
    rows = nodes.select(F.lit(0).alias("table"), "fp", F.col("fp").alias("label"))
    found = _meetings(rows, BITS, leading_bits(nodes.count(), (radius + 1) // 2), radius, at_a_time=at_a_time)
    return found.select("a", "b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component; one row per node that has a link.

    Each round is a large-star and a small-star step, written to the shared folder; rounds end when a round changes
    nothing.  A node's least neighbour is a partial minimum, and the join back is one that Spark splits where a node
    is hot.
    """

    def star(directed: DataFrame) -> DataFrame:
        least = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return directed.join(least, "u")

    def signature(table: DataFrame) -> tuple:
        # Sums of 32 bits, which don't overflow.
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first())

    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    before, mark = None, signature(now)
    while mark != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Large-star keeps u > v, as m is below v's neighbour u.
        small = star(large)
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = written(small.distinct(), "links")
        before, mark = mark, signature(now)
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())


def _labelled(fps: DataFrame, radius: int) -> DataFrame:
    """fp, first (its first document: null, doc_id, text_key), label (the least fingerprint of the component)."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = written(fps.groupBy("fp").agg(F.min(first).alias("first")), "fingerprint-nodes")
    labels = components(links(nodes, radius))
    return nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))


def cluster(documents: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links): one row per document."""
    fps = written(fingerprints(documents, words, seed), "fingerprints")
    labelled = _labelled(fps, radius)
    first = labelled.groupBy("label").agg(F.min("first.doc_id").alias("component_id"))
    of_fp = written(labelled.join(first, "label").select(F.col("fp").alias("_fp"), "component_id"), "fingerprint-components")
    return fps.join(of_fp, fps["fp"] == of_fp["_fp"]).select("doc_id", "fp", "component_id")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    found = cluster(documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- groups by similarity of sets of shingles ------------------------------------------------------------------------

#: Bits of a fingerprint that may differ, and in how many of them, where fingerprints meet.
BALL_BITS, TABLE_RADIUS = 32, 4
#: Texts of a table that meet in a group, at most on the average.  A variant then has a quarter of a text.
GROUP = 2_000_000
#: The chance with which a pair at the limit of similarity meets in some table.
MEETS = 0.98
#: Bits by which pairs are checked where they meet, and standard deviations above the mean at the limit.
CHECK_BITS, CHECK_DEVIATIONS = 128, 4
#: Groups of a table, as a power of two, that its fingerprints are dealt over however few there are.
LEAST_GROUPS = 3
#: Fingerprints of a sketch, at least.
WIDTH = 14
MIX = np.uint64(0xD6E8FEB86659FD93)


class Shape(NamedTuple):
    """Tables in which a text has a fingerprint, the bits of one, how many leading bits must agree, and the fingerprints of
    a sketch, which tell by all their bits how much two texts that meet have in common."""

    tables: int
    bits: int
    agree: int = 0
    width: int = 0


def differing(similarity: float) -> float:
    """The chance that a bit of two fingerprints differs, for sets of one size and this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shape_for(count: int, similarity: float = 0.8) -> Shape:
    """Independent fingerprints of a text, and their bits.

    So many leading bits must agree that ``GROUP`` texts have them in common; of the 32 bits that follow, four may differ.
    So a text has a row per table, and no more texts meet by chance the more there are.  So many tables that a pair at the
    limit meets with a chance of ``MEETS``: seven for two million texts, where one fingerprint is near with a chance of
    0.46.
    """
    agree = max(0, math.ceil(math.log2(max(1, count) / GROUP)))
    p = differing(similarity)
    near = (1 - p) ** agree * sum(math.comb(BALL_BITS, k) * p**k * (1 - p) ** (BALL_BITS - k) for k in range(TABLE_RADIUS + 1))
    tables = max(5, math.ceil(math.log(1 - MEETS) / math.log(1 - near)))
    return Shape(tables, agree + BALL_BITS, agree, max(WIDTH, tables))


def most_checked(similarity: float) -> int:
    """Differing bits of the check up to which a pair that meets is a pair."""
    p = differing(similarity)
    return math.floor(CHECK_BITS * p + CHECK_DEVIATIONS * math.sqrt(CHECK_BITS * p * (1 - p)))


def chance_partners(count: int, similarity: float = 0.8) -> float:
    """Texts that a text has as pairs in a table though they have no shingle in common."""
    shape = shape_for(count, similarity)
    ball = sum(math.comb(BALL_BITS, k) for k in range(TABLE_RADIUS + 1)) / 2**shape.bits
    check = sum(math.comb(CHECK_BITS, k) for k in range(most_checked(similarity) + 1)) / 2**CHECK_BITS
    return count * ball * check


def _lead(shape: Shape) -> int:
    return max(0, LEAST_GROUPS - shape.agree)


def rows_of_a_text(count: int, similarity: float = 0.8) -> int:
    """Rows that a text has where its fingerprints meet."""
    shape = shape_for(count, similarity)
    return shape.tables * len(masks(_lead(shape), (TABLE_RADIUS + 1) // 2))


def sketch(hashes: np.ndarray, shape: Shape) -> list[int]:
    """The fingerprints of a set of shingle hashes, those of the tables first."""
    hashes = np.unique(hashes)
    tables, width = max(shape.width, shape.tables), -(-shape.bits // 8)
    salts = np.arange(1, 2 * tables, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(tables * width * 8, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so many single bits still sum up in a byte
        h = hashes[at : at + 255, None] ^ salts
        h = (h ^ (h >> np.uint64(32))) * MIX
        h = (h ^ (h >> np.uint64(29))) * MIX
        raw = (h ^ (h >> np.uint64(32))).astype(">u8").view(np.uint8).reshape(len(h), tables, 8)[:, :, :width]
        ones += np.unpackbits(raw.reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.uint8)
    packed = np.packbits(2 * ones > len(hashes)).reshape(tables, width)
    return [int.from_bytes(row.tobytes(), "big") >> (8 * width - shape.bits) for row in packed]


def sketches(documents: DataFrame, shape: Shape, words: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, text_key, node (a hash of the words, A-Z lower-cased), sketch."""
    schema = T.StructType([documents.schema["doc_id"], *T._parse_datatype_string("text_key long, node long, sketch array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                texts = [t.as_py() or "" for t in part.column("text")]
                nodes = np.array([xxhash.xxh3_64_intdigest(b" ".join(t.encode().lower().split()), seed) for t in texts], dtype=np.uint64).view(np.int64)
                made = [sketch(shingle_hashes(t, words, seed), shape) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(nodes), pa.array(made, pa.list_(pa.int64()))], names=schema.names)

    return documents.select("doc_id", _text_key(documents).alias("text_key"), "text").mapInArrow(run, schema)


def most_bits(similarity: float, shape: Shape) -> int:
    """Differing bits of two sketches up to which their sets are compared: the mean at this Jaccard similarity of sets
    of one size, and three standard deviations."""
    n, p = max(shape.width, shape.tables) * shape.bits, differing(similarity)
    return math.floor(n * p + 3 * math.sqrt(n * p * (1 - p)))


def meetings(nodes: DataFrame, shape: Shape, similarity: float = 0.8) -> DataFrame:
    """a, b, large: links of nodes (node, sketch) of which a fingerprint is near.

    Fingerprints whose leading bits agree meet per table by ball hashing over the other bits.  Each brings bits of the
    four tables that follow its own, by which pairs are checked where they meet, before they are rows.  Where few meet all
    pairs are links.  Where many do (``large``), each links to the least in a variant and to the one before it, and a
    forest of the nearest links stays, so links grow with the nodes and not with their pairs.
    """
    ball = shape.bits - shape.agree
    at = lambda k: F.get("sketch", F.pmod(F.col("table") + k, F.lit(shape.tables)).cast("int"))
    both = lambda k: at(k).bitwiseAND(F.lit((1 << ball) - 1)).bitwiseXOR(F.shiftleft(at(k + 1), ball))
    rows = nodes.select("node", "sketch", F.posexplode(F.slice("sketch", 1, shape.tables)).alias("table", "whole")).select(
        (F.col("table").cast("long") * (1 << shape.agree) + F.shiftrightunsigned("whole", ball)).alias("table"),
        F.col("whole").bitwiseAND(F.lit((1 << ball) - 1)).alias("fp"), F.col("node").alias("label"), both(1).alias("check_1"), both(3).alias("check_2"),
    )
    return _meetings(rows, ball, _lead(shape), TABLE_RADIUS, FEW, most=most_checked(similarity))


def near(pairs: DataFrame, nodes: DataFrame, similarity: float, shape: Shape) -> DataFrame:
    """The pairs (a, b) of which, by all bits of both sketches, no more differ than of similar texts."""
    of = [nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"_{c}")) for c in "ab"]
    apart = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    return pairs.join(of[0], "a").join(of[1], "b").filter(apart <= most_bits(similarity, shape)).select("a", "b")


def shingle_sets(rows: DataFrame, words: int = 5, seed: int = 42) -> DataFrame:
    """node, shingles: the set of a text's shingle hashes, from rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(t.as_py(), words, seed)).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have this Jaccard similarity at least."""
    of = [sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab"]
    common = F.size(F.array_intersect("_a", "_b"))
    percent = round(100 * similarity)
    alike = 100 * common >= percent * (F.size("_a") + F.size("_b") - common)
    return pairs.join(of[0], "a").join(of[1], "b").filter(alike).select("a", "b")


#: Nodes and shingles of a chunk of a family, on the average.
CHUNK, CHUNK_SHINGLES = 128, 500_000


def _block(similarity: float, most: int, one: list[tuple], two: list[tuple]) -> Iterator[tuple[int, int]]:
    """Similar pairs of rows (node, component, sketch, shingles), one of each list, that meet and are of different
    components."""
    percent = round(100 * similarity)
    near = np.zeros((len(one), len(two)), dtype=bool)
    apart = np.zeros((len(one), len(two)), dtype=np.int64)
    for table in range(len(one[0][2])):
        differ = np.bitwise_count(np.array([r[2][table] for r in one], dtype=np.int64).view(np.uint64)[:, None] ^ np.array([r[2][table] for r in two], dtype=np.int64).view(np.uint64))
        near |= differ <= TABLE_RADIUS
        apart += differ
    near &= (apart <= most) & (np.array([r[1] for r in one])[:, None] != np.array([r[1] for r in two]))
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        (x, _, _, a), (y, _, _, b) = one[i], two[j]
        if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
            common = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * common >= percent * (len(a) + len(b) - common):
                yield x, y


def verified_across(rows: DataFrame, similarity: float, shape: Shape) -> DataFrame:
    """a, b: the similar pairs of one family and different components, from rows (family, component, node, sketch,
    shingles); every pair that meets is compared.

    A family is dealt into chunks, and each two chunks meet in a block, which compares their nodes in its task: a node
    moves once to each chunk of its family, and pairs that aren't alike are no rows.
    """
    sizes = rows.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.size("shingles")) / CHUNK_SHINGLES)).cast("int").alias("chunks"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    open_ = rows.join(sizes.filter("low < high").select("family", "chunks"), "family").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("family", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "component", "sketch", "shingles")
    most = most_bits(similarity, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, later = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                same = current is not None and current[1] == current[2]
                found = list(_block(similarity, most, held, held if same else later)) if same or later else []
                yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in found], pa.int64()) for f in (max, min)], names=["a", "b"])

        for batch in batches:
            family, i, j, chunk, node, component, sketch_, shingles = batch.columns
            for n, key in enumerate(zip(family.to_pylist(), i.to_pylist(), j.to_pylist())):
                if key != current:
                    yield from close()
                    current, held, later = key, [], []
                row = node[n].as_py(), component[n].as_py(), sketch_[n].values.to_numpy(), shingles[n].values.to_numpy()
                (held if chunk[n].as_py() == key[1] else later).append(row)
        yield from close()

    return dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _families(links_: DataFrame, labels: DataFrame) -> DataFrame:
    """node, component, family: the ends of links, their components (``labels``), and what the links between different
    components connect; nodes of which no link leaves the component have no row."""
    known = labels.withColumnRenamed("label", "_label")
    of = lambda c: F.coalesce("_label", c).alias(f"_{c}")
    ends = links_.join(known, F.col("a") == F.col("node"), "left").select("a", "b", of("a")).join(known, F.col("b") == F.col("node"), "left").select("a", "b", "_a", of("b"))
    ends = written(ends, "links-of-components")
    family = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("component"), F.col("label").alias("family"))
    rows = ends.select(F.col("a").alias("node"), F.col("_a").alias("component")).union(ends.select("b", "_b")).distinct()
    return written(rows.join(family, "component").select("node", "component", "family"), "families")


def _keys(doc_id: Column, text_key: Column) -> dict[str, Column]:
    """Keys of a row without nulls: a later step then finds rows where a join has put them."""
    return {"_id": F.coalesce(doc_id, F.lit(0)), "_none": doc_id.isNull(), "_text": text_key}


def deduplicated(documents: DataFrame, similarity: float = 0.8, words: int = 5, seed: int = 42) -> DataFrame:
    """The rows of ``documents`` that stay: of each group of similar texts the one with the smallest doc_id (null
    last, then by a hash of the text); of repeated rows one.  Texts without words are one group.

    Sketches find the pairs; the sets of shingles, of texts that are in a pair alone, verify them, and the pairs that
    hold make components.  Where many texts meet, these pairs are a forest of nearest links.  So then all texts of such
    a family that meet and are still of different components are compared, in blocks: no similar pair is lost to a link
    that does not hold.  Texts move once to meet the table of those that stay, and twice to meet that of those whose sets
    are wanted.  The row travels as a struct, so its columns can't clash with those used here.
    """
    shape = shape_for(documents.count(), similarity)
    made = written(sketches(documents, shape, words, seed), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = written(made.groupBy("node").agg(F.min(first).alias("first"), F.first("sketch").alias("sketch")), "sketch-nodes")
    keyed = documents.select(F.struct(*documents.columns).alias("_row"), *[c.alias(k) for k, c in _keys(F.col("doc_id"), _text_key(documents)).items()])
    keys = ["_id", "_none", "_text"]

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = nodes.join(wanted, "node").select("node", *[c.alias(k) for k, c in _keys(F.col("first.doc_id"), F.col("first.text_key")).items()])
        texts = keyed.select(F.col("_row.text").alias("text"), *keys).join(written(wanted, "sketch-candidates"), keys)
        return written(shingle_sets(texts, words, seed).dropDuplicates(["node"]), "shingle-sets")

    met = written(meetings(nodes, shape, similarity), "sketch-meetings")
    pairs = written(near(met, nodes, similarity, shape), "sketch-pairs")
    alike = written(verified(pairs, sets_of(pairs), similarity), "similar-pairs")
    labels = components(alike)
    families = _families(met.filter("large"), labels)
    if not families.isEmpty():
        sets = sets_of(families.select(F.col("node").alias("a"), F.col("node").alias("b")))
        more = verified_across(families.join(nodes.select("node", "sketch"), "node").join(sets, "node"), similarity, shape)
        labels = components(alike.union(written(more, "similar-pairs-across")))
    labelled = nodes.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("first", F.coalesce("label", "node").alias("label"))
    keep = labelled.groupBy("label").agg(F.min("first").alias("first"))
    keep = written(keep.select(*[c.alias(k) for k, c in _keys(F.col("first.doc_id"), F.col("first.text_key")).items()]), "documents-kept")
    return keyed.join(keep, keys, "left_semi").dropDuplicates(keys).select(*[F.col("_row")[c].alias(c) for c in documents.columns])
