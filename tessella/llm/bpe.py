"""Byte-level BPE encoding and decoding.

Method: a segment tree over the byte positions of a piece stores, per node, the least (pair rank, position); its root
is the leftmost pair of minimum rank.  Each merge takes the root, unlinks the right token from the list of live
positions, and updates the tree at the merged position, at the dead one and at the live neighbour on the left: a
logarithmic number of nodes each.  Short pieces are merged many at a time, one tree per row of an array; longer ones
alone.  Pieces recur, so their ids are remembered in a table of bounded size.

Spark deals the documents; a document never leaves its task, and nothing is shuffled.

Defined results
* null text: the empty text, no ids.  null doc_id, repeated rows: each row gets its own result.
* very long pieces take n log n steps.  Empty table: no rows.
* extra columns of the input are carried along by ``encode`` (input columns named ids or n_tokens are replaced).
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: Pieces of up to so many bytes are merged many at a time.
SHORT = 64
#: Bytes of a generation of remembered pieces in a worker, and those of an entry besides its characters and ids.
REMEMBERED, OVERHEAD = 24_000_000, 180
#: Characters above which a piece isn't remembered, and of texts that are encoded together.
LONG, TOGETHER = 256, 2_000_000
NONE = np.int64(1) << 62


class Vocabulary:
    """Ranks of tokens, and the rank of every pair of tokens that merges into a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # Rust's \s is the White_Space property; Python's has four characters more.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        get = ranks.get
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = get(token[:k]), get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        keys = np.fromiter(self.pairs.keys(), dtype=np.int64, count=len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], NONE)
        self.pair_ranks = np.append(np.fromiter(self.pairs.values(), dtype=np.int64, count=len(self.pairs))[order], NONE)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where it doesn't merge."""
        key = left * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as file:
        lines = (line.split() for line in file)
        return Vocabulary({base64.b64decode(x[0]): int(x[1]) for x in lines if x}, pattern)


def merge_many(vocabulary: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Ids (as little-endian unsigned 32-bit integers) of pieces of 2 to ``SHORT`` bytes."""
    out: list[bytes] = [b""] * len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    width = 2
    while width <= SHORT:
        chosen = np.flatnonzero((lengths <= width) & (lengths > width // 2) if width > 2 else lengths <= 2)
        for at in range(0, len(chosen), 20_000):
            some = chosen[at : at + 20_000]
            _merge_rows(vocabulary, [pieces[i] for i in some], lengths[some], width, some, out)
        width *= 2
    return out


def _merge_rows(vocabulary: Vocabulary, pieces: list[bytes], lengths: np.ndarray, width: int, at: np.ndarray, out: list[bytes]) -> None:
    n = len(pieces)
    place = np.arange(width)
    filled = place < lengths[:, None]
    raw = np.zeros((n, width), dtype=np.uint8)
    raw[filled] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ids = np.where(filled, vocabulary.of_byte[raw], -1)
    after = np.where(place + 1 < lengths[:, None], place + 1, width)
    before = np.tile(place - 1, (n, 1))
    tree = np.full((n, 2 * width), NONE)
    rank = vocabulary.rank_of(ids[:, :-1], ids[:, 1:])
    has = place[1:] < lengths[:, None]
    tree[:, width:-1] = np.where(has & (rank < NONE), rank * width + place[:-1], NONE)
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

    def put(rows: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
        node = position + width
        tree[rows, node] = value
        node = node >> 1
        while node[0]:  # all paths have the same length
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    rows = np.arange(n)
    while True:
        root = tree[rows, 1]
        rows = rows[root < NONE]
        if not len(rows):
            break
        root = root[root < NONE]
        here = root % width
        right = after[rows, here]
        then = after[rows, right]
        merged = root // width
        ids[rows, here] = merged
        ids[rows, right] = -1
        after[rows, here] = then
        put(rows, right, np.full(len(rows), NONE))
        more = then < width
        r, h, t = rows[more], here[more], then[more]
        before[r, t] = h
        rank = np.full(len(rows), NONE)
        rank[more] = vocabulary.rank_of(merged[more], ids[r, t])
        put(rows, here, np.where(rank < NONE, rank * width + here, NONE))
        more = before[rows, here] >= 0
        if more.any():
            r, b = rows[more], before[rows, here][more]
            rank = vocabulary.rank_of(ids[r, b], merged[more])
            put(r, b, np.where(rank < NONE, rank * width + b, NONE))
    live = ids >= 0
    ends = np.cumsum(live.sum(axis=1)) * 4
    blob = ids[live].astype("<u4").tobytes()
    start = 0
    for i, end in zip(at.tolist(), ends.tolist()):
        out[i] = blob[start:end]
        start = end


def merge_one(vocabulary: Vocabulary, piece: bytes) -> bytes:
    """The same for one piece of any length."""
    n = len(piece)
    size, pairs, none = vocabulary.size, vocabulary.pairs, int(NONE)
    ids = vocabulary.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
    width = 1 << max(1, (n - 1).bit_length())
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = pairs.get(ids[i] * size + ids[i + 1])
        if rank is not None:
            tree[width + i] = rank * width + i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(position: int, value: int) -> None:
        node = position + width
        tree[node] = value
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

    while tree[1] < none:
        merged, here = divmod(tree[1], width)
        right = after[here]
        then = after[here] = after[right]
        ids[here], ids[right] = merged, -1
        put(right, none)
        rank = None
        if then < n:
            before[then] = here
            rank = pairs.get(merged * size + ids[then])
        put(here, none if rank is None else rank * width + here)
        if (b := before[here]) >= 0:
            rank = pairs.get(ids[b] * size + merged)
            put(b, none if rank is None else rank * width + b)
    return array("I", [i for i in ids if i >= 0]).tobytes()


class Encoder:
    """Encodes texts with a vocabulary; remembers pieces.

    What is remembered is bounded by bytes: two generations of ``REMEMBERED`` each, the older of which goes when the
    newer is full.  Pieces longer than ``LONG`` characters aren't remembered.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _merged(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't known."""
        out, short, ranks = {}, [], self.vocabulary.ranks
        for piece in pieces:
            raw = piece.encode()
            if (whole := ranks.get(raw)) is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short.append((piece, raw))
            else:
                out[piece] = merge_one(self.vocabulary, raw)
        if short:
            out.update(zip([p for p, _ in short], merge_many(self.vocabulary, [r for _, r in short])))
        return out

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Has ``known`` hold the new pieces; returns those that are too long for that."""
        again = new & self.old.keys()
        found = {p: self.old[p] for p in again} | self._merged(new - again)
        long = {p: found.pop(p) for p in new if len(p) > LONG}
        held = sum(OVERHEAD + 2 * len(p) + len(i) for p, i in found.items())
        if self.held + held > REMEMBERED:
            self.old, self.known, self.held = self.known, {}, 0
        self.held += held
        self.known.update(found)
        return long

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers.  Texts are taken a few million characters at
        a time, a longer one in stretches."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) < TOGETHER):
                chars += len(texts[end])
                end += 1
            if chars > TOGETHER:
                yield b"".join(self._stretches(texts[at]))
            else:
                yield from self._encoded([self.vocabulary.pieces.findall(t) for t in texts[at:end]])
            at = end

    def _encoded(self, pieces: list[list[str]]) -> list[bytes]:
        every = set().union(*pieces)
        before = self.known
        long = self._learn(every - before.keys())
        if self.known is before and not long:
            get = self.known.__getitem__
            return [b"".join(map(get, p)) for p in pieces]
        # What was known may be the older generation by now.
        here = {p: before[p] for p in every if p in before} | {p: self.known[p] for p in every if p in self.known} | long
        return [b"".join(map(here.__getitem__, p)) for p in pieces]

    def _stretches(self, text: str) -> Iterator[bytes]:
        some = []
        for m in self.vocabulary.pieces.finditer(text):
            some.append(m[0])
            if len(some) == TOGETHER // 8:
                yield from self._encoded([some])
                some = []
        yield from self._encoded([some])


def decode(vocabulary: Vocabulary, ids: bytes) -> bytes:
    """The bytes of ids given as little-endian unsigned 32-bit integers."""
    return b"".join(map(vocabulary.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this worker; it outlives a task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load(path, pattern))
    return _ENCODERS[path, pattern]


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``documents`` with n_tokens, ids (array<int>), and the SHA-256 of the ids and of what they decode to."""
    added = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType(), False)), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    columns = [c for c in documents.columns if c not in dict(added)]
    schema = T.StructType([*documents.select(columns).schema.fields, *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = list(own.encode(texts))
                ids = np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int32)
                ends = np.cumsum([0, *[len(r) // 4 for r in rows]]).astype(np.int32)
                decoded = [hashlib.sha256(decode(own.vocabulary, r)).hexdigest() for r in rows]
                new = [
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                    pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()),
                    pa.array(decoded, pa.string()),
                ]
                kept = [part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=schema.names)

    return documents.select(columns).mapInArrow(run, schema)


def report(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: n_tokens and the digests of its ids and of what they decode to.

    The ids are dropped in the worker, as only their digests are asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = [(len(r) // 4, hashlib.sha256(r).hexdigest(), hashlib.sha256(decode(own.vocabulary, r)).hexdigest()) for r in own.encode(texts)]
                n, ids, decoded = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = T.StructType([documents.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return documents.select("doc_id", "text").mapInArrow(run, schema)
