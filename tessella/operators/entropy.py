"""Entropy coding: byte histograms, frequency tables, rate estimates, and a range coder of the ANS family.

Counting is done per batch in the tasks and summed by Spark; a table has 256 rows.  Coding is sequential within a
payload and parallel across payloads.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the coder and its framing.
SYMBOLS = 256
FIRST_STATE = 1 << 16
MAGIC = b"ANS0"
#: The first symbol of a packed tile.
TAG = 0xF0


@dataclass(frozen=True)
class Table:
    precision: int
    freqs: tuple[int, ...]

    @property
    def cdf(self) -> list[int]:
        out = [0]
        for f in self.freqs:
            out.append(out[-1] + f)
        return out


UNIFORM = Table(8, (1,) * SYMBOLS)


def byte_counts(rows: DataFrame, column: str = "text") -> DataFrame:
    """sym, n: how often each byte occurs in the UTF-8 of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    total += np.bincount(np.frombuffer(value.as_buffer(), dtype=np.uint8), minlength=SYMBOLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["sym", "n"])

    return rows.select(column).mapInArrow(run, "sym int, n long").groupBy("sym").agg(F.sum("n").alias("n"))


def floor_shares(counts: DataFrame, precision: int = 12) -> DataFrame:
    """sym, n, share: a present symbol's part of 2 ** precision, cut off, 1 at least."""
    total = Window.partitionBy()
    share = F.greatest(F.floor(F.col("n") * (1 << precision) / F.sum("n").over(total)), F.lit(1))
    return counts.select("sym", "n", share.cast("long").alias("share"))


def cumulative(shares: DataFrame) -> DataFrame:
    """sym, share, below: the running sum before each symbol (a table of at most 256 rows)."""
    before = Window.orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return shares.select("sym", "share", F.coalesce(F.sum("share").over(before), F.lit(0)).cast("long").alias("below"))


def normalised(counts: list[int], precision: int) -> Table:
    """Frequencies that sum to 2 ** precision, 1 at least for a present symbol.

    Shares are cut off; what is over is taken from the smallest remainders (of equals the rarer), then from the
    largest frequencies; what is missing goes to the largest remainders (of equals the commoner), then to the
    commonest; symbol 0 takes what is left.
    """
    base, total = 1 << precision, sum(counts)
    if total <= 0:
        return Table(precision, (base,) + (0,) * (SYMBOLS - 1))
    exact = {s: n * base / total for s, n in enumerate(counts) if n > 0}
    if len(exact) > base:
        raise ValueError("more symbols than the precision can tell apart")
    freq = [max(1, int(exact[s])) if s in exact else 0 for s in range(SYMBOLS)]
    over = sum(freq) - base

    def spend(order: list[int], change: int, amount: int) -> int:
        for s in order:
            if amount <= 0:
                break
            if change > 0 or freq[s] > 1:
                freq[s] += change
                amount -= 1
        return amount

    rest = {s: exact[s] - freq[s] for s in exact}
    if over > 0:
        over = spend(sorted(rest, key=lambda s: (rest[s], counts[s])), -1, over)
        while over > 0:  # one pass of the format's rule is often enough; a table with a negative entry helps nobody
            over = spend(sorted(range(SYMBOLS), key=lambda s: -freq[s]), -1, over)
    elif over < 0:
        missing = spend(sorted(rest, key=lambda s: (-rest[s], -counts[s])), 1, -over)
        spend(sorted(range(SYMBOLS), key=lambda s: -counts[s]), 1, missing)
    freq[0] += base - sum(freq)
    return Table(precision, tuple(freq))


def build_table(counts: DataFrame, precision: int = 12) -> Table:
    """The table of a histogram (sym, n), whose at most 256 rows come to the driver."""
    if not 1 <= precision <= 15:
        raise ValueError("precision is 1 to 15")
    found = {r["sym"]: r["n"] for r in counts.collect()}
    return normalised([found.get(s, 0) for s in range(SYMBOLS)], precision)


def build_tables(rows: DataFrame, table_id: str, column: str = "text", precision: int = 12) -> dict[str, Table]:
    """A table for each id of the column ``table_id``, from the bytes of its rows: at most 256 rows an id come to the driver.
    A null id has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name is not None and value.is_valid:
                    counts = np.bincount(np.frombuffer(value.as_buffer(), dtype=np.uint8), minlength=SYMBOLS)
                    total[name] = total[name] + counts if name in total else counts
        for name, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["id", "sym", "n"])

    counted = rows.select(F.col(table_id).cast("string"), column).mapInArrow(run, "id string, sym int, n long").groupBy("id", "sym").agg(F.sum("n").alias("n"))
    found: dict[str, list[int]] = {}
    for r in counted.toLocalIterator():
        found.setdefault(r["id"], [0] * SYMBOLS)[r["sym"]] = r["n"]
    return {name: normalised(counts, precision) for name, counts in sorted(found.items())}


def precision_for(total: int, present: int) -> int:
    return min(15, max(1, math.ceil(math.log2(max(total, present, 1)))))


def table_from(spec: dict) -> Table:
    """A table from a parsed description: freqs with precision, the uniform kind, or counts."""
    if "freqs" in spec and "precision" in spec:
        return Table(int(spec["precision"]), tuple(int(f) for f in spec["freqs"]))
    if spec.get("kind") == "byte_256_uniform":
        return UNIFORM
    counts = [int(c) for c in (spec.get("counts") or spec.get("hist") or [])][:SYMBOLS]
    counts += [0] * (SYMBOLS - len(counts))
    precision = spec.get("precision_bits") or spec.get("precision") or precision_for(sum(counts), sum(c > 0 for c in counts))
    return normalised(counts, int(precision))


#: The environment's folders of tables, in the order in which they are asked: own tables, then those of models.
TABLE_FOLDERS = (("TESSELLA_RANS_TABLES", ""), ("TESSELLA_MODELS_DIR", "/rans"))
#: Tables that come with the package, by id.
OWN_TABLES = {"v15_default": {"kind": "byte_256_uniform"}}


def table_roots(environment: dict | None = None) -> list[str]:
    environment = os.environ if environment is None else environment
    return [environment[name].rstrip("/") + below for name, below in TABLE_FOLDERS if environment.get(name)]


def table_specs(spark: SparkSession, roots: list[str]) -> DataFrame:
    """rank, id, spec: the JSON files of the folders (missing ones are passed over) and the own tables, a row each."""
    own = spark.createDataFrame([(len(roots), name, json.dumps(spec)) for name, spec in OWN_TABLES.items()], "rank int, id string, spec string")
    for rank, root in enumerate(roots):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(root)
            name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
            own = own.union(files.select(F.lit(rank), name, F.col("value")))
    return own


def available_tables(spark: SparkSession, roots: list[str] | None = None) -> DataFrame:
    """id, rank: every table once, with the first root that has it; by id."""
    roots = table_roots() if roots is None else roots
    return table_specs(spark, roots).groupBy("id").agg(F.min("rank").alias("rank")).orderBy("id")


def load_tables(spark: SparkSession, ids: list[str], roots: list[str] | None = None) -> dict[str, Table]:
    """The tables of these ids, each from the first root that has it; a table is a row of at most 256 numbers."""
    roots = table_roots() if roots is None else roots
    first = table_specs(spark, roots).filter(F.col("id").isin(ids)).groupBy("id").agg(F.min_by("spec", "rank").alias("spec"))
    found = {r["id"]: table_from(json.loads(r["spec"])) for r in first.collect()}
    if missing := [i for i in ids if i not in found]:
        raise FileNotFoundError(f"no table {missing} below {roots} or in the package")
    return found


def bits_of(symbols: Column, counts: Column, total: Column) -> Column:
    """Sum of -log2(count / total) over an array of symbols; a missing count is taken as 1."""
    return F.aggregate(symbols, F.lit(0.0), lambda bits, s: bits - F.log2(F.greatest(F.get(counts, s), F.lit(1)) / total))


def symbol_bits(table: Table) -> np.ndarray:
    """-log2 of each symbol's share; a missing one is taken as 1."""
    return -np.log2(np.maximum(np.array(table.freqs, dtype=float), 1) / (1 << table.precision))


def estimated_bits(rows: DataFrame, table: Table, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, bits: the rate of each row's bytes under a table, from the row's histogram."""
    cost = symbol_bits(table)
    schema = T.StructType([rows.schema[key], T.StructField("bits", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.bincount(np.frombuffer(v.as_buffer(), dtype=np.uint8), minlength=SYMBOLS) @ cost if v.is_valid else 0.0 for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=schema.names)

    return rows.select(key, column).mapInArrow(run, schema)


# --- symbols of a tile --------------------------------------------------------------------------------------------


def pack_symbols(gen_id: Column, qv_id: Column, seed: Column, flags: Column, steps: Column) -> Column:
    """The symbols of a tile as array<int>: tag, ids, flags, seed, number of steps, steps + 128."""
    byte = lambda c, k: F.shiftright(c.cast("long"), 8 * k).bitwiseAND(F.lit(255)).cast("int")
    head = [F.lit(TAG), byte(gen_id, 0), byte(gen_id, 1), byte(qv_id, 0), byte(qv_id, 1), byte(flags, 0), *[byte(seed, k) for k in range(4)], F.size(steps)]
    fits = (F.size(steps) <= 255) & gen_id.between(0, 0xFFFF) & qv_id.between(0, 0xFFFF) & seed.between(0, 0xFFFFFFFF) & flags.between(0, 255) & F.forall(steps, lambda o: o.between(-128, 127))
    packed = F.concat(F.array(*head), F.transform(steps, lambda o: (o + 128).cast("int")))
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("a tile's fields are out of range")).cast("array<int>"))


def unpack_symbols(symbols: Column) -> Column:
    """gen_id, qv_id, flags, seed, steps; raises for another tag or missing steps."""
    at = lambda i: F.get(symbols, F.lit(i))
    number = lambda first, n: sum((at(first + k).cast("long") * (1 << 8 * k) for k in range(n)), F.lit(0))
    steps = F.transform(F.slice(symbols, 12, F.greatest(at(10), F.lit(0))), lambda s: s - 128)
    fields = F.struct(number(1, 2).alias("gen_id"), number(3, 2).alias("qv_id"), at(5).alias("flags"), number(6, 4).alias("seed"), steps.alias("steps"))
    good = (at(0) == TAG) & (F.size(symbols) >= 11 + at(10))
    bad = F.raise_error(F.lit("not the symbols of a tile"))
    return F.when(good, fields).otherwise(bad.cast("struct<gen_id:bigint,qv_id:bigint,flags:int,seed:bigint,steps:array<int>>"))


# --- the coder ----------------------------------------------------------------------------------------------------

#: Payloads that are coded side by side at least; the last longer ones go on alone.
SIDE_BY_SIDE = 24


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order from the longest on, and how many are longer than 0, 1, 2, ... until few are."""
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths[order[SIDE_BY_SIDE - 1]]) if len(lengths) >= SIDE_BY_SIDE else 0
    longer = np.cumsum(np.bincount(lengths, minlength=1)[::-1])[::-1]  # of n or more
    return order, longer[1 : least + 1]


def _stacked(table: Table | list[Table], which: np.ndarray | None, count: int) -> tuple[list[Table], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tables, which of them each of ``count`` payloads has, and their precisions, frequencies and sums as arrays."""
    tables = [table] if isinstance(table, Table) else table
    which = np.zeros(count, dtype=np.int64) if which is None else np.asarray(which, dtype=np.int64)
    return tables, which, np.array([t.precision for t in tables], dtype=np.int64), *(np.array([getattr(t, n) for t in tables], dtype=np.int64).reshape(len(tables), -1) for n in ("freqs", "cdf"))


def encode_many(payloads: list[bytes], table: Table | list[Table], which: np.ndarray | None = None) -> list[bytes]:
    """Streams of the payloads: number of symbols and final state, then what the state shed, 16 bits at a time.  Where
    there are several tables, ``which`` says the place of each payload's own.

    All payloads take a step at a time, from their ends on, so a step is a few array operations.  A state sheds at most
    once in a step, as it is below 2 ** 32 and a frequency is 1 at least.
    """
    tables, which, precisions, freqs, cdf = _stacked(table, which, len(payloads))
    lengths = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads))
    raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    absent = freqs == 0
    for payload, n in zip(payloads, which.tolist()):  # one at a time: an index of all symbols takes many times their bytes
        own = np.frombuffer(payload, dtype=np.uint8)
        if (bad := absent[n][own]).any():
            raise ValueError(f"symbol {own[bad.argmax()]} has no frequency")
    order, active = _by_length(lengths)
    last = (np.cumsum(lengths) - 1)[order]
    state = np.full(len(payloads), FIRST_STATE, dtype=np.int64)
    shed, n_shed = np.zeros(len(raw), dtype="<u2"), np.zeros(len(payloads), dtype=np.int64)
    first = (np.cumsum(lengths) - lengths)[order]
    lane, bits = which[order], precisions[which[order]]
    for step, n in enumerate(active.tolist()):
        s, own, precision = raw[last[:n] - step], lane[:n], bits[:n]
        f, x = freqs[own, s], state[:n]
        over = np.flatnonzero(x >= f << (32 - precision))
        shed[first[over] + n_shed[over]] = x[over] & 0xFFFF
        n_shed[over] += 1
        x[over] >>= 16
        whole, part = np.divmod(x, f)
        state[:n] = (whole << precision) + part + cdf[own, s]
    out: list[bytes] = [b""] * len(payloads)
    for i, at in enumerate(order.tolist()):
        x, own = int(state[i]), bytearray(shed[first[i] : first[i] + n_shed[i]].tobytes())
        table, sums, precision = tables[which[at]], cdf[which[at]], tables[which[at]].precision
        for s in payloads[at][: max(0, int(lengths[at]) - len(active))][::-1]:
            f = table.freqs[s]
            while x >= f << (32 - precision):
                own += (x & 0xFFFF).to_bytes(2, "little")
                x >>= 16
            whole, part = divmod(x, f)
            x = (whole << precision) + part + int(sums[s])
        out[at] = struct.pack("<II", int(lengths[at]), x) + bytes(own)
    return out


#: Symbols that a stream may stand for if they cost nothing, as one symbol has the whole table.
MOST_FREE = 1 << 28


def most_symbols(words: np.ndarray, table: Table) -> np.ndarray:
    """More symbols than so many words of a stream, and its state, can't stand for.

    A symbol of frequency f takes the state x to x - (2^p - f) (x >> p) or less, and x >> p is a part c of x / 2^p at
    least; so 16 bits last for 16 ln 2 / (c (1 - f / 2^p)) symbols at most, however frequent they are.
    """
    whole = 1 << table.precision
    most = max(table.freqs)
    if most >= whole:
        return np.full(len(words), MOST_FREE, dtype=np.int64)
    part = max(0.5, 1 - whole / FIRST_STATE)
    each = math.ceil(16 * math.log(2) / (part * (1 - most / whole))) + 1
    return (words + 2) * each


def decode_many(streams: list[bytes], table: Table | list[Table], which: np.ndarray | None = None) -> list[bytes | None]:
    """The payloads of streams; None for one that ends early, or whose count of symbols is more than it can hold.  Where
    there are several tables, ``which`` says the place of each stream's own."""
    tables, which, precisions, freqs, cdf = _stacked(table, which, len(streams))
    owner = np.zeros((len(tables), 1 << int(precisions.max(initial=1))), dtype=np.uint8)
    for n, f in enumerate(freqs):
        owner[n, : 1 << precisions[n]] = np.repeat(np.arange(SYMBOLS, dtype=np.uint8), f)
    sound = np.array([len(s) >= 8 and len(s) % 2 == 0 for s in streams], dtype=bool)
    heads = [struct.unpack_from("<II", s) if good else (0, 0) for s, good in zip(streams, sound)]
    counts = np.array([(len(s) - 8) // 2 if good else 0 for s, good in zip(streams, sound)], dtype=np.int64)
    lengths = np.array([h[0] for h in heads], dtype=np.int64)
    for n, own in enumerate(tables):
        mine = which == n
        sound[mine] &= lengths[mine] <= most_symbols(counts[mine], own)
    lengths[~sound] = 0
    state = np.array([h[1] for h in heads], dtype=np.int64)
    words = np.frombuffer(b"".join([s[8 : 8 + 2 * n] for s, n in zip(streams, counts.tolist())]), dtype="<u2")
    begin = np.cumsum(counts) - counts
    order, active = _by_length(lengths)
    state, left, base = state[order], counts[order].copy(), begin[order]
    ended = np.zeros(len(streams), dtype=bool)
    steps = len(active)
    side = np.minimum(lengths, steps)  # symbols that are decoded side by side, payload after payload
    out, place = np.zeros(int(side.sum()), dtype=np.uint8), (np.cumsum(side) - side)[order]
    lane, bits = which[order], precisions[which[order]]
    below = (1 << bits) - 1
    for step, n in enumerate(active.tolist()):
        x, own = state[:n], lane[:n]
        slot = x & below[:n]
        s = owner[own, slot]
        out[place[:n] + step] = s
        x = freqs[own, s] * (x >> bits[:n]) + slot - cdf[own, s]
        under = np.flatnonzero(x < FIRST_STATE)
        ended[under] |= left[under] <= 0
        under = under[left[under] > 0]
        left[under] -= 1
        x[under] = (x[under] << 16) | words[base[under] + left[under]]
        state[:n] = x
    result: list[bytes | None] = [None] * len(streams)
    for i, at in enumerate(order.tolist()):
        n = int(lengths[at])
        own = bytearray(out[place[i] : place[i] + side[at]].tobytes())
        x, k, bad = int(state[i]), int(left[i]), bool(ended[i]) or not sound[at]
        table, sums, owners, low = tables[which[at]], cdf[which[at]], owner[which[at]], int(below[i])
        while len(own) < n and not bad:
            slot = x & low
            s = int(owners[slot])
            own.append(s)
            x = table.freqs[s] * (x >> table.precision) + slot - int(sums[s])
            while x < FIRST_STATE and not bad:
                k -= 1
                bad = k < 0
                x = x << 16 | int(words[base[i] + k]) if not bad else x
        result[at] = None if bad else bytes(own)
    return result


def encode_bytes(symbols: bytes, table: Table) -> bytes:
    return encode_many([symbols], table)[0]


def decode_bytes(stream: bytes, table: Table) -> bytes:
    (out,) = decode_many([stream], table)
    if out is None:
        raise ValueError("the stream ends early")
    return out


def frame_stream(stream: bytes, table_id: str) -> bytes:
    name = table_id.encode("ascii")
    if len(name) > 255:
        raise ValueError("a table's id has at most 255 characters")
    return MAGIC + bytes([len(name)]) + name + stream


def unframe_stream(raw: bytes) -> tuple[str, bytes]:
    if raw[:4] != MAGIC or len(raw) < 5 or len(raw) < 5 + raw[4]:
        raise ValueError("not a coded stream")
    return raw[5 : 5 + raw[4]].decode("ascii"), raw[5 + raw[4] :]


#: Bytes of payloads that are coded together.
TOGETHER = 4_000_000


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in parts of so many bytes of the column, or a row each; nothing is copied."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, size = 0, 0
    for at, more in enumerate(sizes):
        if at > start and size + more > TOGETHER:
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += more
    if start < len(sizes):
        yield batch.slice(start)


def encode_column(rows: DataFrame, table: Table, table_id: str, column: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the framed stream of a binary column's bytes (null stays null)."""

    def many(values: list[bytes | None]) -> list[tuple]:
        coded = iter(encode_many([v for v in values if v is not None], table))
        return [(None,) if v is None else (frame_stream(next(coded), table_id),) for v in values]

    return _coded(rows, column, [(out, T.BinaryType())], many)


def encode_by_table(rows: DataFrame, tables: dict[str, Table], table_id: str, column: str, out: str, default: str | None = None) -> DataFrame:
    """``encode_column`` with a table for each row, side by side: the one whose id the column ``table_id`` names, or else
    ``default``; null for a row without a table, and for a null."""
    places = {name: n for n, name in enumerate(tables)}
    if default is not None and default not in places:
        raise ValueError(f"no table {default!r}")
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != out], T.StructField(out, T.BinaryType())])
    kept = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _parts(batch, column):
                part = some.column(column).to_pylist()
                names = [n if n in places else default for n in some.column(table_id).to_pylist()]
                ready = [i for i, (n, v) in enumerate(zip(names, part)) if n is not None and v is not None]
                made: list[bytes | None] = [None] * len(part)
                for i, stream in zip(ready, encode_many([part[i] for i in ready], list(tables.values()), np.array([places[names[i]] for i in ready]))):
                    made[i] = frame_stream(stream, names[i])
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.array(made, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode_column(rows: DataFrame, tables: dict[str, Table], column: str, out: str, error: str | None = None) -> DataFrame:
    """The inverse; ``tables`` by the ids that streams name.  A stream that can't be decoded gives its message in the column
    ``error``, or fails the job if there is none."""

    def many(values: list[bytes | None]) -> list[tuple]:
        found: list[tuple] = [(None, None)] * len(values)
        places, ready = {name: n for n, name in enumerate(tables)}, []
        for i, v in enumerate(values):
            if v is not None:
                try:
                    name, stream = unframe_stream(v)
                    ready.append((i, places[name], stream))
                except (ValueError, KeyError) as problem:
                    found[i] = (None, str(problem) if isinstance(problem, ValueError) else f"no table {problem}")
        if ready:  # all tables side by side
            for (i, _, _), raw in zip(ready, decode_many([r[2] for r in ready], list(tables.values()), np.array([r[1] for r in ready]))):
                found[i] = (raw, "the stream ends early" if raw is None else None)
        if error is None:
            if bad := next((m for _, m in found if m), None):
                raise ValueError(bad)
            return [f[:1] for f in found]
        return found

    return _coded(rows, column, [(out, T.BinaryType()), *([(error, T.StringType())] if error else [])], many)


def _coded(rows: DataFrame, column: str, added: list[tuple[str, T.DataType]], many) -> DataFrame:
    names = dict(added)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in names], *[T.StructField(n, t) for n, t in added]])
    kept = [f.name for f in schema.fields[: -len(added)]]
    kinds = [pa.binary() if t == T.BinaryType() else pa.string() for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _parts(batch, column):
                columns = list(zip(*many(some.column(column).to_pylist())))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names)

    return rows.mapInArrow(run, schema)
