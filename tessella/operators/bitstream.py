"""Framing of coded images: a header and the records of the tiles.

Records are packed with column functions, a tile at a time; only the concatenation of an image's records is per image.
Parsing walks a blob in a task and gives a row per record.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the formats: the magic bytes, version and layouts.
MAGIC = b"PC15"
VERSION = 15
RECORD = struct.Struct("<IHHIHBI")
OLD_HEADER = struct.Struct("<4sHHIIHHBBHI")
OLD_RECORD = struct.Struct("<IHHIHHI")
OLD_FOOTER = struct.Struct("<III")
CODED, RAW = 0, 1


class FormatError(ValueError):
    """A blob that isn't what it should be."""


class Record(NamedTuple):
    tile_id: int
    gen_id: int
    qv_id: int
    seed: int
    rec_flags: int = 0
    payload_fmt: int = CODED
    payload: bytes = b""


def _need(condition: bool, what: str) -> None:
    if not condition:
        raise FormatError(what)


# --- column form --------------------------------------------------------------------------------------------------


def little(value: Column, width: int) -> Column:
    """An unsigned number as ``width`` bytes, the low one first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (width - k) - 1, 2) for k in range(width)]))


def big(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def packed_record(tile_id: Column, gen_id: Column, qv_id: Column, seed: Column, rec_flags: Column, payload_fmt: Column, payload: Column) -> Column:
    """A record with its checksum."""
    fields = zip((tile_id, gen_id, qv_id, seed, rec_flags, payload_fmt, F.octet_length(payload)), (4, 2, 2, 4, 2, 1, 4))
    body = F.concat(*[little(c, n) for c, n in fields], payload)
    return F.concat(body, little(F.crc32(body), 4))


def packed_header(body: Column) -> Column:
    """The header around JSON text."""
    raw = F.concat(F.lit(MAGIC), big(F.lit(VERSION), 2), big(F.octet_length(body), 4), body.cast("binary"))
    return F.concat(raw, big(F.crc32(raw), 4))


def pack_images(records: DataFrame, headers: DataFrame) -> DataFrame:
    """img, blob: from records (img and the fields) and headers (img, header as JSON text)."""
    fields = [F.col(f) for f in Record._fields]
    rows = records.select("img", "tile_id", packed_record(*fields).alias("raw"))
    ordered = F.array_sort(F.collect_list(F.struct("tile_id", F.hex("raw").alias("raw"))))
    body = rows.groupBy("img").agg(ordered.alias("r"))
    joined = F.unhex(F.array_join(F.transform("r", lambda x: x["raw"]), ""))
    return body.join(headers, "img").select("img", F.concat(packed_header(F.col("header")), little(F.size("r"), 4), joined).alias("blob"))


def is_stream(content: Column) -> Column:
    """Whether a file's bytes can be one of ours."""
    return (F.substring(content, 1, 4) == F.lit(MAGIC)) & (F.octet_length(content) > 8)


# --- one blob -----------------------------------------------------------------------------------------------------


def pack_header(header: dict) -> bytes:
    body = json.dumps(header, separators=(",", ":"), ensure_ascii=False).encode()
    raw = MAGIC + struct.pack(">HI", VERSION, len(body)) + body
    return raw + struct.pack(">I", zlib.crc32(raw))


def header_size(blob: bytes) -> int:
    _need(len(blob) >= 10 and blob[:4] == MAGIC, "no header")
    version, n = struct.unpack_from(">HI", blob, 4)
    _need(version == VERSION, "another version")
    _need(len(blob) >= 14 + n, "the header is cut off")
    return 14 + n


def unpack_header(blob: bytes) -> dict:
    end = header_size(blob)
    _need(zlib.crc32(blob[: end - 4]) == struct.unpack_from(">I", blob, end - 4)[0], "the header's checksum is wrong")
    return json.loads(blob[10 : end - 4])


def pack_records(records: list[Record]) -> bytes:
    out = [struct.pack("<I", len(records))]
    for r in records:
        body = RECORD.pack(*r[:6], len(r.payload)) + r.payload
        out += [body, struct.pack("<I", zlib.crc32(body))]
    return b"".join(out)


def unpack_records(raw: bytes) -> Iterator[Record]:
    _need(len(raw) >= 4, "no records")
    (count,), at = struct.unpack_from("<I", raw), 4
    for _ in range(count):
        _need(at + RECORD.size <= len(raw), "a record is cut off")
        *fields, n = RECORD.unpack_from(raw, at)
        end = at + RECORD.size + n
        _need(end + 4 <= len(raw), "a payload is cut off")
        _need(zlib.crc32(raw[at:end]) == struct.unpack_from("<I", raw, end)[0], "a record's checksum is wrong")
        yield Record(*fields, bytes(raw[at + RECORD.size : end]))
        at = end + 4
    _need(at == len(raw), "bytes are left over")


def unpack_stream(blob: bytes) -> tuple[dict, list[Record]]:
    header = unpack_header(blob)
    return header, list(unpack_records(blob[header_size(blob) :]))


# --- the older format ---------------------------------------------------------------------------------------------


def _filled(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 4)


def pack_old(width: int, height: int, tile: int, overlap: int, records: list[Record], colorspace: int = 0, flags: int = 0, meta: dict | None = None) -> bytes:
    """Fixed header, JSON, records filled up to four bytes, and a footer with the checksum of it all."""
    text = json.dumps(meta or {}, ensure_ascii=False, separators=(",", ":")).encode()
    length = OLD_HEADER.size + len(_filled(text)) + 4
    head = OLD_HEADER.pack(MAGIC, VERSION, length, width, height, tile, overlap, colorspace, flags & 0xFF | 2, 0, len(text)) + _filled(text)
    body = head + struct.pack("<I", zlib.crc32(head)) + b"".join(OLD_RECORD.pack(*r[:6], len(r.payload)) + _filled(r.payload) for r in records)
    return body + OLD_FOOTER.pack(len(records), 0, zlib.crc32(body))


def unpack_old(blob: bytes) -> tuple[dict, list[Record]]:
    _need(len(blob) >= OLD_HEADER.size + 4 + OLD_FOOTER.size, "too short")
    count, _, checksum = OLD_FOOTER.unpack_from(blob, len(blob) - OLD_FOOTER.size)
    body = blob[: -OLD_FOOTER.size]
    _need(zlib.crc32(body) == checksum, "the checksum is wrong")
    _need(len(body) >= OLD_HEADER.size and body[:4] == MAGIC, "no header")
    _, version, length, width, height, tile, overlap, colorspace, flags, _, n = OLD_HEADER.unpack_from(body)
    _need(version == VERSION, "another version")
    text = body[OLD_HEADER.size : OLD_HEADER.size + n]
    at = OLD_HEADER.size + len(_filled(text))
    _need(len(text) == n and at + 4 == length <= len(body), "the header's length is wrong")
    _need(zlib.crc32(body[:at]) == struct.unpack_from("<I", body, at)[0], "the header's checksum is wrong")
    records, at = [], length
    while at < len(body):
        _need(at + OLD_RECORD.size <= len(body), "a record is cut off")
        *fields, n = OLD_RECORD.unpack_from(body, at)
        at += OLD_RECORD.size
        _need(at + n <= len(body), "a payload is cut off")
        records.append(Record(*fields, body[at : at + n]))
        at += n + -n % 4
    _need(len(records) == count, "the number of records is wrong")
    header = {"width": width, "height": height, "tile": tile, "overlap": overlap, "colorspace": colorspace, "flags": flags, "meta": json.loads(text) or None}
    return header, records


# --- tables of blobs ----------------------------------------------------------------------------------------------

RECORD_FIELDS = "width int, height int, tile int, overlap int, tile_id long, gen_id int, qv_id int, seed long, rec_flags int, payload_fmt int, payload binary, error string"


def rows_of_blob(blob: bytes | None, old: bool = False) -> list[tuple]:
    """Rows of ``RECORD_FIELDS``: a record each; for a bad blob one with its error."""
    try:
        _need(blob is not None, "no blob")
        header, records = (unpack_old if old else unpack_stream)(blob)
    except (FormatError, ValueError, struct.error) as error:
        return [(None,) * 11 + (str(error),)]
    sizes = tuple(header.get(k) for k in ("width", "height", "tile", "overlap"))
    return [(*sizes, *r, None) for r in records] or [(*sizes, *(None,) * 8)]


def parse_images(blobs: DataFrame, key: str = "img", column: str = "blob", old: bool = False) -> DataFrame:
    """key, header fields and a record: a row per record; for a bad blob one row with its error."""
    added = T._parse_datatype_string(RECORD_FIELDS).fields
    schema = T.StructType([blobs.schema[key], *added])
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in enumerate(batch.column(column).to_pylist()):
                rows = rows_of_blob(blob, old)
                keys = batch.column(key).take(pa.array([i] * len(rows)))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=schema.names)

    return blobs.select(key, column).mapInArrow(run, schema)
