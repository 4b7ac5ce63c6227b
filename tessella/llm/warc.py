"""WARC archives with a two-level capture index.

Method: each task writes its pages as records (a gzip member each) into an archive of its own and reports where they
lie.  These captures are range-sorted by reversed-host URL key; each range is a shard of the index, written as
compressed blocks of lines, with a sparse directory of the blocks' first keys beside it.  A lookup bisects the shards'
first keys, then the directory of one shard, reads one block, and bisects its lines; the capture found is a range
read of its archive.

Records with equal payloads of at least ``LEAST_REVISIT`` bytes are one response (of the smallest page_id) and
revisits of it.  Digests are grouped before payloads move; only digests that repeat are joined back.

A task that is lost writes a new archive when it runs again; only what the written tables name counts.

Defined results
* null html: empty payload.  null url: empty key.  null page_id: no page's original unless all equal payloads have
  null, in which case all of them are responses.
* repeated rows: a record each; those with the original's page_id are responses.
* very long payloads: one record each, of which a task holds one at a time.  Empty table: no records, no rows.
* page_id: any whole number, a long in all results.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, join_hot, open_store, shared_folder, tasks, written

LEAST_REVISIT = 100
#: Lines of an index block.
BLOCK_LINES = 1000
GZIP = 31
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Reversed host, then what follows it: ``com,example,www)/path?query``."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    backward = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(rest == "", F.lit("")).otherwise(F.concat(backward, F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", "")))


# --- records ---------------------------------------------------------------------------------------------------


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    value = name[len("<urn:page:") : -1] if name else "none"
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, original: int | None) -> bytes:
    """One record, compressed as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {_name(original)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packed = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return packed.compress("\r\n".join(head).encode()) + packed.compress(block) + packed.compress(b"\r\n\r\n") + packed.flush()


def read_record(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page_id, payload bytes, payload digest, type, refers to, payload (None for a revisit); digests are verified."""
    text = zlib.decompress(raw, GZIP)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    page_id = _page(fields["WARC-Record-ID"])
    return page_id, size, digest, kind, _page(fields.get("WARC-Refers-To")), payload if kind == "response" else None


# --- writing ---------------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """key, page_id, file, offset, length: where each page's record lies."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    html = pages["html"]
    rows = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"), url_key(pages["url"]).alias("key"))
    digests = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")).filter(F.col("n") >= LEAST_REVISIT)
    repeated = digests.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = join_hot(rows, written(repeated, "warc-originals"), "digest", [F.col("page_id"), F.col("url")])
    schema = T._parse_datatype_string("key string, page_id long, file string, offset long, length int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                column = {c: batch.column(c) for c in batch.schema.names}
                offsets, lengths = [], []
                for i in range(batch.num_rows):
                    page_id, original = column["page_id"][i].as_py(), column["original"][i].as_py()
                    payload = column["html"][i].as_buffer().to_pybytes() if column["html"][i].is_valid else b""
                    revisit = original is not None and original != page_id
                    raw = record(page_id, column["url"][i].as_py(), payload, column["digest"][i].as_py(), revisit, original)
                    out.write(raw)
                    offsets.append(offset)
                    lengths.append(len(raw))
                    offset += len(raw)
                yield pa.RecordBatch.from_arrays(
                    [column["key"], column["page_id"], pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int32())],
                    names=schema.names,
                )
        finally:
            if out is not None:
                out.close()

    return written(joined.select("page_id", "url", "html", "digest", "key", "original").mapInArrow(run, schema), "warc-captures")


def _order(key: str, page_id: int | None) -> tuple:
    return key.encode(), page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str) -> list[tuple[tuple, str]]:
    """Writes the shards; first key and name of each, in order.  This list has one entry per task of the range sort."""
    by = [F.col("key"), F.col("page_id").asc_nulls_first()]
    ranged = captures.repartitionByRange(*by).sortWithinPartitions(*by, "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"shard-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        directory, lines, offset, out, first = [], [], 0, None, None

        def close() -> None:
            nonlocal offset
            raw = zlib.compress("\n".join(x[1] for x in lines).encode(), LEVEL, GZIP)
            out.write(raw)
            directory.append(f"{lines[0][0]}\t{offset}\t{len(raw)}")
            offset += len(raw)
            lines.clear()

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    # No tab or line end may stand in a key.
                    head = f"{_quoted(row['key'])}\t{'' if row['page_id'] is None else row['page_id']}"
                    if out is None:
                        out, first = store.open_output_stream(f"{base}/{name}.cdx.gz", compression=None), (row["key"], row["page_id"])
                    lines.append((head, f"{head}\t{row['file']}\t{row['offset']}\t{row['length']}"))
                    if len(lines) == BLOCK_LINES:
                        close()
            if lines:
                close()
        finally:
            if out is not None:
                out.close()
        if out is not None:
            with store.open_output_stream(f"{base}/{name}.dir") as file:
                file.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.string()), pa.array([first[1]], pa.int64()), pa.array([name])], names=["key", "page_id", "shard"])

    shards = written(ranged.mapInArrow(run, "key string, page_id long, shard string"), "warc-shards")
    return sorted((_order(s["key"], s["page_id"]), s["shard"]) for s in shards.collect())


def _quoted(key: str) -> str:
    return key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A") if any(c in key for c in "%\t\n") else key


def _unquoted(key: str) -> str:
    return key.replace("%0A", "\n").replace("%09", "\t").replace("%25", "%")


# --- reading ---------------------------------------------------------------------------------------------------


class Index:
    """Lookups in the two-level index.  Holds one shard's directory and a few blocks."""

    def __init__(self, folder: str, shards: list[tuple[tuple, str]]):
        self.store, self.base = open_store(folder)
        self.first = [s[0] for s in shards]
        self.names = [s[1] for s in shards]
        self.directory = lru_cache(maxsize=4)(self._directory)
        self.block = lru_cache(maxsize=8)(self._block)

    def _directory(self, shard: int) -> tuple[list[tuple], list[tuple[int, int]]]:
        with self.store.open_input_stream(f"{self.base}/{self.names[shard]}.dir") as file:
            lines = [x.split("\t") for x in file.read().decode().split("\n")]
        return [_line_key(x) for x in lines], [(int(x[2]), int(x[3])) for x in lines]

    def _block(self, shard: int, block: int) -> tuple[list[tuple], list[tuple[str, int, int]]]:
        offset, length = self.directory(shard)[1][block]
        with self.store.open_input_file(f"{self.base}/{self.names[shard]}.cdx.gz") as file:
            lines = [x.split("\t") for x in zlib.decompress(file.read_at(length, offset), GZIP).decode().split("\n")]
        return [_line_key(x) for x in lines], [(x[2], int(x[3]), int(x[4])) for x in lines]

    def find(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """file, offset, length of each capture of the key and page."""
        wanted = _order(key, page_id)
        # The first place that can hold the key is before the first shard or block that starts with it or above.
        shard = max(0, bisect.bisect_left(self.first, wanted) - 1)
        while shard < len(self.names) and self.first[shard] <= wanted:
            first = self.directory(shard)[0]
            block = max(0, bisect.bisect_left(first, wanted) - 1)
            while block < len(first) and first[block] <= wanted:
                keys, places = self.block(shard, block)
                at = bisect.bisect_left(keys, wanted)
                while at < len(keys) and keys[at] == wanted:
                    yield places[at]
                    at += 1
                block += 1
            shard += 1


def _line_key(line: list[str]) -> tuple:
    return _order(_unquoted(line[0]), int(line[1]) if line[1] else None)


def look_up(requests: DataFrame, folder: str, shards: list[tuple[tuple, str]]) -> DataFrame:
    """file, offset, length of the captures of the requested (key, page_id); requests are distinct.

    Requests are range-sorted like the index, so a task reads each block about once.
    """
    by = [F.col("key"), F.col("page_id").asc_nulls_first()]
    ranged = requests.select("key", "page_id").distinct().repartitionByRange(tasks(requests), *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, shards)
        for batch in batches:
            found = [x for r in batch.to_pylist() for x in index.find(r["key"], r["page_id"])]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()))], names=["file", "offset", "length"])

    return ranged.mapInArrow(run, "file string, offset long, length int")


def fetch(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records at (file, offset, length), by range reads in order of their place.

    Stretches of an archive go to tasks whole, so neighbours are read one after the other.
    """
    fields = T._parse_datatype_string("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long").fields
    schema = T.StructType(fields + [T.StructField("payload", T.BinaryType())] * payloads)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(schema)]
    dealt = captures.repartition(tasks(captures), "file", F.floor(F.col("offset") / 16_000_000)).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    if file:
                        file.close()
                    name, file = row["file"], store.open_input_file(f"{base}/{row['file']}")
                rows.append(read_record(file.read_at(row["length"], row["offset"]))[: len(kinds)])
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)
        if file:
            file.close()

    return dealt.mapInArrow(run, schema)


def report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives every page, indexes the captures, looks every page up and reads its record back."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    shards = write_index(write_archives(pages, folder), folder)
    requests = pages.select(url_key(pages["url"]).alias("key"), pages["page_id"].cast("long").alias("page_id"))
    return fetch(look_up(requests, folder, shards), folder)
