"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Method: Spark ranges the documents by doc_id; each task encodes its rows in order and writes one file.  A record is
framed as: length (unsigned 64 bits, little-endian), masked checksum of the length, payload, masked checksum of the
payload.  Checksums are CRC-32C, masked by a rotation and a constant.  The payload is a header (doc_id, whether it is
null, bytes per id, number of ids) and the ids; ids take two bytes where the vocabulary has no more than 65,536.  An
index file beside each file has (offset, length) of every record as unsigned 64-bit integers.

A task that is lost writes a new file when it runs again; only the files in the manifest count.

Defined results
* null text: empty, one record with the end id alone.  null doc_id: before all others.
* order: doc_id, then a hash of the text, then the text, so reruns agree; repeated rows are records like others.
* empty table: an empty manifest, no rows.  Very long texts: one record each, encoded in stretches between spaces; a
  stretch without spaces is cut where a word ends.  What can't be cut is one word to the tokenizer and is encoded whole.
* extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import open_store, shared_folder, slices, tasks, written

_HEADER = struct.Struct("<q?BxxI")
#: Bytes of a generation of remembered pieces or chunks in a worker, and those of an entry besides its characters and ids.
REMEMBERED, OVERHEAD = 40_000_000, 150
#: Characters above which a piece isn't remembered, of the parts of a long chunk, and of a stretch of text between spaces.
LONG, PART, STRETCH = 256, 65_536, 250_000
BLANK = re.compile(r"[ \t\n\r]")

# --- CRC-32C ---------------------------------------------------------------------------------------------------

POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
#: Bytes of the pieces that are summed side by side.
PIECE = 1024


def _byte_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return crc


def _word_tables() -> list[np.ndarray]:
    """Table k: the effect of a byte that k bytes follow."""
    tables = [_byte_table()]
    for _ in range(7):
        last = tables[-1]
        tables.append(tables[0][last & np.uint32(255)] ^ (last >> np.uint32(8)))
    return tables


TABLES = _word_tables()


def _over_words(words: np.ndarray) -> np.ndarray:
    """Per row of 64-bit words the CRC that starts at 0 and isn't inverted at the end."""
    crc = np.zeros(len(words), dtype=np.uint64)
    for column in words.T:
        crc ^= column
        out = TABLES[7][crc & np.uint64(255)]
        for k in range(1, 8):
            out = out ^ TABLES[7 - k][(crc >> np.uint64(8 * k)) & np.uint64(255)]
        crc = out.astype(np.uint64)
    return crc


def _advance_tables() -> list[np.ndarray]:
    """By byte of a CRC: what it becomes after PIECE zero bytes."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(PIECE):
        basis = TABLES[0][basis & np.uint32(255)] ^ (basis >> np.uint32(8))
    out = []
    for k in range(4):
        table = np.zeros(256, dtype=np.uint32)
        for bit in range(8):
            table ^= np.where(np.arange(256) >> bit & 1, basis[8 * k + bit], np.uint32(0)).astype(np.uint32)
        out.append(table)
    return out


ADVANCE = _advance_tables()


def masked_crc32c(payloads: list[bytes]) -> list[int]:
    """The masked CRC-32C of each payload of 4 bytes or more.

    Zeros in front don't change a CRC that starts at 0, and starting at ones is the same as inverting the first four
    bytes.  So payloads are filled up in front to whole pieces, all pieces are summed at once, and joined in order.
    """
    if not payloads:
        return []
    lengths = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads))
    pieces = -(-lengths // PIECE)
    ends = np.cumsum(pieces) * PIECE
    raw = np.zeros(int(ends[-1]), dtype=np.uint8)
    for payload, start, end in zip(payloads, (ends - lengths).tolist(), ends.tolist()):
        raw[start:end] = np.frombuffer(payload, dtype=np.uint8)
        raw[start : start + 4] ^= 255
    each = _over_words(raw.view("<u8").reshape(-1, PIECE // 8)).astype(np.uint32)
    first = np.cumsum(pieces) - pieces
    crc = np.zeros(len(payloads), dtype=np.uint32)
    for k in range(int(pieces.max())):
        some = np.flatnonzero(pieces > k)
        old = crc[some]
        moved = ADVANCE[0][old & np.uint32(255)]
        for b in range(1, 4):
            moved = moved ^ ADVANCE[b][(old >> np.uint32(8 * b)) & np.uint32(255)]
        crc[some] = moved ^ each[first[some] + k]
    crc = ~crc
    rotated = (crc >> np.uint32(15)) | (crc << np.uint32(17))
    return (rotated + np.uint32(MASK_DELTA)).tolist()


# --- encoding --------------------------------------------------------------------------------------------------


#: Texts of these characters alone are taken apart here; what else stands between spaces by the tokenizer's own normaliser
#: and splitter.  They hold no control character or "<" (which begins special tokens), and Unicode composes none of them.
_OWN = "!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
PLAIN_TEXT, PLAIN = re.compile(rf"[ \t\n\r{_OWN}]*"), re.compile(f"[{_OWN}]+")
#: The tokenizer's split of lower-cased plain texts.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^ \t\n\ra-z\u00df-\u00f6\u00f8-\u017e0-9]+")
#: Where a long chunk may be cut: before a mark that follows a letter or a digit.  A word ends there and no character
#: composes across it; bars are left out, as special tokens hold them.
CUT = re.compile("(?<=[A-Za-z0-9\u4e00-\u9fff])(?=[!-/:-@\\[-`{}~\u3001\u3002\uff0c])")
#: The normaliser and the splitter that allow for this; texts are encoded whole with any other.
CHUNKED = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, other = {b: chr(b) for b in shown}, iter(range(256, 512))
    return [out[b] if b in out else chr(next(other)) for b in range(256)]


def _is_chunked(tokenizer) -> bool:
    """Whether the tokenizer drops white space and acts on what stands between spaces alone."""
    spec = json.loads(tokenizer.to_str())
    normalizer, split, model = spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}], spec["model"]
    return (
        normalizer.get("normalizers") == CHUNKED[0]
        and [x.get("type") for x in split] == ["Split", "ByteLevel"]
        and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == ({"Regex": CHUNKED[1]}, "Removed", True)
        and not split[1]["add_prefix_space"]
        and not split[1]["use_regex"]
        and model["type"] == "BPE"
        and not (model.get("dropout") or model.get("continuing_subword_prefix"))
        and all(re.fullmatch(r"<\|[a-z]+\|>", t["content"]) and not t["normalized"] for t in spec["added_tokens"])
    )


class Remembered(dict):
    """What ``make`` gives for a key, bounded by bytes: two generations, the older of which goes when the newer is full.
    Results of long keys aren't kept."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONG:
            return self.make(key)
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        self.held += OVERHEAD + len(key) + len(made)
        if self.held > REMEMBERED:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = made
        return made


class ChunkEncoder:
    """Encodes texts, remembering the ids of pieces.

    With a lower-casing tokenizer that drops white space, words and special tokens hold no white space, and the
    normaliser acts on either side of a space alone.  So a text's ids are those of its chunks between spaces, one after
    the other, and those of a plain text are those of its pieces.  Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = _is_chunked(self.tokenizer)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        self.model = self.tokenizer.model
        self.shown = _byte_characters()
        self.pieces, self.chunks = Remembered(self._piece), Remembered(self._chunk)

    def _piece(self, piece: str) -> bytes:
        word = piece if piece.isascii() else "".join([self.shown[b] for b in piece.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, SPLIT.findall(text.lower())))

    def _chunk(self, chunk: str) -> bytes:
        out, at = [], 0
        while at < len(chunk):
            cut = CUT.search(chunk, at + PART)
            end = cut.start() if cut else len(chunk)
            part, at = chunk[at:end], end
            out.append(self._plain(part) if PLAIN.fullmatch(part) else self._whole(part))
        return b"".join(out)

    def _ids(self, text: str) -> bytes:
        if not self.chunked:
            return self._whole(text)
        out, at = [], 0
        while at < len(text):
            cut = BLANK.search(text, at + STRETCH)
            end = cut.start() if cut else len(text)
            part, at = text[at:end], end
            if len(part) < 2 * STRETCH and PLAIN_TEXT.fullmatch(part):
                out.append(self._plain(part))
            else:
                out += map(self.chunks.__getitem__, BLANK.split(part))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, ``width`` bytes each."""
        return [self._ids(t) for t in texts]


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _HEADER.pack(doc_id or 0, doc_id is None, width, len(ids) // width) + ids


# --- files -----------------------------------------------------------------------------------------------------


def frame(payloads: list[bytes]) -> list[bytes]:
    """Framed records."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    return [
        b"".join((h, struct.pack("<I", c), p, struct.pack("<I", d))) for h, c, p, d in zip(heads, masked_crc32c(heads), payloads, masked_crc32c(payloads))
    ]


def write(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the files, in order of doc_id; the manifest: file, index, place (in the order of files), n_records, n_ids."""
    folder = folder or shared_folder(documents.sparkSession, "token-records")
    text = F.coalesce(documents["text"], F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "text_key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        encoder = chunk_encoder(tokenizer)
        end = np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{place:05d}-{uuid.uuid4().hex}"
        offset = n_ids = n_records = 0
        out = None
        try:
            for batch in batches:
                for part in slices(batch, "text", 2_000_000):
                    if out is None:
                        out, index = store.open_output_stream(f"{base}/{name}.rec"), store.open_output_stream(f"{base}/{name}.idx")
                    encoded = [e + end for e in encoder.encode(part.column("text").to_pylist())]
                    payloads = [_payload(d, e, encoder.width) for d, e in zip(part.column("doc_id").to_pylist(), encoded)]
                    frames = frame(payloads)
                    lengths = np.fromiter(map(len, frames), dtype=np.uint64, count=len(frames))
                    starts = np.uint64(offset) + np.cumsum(lengths) - lengths
                    out.write(b"".join(frames))
                    index.write(np.stack([starts, lengths], axis=1).astype("<u8").tobytes())
                    offset += int(lengths.sum())
                    n_records += len(frames)
                    n_ids += sum(map(len, encoded)) // encoder.width
        finally:
            if out is not None:
                out.close()
                index.close()
        if out is not None:
            row = [f"{folder}/{name}.rec", f"{folder}/{name}.idx", place, n_records, n_ids]
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "index", "place", "n_records", "n_ids"), row))], pa.schema(list(zip(("file", "index", "place", "n_records", "n_ids"), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())))))

    return written(ranged.mapInArrow(run, "file string, index string, place int, n_records long, n_ids long"), "token-manifest")


def read_record(raw: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one framed record, its checksums verified."""
    return _read_frames([raw])[0]


def _read_frames(frames: list[bytes]) -> list[tuple[int | None, np.ndarray]]:
    heads, payloads = [f[:8] for f in frames], [f[12:-4] for f in frames]
    for f, h, p, c, d in zip(frames, heads, payloads, masked_crc32c(heads), masked_crc32c(payloads)):
        if struct.unpack("<Q", h)[0] != len(p) or struct.unpack("<I", f[8:12])[0] != c or struct.unpack("<I", f[-4:])[0] != d:
            raise ValueError("a record's length or checksum is wrong")
    out = []
    for p in payloads:
        doc_id, none, width, n = _HEADER.unpack_from(p)
        out.append((None if none else doc_id, np.frombuffer(p, dtype=f"<u{width}", count=n, offset=_HEADER.size)))
    return out


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document's), n_tokens, ids_crc32: one row per record, from the files.

    A task reads files by their index, some megabytes at a time.  The running sum over the manifest has one row per
    file.
    """
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    schema = T._parse_datatype_string("doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["base"]
                folder, _, name = row["file"].rpartition("/")
                store, base = open_store(folder)
                with store.open_input_stream(f"{base}/{row['index'].rpartition('/')[2]}") as file:
                    index = np.frombuffer(file.read(), dtype="<u8").reshape(-1, 2).astype(np.int64)
                with store.open_input_file(f"{base}/{name}") as file:
                    at = 0
                    while at < len(index):
                        last = max(at + 1, int(np.searchsorted(index[:, 0], index[at, 0] + 4_000_000)))
                        begin, end = int(index[at, 0]), int(index[last - 1].sum())
                        raw = file.read_at(end - begin, begin)
                        frames = [raw[o - begin : o - begin + n] for o, n in index[at:last].tolist()]
                        rows = []
                        for doc_id, ids in _read_frames(frames):
                            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=schema.names)
                        at = last

    return files.repartition(tasks(files), "place").mapInArrow(run, schema)


def report(documents: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    return read(write(documents, tokenizer, end_id))
