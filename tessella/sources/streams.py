"""Coded images as a data source: ``spark.read.format("tiled_images").load(folder)`` gives a row per record.

The source lists the files once; each file is a partition that is read where its task runs.  Writing takes rows of
(name, blob) and puts each task's files in place only when the job commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.bitstream import FormatError, unpack_stream

SCHEMA = "file string, width int, height int, tile int, overlap int, tile_id long, gen_id int, qv_id int, seed long, rec_flags int, payload_fmt int, payload binary, error string"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _store(self.folder)
        return [_File(f.path) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(self.suffix)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = _store(self.folder)
        with store.open_input_stream(partition.value) as file:
            blob = file.read()
        try:
            header, records = unpack_stream(blob)
        except (FormatError, ValueError) as error:
            yield (partition.value, *[None] * 11, str(error))
            return
        sizes = [header.get(k) for k in ("width", "height", "tile", "overlap")]
        for r in records:
            yield (partition.value, *sizes, *r, None)


class _Done(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class _Writer(DataSourceWriter):
    """Rows (name, blob).  A task writes under names of its own; the commit renames what tasks report."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, base = _store(self.folder)
        store.create_dir(base, recursive=True)
        names = []
        try:
            for row in rows:
                at = f"{base}/.{uuid.uuid4().hex}"
                names.append((at, f"{base}/{row['name']}{self.suffix}"))
                with store.open_output_stream(at) as out:
                    out.write(bytes(row["blob"]))
        except BaseException:  # a task that fails takes its files with it
            from pyarrow import fs

            for at, _ in names:
                if store.get_file_info(at).type != fs.FileType.NotFound:
                    store.delete_file(at)
            raise
        return _Done(names)

    def commit(self, messages: list) -> None:
        store, _ = _store(self.folder)
        for message in messages:
            for at, name in message.names if message else ():
                store.move(at, name)

    def abort(self, messages: list) -> None:
        store, _ = _store(self.folder)
        for message in messages:
            for at, _name in message.names if message else ():
                store.delete_file(at)


class TiledImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiled_images"

    def schema(self) -> str:
        return SCHEMA

    def _suffix(self) -> str:
        return self.options.get("suffix", ".img")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._suffix())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self._suffix())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiledImages)
