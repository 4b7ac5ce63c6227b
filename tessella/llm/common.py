"""What the operators of this subpackage share: tables, the shared folder, small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[ \t-\r]+"

_OWN_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (not yet made) that driver and executors share, below ``spark.checkpoint.dir``.

    Where that setting is absent and Spark runs in one process, as in tests, a temporary folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDERS:
            _OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        root = _OWN_FOLDERS[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its size known, safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, of_some: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> Column:
    """What ``of_some`` gives of the first, the first two, ... values, in two levels, so that n values cost n * sqrt(n)
    steps: what stands before a chunk is had from the chunks, what stands before a value in its chunk from the chunk."""

    def by_chunks(v: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.size(v) - 1, wide), lambda at: F.slice(v, at + 1, wide))
        within = lambda c: F.transform(c, lambda _, i: of_some(F.slice(c, F.lit(1), i + 1)))

        def joined(c: Column) -> Column:
            return let(
                F.transform(c, of_some),
                lambda t: F.flatten(F.transform(c, lambda x, k: F.when(k == 0, within(x)).otherwise(let(of_some(F.slice(t, F.lit(1), k)), lambda b: F.transform(within(x), lambda y: both(b, y)))))),
            )

        return let(chunks, joined)

    return let(values, lambda v: F.when(F.size(v) < 1, v).otherwise(by_chunks(v)))


def running_sum(values: Column) -> Column:
    """The sums of the first, the first two, ... of an array of ints."""
    return _running(values, lambda some: F.aggregate(some, F.lit(0), lambda a, b: a + b), lambda a, b: a + b)


def running_max(values: Column) -> Column:
    """The largest of the first, the first two, ... of an array."""
    return _running(values, F.array_max, F.greatest)


#: The keys over which the rows of a hot key are dealt.
SALTS = 16


def join_hot(rows: DataFrame, found: DataFrame, key: str, others: list[Column]) -> DataFrame:
    """``rows`` left join ``found`` (a row per key) on ``key``, which many rows may share: ``found`` is repeated ``SALTS``
    times and the rows of a key are dealt over so many tasks by their ``others`` (of any types; maps have no hash, and rows
    without other columns are dealt by their places)."""
    hashed = [f"_{i}" for i, f in enumerate(rows.select(*[c.alias(f"_{i}") for i, c in enumerate(others)]).schema) if "map<" not in f.dataType.simpleString()]
    others = [others[int(name[1:])] for name in hashed] or [F.monotonically_increasing_id()]
    many = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")).join(many, [key, "_salt"], "left").drop("_salt")


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    return let(
        F.btrim(text, F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)),
    )


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def open_store(uri: str):
    """The file system of a folder and the folder's path in it; works in tasks, for any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def slices(batch, column: str, size: int):
    """An Arrow batch in parts of about ``size`` bytes of a string column, so that what is made of a part stays small; a
    longer value is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


def tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions: for rows that are few bytes but much work, which Spark would
    otherwise put together in a few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
