"""Source divergence audit: how far the words of each source lie from those of the other sources of its language.

Method: joint count histograms.  For two sources a term is a cell (count here, count there), and what it adds to their
distance depends on these two counts alone.  So per pair of sources the distinct combinations of counts are tallied, the
terms that neither source has by subtraction from the vocabulary, and the distance is evaluated once per combination,
times its multiplicity.

Spark deals the documents; a task counts terms in its own documents before anything moves.  The table of counts per
(lang, source, term) is written once.  For the pairs, the terms of a language are dealt over shards and its sources over
blocks; a task holds one shard of two blocks of sources as a matrix of counts and tallies the pairs of columns, so no row
is made per term and pair, and neither a common term nor a large source meets in one task.

All arithmetic is in whole numbers: shares are floors of ``SCALE * (count + PRIOR) / (total + PRIOR * V)``, divided as
decimals of 38 digits.

Defined results
* null text, lang or source: the empty string, a language or source like any other.  null doc_id, repeated rows: every row
  is a document of its own.
* texts without terms and empty texts: their (lang, source) is a group with counts of 0.
* ties: ranks go by value, then by the UTF-8 bytes of the item.
* very long texts: counted whole; a task gives its counts away once it holds ``HELD`` of them.
* empty table: no rows.  Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

#: Documents of a language that a term must be in, and what is added to each count.
LEAST_DOCUMENTS, PRIOR = 30, 5
SCALE = 1_000_000_000
#: Terms of a source that are listed.
TOP = 50
#: Counts that a task holds before it gives them away.
HELD = 400_000
#: Terms of a shard and sources of a block, on the average.
SHARD, BLOCK = 4_096, 32

#: Bytes of terms as they are, A-Z in lower case; every other byte is a blank.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The runs of ASCII letters and of characters above U+007F, with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it); a row with null term for each group."""
    schema = "lang string, source string, term string, n long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                words = [None, *n]
                columns = [
                    pa.array([lang] * len(words), pa.string()),
                    pa.array([source] * len(words), pa.string()),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *map(docs.__getitem__, n)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                for text, lang, source in zip(part.column("text"), part.column("lang").to_pylist(), part.column("source").to_pylist()):
                    n, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                    words = terms(text.as_py())
                    n.update(words)
                    docs.update(set(words))
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from given()
        yield from given()

    columns = [F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]
    counted = documents.select(*columns).mapInArrow(run, schema)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, vocabulary: Column, prior: int = PRIOR) -> Column:
    """1 + floor(SCALE * (count + prior) / (total + prior * vocabulary)), exactly."""
    whole = lambda c: c.cast("decimal(20,0)")
    divided = F.call_function("div", whole(count + prior) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + prior * vocabulary))
    return 1 + divided


def tallies(kept: DataFrame, groups: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """lang, a, b (sources, a < b), ca, cb (counts, not both 0), m (terms with these counts): a row for each combination
    and shard of terms, and one of m = 0 for each pair of sources.

    kept: (lang, source, term, n); groups: (lang, source, vocabulary), a row for each source.
    """
    blocks = F.ceil(F.count("*") / block).cast("int").alias("blocks")
    shape = groups.groupBy("lang").agg(blocks, F.greatest(F.lit(1), F.ceil(F.max("vocabulary") / shard)).cast("int").alias("shards"))
    cells = kept.select("lang", "source", "term", "n").join(shape, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    # A source has a row in each shard, so a shard of which it has no term counts zeros for it.
    every = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n")).join(shape, "lang")
    dealt = (
        cells.unionByName(every.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))))
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "shard", "block", "source", "term", "n")
    )

    def tally(group: pa.Table) -> pa.Table:
        lang, i, j = (group.column(c)[0].as_py() for c in ("lang", "i", "j"))
        source = pc.dictionary_encode(group.column("source")).combine_chunks()
        names = source.dictionary.to_pylist()
        column, of_block = source.indices.to_numpy(), group.column("block").to_numpy()
        row = pc.dictionary_encode(group.column("term")).combine_chunks().indices.fill_null(-1).to_numpy()
        counts = np.zeros((len(names), row.max() + 1), dtype=np.int64)
        has = row >= 0
        counts[column[has], row[has]] = group.column("n").to_numpy()[has]
        block_of = np.zeros(len(names), dtype=np.int64)
        block_of[column] = of_block
        values, number = np.unique(counts, return_inverse=True)
        number = number.reshape(counts.shape)
        out: list[list] = [[], [], [], [], []]
        for x in np.flatnonzero(block_of == i).tolist():
            for y in np.flatnonzero(block_of == j).tolist():
                if (i == j and names[x] >= names[y]) or x == y:
                    continue
                one, two = (x, y) if names[x] < names[y] else (y, x)
                either = (counts[one] > 0) | (counts[two] > 0)
                codes, times = np.unique(number[one][either] * len(values) + number[two][either], return_counts=True)
                here, there = (np.append(values[v], 0) for v in np.divmod(codes, max(1, len(values))))
                for some, more in zip(out, ([names[one]] * len(here), [names[two]] * len(here), here, there, np.append(times, 0))):
                    some.append(more)
        flat = lambda parts, kind: pa.array([v for p in parts for v in p] if kind == pa.string() else np.concatenate(parts or [np.zeros(0)]).astype(np.int64), kind)
        columns = [flat(out[0], pa.string()), flat(out[1], pa.string()), *(flat(o, pa.int64()) for o in out[2:])]
        return pa.Table.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *columns], names=["lang", "a", "b", "ca", "cb", "m"])

    return dealt.groupBy("lang", "i", "j", "shard").applyInArrow(tally, "lang string, a string, b string, ca long, cb long, m long")


def _counted(documents: DataFrame, least_documents: int) -> tuple[DataFrame, DataFrame]:
    """kept: (lang, source, term, n, in_lang) of the terms that their language keeps; groups: (lang, source, total,
    lang_total, vocabulary), a row for each source."""
    cells = written(term_counts(documents), "term-counts")
    of_lang = cells.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    of_lang = written(of_lang.filter(F.col("docs") >= least_documents).drop("docs"), "terms-kept")
    kept = written(cells.drop("docs").join(of_lang, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"), "term-counts-kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = of_lang.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("vocabulary"))
    groups = cells.filter("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    return kept, written(groups, "source-totals")


def distances(kept: DataFrame, groups: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """lang, a, b (sources, a < b), value: the sum of the differences of shares over all kept terms."""
    of = [groups.select("lang", F.col("source").alias(c), F.col("total").alias(f"total_{c}"), *([F.col("vocabulary")] if c == "a" else [])) for c in "ab"]
    differs = lambda ca, cb: F.abs(share(ca, F.col("total_a"), F.col("vocabulary")) - share(cb, F.col("total_b"), F.col("vocabulary")))
    combined = tallies(kept, groups, shard, block).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    combined = combined.join(of[0], ["lang", "a"]).join(of[1], ["lang", "b"])
    summed = combined.groupBy("lang", "a", "b", "total_a", "total_b", "vocabulary").agg(F.sum(F.col("m") * F.when(F.col("m") > 0, differs(F.col("ca"), F.col("cb"))).otherwise(0)).alias("seen"), F.sum("m").alias("terms"))
    unseen = F.col("vocabulary") - F.col("terms")
    return summed.select("lang", "a", "b", (F.col("seen") + F.when(unseen > 0, unseen * differs(F.lit(0), F.lit(0))).otherwise(0)).alias("value"))


def leading_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the terms of which a source has a larger share than its language, and by how much."""
    both = kept.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("vocabulary")), share(F.col("in_lang"), F.col("lang_total"), F.col("vocabulary"))
    return both.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")


def report(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source from each other one of its language
    (``pair``), and its ``top`` terms beyond their share in the language (``term``)."""
    kept, groups = _counted(documents, least_documents)
    either = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = distances(kept, groups, shard, block).select("lang", "value", either.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    words = leading_terms(kept, groups).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).union(words.select("*", rank).filter(F.col("rank") <= top))
