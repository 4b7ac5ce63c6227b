"""Quality rules: counts within a text, and the frequency of lines across the documents of a host.

Method: normalised lines are hashed, distinct documents are counted per host and line hash, lines above the
limit are removed from all documents but the first that has them, and documents left with too little are
rejected.  Everything is DataFrame functions.  Lines are hashed once, into a table of their hashes and places, which
serves for the counts and for the removal.

Defined results
* null text: no words, no lines; ``base_failed`` is true, as fewer than ``min_words`` words remain.
* null host: a host of its own.  null doc_id: never the first holder of a line; a line that only such documents have
  stays in none of them.
* a document is a doc_id and its text: exact copies of other doc_ids are documents like others, repeated rows are one
  document for the line counts; each row gets its own (equal) result.
* empty table: no rows.  ``judge`` reads the named columns alone; ``accepted`` and ``cleaned`` carry all columns along,
  whatever their names.
* lines and windows are compared by 64-bit hashes (of host and line, of five words).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, ascii_lower, let, words_of, written


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: A line in more distinct documents of one host than this is removed (the first document keeps it).
    max_documents: int = 20
    #: A document is depleted if more than this share of its line characters is removed.
    max_removed_percent: int = 50


def _repeat_words(words: Column, window: int) -> Column:
    """Words that lie in a window of ``window`` words which the text has twice or more."""

    def windows(hashes: Column) -> Column:
        n = F.size(hashes)
        at = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])
        return F.when(n < window, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - window), at))

    def covered(found: Column) -> Column:
        by_hash = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"])
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        def union_length(p: Column) -> Column:
            gap = F.transform(p, lambda v, k: F.least(F.lit(window), v - F.coalesce(F.get(p, k - 1), v - window)))
            return F.aggregate(gap, F.lit(0), lambda a, g: a + g)

        return let(let(by_hash, twice), union_length)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(
        let(hashes, windows),
        lambda f: F.when(F.size(F.array_distinct(f)) == F.size(f), F.lit(0)).otherwise(covered(f)),
    ).cast("long")


def _lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def text_counts(documents: DataFrame, rules: QualityRules = QualityRules()) -> Column:
    """A struct of the counts within one text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(documents["text"], F.lit(""))
    by_word = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w, rules.window).alias("n_repeat_words"),
        ),
    )
    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")
    repeated = let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return F.struct(by_word.alias("w"), symbols.alias("n_symbols"), repeated.alias("n_dup_lines"))


def _normal(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), BLANK_RUN, " "))


def line_table(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, text_key (a hash of the text), line_chars (of the document), pos, line_key (a hash of host and line),
    n_chars: the lines that have a word, normalised."""
    text = F.coalesce(documents["text"], F.lit(""))
    own = documents[host].alias("host")

    def rows(lines: Column) -> Column:
        total = F.aggregate(lines, F.lit(0).cast("long"), lambda n, line: n + F.length(line))
        row = lambda line, i, n: F.struct(n.alias("line_chars"), i.alias("pos"), F.xxhash64(documents[host], line).alias("line_key"), F.length(line).alias("n_chars"))
        return let(total, lambda n: F.transform(lines, lambda line, i: row(line, i, n)))

    lines = F.explode(let(F.transform(_lines(text), _normal), rows)).alias("l")
    return documents.select(documents["doc_id"], own, F.xxhash64(text).alias("text_key"), lines).select("doc_id", "host", "text_key", "l.*")


def frequent_lines(lines: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """line_key, n_documents, first_doc: lines in more than ``max_documents`` distinct documents of a host, from ``lines``
    as of ``line_table``.

    Counting is by (line, document) first and by line after that, each with a partial sum before its shuffle,
    so neither a hot host nor a line of a third of the documents meets in one task.
    """
    return (
        lines.select("line_key", "doc_id", "text_key").distinct()
        .groupBy("line_key")
        .agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc"))
        .filter(F.col("n_documents") > rules.max_documents)
    )


def removed_lines(documents: DataFrame, host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, host, text_key, pos, n_chars, line_chars (of the document): each line removed from a document.

    The frequent lines are written first, so their size is known when the join is planned: Spark broadcasts them
    below its threshold and shuffles both sides beyond it.
    """
    lines = written(line_table(documents, host), "line-hashes")
    frequent = written(frequent_lines(lines, rules), "frequent-lines")
    return (
        lines.join(frequent, "line_key")
        .filter(~F.coalesce(F.col("doc_id") == F.col("first_doc"), F.lit(False)))
        .select("doc_id", "host", "text_key", "line_chars", "pos", "n_chars")
        .dropDuplicates(["doc_id", "host", "text_key", "pos"])
    )


def losses(documents: DataFrame, host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, host, text_key, removed_lines, depleted, positions: the documents that lose a line."""
    lost = removed_lines(documents, host, rules).groupBy("doc_id", "host", "text_key").agg(
        F.count("*").alias("removed_lines"), F.sum("n_chars").alias("removed"), F.first("line_chars").alias("line_chars"),
        F.collect_list("pos").alias("positions"),
    )
    return lost.select("doc_id", "host", "text_key", "removed_lines", (100 * F.col("removed") > rules.max_removed_percent * F.col("line_chars")).alias("depleted"), "positions")


def _base_failed(n_words: Column, n_repeat_words: Column, rules: QualityRules) -> Column:
    return (n_words < rules.min_words) | (100 * n_repeat_words > rules.max_repeat_percent * n_words)


def judge(documents: DataFrame, host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: the counts, ``base_failed``, what line removal takes, ``kept``."""
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = documents.select("doc_id", documents[host].alias("host"), text_key.alias("text_key"), text_counts(documents, rules).alias("c"))
    found = found.select("doc_id", "host", "text_key", "c.w.n_words", "c.w.word_chars", "c.n_symbols", "c.n_dup_lines", "c.w.n_repeat_words")
    lost = losses(documents, host, rules)
    same = [found[k].eqNullSafe(lost[k]) for k in ("doc_id", "host", "text_key")]
    joined = found.join(lost, same, "left").select(
        *[found[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        _base_failed(found["n_words"], found["n_repeat_words"], rules).alias("base_failed"),
        F.coalesce(lost["removed_lines"], F.lit(0).cast("long")).alias("removed_lines"),
        F.coalesce(lost["depleted"], F.lit(False)).alias("depleted"),
    )
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def _sound(documents: DataFrame, rules: QualityRules) -> DataFrame:
    """_row (all columns), of the documents whose own counts don't fail."""
    counted = documents.select(F.struct(*documents.columns).alias("_row"), text_counts(documents, rules)["w"].alias("_c"))
    return counted.filter(~_base_failed(F.col("_c.n_words"), F.col("_c.n_repeat_words"), rules)).select("_row")


def _of_row(lost: DataFrame, host: str) -> Column:
    row = F.col("_row")
    return row["doc_id"].eqNullSafe(lost["doc_id"]) & row[host].eqNullSafe(lost["host"]) & (F.xxhash64(F.coalesce(row["text"], F.lit(""))) == lost["text_key"])


def accepted(documents: DataFrame, host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that the rules keep, as they are.

    The texts are judged where they lie; the depleted documents are a table of known size, and texts move only where
    it is too large to broadcast.
    """
    gone = written(losses(documents, host, rules).filter("depleted").select("doc_id", "host", "text_key"), "depleted-documents")
    return _sound(documents, rules).join(gone, _of_row(gone, host), "left_anti").select("_row.*")


def without_lines(text: Column, positions: Column) -> Column:
    """The text without the lines at these positions among those that have a word; where positions are null, as it is."""

    def rest(lines: Column) -> Column:
        own = F.filter(F.transform(lines, lambda line, i: F.when(F.btrim(line, F.lit(BLANKS)) != "", i)), lambda i: i.isNotNull())
        gone = let(own, lambda o: F.transform(positions, lambda p: F.get(o, p)))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return F.when(positions.isNull(), text).otherwise(let(F.split(text, "\n", -1), rest))


def cleaned(documents: DataFrame, host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that the rules keep, without the lines that are removed from them; n_chars, where there is such a
    column, follows.  The verdicts are those on the whole texts, as of ``judge``.

    Texts move once, to meet the positions of their lost lines, which are a table that grows with the documents.
    """
    lost = losses(documents, host, rules).select("doc_id", "host", "text_key", F.struct("depleted", "positions").alias("_lost"))
    lost = written(lost, "lost-lines").hint("merge")
    left = _sound(documents, rules).join(lost, _of_row(lost, host), "left").select("_row", "_lost").filter(~F.coalesce("_lost.depleted", F.lit(False)))
    left = left.withColumn("_text", without_lines(F.col("_row.text"), F.col("_lost.positions")))
    made = {"text": F.col("_text"), "n_chars": F.when(F.col("_lost").isNull(), F.col("_row")["n_chars"]).otherwise(F.length("_text").cast("long")) if "n_chars" in documents.columns else None}
    return left.select(*[(made[c] if c in made else F.col("_row")[c]).alias(c) for c in documents.columns])
