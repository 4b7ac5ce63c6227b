"""Mixing sources to target weights along a time-varying curriculum.

Method: each source has a weight schedule over training time 0..1; the schedule is integrated, and the cumulative
token demand of the source is inverted at the token offset of each document to get the document's training
position; the mix is range-sorted by position.  Everything is DataFrame functions.

Targets: source i weighs w_i and may get at most ``max_repeats`` times its size.  The excess of capped sources is
reshared by weight until none is above its cap.  With the sources ordered by cap / weight, the capped ones are a
prefix, so the fixed point is one running sum over the table of sources.

Supply: within a source, documents stand in the order of a hash of their id, so that reruns agree.  Epoch e
of a document begins at e * source size + its offset and is taken if that is below the target.  So a source misses
its target by less than one document, and no document is taken more than ``max_repeats`` times.

Defined results
* null text: size 0.  null source: a source of its own, last in order.  null doc_id: a document like any other.
* documents of size 0 are taken at their offset like others and count 0 words.
* repeated rows: equal rows tie in the order; they're interchangeable.
* empty table: no rows.  Extra columns are carried along by ``mix``, whatever their names, but that input columns named
  epoch or position are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, word_count, written


@dataclass(frozen=True)
class MixRules:
    #: Weights of the sources in their order, repeating.
    weights: tuple[int, ...] = (1, 2, 3)
    max_repeats: int = 3
    #: The schedule of a source rises or falls linearly by this share over the run, by its place in the order.
    slopes: tuple[float, ...] = (0.0, 0.5, -0.5)
    #: Documents of a source are summed in groups by their draw, in 16 ** 3 at least, and so many that all documents in
    #: one source would be about this many to a group.
    group_rows: int = 16_384
    seed: int = 7


def with_size(documents: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """``documents`` with size, draw (the place in the source's order) and text_key (which breaks ties)."""
    text = F.coalesce(documents["text"], F.lit(""))
    draw = F.substring(F.md5(F.concat_ws(":", F.lit(str(rules.seed)), F.coalesce(documents["doc_id"].cast("string"), F.lit("-"))).cast("binary")), 1, 16)
    return documents.withColumns({"size": word_count(text), "draw": draw, "text_key": F.xxhash64(text)})


def group_digits(count: int, rules: MixRules = MixRules()) -> int:
    """Hex digits of the draw that make the groups of a source."""
    return next(d for d in range(3, 17) if 16**d * rules.group_rows >= count or d == 16)


def sized(documents: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """``with_size`` without the texts, so that what follows moves few bytes."""
    return with_size(documents.select("doc_id", "source", "text"), rules).drop("text")


def targets(sizes: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """source, source_size, weight, slope, target: one row per source.

    The windows run over this table of sources alone, after documents have been summed by source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col("place"), F.lit(len(values))).cast("int"))
    s = by_source.withColumn("place", place)
    s = s.withColumn("weight", cycle(rules.weights).cast("long")).withColumn("slope", cycle(rules.slopes).cast("double"))
    s = s.withColumn("cap", rules.max_repeats * F.col("source_size"))
    filling = Window.orderBy((F.col("cap") / F.col("weight")), F.col("place"))
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("left") * F.col("weight"))
    s = s.withColumn("rank", F.row_number().over(filling))
    # The first source that isn't capped has what is left to share: sums of integers, exact in any order.
    s = s.withColumn("share", F.min(F.when(~F.col("capped"), F.struct("rank", "left", "left_weight"))).over(everything))
    shared = (F.col("weight") * F.col("share.left")).cast("double") / F.col("share.left_weight").cast("double")
    return s.select("source", "source_size", "weight", "slope", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def demand(time: Column, slope: Column) -> Column:
    """Share of a source's target that is due by ``time``: the integral of its schedule 1 + slope * (2 * time - 1)."""
    return time + slope * (time * time - time)


def when_due(share: Column, slope: Column) -> Column:
    """The inverse of ``demand``: the time by which this share of the target is due."""
    u = 1 - slope
    root = (F.sqrt(u * u + 4 * slope * share) - u) / (2 * slope)
    return F.when(slope == 0, share).otherwise(root)


def assign(rows: DataFrame, sizes: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """``rows`` (as of ``with_size``) with source_size, target, slope, offset and copies; ``sizes`` has them without texts.

    Offsets are running sums in two steps, over the groups of a source and within a group, so the rows of a hot
    source never meet in one task.  The groups grow in number with the rows; Spark broadcasts their table below its
    threshold and shuffles it beyond.
    """
    goal = targets(sizes, rules)
    # Keys without nulls: the join then finds the rows where the window has put them.
    place = {"_source": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull(), "_part": F.substring("draw", 1, group_digits(sizes.count(), rules))}
    keys = list(place)
    per_group = sizes.withColumns(place).groupBy(*keys).agg(F.sum("size").alias("_size"))
    before = Window.partitionBy("_source", "_none").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_group.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    goal = goal.withColumns({k: place[k] for k in keys[:2]}).drop("source", "weight")
    starts = starts.join(goal, keys[:2])
    within = Window.partitionBy(*keys).orderBy("draw", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.drop("source_size", "target", "slope", "offset", "copies").withColumns(place)
    placed = placed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, keys)
    placed = placed.withColumn("offset", (F.col("_start") + F.col("_before")).cast("long"))
    taken = [((F.col("offset") + e * F.col("source_size")) < F.col("target")).cast("long") for e in range(rules.max_repeats)]
    return placed.withColumn("copies", sum(taken, F.lit(0).cast("long"))).drop(*keys, "_start", "_before")


def position(epoch: Column) -> Column:
    """Training position of a document's copy of this epoch."""
    share = (F.col("offset") + epoch * F.col("source_size")) / F.col("target")
    return let(share, lambda u: when_due(u, F.col("slope")))


def training_order(assigned: DataFrame) -> DataFrame:
    """One row per taken copy, range-sorted by training position: ``assigned`` with epoch and position."""
    taken = assigned.filter(F.col("copies") > 0)
    copies = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    return copies.withColumn("position", position(F.col("epoch"))).orderBy("position", "draw", "epoch", "text_key")


def _ordered(documents: DataFrame, rules: MixRules) -> DataFrame:
    """_row (all columns), epoch, position: the rows of the mix in training order.

    Sizes are written once.  The texts move twice: into the groups of their source, and in the range sort.  The row
    travels as a struct, so its columns can't clash with those used here.
    """
    sizes = written(sized(documents, rules), "mix-sizes")
    rows = with_size(documents.select(F.struct(*documents.columns).alias("_row"), "doc_id", "source", "text"), rules).drop("text")
    return training_order(assign(rows, sizes, rules)).select("_row", "epoch", "position")


def mix(documents: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """The rows of the mix in training order: the columns of ``documents``, with epoch and position."""
    return _ordered(documents, rules).select(*[F.col("_row")[c].alias(c) for c in documents.columns if c not in ("epoch", "position")], "epoch", "position")


def mixed(documents: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """The rows of the mix in training order, with the columns of ``documents`` alone, whatever their names."""
    return _ordered(documents, rules).select("_row.*")


def report(documents: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """One row per document, in the order of first training positions; documents that aren't taken come last."""
    sizes = written(sized(documents, rules), "mix-sizes")
    assigned = assign(sizes, sizes, rules).withColumn("position", F.when(F.col("copies") > 0, position(F.lit(0))))
    return assigned.orderBy(F.col("position").asc_nulls_last(), "draw").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.round("position", 6).alias("position")
    )
