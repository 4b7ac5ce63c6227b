"""Secret scans over an incremental ledger of blobs.

Method: every version of every path is addressed by the SHA-256 of its content.  The ledger records which
(blob, rule version) pairs have been scanned and what was found; a run scans only pairs that it doesn't have
yet, appends them, and joins the findings back to all paths that hold the blob.  Everything is DataFrame
functions: a rule is a Java regular expression, its spans come from the pieces between its matches.

Defined results
* null text: the empty text.  null path or id: a path like any other.
* repeated rows and equal texts: one blob, scanned once; each row gets the findings.
* empty table: no rows, and an empty addition to the ledger.
* spans are code points, end exclusive, leftmost and non-overlapping per rule; rules may overlap each other.
* extra columns of the input, of any type, are carried along by ``scan``; ``blob`` and ``spans`` are its own names, and
  input columns of these names are replaced.  A column ``text`` is all that it needs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, let, running_max, running_sum, shared_folder

SPANS = "array<struct<start:int,rule:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length; shorter matches are dropped after matching.
    group: int = 0
    min_length: int = 0

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(f'{self.pattern}|{self.group}|{self.min_length}'.encode()).hexdigest()[:16]}"


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # A maximal run is matched whole or not at all, so the least length may stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: A key from its BEGIN line to its END line, whatever stands between (quote marks, comments, headers, markup) but five
#: dashes.  Where END is missing, to the end of the body: runs of 16 and more between breaks, quote marks and comment signs,
#: and a last shorter one that is padded or has a line to itself.  A line break may be spelled out, as in JSON.  Loops are
#: possessive and the one over dashes is bounded, so Java takes long bodies without recursion.
PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*+(?:-{1,4}+[^-]++){0,200}+-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:[ \t\r\n>#*|;]{0,8}[A-Z][A-Za-z-]{2,20}:[^\r\n]{0,200}){0,8}+"
    r"(?:(?:[\\ \t\r\n>#*|;]|<br ?/?>){0,12}+[A-Za-z0-9+/=]{16,}+)++(?:[\\ \t\r\n]{0,8}[A-Za-z0-9+/]{1,15}={1,2}|[ \t]{0,4}\r?\n[ \t]{0,4}[A-Za-z0-9+/]{1,15}(?=[ \t]*+(?:[\r\n]|\z)))?"
    r"|)"
)
MORE_RULES = (
    Rule("pem", PEM),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """The spans of one rule.  A text without a match costs one search."""
    none = F.array().cast(SPANS)

    def place(parts: Column) -> Column:
        long = F.transform(parts["whole"], F.length)
        steps = F.zip_with(F.slice(parts["between"], F.lit(1), F.size(parts["whole"])), long, lambda x, n: F.length(x) + n)
        ends = F.zip_with(long, running_sum(steps), lambda n, end: F.struct((end - n).alias("start"), F.lit(number).alias("rule"), end.alias("end")))
        if rule.min_length:
            pairs = F.zip_with(ends, parts["value"], lambda s, v: F.when(F.length(v) >= rule.min_length, s))
            ends = F.filter(pairs, lambda s: s.isNotNull())
        return ends

    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
    )
    return F.when(text.rlike(rule.pattern), let(parts, place)).otherwise(none)


def spans_in(text: Column, rules: tuple[Rule, ...] = RULES, wanted: Column | None = None) -> Column:
    """All spans of the rules (those whose version is in ``wanted``), by start, then rule."""
    found = []
    for number, rule in enumerate(rules):
        spans = _spans(text, number, rule)
        found.append(spans if wanted is None else F.when(F.array_contains(wanted, rule.version), spans).otherwise(F.array().cast(SPANS)))
    return F.sort_array(F.concat(*found))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _ledger(versions: DataFrame, ledger: str) -> DataFrame | None:
    """blob, rules (versions scanned), findings (rule version, start, end); None if there is no ledger yet."""
    jvm = versions.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(versions.sparkSession._jsc.hadoopConfiguration()).exists(path):
        return None
    return versions.sparkSession.read.schema("blob binary, rules array<string>, findings array<struct<version:string,start:int,end:int>>").parquet(ledger)


def update(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the (blob, rule version) pairs of ``versions`` (column text) that the ledger lacks, and appends them.

    Equal contents meet after a partial removal of copies in each task, so a hot blob moves once per task.
    """
    known = _ledger(versions, ledger)
    blobs = versions.select(blob_of(versions["text"]).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    wanted = F.array(*[F.lit(r.version) for r in rules])
    if known is None:
        todo = blobs.withColumn("rules", wanted)
    else:
        seen = known.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        none = F.array().cast("array<string>")
        todo = blobs.join(seen, "blob", "left").select("blob", "text", F.array_except(wanted, F.coalesce("seen", none)).alias("rules"))
        todo = todo.filter(F.size("rules") > 0)
    version = F.array(*[F.lit(r.version) for r in rules])
    spans = spans_in(F.col("text"), rules, None if known is None else F.col("rules"))
    findings = F.transform(spans, lambda s: F.struct(F.get(version, s["rule"]).alias("version"), s["start"].alias("start"), s["end"].alias("end")))
    todo.select("blob", "rules", findings.alias("findings")).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans (start, rule, end; by start, then rule) for the blobs in which the rules found something."""
    known = _ledger(versions, ledger)
    number = F.array(*[F.lit(r.version) for r in rules])
    to_span = lambda f: F.struct(f["start"].alias("start"), (F.array_position(number, f["version"]) - 1).cast("int").alias("rule"), f["end"].alias("end"))
    # Two runs at a time may have scanned a pair twice; in order, equal spans are neighbours.
    spans = let(F.sort_array(F.flatten(F.collect_list(F.transform("findings", to_span)))), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))
    own = F.filter(F.col("spans"), lambda s: s["rule"] >= 0)
    found = known.filter(F.size("findings") > 0).groupBy("blob").agg(spans.alias("spans"))
    return found.select("blob", own.alias("spans")).filter(F.size("spans") > 0)


def attached(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``blob`` and the ``spans`` that the ledger has for it.

    Findings are one row per blob with findings; the rows of a hot blob are dealt by their other columns.
    """
    kept = [c for c in versions.columns if c not in ("spans", "blob")]
    rows = versions.select(F.struct(*kept).alias("_row"), blob_of(versions["text"]).alias("blob"))
    joined = join_hot(rows, findings(versions, ledger, rules), "blob", [F.col("_row")[c] for c in kept if c != "text"])
    return joined.select(*[F.col("_row")[c].alias(c) for c in kept], "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``blob`` and ``spans``, after the ledger (a new one by default) has been brought up to date."""
    ledger = ledger or shared_folder(versions.sparkSession, "secret-ledger")
    update(versions, ledger, rules)
    return attached(versions, ledger, rules)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, joined by commas."""
    kind = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points of the blocks that a long text is cut into, so that a stretch of it is found without a walk from its start.
BLOCK = 4096


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch that spans (by start) cover replaced by ``mark``; a null text stays null."""

    def stretch(blocks: Column, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / BLOCK).cast("int"), F.floor(F.greatest(end - 1, begin) / BLOCK).cast("int")
        return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), begin - first * BLOCK + 1, end - begin)

    def rest(x: Column) -> Column:
        # A span that begins before all earlier ones have ended goes on with their stretch.
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(x["ends"], i - 1))
            return F.when(s["start"] >= before, F.concat(stretch(x["blocks"], before, s["start"]), F.lit(mark)))

        pieces = F.filter(F.transform(spans, piece), lambda p: p.isNotNull())
        tail = stretch(x["blocks"], F.element_at(x["ends"], -1), F.length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    found = F.struct(blocks.alias("blocks"), running_max(F.transform(spans, lambda s: s["end"])).alias("ends"))
    return F.when(F.size(spans) == 0, text).otherwise(let(found, rest))


def report(documents: DataFrame, ledger: str | None = None, deliveries: int = 2) -> DataFrame:
    """One row per document: counts and digests of the base spans, and all spans.

    Documents come in ``deliveries`` (by a hash of their id), each of which is a run: it scans the pairs of blob and rule
    version that the runs before it have not put into the ledger.  The findings of all are then joined to all documents.
    """
    documents = documents.select("doc_id", "text")
    ledger = ledger or shared_folder(documents.sparkSession, "secret-ledger")
    for n in range(deliveries):
        update(documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(deliveries)) == n), ledger)
    found = attached(documents, ledger)
    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))
    count = lambda n: F.size(F.filter("spans", lambda s: s["rule"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def cleaned(documents: DataFrame, ledger: str | None = None, mark: str = "[secret]") -> DataFrame:
    """``documents`` with their secrets replaced by ``mark``; n_chars, where there is such a column, follows."""
    # The row travels as a struct, so its columns can't clash with those of the scan.
    rows = documents.select(F.struct(*documents.columns).alias("_row"), "text")
    found = scan(rows, ledger).withColumn("_text", redacted(F.col("_row.text"), F.col("spans"), mark))
    made = {"text": F.col("_text"), "n_chars": F.when(F.size("spans") == 0, F.col("_row")["n_chars"]).otherwise(F.length("_text").cast("long"))}
    return found.select(*[(made[c] if c in made else F.col("_row")[c]).alias(c) for c in documents.columns])
