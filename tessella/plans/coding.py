"""Queries on entropy coding and framing, over the bytes of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from ..operators import bitstream, entropy
from .common import sql_tidy, table, tidy

QUERIES, SQL = {}, {}
PRECISION = 12


def query(function):
    QUERIES[function.__name__] = function
    return function


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_BYTES = """hexed AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents WHERE text IS NOT NULL
), bytes AS (SELECT doc_id, ('0x' || x)::INT AS sym FROM hexed
), hist AS (SELECT sym, count(*) AS n FROM bytes GROUP BY sym
), shares AS (SELECT sym, n, greatest(floor(n * 4096 / (SELECT sum(n) FROM hist)), 1)::BIGINT AS share FROM hist)"""


@query
def byte_histogram(spark, sf_dir):
    return entropy.byte_counts(_documents(spark, sf_dir))


@query
def freq_floor(spark, sf_dir):
    return entropy.floor_shares(entropy.byte_counts(_documents(spark, sf_dir)), PRECISION)


@query
def cdf(spark, sf_dir):
    return entropy.cumulative(entropy.floor_shares(entropy.byte_counts(_documents(spark, sf_dir)), PRECISION))


@query
def table_ids(spark, sf_dir):
    """The frequency table for each language of the documents: the one of its name, or else the default."""
    langs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    known = entropy.available_tables(spark, []).select("id")
    return langs.join(known, langs["lang"] == known["id"], "left").select("lang", "n", F.coalesce("id", F.lit("v15_default")).alias("id"))


SQL["table_ids"] = "SELECT lang, count(*) AS n, 'v15_default' AS id FROM documents GROUP BY lang"
SQL["byte_histogram"] = f"WITH {_BYTES} SELECT sym, n FROM hist"
SQL["freq_floor"] = f"WITH {_BYTES} SELECT sym, n, share FROM shares"
SQL["cdf"] = f"WITH {_BYTES} SELECT sym, share, coalesce(sum(share) OVER (ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM shares"


@query
def rans_table(spark, sf_dir):
    """The normalised table of all documents: symbols, frequencies, and sums before."""
    made = entropy.build_table(entropy.byte_counts(_documents(spark, sf_dir)), PRECISION)
    rows = [(s, f, c) for s, (f, c) in enumerate(zip(made.freqs, made.cdf))]
    return spark.createDataFrame(rows, "sym int, freq int, below int")


#: Shares cut off; what is over is taken from the smallest remainders, what is missing goes to the largest.
SQL["rans_table"] = f"""WITH {_BYTES}, exact AS (
  SELECT sym, n, share, n * 4096.0::DOUBLE / (SELECT sum(n) FROM hist) - share AS rest, sum(share) OVER () - 4096 AS over FROM shares
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY share > 1 ORDER BY rest, n, sym) AS low, row_number() OVER (ORDER BY rest DESC, n DESC, sym) AS high FROM exact
), spent AS (
  SELECT sym, share - (share > 1 AND low <= over)::BIGINT + (high <= -over)::BIGINT AS freq FROM ranked
), every AS (
  SELECT r.s::INT AS sym, coalesce(freq, 0)::INT AS freq FROM range(256) r(s) LEFT JOIN spent ON spent.sym = r.s
)
SELECT sym, freq, coalesce(sum(freq) OVER (ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS below FROM every"""


@query
def bits_estimate(spark, sf_dir):
    """Bits of each document by the shares of all bytes, cut off."""
    documents = _documents(spark, sf_dir)
    found = {r["sym"]: r["share"] for r in entropy.floor_shares(entropy.byte_counts(documents), PRECISION).collect()}
    made = entropy.Table(PRECISION, tuple(int(found.get(s, 0)) for s in range(entropy.SYMBOLS)))
    return entropy.estimated_bits(documents, made).select("doc_id", tidy(F.col("bits"), 2).alias("bits"))


SQL["bits_estimate"] = f"""WITH {_BYTES}, cost AS (SELECT doc_id, -sum(log2(share / 4096.0)) AS bits FROM bytes JOIN shares USING (sym) GROUP BY doc_id)
SELECT doc_id, {sql_tidy('coalesce(bits, 0)', 2)} AS bits FROM documents LEFT JOIN cost USING (doc_id)"""


def _fields(documents):
    d = F.col("doc_id")
    steps = F.array((d % 200 - 100).cast("int"), (d % 7).cast("int"), F.lit(-128), F.lit(127))
    return documents.select("doc_id", (d % 47).alias("gen_id"), (d % 5 * 1000).alias("qv_id"), (d * 7919 % 4294967296).alias("seed"), (d % 4).alias("flags"), steps.alias("steps"))


@query
def pack_symbols(spark, sf_dir):
    rows = _fields(_documents(spark, sf_dir))
    packed = entropy.pack_symbols(*[F.col(c) for c in ("gen_id", "qv_id", "seed", "flags", "steps")])
    back = rows.withColumn("packed", packed).withColumn("u", entropy.unpack_symbols(F.col("packed")))
    same = (F.col("u.gen_id") == F.col("gen_id")) & (F.col("u.qv_id") == F.col("qv_id")) & (F.col("u.seed") == F.col("seed")) & (F.col("u.flags") == F.col("flags")) & (F.col("u.steps") == F.col("steps"))
    return back.select("doc_id", F.array_join(F.col("packed").cast("array<string>"), ",").alias("packed"), same.alias("same"))


SQL["pack_symbols"] = """WITH f AS (SELECT doc_id, doc_id % 47 AS g, doc_id % 5 * 1000 AS q, doc_id * 7919 % 4294967296 AS s, doc_id % 4 AS f, doc_id % 200 + 28 AS a, doc_id % 7 + 128 AS b FROM documents)
SELECT doc_id, array_to_string([240, g & 255, g >> 8, q & 255, q >> 8, f, s & 255, (s >> 8) & 255, (s >> 16) & 255, (s >> 24) & 255, 4, a, b, 0, 255], ',') AS packed, true AS same FROM f"""


def _coded(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    made = entropy.build_table(entropy.byte_counts(documents), PRECISION)
    if documents.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        # Coding takes far longer than moving: a table of few row groups is dealt over all cores.
        documents = documents.repartition(spark.sparkContext.defaultParallelism)
    raw = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return entropy.encode_column(raw, made, "documents", "raw", "coded"), made


@query
def rans_roundtrip(spark, sf_dir):
    """Each document coded and decoded: the digest of what comes back."""
    coded, made = _coded(spark, sf_dir)
    back = entropy.decode_column(coded.select("doc_id", "coded"), {"documents": made}, "coded", "back")
    return back.select("doc_id", F.sha2("back", 256).alias("sha256"))


SQL["rans_roundtrip"] = "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents"


@query
def rans_sizes(spark, sf_dir):
    coded, _ = _coded(spark, sf_dir)
    return coded.select("doc_id", F.octet_length("raw").alias("raw_bytes"), F.octet_length("coded").alias("coded_bytes"))


def _records(spark, sf_dir):
    """Documents as records: ten to an image, the whole text as payload."""
    d = F.col("doc_id")
    rows = _documents(spark, sf_dir).select(
        F.expr("doc_id div 10").alias("img"), (d % 10).alias("tile_id"), (d % 47).alias("gen_id"), (d % 9).alias("qv_id"), (d * 7919 % 4294967296).alias("seed"), (d % 2).alias("rec_flags"),
        F.lit(bitstream.RAW).alias("payload_fmt"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"),
    )
    header = F.concat(F.lit('{"width":'), (F.col("img") + 1).cast("string"), F.lit(',"height":64,"tile":32,"overlap":8}'))
    return rows, rows.select("img").distinct().withColumn("header", header)


@query
def stream_roundtrip(spark, sf_dir):
    """Framed and parsed again: the fields of every record."""
    parsed = bitstream.parse_images(bitstream.pack_images(*_records(spark, sf_dir)))
    return parsed.select("img", "width", "tile_id", "gen_id", "qv_id", "seed", "rec_flags", F.hex("payload").alias("payload"), "error")


SQL["stream_roundtrip"] = """SELECT doc_id // 10 AS img, (doc_id // 10 + 1)::INT AS width, doc_id % 10 AS tile_id, (doc_id % 47)::INT AS gen_id, (doc_id % 9)::INT AS qv_id, doc_id * 7919 % 4294967296 AS seed, (doc_id % 2)::INT AS rec_flags,
  hex(encode(coalesce(text, ''))) AS payload, NULL::VARCHAR AS error FROM documents"""


@query
def crc32_records(spark, sf_dir):
    rows, _ = _records(spark, sf_dir)
    packed = bitstream.packed_record(*[F.col(f) for f in bitstream.Record._fields])
    return rows.select("img", "tile_id", F.octet_length(packed).alias("bytes"), F.crc32(packed).alias("crc32"))


_LE = lambda value, width: " || ".join(f"printf('%02X', (({value}) >> {8 * k}) & 255)" for k in range(width))
#: A checksum in SQL: byte by byte over the hex digits, eight shifts for a byte.
SQL["crc32_records"] = f"""WITH r AS (
  SELECT doc_id // 10 AS img, doc_id % 10 AS tile_id, hex(encode(coalesce(text, ''))) AS p, {_LE('doc_id % 10', 4)} || {_LE('doc_id % 47', 2)} || {_LE('doc_id % 9', 2)} || {_LE('doc_id * 7919 % 4294967296', 4)} || {_LE('doc_id % 2', 2)} || '01' AS head
  FROM documents
), b AS (
  SELECT img, tile_id, head || {_LE('length(p) // 2', 4)} || p AS h FROM r
), c AS (
  SELECT img, tile_id, length(h) // 2 + 4 AS bytes, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS l FROM b
), d AS (
  SELECT img, tile_id, bytes, xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) AS body FROM c
), e AS (
  SELECT img, tile_id, bytes, body, [body & 255, (body >> 8) & 255, (body >> 16) & 255, (body >> 24) & 255] AS l FROM d
)
SELECT img, tile_id, bytes::INT AS bytes, xor(list_reduce(list_prepend(xor(body, 4294967295), l), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) AS crc32 FROM e"""


def _old_blobs(spark, sf_dir):
    rows, _ = _records(spark, sf_dir)

    def pack(key, frame):
        records = [bitstream.Record(*r) for r in frame.sort_values("tile_id")[list(bitstream.Record._fields)].itertuples(index=False)]
        return frame.iloc[:1][["img"]].assign(blob=bitstream.pack_old(64, 64, 32, 8, records, meta={"img": int(key[0])}))

    return rows.groupBy("img").applyInPandas(pack, "img long, blob binary")


@query
def legacy_roundtrip(spark, sf_dir):
    parsed = bitstream.parse_images(_old_blobs(spark, sf_dir), old=True)
    return parsed.select("img", "width", "tile_id", "gen_id", "qv_id", "seed", "rec_flags", F.hex("payload").alias("payload"), "error")


SQL["legacy_roundtrip"] = SQL["stream_roundtrip"].replace("(doc_id // 10 + 1)::INT AS width", "64::INT AS width")


@query
def corrupt_rejected(spark, sf_dir):
    """Blobs with a byte changed or an end cut off, and whether each was turned away."""
    blobs = bitstream.pack_images(*_records(spark, sf_dir))
    size = F.octet_length("blob")
    at = F.pmod(F.col("img") * 31, size - 1).cast("int")
    changed = F.concat(F.expr("substring(blob, 1, cast(pmod(img * 31, octet_length(blob) - 1) as int))"), F.unhex(F.lpad(F.hex(255 - F.conv(F.hex(F.substring("blob", at + 1, F.lit(1))), 16, 10).cast("long")), 2, "0")), F.expr("substring(blob, cast(pmod(img * 31, octet_length(blob) - 1) as int) + 2)"))
    cut = F.expr("substring(blob, 1, octet_length(blob) - 3)")
    bad = blobs.select("img", F.when(F.col("img") % 2 == 0, changed).otherwise(cut).alias("blob"))
    return bitstream.parse_images(bad).select("img", F.col("error").isNotNull().alias("rejected"))


SQL["corrupt_rejected"] = "SELECT DISTINCT doc_id // 10 AS img, true AS rejected FROM documents"


@query
def generators_hist(spark, sf_dir):
    """Records per generator, after a round through the framing."""
    parsed = bitstream.parse_images(bitstream.pack_images(*_records(spark, sf_dir)))
    return parsed.groupBy("gen_id").agg(F.count("*").alias("n"))


SQL["generators_hist"] = "SELECT (doc_id % 47)::INT AS gen_id, count(*) AS n FROM documents GROUP BY 1"


@query
def looks_like_stream(spark, sf_dir):
    """Whether framed images, texts and cut-off blobs can be streams."""
    blobs = bitstream.pack_images(*_records(spark, sf_dir)).select("img", "blob")
    kinds = F.array(F.col("blob"), F.substring("blob", 1, 8), F.substring("blob", 2, 100))
    return blobs.select("img", F.posexplode(kinds).alias("kind", "b")).select("img", "kind", bitstream.is_stream(F.col("b")).alias("yes"))


SQL["looks_like_stream"] = "SELECT DISTINCT doc_id // 10 AS img, k::INT AS kind, k = 0 AS yes FROM documents, range(3) r(k)"


@query
def sql_unpack_records(spark, sf_dir):
    """Framed images taken apart by a table function, in SQL."""
    table_functions.register(spark)
    blobs = bitstream.pack_images(*_records(spark, sf_dir))
    return spark.sql(
        """SELECT b.img, r.width, r.tile_id, r.gen_id, r.qv_id, r.seed, r.rec_flags, hex(r.payload) AS payload, r.error
           FROM {blobs} b, LATERAL unpack_records(b.blob) r""", blobs=blobs,
    )


SQL["sql_unpack_records"] = SQL["stream_roundtrip"]


@query
def rans_by_lang(spark, sf_dir):
    """Each document coded by the table of its language, side by side, and decoded: the id in its
    stream, and the digest of what comes back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    tables = entropy.build_tables(documents, "lang", "raw", PRECISION)
    coded = entropy.encode_by_table(documents, tables, "lang", "raw", "coded")
    named = F.decode(F.expr("substring(coded, 6, cast(conv(hex(substring(coded, 5, 1)), 16, 10) as int))"), "utf-8")
    back = entropy.decode_column(coded.select("doc_id", "coded", named.alias("id")), tables, "coded", "back")
    return back.select("doc_id", "id", F.sha2("back", 256).alias("sha256"))


SQL["rans_by_lang"] = "SELECT doc_id, lang AS id, sha256(coalesce(text, '')) AS sha256 FROM documents"
