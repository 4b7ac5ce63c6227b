"""Tiling, search, entropy coding, framing and workflow: round trips and invariants."""

import itertools
import json
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import bitstream, codec, entropy, metrics, quantize, search, tiling, workflow
from tessella.sources import raster, streams
from tessella.streaming.runs import run_new_files


def test_grids_cover_and_agree(spark):
    dims = spark.createDataFrame([(i, h, w) for i, (h, w) in enumerate([(64, 64), (31, 100), (5, 7), (33, 32), (1, 1)])], "img int, h int, w int")
    for size, overlap in ((32, 8), (16, 0), (10, 9)):
        both = [tiling.tiles(dims, size, overlap, c).collect() for c in (False, True)]
        for d in dims.collect():
            counts = [[t for t in b if t["img"] == d["img"]] for b in both]
            assert len(counts[0]) == len(counts[1])
            for rows in counts:
                seen = {(y, x) for t in rows for y in range(t["y0"], t["y1"]) for x in range(t["x0"], t["x1"])}
                assert len(seen) == d["h"] * d["w"] and sorted(t["tile_id"] for t in rows) == list(range(len(rows)))


def image(spark, values):
    h, w = values.shape
    return spark.createDataFrame([(0, y, x, float(values[y, x])) for y in range(h) for x in range(w)], "img long, y int, x int, v double")


def test_blend_of_equal_tiles_is_the_image(spark):
    values = np.random.default_rng(1).uniform(-1, 1, (40, 40))
    dims = spark.createDataFrame([(0, 40, 40)], "img long, h int, w int")
    rows = tiling.tile_pixels(image(spark, values), dims, 16, 4)
    for kind in ("hann", "tukey"):
        out = {(r["y"], r["x"]): r["v"] for r in tiling.blend(rows, 16, 4, kind).collect()}
        inner = [(y, x) for y in range(1, 39) for x in range(1, 39)]
        assert max(abs(out[p] - values[p]) for p in inner) < 1e-4


def test_ssim_forms_agree(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(-1, 1, (20, 23))
    b = a + rng.normal(0, 0.1, a.shape)
    pairs = spark.createDataFrame([(0, y, x, float(a[y, x]), float(b[y, x])) for y in range(20) for x in range(23)], "img int, y int, x int, a double, b double")
    assert metrics.ssim(pairs).first()["ssim"] == pytest.approx(float(metrics.ssim_of(a, b)))
    assert metrics.ssim_of(a, a) == pytest.approx(1.0)
    same = pairs.withColumn("b", F.col("a"))
    assert metrics.psnr(same).first()["psnr"] == pytest.approx(120.0)


def test_search_finds_what_was_drawn(spark):
    made = codec.draw(24, 24, 7, 60, 90)
    dims = spark.createDataFrame([(0, 24, 24)], "img long, h int, w int")
    scored = search.scores(tiling.tile_pixels(image(spark, made), dims, 24, 0, clipped=True))
    best = search.best(scored, F.lit(1.0), 0.02).first()
    assert (best["freq"], best["ang"], best["phase"]) == (7, 60, 90) and best["d"] < 1e-12
    seam = search.scores(tiling.tile_pixels(image(spark, made), dims, 24, 0, clipped=True), 0.5, 24, 4)
    plain = {r["cand_id"]: r["d"] for r in scored.collect()}
    assert all(r["d"] >= plain[r["cand_id"]] - 1e-12 for r in seam.collect())


def test_encode_decode(spark):
    made = codec.draw(48, 48, 4, 30, 180)
    images = raster.wide(image(spark, made))
    config = codec.CodecConfig(tile=48, overlap=0, seed=9)
    coded = codec.encode(images, config)
    row = coded.first()
    header, records = bitstream.unpack_stream(bytes(row["blob"]))
    assert (header["width"], header["height"], header["tile"], len(records)) == (48, 48, 48, 1) and row["bpp"] == pytest.approx(8 * len(row["blob"]) / 48**2)
    assert len(records[0].payload) == 38
    name, stream = entropy.unframe_stream(records[0].payload)
    assert list(entropy.decode_bytes(stream, entropy.UNIFORM)[11:]) == [128, 129, 130]
    assert coded.first()["blob"] == codec.encode(images, config).first()["blob"]
    back = {(r["y"], r["x"]): r["v"] for r in codec.decode(coded, by="symbols").collect()}
    assert max(abs(back[y, x] - made[y, x]) for y in range(48) for x in range(48)) < 1e-6
    drawn = {(r["y"], r["x"]): r["v"] for r in codec.decode(coded).collect()}
    s = records[0].seed
    want = codec.draw(48, 48, 3 + s % 9, s // 7 % 180, (s >> 8) % 360)
    assert max(abs(drawn[y, x] - want[y, x]) for y in range(48) for x in range(48)) < 1e-6
    raw = codec.encode(images, codec.CodecConfig(tile=48, overlap=0, payload="raw")).first()
    assert bitstream.unpack_stream(bytes(raw["blob"]))[1][0].payload == b"raw"


def test_decode_by_each_header(spark):
    """Images of several tile sizes are decoded together; each as alone."""
    images = raster.wide(image(spark, codec.draw(40, 48, 4, 30, 180)))
    coded = [codec.encode(images.withColumn("img", F.lit(n).cast("long")), codec.CodecConfig(tile=t, overlap=o, seed=5)) for n, (t, o) in enumerate(((48, 0), (16, 4), (24, 8)))]
    together = coded[0].union(coded[1]).union(coded[2])
    for by in ("seed", "symbols"):
        found = {(r["img"], r["y"], r["x"]): r["v"] for r in codec.decode(together, by).collect()}
        alone = {(r["img"], r["y"], r["x"]): r["v"] for one in coded for r in codec.decode(one, by).collect()}
        assert len(found) == 3 * 40 * 48 and found == pytest.approx(alone)


def test_decode_tells_what_it_cannot(spark):
    images = raster.wide(image(spark, codec.draw(16, 16, 4, 30, 180)))
    good = bytes(codec.encode(images, codec.CodecConfig(tile=16, overlap=0)).first()["blob"])
    raw = bytes(codec.encode(images, codec.CodecConfig(tile=16, overlap=0, payload="raw")).first()["blob"])
    header, (record,) = bitstream.unpack_stream(good)
    framed = lambda payload, h=header: bitstream.pack_header(h) + bitstream.pack_records([record._replace(payload=payload)])
    table, stream = entropy.unframe_stream(record.payload)
    other = entropy.frame_stream(entropy.encode_bytes(b"\1" + b"\0" * 20, entropy.UNIFORM), table)
    cases = {
        0: good, 1: raw, 2: b"nothing", 3: framed(b"ANS"), 4: framed(entropy.frame_stream(stream, "missing")), 5: framed(entropy.frame_stream(stream[:-2], table)), 6: framed(other), 7: framed(record.payload, header | {"tile": 0}), 8: None,
    }
    blobs = spark.createDataFrame([(k, v) for k, v in cases.items()], "img long, blob binary")
    by_seed = {r["img"]: r["error"] for r in codec.problems(blobs).collect()}
    assert by_seed.keys() == {2, 3, 4, 5, 6, 7, 8} and "missing" in by_seed[4] and "early" in by_seed[5] and "symbols" in by_seed[6] and "sizes" in by_seed[7]
    by_symbols = {r["img"]: r["error"] for r in codec.problems(blobs, by="symbols").collect()}
    assert by_symbols.keys() == {*by_seed, 1} and "RAW" in by_symbols[1]
    assert {r["img"] for r in codec.decode(blobs, lenient=True).collect()} == {0, 1}
    assert {r["img"] for r in codec.decode(blobs, by="symbols", lenient=True).collect()} == {0}
    with pytest.raises(Exception, match="image 1: a RAW tile holds no steps"):
        codec.decode(blobs.filter("img < 2"), by="symbols").collect()


def test_rates_of_candidates(spark):
    """Under the uniform table a symbol costs 8 bits; exact bits are those of the framed payload."""
    images = raster.wide(image(spark, codec.draw(16, 16, 4, 30, 180)))
    found = {b: codec.search_tiles(images, codec.CodecConfig(tile=16, overlap=0, bits=b)).first() for b in ("table", "exact")}
    assert found["table"]["bits"] == 8 * 14 and found["exact"]["bits"] == 8 * 38
    assert found["table"]["cand_id"] == found["exact"]["cand_id"] and found["table"]["payload"] == found["exact"]["payload"]


def test_tables_by_id(spark, tmp_path):
    own, models = tmp_path / "own", tmp_path / "models"
    (models / "rans").mkdir(parents=True)
    own.mkdir()
    (own / "a.json").write_text(json.dumps({"counts": [1, 1], "precision_bits": 4}))
    (models / "rans" / "a.json").write_text(json.dumps({"counts": [3, 1], "precision_bits": 4}))
    (models / "rans" / "b.json").write_text(json.dumps({"freqs": [16] + [0] * 255, "precision": 4}))
    roots = entropy.table_roots({"TESSELLA_RANS_TABLES": str(own), "TESSELLA_MODELS_DIR": str(models)})
    assert [tuple(r) for r in entropy.available_tables(spark, roots).collect()] == [("a", 0), ("b", 1), ("v15_default", 2)]
    found = entropy.load_tables(spark, ["a", "b", "v15_default"], roots)
    assert found["a"].freqs[:2] == (8, 8) and found["b"].freqs[0] == 16 and found["v15_default"] == entropy.UNIFORM
    assert entropy.load_tables(spark, ["a"], roots[1:])["a"].freqs[:2] == (12, 4)
    with pytest.raises(FileNotFoundError):
        entropy.load_tables(spark, ["c"], [*roots, str(tmp_path / "no such folder")])


def test_many_payloads_side_by_side():
    draw = random.Random(7)
    payloads = [bytes(draw.choices(b"abcdef", weights=(9, 7, 5, 3, 2, 1), k=draw.choice((0, 1, 2, 30, 31, 400, 5000)))) for _ in range(90)]
    counts = [sum(p.count(s) for p in payloads) for s in range(256)]
    made = entropy.normalised(counts, 12)
    coded = entropy.encode_many(payloads, made)
    assert coded == [entropy.encode_bytes(p, made) for p in payloads] and entropy.decode_many(coded, made) == payloads
    cut = [c[:-2] if i % 3 == 0 and len(c) > 8 else c for i, c in enumerate(coded)]
    for p, c, w, back in zip(payloads, cut, coded, entropy.decode_many(cut, made)):
        assert back == p if c == w else back is None or back != p
    assert entropy.decode_many([b"", b"1234567", coded[0]], made)[:2] == [None, None]


@pytest.mark.parametrize(("freqs", "precision"), [([4095, 1], 12), ([2048, 2048], 12), ([65535, 1], 16), ([15, 1], 4), ([4096], 12), ([1] * 256, 8)])
def test_counts_that_a_stream_cannot_hold(freqs, precision):
    """Whatever an encoder makes is decoded; counts beyond what a stream can hold are told apart before anything is made."""
    made = entropy.Table(precision, tuple(freqs + [0] * (256 - len(freqs))))
    payloads = [bytes(n) for n in (0, 1, 1000, 60_000)] + [bytes([len(freqs) - 1]) * 50]
    coded = entropy.encode_many(payloads, made)
    assert entropy.decode_many(coded, made) == payloads
    hostile = [(0xFFFFFFFF).to_bytes(4, "little") + c[4:] for c in coded]
    assert entropy.decode_many(hostile, made) == [None] * len(coded)
    assert entropy.decode_many([hostile[0], *coded], made) == [None, *payloads]


def test_a_table_for_each_payload(spark):
    """Payloads of several tables and precisions side by side are coded as alone; rows without a table are null."""
    draw, made = random.Random(3), [entropy.UNIFORM]
    for precision in (9, 12, 15):
        made.append(entropy.normalised([draw.choice((0, 1, 5, 90)) + (s < 3) for s in range(256)], precision))
    which, payloads = [], []
    for _ in range(120):
        k = draw.randrange(4)
        payloads.append(bytes(draw.choices([s for s in range(256) if made[k].freqs[s]], k=draw.choice((0, 1, 5, 300, 3000)))))
        which.append(k)
    coded = entropy.encode_many(payloads, made, np.array(which))
    assert coded == [entropy.encode_bytes(p, made[k]) for p, k in zip(payloads, which)]
    assert entropy.decode_many(coded, made, np.array(which)) == payloads
    tables = {f"t{n}": t for n, t in enumerate(made)}
    rows = spark.createDataFrame([(n, f"t{k}", p) for n, (p, k) in enumerate(zip(payloads, which))] + [(900, "none", b"abc"), (901, None, b"abc"), (902, "t0", None)], "n int, id string, raw binary")
    streams = entropy.encode_by_table(rows, tables, "id", "raw", "coded")
    back = {r["n"]: (r["id"], r["raw"], r["back"]) for r in entropy.decode_column(streams, tables, "coded", "back").collect()}
    assert all(back[n][1] == back[n][2] for n in range(120)) and all(back[n][2] is None for n in (900, 901, 902))
    other = entropy.encode_by_table(rows, tables, "id", "raw", "coded", default="t0").filter("n in (900, 901)").collect()
    assert [entropy.unframe_stream(bytes(r["coded"]))[0] for r in other] == ["t0", "t0"]
    by_id = entropy.build_tables(rows.filter("n < 900"), "id", "raw")
    for name, own in by_id.items():
        joined = b"".join(p for p, k in zip(payloads, which) if f"t{k}" == name)
        assert own == entropy.normalised([joined.count(s) for s in range(256)], 12)


def test_hostile_counts_in_columns_and_images(spark):
    images = raster.wide(image(spark, codec.draw(16, 16, 4, 30, 180)))
    good = bytes(codec.encode(images, codec.CodecConfig(tile=16, overlap=0)).first()["blob"])
    header, (record,) = bitstream.unpack_stream(good)
    table, stream = entropy.unframe_stream(record.payload)
    payload = entropy.frame_stream(b"\xff" * 4 + stream[4:], table)
    bad = bitstream.pack_header(header) + bitstream.pack_records([record._replace(payload=payload)])  # its checksum is right
    blobs = spark.createDataFrame([(0, good), (1, bad)], "img long, blob binary")
    assert {r["img"]: r["error"] for r in codec.problems(blobs).collect()}.keys() == {1} and "early" in codec.problems(blobs).first()["error"]
    assert {r["img"] for r in codec.decode(blobs, lenient=True).collect()} == {0}
    column = spark.createDataFrame([(0, payload), (1, record.payload)], "k long, c binary")
    found = {r["k"]: (r["back"], r["error"]) for r in entropy.decode_column(column, {table: entropy.UNIFORM}, "c", "back", "error").collect()}
    assert found[0] == (None, "the stream ends early") and found[1][1] is None


def test_a_few_long_payloads_among_many_short_ones():
    """Memory goes with the bytes, not with the longest payload times their number."""
    import tracemalloc

    draw = random.Random(1)
    payloads = [bytes(draw.choices(b"abcdef", k=75_000)) for _ in range(24)] + [b"abcabcdefa" * 20] * 9_976
    made = entropy.normalised([sum(p.count(s) for p in payloads) for s in range(256)], 12)
    coded = entropy.encode_many(payloads, made)
    tracemalloc.start()
    assert entropy.decode_many(coded, made) == payloads
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_table_normalisation():
    draw = random.Random(3)
    for precision, present in itertools.product((8, 9, 12, 15), (1, 2, 17, 200, 256)):
        counts = [0] * 256
        for s in draw.sample(range(256), present):
            counts[s] = draw.choice((1, 2, 50, 10**6))
        made = entropy.normalised(counts, precision)
        assert sum(made.freqs) == 1 << precision and made.cdf[-1] == 1 << precision
        assert all(f >= 1 for f, c in zip(made.freqs, counts) if c)
    assert entropy.normalised([0] * 256, 4).freqs[0] == 16
    assert entropy.table_from({"kind": "byte_256_uniform"}) == entropy.UNIFORM
    assert sum(entropy.table_from({"counts": [3, 1], "precision_bits": 4}).freqs) == 16


def test_coder_round_trip():
    draw = random.Random(4)
    for data in (b"", b"a", bytes(range(256)) * 3, bytes(draw.choices(b"abcd", weights=(90, 5, 4, 1), k=5000))):
        counts = [data.count(s) for s in range(256)]
        made = entropy.normalised(counts, 12) if data else entropy.UNIFORM
        coded = entropy.encode_bytes(data, made)
        assert entropy.decode_bytes(coded, made) == data
    assert len(coded) < 1000
    with pytest.raises(ValueError):
        entropy.decode_bytes(coded[:40], made)
    with pytest.raises(ValueError):
        entropy.encode_bytes(b"\0", entropy.Table(1, (0, 2) + (0,) * 254))
    with pytest.raises(ValueError):
        entropy.unframe_stream(b"nothing")


def test_symbols_out_of_range(spark):
    good = spark.createDataFrame([(1, 2, 3, 0, [0])], "g int, q int, s long, f int, o array<int>")
    packed = entropy.pack_symbols(*[F.col(c) for c in "gqsf"], F.col("o"))
    assert good.select(packed.alias("p")).first()["p"] == [240, 1, 0, 2, 0, 0, 3, 0, 0, 0, 1, 128]
    for bad in ((70000, 0, 0, 0, [0]), (0, 0, -1, 0, [0]), (0, 0, 0, 0, [200])):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([bad], good.schema).select(packed).collect()
    with pytest.raises(Exception, match="not the symbols"):
        spark.createDataFrame([([240, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3, 1],)], "p array<int>").select(entropy.unpack_symbols(F.col("p"))).collect()


RECORDS = [bitstream.Record(0, 1, 2, 4294967295, 3, 0, b"abc"), bitstream.Record(1, 65535, 0, 0, 0, 1, b"")]


def test_framing_forms_agree(spark):
    header = {"width": 4, "height": 5, "tile": 6, "overlap": 1, "é": ["x"]}
    whole = bitstream.pack_header(header) + bitstream.pack_records(RECORDS)
    rows = spark.createDataFrame([(7, *r[:6], bytearray(r.payload)) for r in RECORDS], "img long, tile_id long, gen_id int, qv_id int, seed long, rec_flags int, payload_fmt int, payload binary")
    heads = spark.createDataFrame([(7, json.dumps(header, separators=(",", ":"), ensure_ascii=False))], "img long, header string")
    assert bytes(bitstream.pack_images(rows, heads).first()["blob"]) == whole
    assert bitstream.unpack_stream(whole) == (header, RECORDS)
    assert whole[:4] == bitstream.MAGIC and struct.unpack(">H", whole[4:6])[0] == 15
    assert struct.unpack("<I", whole[-4:])[0] == zlib.crc32(whole[-23:-4])
    old = bitstream.pack_old(4, 5, 6, 1, RECORDS, meta={"a": 1})
    found, records = bitstream.unpack_old(old)
    assert records == RECORDS and found["meta"] == {"a": 1} and found["width"] == 4


def test_every_damage_is_noticed():
    for blob, parse in ((bitstream.pack_header({"width": 1}) + bitstream.pack_records(RECORDS), bitstream.unpack_stream), (bitstream.pack_old(1, 1, 1, 0, RECORDS), bitstream.unpack_old)):
        for i in range(len(blob)):
            for bad in (blob[:i], blob[:i] + bytes([blob[i] ^ 255]) + blob[i + 1 :]):
                # The spare field of the older footer is covered by nothing.
                if parse is bitstream.unpack_old and len(bad) == len(blob) and len(blob) - 8 <= i < len(blob) - 4:
                    continue
                with pytest.raises((ValueError, struct.error)):
                    parse(bad)


def test_data_source(spark, tmp_path):
    streams.register(spark)
    blobs = [("one", bitstream.pack_header({"width": 4, "height": 5, "tile": 6, "overlap": 1}) + bitstream.pack_records(RECORDS)), ("bad", b"nothing")]
    frame = spark.createDataFrame([(n, bytearray(b)) for n, b in blobs], "name string, blob binary")
    frame.write.format("tiled_images").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad.img", "one.img"]
    rows = spark.read.format("tiled_images").load(str(tmp_path)).collect()
    assert sorted((r["tile_id"], r["gen_id"]) for r in rows if r["error"] is None) == [(0, 1), (1, 65535)] and sum(r["error"] is not None for r in rows) == 1


def test_stream_of_files_resumes(spark, tmp_path):
    source, out, memory = tmp_path / "in", tmp_path / "out", tmp_path / "memory"
    source.mkdir()
    for n, want in (("a.png", {"a"}), ("b.png", {"a", "b"})):
        (source / n).write_bytes(n.encode())
        run_new_files(spark, str(source), str(out), str(memory), lambda row: bytes(row["content"]) * 2).awaitTermination()
        rows = spark.read.parquet(str(out)).collect()
        assert {r["id"] for r in rows} == want and len(rows) == len(want)
    assert all(r["state"] == "done" and r["size"] == 10 for r in rows)


def test_scan_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.PNG", "sub/b.jpg", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert {r["path"].rpartition("/")[2] for r in raster.scan_images(spark, str(tmp_path)).collect()} == {"a.PNG", "b.jpg"}


def test_luma(spark, tmp_path):
    import struct as s
    import zlib as z

    def chunk(kind, body):
        return s.pack(">I", len(body)) + kind + body + s.pack(">I", z.crc32(kind + body))

    pixels = [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (255, 255, 255)]]
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in pixels)
    (tmp_path / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", s.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", z.compress(raw)) + chunk(b"IEND", b""))
    row = raster.load_luma(spark, str(tmp_path)).first()
    assert (row["h"], row["w"]) == (2, 2) and row["data"] == pytest.approx([v / 127.5 - 1 for v in (76, 150, 29, 255)])


def test_codebook_round_trip():
    book = [[0.5, -1.25], [2.0, 3.0], [0.0, 8.5]]
    assert quantize.unpack_codebook(quantize.pack_codebook(book)) == book
    with pytest.raises(ValueError):
        quantize.unpack_codebook(quantize.pack_codebook(book)[:-1])


def test_training_finds_clusters(spark):
    rng = np.random.default_rng(123)
    points = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in ((0, 0), (3, 3), (0, 3))])
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    book = quantize.train(frame, 3, iterations=15, seed=123)
    assert sorted(np.round(book, 0).tolist()) == [[0.0, 0.0], [0.0, 3.0], [3.0, 3.0]]
    assert quantize.assign(frame, book).agg(F.avg("d2")).first()[0] < 0.12**2 * 2


def test_run_config():
    made = workflow.RunConfig.merged({"lambda": 0.5, "tile": 64, "unknown": 1}, {"TESSELLA_TILE": "128"})
    assert made == workflow.RunConfig(tile=128, rate_weight=0.5)
    with pytest.raises(ValueError):
        codec.CodecConfig(tile=8, overlap=8)


def test_rate_curve(spark):
    rows = spark.createDataFrame([("0.5", "30"), ("x", "1"), (None, "2"), ("0.1", "20")], "bpp string, psnr string")
    assert [tuple(r) for r in workflow.rate_curve(rows).collect()] == [(0.1, 20.0), (0.5, 30.0)]


def test_coding_takes_few_times_the_bytes_of_its_payloads():
    payloads = [bytes(np.random.default_rng(n).integers(0, 200, 1000, dtype=np.uint8)) for n in range(1000)]
    made = entropy.normalised(np.bincount(np.frombuffer(b"".join(payloads), dtype=np.uint8), minlength=256).tolist(), 12)
    tracemalloc.start()
    streams_ = entropy.encode_many(payloads, made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * 1_000_000 and entropy.decode_many(streams_, made) == payloads


def test_decoding_deals_records_by_number_not_by_bytes(spark):
    blobs = spark.createDataFrame([(0, b"")], "img long, blob binary")
    assert "REPARTITION_BY_NUM" in codec.decode(blobs)._jdf.queryExecution().executedPlan().toString()
