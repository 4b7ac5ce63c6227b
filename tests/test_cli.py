"""The commands, end to end, on two small images."""

import struct
import zlib

from tessella import cli


def png(path, shade):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + bytes(shade(y, x) for x in range(16)) for y in range(16))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_commands(spark, tmp_path):
    source, coded, made = tmp_path / "in", tmp_path / "coded", tmp_path / "made"
    source.mkdir()
    assert cli.main(["encode", str(source), str(coded)], spark) == 2
    png(source / "a.png", lambda y, x: 16 * x)
    png(source / "b.png", lambda y, x: 255 * ((x + y) % 2))
    assert cli.main(["encode", str(source), str(tmp_path / "plan"), "--only-plan"], spark) == 0
    assert {r["id"] for r in spark.read.json(str(tmp_path / "plan/manifest")).collect()} == {"a", "b"}
    assert {r["state"] for r in cli.read_manifest(spark, str(tmp_path / "plan")).collect()} == {"todo"}
    assert cli.main(["encode", str(source), str(coded), "--tile", "16", "--overlap", "0"], spark) == 0
    assert sorted(p.name for p in coded.glob("*.img")) == ["a.img", "b.img"]
    for by in ("seed", "symbols"):
        assert cli.main(["decode", str(coded), str(made), "--by", by, "--format", "parquet"], spark) == 0
        assert spark.read.parquet(str(made)).groupBy("name").count().collect() and spark.read.parquet(str(made)).count() == 512
    assert cli.main(["metrics", str(made), str(made), str(tmp_path / "csv")], spark) == 0
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert {(r["ref"], r["psnr"], r["ssim"]) for r in rows} == {("a", "120.000", "1.00000"), ("b", "120.000", "1.00000")}
    for kind in ("csv", "json"):
        assert cli.main(["audit", str(tmp_path / kind), "--format", kind], spark) == 0


def test_a_bad_image_and_a_second_run(spark, tmp_path, capsys):
    """A file that can't be read is an error in the manifest; a second run codes only what has no output."""
    source, coded, drawn = tmp_path / "in", tmp_path / "coded", tmp_path / "drawn"
    source.mkdir()
    png(source / "a.png", lambda y, x: 16 * x)
    (source / "broken.png").write_bytes(b"no image")
    assert cli.main(["encode", str(source), str(coded), "--tile", "16", "--overlap", "0"], spark) == 1
    state = {r["id"]: (r["state"], r["size"] is not None, r["error"] is not None) for r in cli.read_manifest(spark, str(coded)).collect()}
    assert state == {"a": ("done", True, False), "broken": ("error", False, True)}
    first = (coded / "a.img").stat().st_mtime_ns
    png(source / "broken.png", lambda y, x: 8 * y)
    assert cli.main(["encode", str(source), str(coded), "--tile", "8", "--overlap", "0"], spark) == 0
    assert (coded / "a.img").stat().st_mtime_ns == first and (coded / "broken.img").exists()
    assert {r["state"] for r in cli.read_manifest(spark, str(coded)).collect()} == {"done"}
    # Two tile sizes, and a damaged file: the others are drawn, the exit code tells.
    (coded / "bad.img").write_bytes((coded / "a.img").read_bytes()[:-3])
    assert cli.main(["decode", str(coded), str(drawn)], spark) == 1
    assert "bad:" in capsys.readouterr().err and sorted(p.name for p in drawn.glob("*.png")) == ["a.png", "broken.png"]
    (coded / "bad.img").unlink()
    assert cli.main(["decode", str(coded), str(drawn)], spark) == 0
    assert cli.main(["metrics", str(source), str(drawn), str(tmp_path / "csv"), "--images", "--coded", str(coded)], spark) == 0
    rows = {r["ref"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert rows.keys() == {"a", "broken"} and float(rows["a"]["bpp"]) == round(8 * (coded / "a.img").stat().st_size / 256, 4)


def test_a_run_that_keeps_going(spark, tmp_path, monkeypatch):
    """A file that is no image, an image that can't be coded, a junk output and a run that is stopped: the others are
    done, and a later run does what is left and nothing else."""
    import hashlib

    import numpy as np
    import pytest

    from tessella.operators import bitstream, metrics

    def fussy(a, b):
        if a.max() >= 1:  # a white pixel
            raise ValueError("too white")
        return ((a - b) ** 2).mean(axis=(-1, -2))

    monkeypatch.setitem(metrics.METRICS, "fussy", metrics.Metric("fussy", arrays=fussy))
    source, coded = tmp_path / "in", tmp_path / "coded"
    for n, folder in enumerate(("a", "b", "c")):
        (source / folder).mkdir(parents=True)
        png(source / folder / "x.png", lambda y, x, n=n: (15 * x, 15 * y, 240 * ((x // 2 + y) % 2))[n])  # one name, three images
    png(source / "white.png", lambda y, x: 255)
    (source / "broken.png").write_bytes(b"no image")
    call = ["encode", str(source), str(coded), "--tile", "8", "--overlap", "0", "--metric", "fussy", "--batch", "2"]

    def stopped(*given, real=cli._encode_batch, calls=[]):  # noqa: B006
        calls.append(1)
        if len(calls) > 1:
            raise KeyboardInterrupt
        real(*given)

    monkeypatch.setattr(cli, "_encode_batch", stopped)
    with pytest.raises(KeyboardInterrupt):
        cli.main(call, spark)
    first = {p.name: p.stat().st_mtime_ns for p in coded.glob("*.img")}
    monkeypatch.undo()
    monkeypatch.setitem(metrics.METRICS, "fussy", metrics.Metric("fussy", arrays=fussy))

    assert cli.main(call, spark) == 1
    rows = {r["id"]: r for r in cli.read_manifest(spark, str(coded)).collect()}
    files = {p.stem: p for p in coded.glob("*.img")}
    assert len(rows) == 5 and len(files) == 3 and all(i.startswith("x-") for i in files)
    assert {i for i, r in rows.items() if r["state"] == "error"} == {"white", "broken"}
    assert "too white" in rows["white"]["error"] and "image" in rows["broken"]["error"]
    for i, file in files.items():
        assert (rows[i]["sha256"], rows[i]["size"]) == (hashlib.sha256(file.read_bytes()).hexdigest(), file.stat().st_size)
        assert rows[i]["bpp"] == 8 * file.stat().st_size / 256 and rows[i]["error"] is None and rows[i]["out"].endswith(file.name)
    assert all((coded / name).stat().st_mtime_ns == at for name, at in first.items())  # the stopped run's work stands
    assert len({f.read_bytes() for f in files.values()}) == 3 and not list(coded.glob(".*img"))

    good = {i: (f.read_bytes(), f.stat().st_mtime_ns) for i, f in files.items()}
    junk, cut, kept = sorted(files)
    files[junk].write_bytes(bitstream.MAGIC)
    files[cut].write_bytes(good[cut][0][:-1])
    png(source / "white.png", lambda y, x: 100)
    assert cli.main(call, spark) == 1
    assert all(f.read_bytes() == good[i][0] for i, f in files.items()) and files[kept].stat().st_mtime_ns == good[kept][1]
    rows = {r["id"]: r for r in cli.read_manifest(spark, str(coded)).collect()}
    assert {i for i, r in rows.items() if r["state"] == "error"} == {"broken"} and rows["white"]["seconds"] > 0
    assert rows[kept]["seconds"] is None and np.isfinite(rows[junk]["seconds"])
    assert cli.main(["encode", str(source), str(tmp_path / "raw"), "--tile", "8", "--overlap", "0", "--payload", "raw", "--bits", "table"], spark) == 1
