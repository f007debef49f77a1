import random

import pytest
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from methyloom.operators import compaction as co


def content(packs):
    return b"".join(bytes(r.data) for r in packs.collect())


def test_lines_with_headers_and_missing_newlines(spark, tmp_path):
    head = b"chrom\tpos"
    texts = {"a": head + b"\nx\t1\ny\t2", "b": b"z\t3\n", "c": b"", "d": head, "e": head + b"\n", "f": "ü\t4\n".encode()}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t)
    files = co.files_on_disk(spark, str(tmp_path)).repartition(3)
    packs = co.join_files(files, header=head, target_bytes=8)
    assert sorted(content(packs).decode().splitlines()) == ["x\t1", "y\t2", "z\t3", "ü\t4"]
    checked = {r.file.rsplit("/", 1)[1]: (r.size, r.lines) for r in co.check_packs(packs).collect()}
    assert checked == {"a": (8, 2), "b": (4, 1), "d": (0, 0), "e": (0, 0), "f": (5, 1)}  # Spark lists no empty files
    out = str(tmp_path / "out")
    co.export_packs(packs, out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["x\t1", "y\t2", "z\t3", "ü\t4"]


def test_zstandard_frames_round_trip(spark, tmp_path):
    c = zstandard.ZstdCompressor()
    rows = [(f"f{i}", c.compress(f"k{i}\t{i}\n".encode())) for i in range(40)] + [("empty", None)]
    packs = co.write_packs(co.join_files(spark.createDataFrame(rows, "file STRING, content BINARY"), "zstd", target_bytes=200), str(tmp_path / "p"))
    got = co.unpack_rows(packs, ["k", "v"], ["k", "v"], "k STRING, v BIGINT").collect()
    assert sorted((r.k, r.v) for r in got) == sorted((f"k{i}", i) for i in range(40))
    with pytest.raises(PythonException):
        co.join_files(spark.createDataFrame([("x", b"plain")], "file STRING, content BINARY"), "zstd").collect()


def test_damage_is_found(spark):
    packs = co.join_files(spark.createDataFrame([("x", b"a\n"), ("y", b"b\n")], "file STRING, content BINARY").coalesce(1))
    broken = packs.withColumn("data", F.lit(b"a\nc\n"))
    with pytest.raises(PythonException):
        co.check_packs(broken).collect()
    with pytest.raises(PythonException):
        co.check_packs(packs.withColumn("data", F.lit(b"a\nb\nc\n"))).collect()


def test_rows_round_trip_and_repeats(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "", " c"]), rng.choice(["chr1", None, "1", ""]), rng.randrange(30) if rng.random() > 0.1 else None, rng.choice(["f1", "f2", "f3"])) for _ in range(500)]
    df = spark.createDataFrame(rows, "cell STRING, chrom STRING, pos BIGINT, file_uid STRING").repartition(4)
    names = ["cell", "chrom", "pos", "file_uid"]
    packs = co.join_files(co.rows_as_files(df, "file_uid", names), target_bytes=700)
    assert packs.count() > 4
    back = co.unpack_rows(packs, names, names, "cell STRING, chrom STRING, pos BIGINT, file_uid STRING")
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, rows))
    short = co.join_files(co.rows_as_files(df, "file_uid", names[:3]), target_bytes=700)
    named = co.unpack_rows(short, names[:3], names[:3], "cell STRING, chrom STRING, pos BIGINT, file_uid STRING", "file_uid")
    assert sorted(map(str, (tuple(r) for r in named.collect()))) == sorted(map(str, rows))
    want = {}
    for c, ch, p, _ in rows:
        if None not in (c, ch, p):
            want[c, ch, p] = want.get((c, ch, p), 0) + 1
    got = {(r.cell, r.chrom, r.pos): r.copies for r in co.repeated_records(back, ["cell", "chrom", "pos"]).collect()}
    assert got == {k: n for k, n in want.items() if n > 1}
    latest = co.latest_records(back, ["cell", "chrom", "pos"], [F.col("file_uid")])
    assert latest.where("cell IS NOT NULL AND chrom IS NOT NULL AND pos IS NOT NULL").count() == len(want)


def test_any_text_comes_back(spark):
    texts = ["a\tb", "\\N", "\\\\N", "\\", "\n", "x\r\ny", "\\t", "", None, "\\\\t\\", "plain"]
    df = spark.createDataFrame([(t, i, "f") for i, t in enumerate(texts)], "cell STRING, pos BIGINT, file_uid STRING")
    packs = co.join_files(co.rows_as_files(df, "file_uid", ["cell", "pos"]))
    got = co.unpack_rows(packs, ["cell", "pos"], ["cell", "pos"], "cell STRING, pos BIGINT").collect()
    assert [r.cell for r in sorted(got, key=lambda r: r.pos)] == texts
    one = co.join_files(co.rows_as_files(df, "file_uid", ["cell"]))
    got = [r.cell for r in co.unpack_rows(one, ["cell"], ["cell"], "cell STRING").collect()]
    assert sorted(got, key=str) == sorted(texts, key=str)


@pytest.mark.parametrize("kind", ["lines", "zstd"])
def test_tiny_files_become_few_of_the_right_size(spark, tmp_path, kind):
    source = tmp_path / "in"
    source.mkdir()
    texts = {f"f{i:05d}": b"\xff\xfe%d\t\\N\n" % i * (i % 7 + 1) for i in range(3000)}
    if kind == "zstd":
        texts = {k: zstandard.ZstdCompressor().compress(v) for k, v in texts.items()}
    for name, t in texts.items():
        (source / name).write_bytes(t)
    total, target = sum(map(len, texts.values())), 20_000
    packs = co.join_files(co.files_on_disk(spark, str(source)), kind, target_bytes=target, path=str(tmp_path / "packs"))
    sizes = [len(r.data) for r in packs.collect()]
    assert max(sizes) <= target and sum(s < target // 4 for s in sizes) <= 1 and len(sizes) <= 1 + 4 * total // target
    assert {r.file.rsplit("/", 1)[1]: r.size for r in co.check_packs(packs).collect()} == {k: len(v) for k, v in texts.items()}
    spread = co.join_files(co.files_on_disk(spark, str(source)).repartition(64), kind, target_bytes=1 << 20)
    assert spread.count() == 1 and spread.selectExpr("inline(entries)").count() == 3000
    out = tmp_path / "out"
    co.export_packs(packs, str(out), kind, file_bytes=50_000)
    files = [p.read_bytes() for p in out.iterdir() if p.name.startswith("part")]
    assert len(files) <= -(-total // 50_000)
    if kind == "zstd":
        assert sorted(b"".join(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() for f in files).split(b"\n")) == sorted(b"".join(zstandard.ZstdDecompressor().decompress(t) for t in texts.values()).split(b"\n"))
        assert sum(map(len, files)) == total + 8 * len(sizes)
    else:
        assert sorted(b"".join(files).split(b"\n")) == sorted(b"".join(texts.values()).split(b"\n"))


def test_empty(spark):
    none = spark.createDataFrame([], "file STRING, content BINARY")
    assert co.join_files(none).collect() == []
    df = spark.createDataFrame([], "cell STRING, pos BIGINT, file_uid STRING")
    packs = co.join_files(co.rows_as_files(df, "file_uid", ["cell", "pos"]))
    assert co.unpack_rows(packs, ["cell", "pos"], ["cell", "pos"], "cell STRING, pos BIGINT").collect() == []
