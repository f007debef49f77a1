"""Many tiny files into few well-sized ones by joining their bytes."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, small_table

ENTRY = "STRUCT<file: STRING, at: BIGINT, size: BIGINT, crc: BIGINT, lines: BIGINT>"
PACK = f"data BINARY, entries ARRAY<{ENTRY}>"
_ENTRY = pa.struct([("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("lines", pa.int64())])
_PACK = pa.schema([("data", pa.binary()), ("entries", pa.list_(_ENTRY))])
#: How a null is written; a text never is, because its backslashes are doubled.
NULL = "\\N"
# How the characters are written that would end a field or a line.
ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}
_UNESCAPE = {written: plain for plain, written in ESCAPES.items()}
#: A zstandard frame that readers skip, 8 bytes of ASCII: what stands between packs of frames in an exported file.
SKIPPED_FRAME = "\x50\x2a\x4d\x18\0\0\0\0"
#: First bytes of a zstandard frame.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


def files_on_disk(spark: SparkSession, path: str, partition_bytes: int = 128 << 20) -> DataFrame:
    """``file``, ``content`` of the files that ``path`` (a folder or a glob) names. Spark lists no files of length 0; they
    have no bytes to lose.

    Spark reckons 4 MB for opening a file, so that a partition would hold some thirty tiny ones. Here it reckons what a
    name costs, in a session of its own whose settings nothing else sees: a partition holds ``partition_bytes`` of files.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", "1024")
    own.conf.set("spark.sql.files.maxPartitionBytes", str(partition_bytes))
    return own.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _escaped(texts: pa.Array) -> pa.Array:
    """Texts without a tab or line break, each backslash doubled."""
    if not pc.any(pc.match_substring_regex(texts, r"[\\\t\n\r]")).as_py():
        return texts
    for plain, written in ESCAPES.items():
        texts = pc.replace_substring(texts, plain, written)
    return texts


def _unescaped(texts: pa.Array) -> pa.Array:
    if not pc.any(pc.match_substring(texts, "\\")).as_py():
        return texts
    coded = texts.dictionary_encode()
    words = [re.sub(r"\\[\\tnr]", lambda m: _UNESCAPE[m.group()], w) for w in coded.dictionary.to_pylist()]
    return pa.array(words, texts.type).take(coded.indices)


def rows_as_files(df: DataFrame, file: str, columns: Sequence[str]) -> DataFrame:
    r"""``file``, ``content``: the rows of each file as tab-separated lines, nulls as ``\N``; in texts a backslash, tab or
    line break is written as ``\\``, ``\t``, ``\n`` or ``\r``, so every text comes back, also one that reads ``\N``.

    Rows of one file that follow each other in a partition make one piece; a file in several places gives several
    pieces, which together hold its rows. No shuffle. A null file name is a file of its own.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            name = b.column(0)
            texts = [_escaped(c) if pa.types.is_string(c.type) else pc.cast(c, pa.string()) for c in b.columns[1:]]
            lines = pc.binary_join_element_wise(*texts, "\t", null_handling="replace", null_replacement=NULL)
            code = pc.fill_null(name.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            cut = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)].astype(np.int32)
            content = pc.cast(pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), lines), "\n"), pa.binary())
            if len(b.columns) == 2:  # a line of one empty text has no bytes, so its line end is written here
                content = pc.cast(pc.binary_join_element_wise(content, pa.scalar(b"\n"), pa.scalar(b"")), pa.binary())
            yield pa.RecordBatch.from_arrays([name.take(pa.array(cut[:-1])), content], names=["file", "content"])

    return df.select(F.col(f"`{file}`"), *[F.col(f"`{c}`") for c in columns]).mapInArrow(render, "file STRING, content BINARY")


def _frame_lines(data: bytes) -> int:
    return -1 if data[:4] == ZSTD_MAGIC else data.count(b"\n")


def _joined(files: DataFrame, kind: str, header: bytes | None, target_bytes: int) -> DataFrame:
    """Packs of each partition's files, and ``part``: the partition, or null for packs that are large enough."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, entries, size, part = [], [], 0, TaskContext.get().partitionId()

        def pack() -> pa.RecordBatch:
            row = {"part": [None if size >= target_bytes // 4 else part], "data": [b"".join(data)], "entries": [entries]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), *_PACK]))

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                content = content or b""
                if kind == "lines":
                    if header and content.startswith(header):
                        content = content[len(header) :].removeprefix(b"\n")
                    if content and content[-1:] != b"\n":
                        content += b"\n"
                elif content and content[:4] != ZSTD_MAGIC:
                    raise ValueError(f"not a zstandard frame: {file}")
                if data and size + len(content) > target_bytes:
                    yield pack()
                    data, entries, size = [], [], 0
                entries.append({"file": file, "at": size, "size": len(content), "crc": zlib.crc32(content), "lines": _frame_lines(content)})
                data.append(content)
                size += len(content)
        if entries:
            yield pack()

    return files.select("file", "content").mapInArrow(join, f"part INT, {PACK}")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of one group, which follow each other, as one."""
    group, data, entries, size = None, [], [], 0

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"data": [b"".join(data)], "entries": [entries]}, schema=_PACK)

    for b in batches:
        for g, content, told in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if g != group and entries:
                yield pack()
                data, entries, size = [], [], 0
            group = g
            entries += [{**e, "at": e["at"] + size} for e in told]
            data.append(content)
            size += len(content)
    if entries:
        yield pack()


def join_files(files: DataFrame, kind: str = "lines", header: bytes | None = None, target_bytes: int = 16 << 20, path: str | None = None) -> DataFrame:
    """Packs of at most ``target_bytes`` that hold the bytes of the files one after the other: ``data``, ``entries``.

    ``files`` has ``file``, ``content``. With ``kind`` lines, contents are newline-delimited text: a missing last
    newline is put in, and ``header``, where a file begins with it, is taken off. With ``kind`` zstd, contents are
    complete zstandard frames and are joined as they are (a row of frames is a valid stream). Nothing is parsed,
    decoded or unpacked. ``entries`` tells of each file its name, place, length, CRC-32 and number of lines (-1 for
    frames). Null and empty contents, or contents that are only a header, have an entry of length 0. A content that is
    not a frame raises with kind zstd. Only a file longer than ``target_bytes`` makes a larger pack, of its own.

    First every task joins the files of its partition; these packs are stored under ``path`` (a folder that does not
    exist yet, else one in the shared folder). A partition's last pack may be small. Small packs, under a quarter of the
    target, are then joined across partitions: the driver gets their sizes (one number per partition), deals them out by
    their running sum, and only their bytes are shuffled. So all packs but one hold a quarter of the target or more:
    there are at most 1 + 4 * bytes / target, however many files and partitions there were.
    """
    if kind not in ("lines", "zstd"):
        raise ValueError(f"unknown kind: {kind}")
    path = path or new_path(files.sparkSession, "packs")
    first = _write(_joined(files, kind, header, target_bytes), path + "/joined")
    small = first.where("part IS NOT NULL")
    sizes = sorted((r.part, r.n) for r in small.select("part", F.length("data").alias("n")).collect())
    large = first.where("part IS NULL").select("data", "entries")
    if len(sizes) < 2:
        return first.select("data", "entries")
    group, run, dealt = 0, 0, []
    for part, n in sizes:
        if run and run + n > target_bytes:
            group, run = group + 1, 0
        dealt.append(group)
        run += n
    table = small_table(files.sparkSession, part=[p for p, _ in sizes], pack=dealt)
    meet = small.join(table, "part").select("pack", "data", "entries", "part")
    merged = meet.repartition(min(group + 1, 1 << 14), "pack").sortWithinPartitions("pack", "part").drop("part").mapInArrow(_merge, PACK)
    return large.unionByName(_write(merged, path + "/merged"))


def _write(packs: DataFrame, path: str) -> DataFrame:
    packs.write.option("compression", "zstd").parquet(path)
    return packs.sparkSession.read.schema(packs.schema).parquet(path)


def write_packs(packs: DataFrame, path: str) -> DataFrame:
    """Packs written to ``path`` (Parquet, zstandard pages) and read again; Spark's commit keeps each pack once."""
    return _write(packs, path)


def export_packs(packs: DataFrame, path: str, kind: str = "lines", file_bytes: int = 128 << 20) -> None:
    """The packs' bytes as files of about ``file_bytes`` under ``path``, byte for byte: nothing is decoded.

    A file holds several packs. Packs of lines end with a newline, so their files are the packs in a row; behind each
    pack of frames stands an empty frame that zstandard readers skip. Empty packs are left out.
    """
    total = packs.agg(F.sum(F.length("data")).alias("n")).first().n or 0
    size = F.length("data")
    raw = (F.expr("substring(data, 1, length(data) - 1)") if kind == "lines" else F.col("data")).cast("string").alias("value")
    few = packs.where(size > 0).select(raw).coalesce(max(1, -(-total // file_bytes)))
    few.write.option("lineSep", "\n" if kind == "lines" else SKIPPED_FRAME).text(path)


def check_packs(packs: DataFrame) -> DataFrame:
    """``file``, ``size``, ``lines`` of every entry, after its bytes in the pack were held against length and CRC-32.

    Raises on the first entry that does not agree.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, entries in zip(b.column(0), b.column(1).to_pylist()):
                verify(memoryview(data.as_buffer()), entries)
                yield pa.RecordBatch.from_pydict({k: [e[k] for e in entries] for k in ("file", "size", "lines")}, schema=pa.schema([("file", pa.string()), ("size", pa.int64()), ("lines", pa.int64())]))

    return packs.mapInArrow(check, "file STRING, size BIGINT, lines BIGINT")


def verify(data: memoryview, entries: Sequence[dict]) -> None:
    """Entries cover ``data`` without overlap or rest, and each has its CRC-32."""
    at = 0
    for e in entries:
        if e["at"] != at or zlib.crc32(data[at : at + e["size"]]) != e["crc"]:
            raise ValueError(f"pack does not hold {e['file']} as it was read")
        at += e["size"]
    if at != len(data):
        raise ValueError("pack has bytes of no file")


def unpack_rows(packs: DataFrame, names: Sequence[str], keep: Sequence[str], schema: str, file: str | None = None) -> DataFrame:
    """The lines of the packs as rows again: of the columns ``names`` those in ``keep``, with the types of ``schema``.
    With ``file`` (a STRING column, the last of ``schema``) each row gets the name of its file, which its entry tells.

    Each pack is held against its lengths, checksums and line counts first; frames are unpacked (the files of their
    rows are not known, as their lines are not counted on joining).
    """
    kinds = {c.name: c.dataType for c in packs.sparkSession.createDataFrame([], schema).schema}
    kinds.pop(file, None)
    arrow = {c: pa.string() if k.typeName() == "string" else pa.int64() if k.typeName() == "long" else pa.int32() if k.typeName() == "integer" else pa.float64() for c, k in kinds.items()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = pa.csv.ConvertOptions(include_columns=list(keep), column_types=arrow, strings_can_be_null=True, null_values=[NULL], quoted_strings_can_be_null=False)
        options = {"read_options": pa.csv.ReadOptions(column_names=list(names), use_threads=False, block_size=1 << 22), "parse_options": pa.csv.ParseOptions(delimiter="\t", quote_char=False, ignore_empty_lines=False), "convert_options": convert}
        for b in batches:
            for data, entries in zip(b.column(0), b.column(1).to_pylist()):
                buffer = data.as_buffer()
                verify(memoryview(buffer), entries)
                if not buffer.size:
                    continue
                if buffer[:4].to_pybytes() == ZSTD_MAGIC:
                    import zstandard

                    buffer = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(buffer.to_pybytes()), read_across_frames=True).read()
                told = np.array([e["lines"] for e in entries])
                owner = np.repeat(np.arange(len(told), dtype=np.int32), np.maximum(told, 0))
                files = pa.array([e["file"] for e in entries], pa.string())
                rows = 0
                for t in pa.csv.open_csv(pa.BufferReader(buffer), **options):
                    got = t.select(list(keep))
                    got = pa.RecordBatch.from_arrays([_unescaped(c) if pa.types.is_string(c.type) else c for c in got.columns], names=got.schema.names)
                    if file is not None:
                        own = files.take(pa.array(owner[rows : rows + t.num_rows])) if (told >= 0).all() else pa.nulls(t.num_rows, pa.string())
                        got = pa.RecordBatch.from_arrays([*got.columns, own], names=[*got.schema.names, file])
                    rows += t.num_rows
                    yield got
                if (told >= 0).all() and rows != told.sum():
                    raise ValueError("pack has another number of lines than its files")

    return packs.mapInArrow(parse, schema)


def repeated_records(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key`` and ``copies`` of the records that more than one row holds; rows with a null in ``key`` are left out.

    Counted in every task first; a record's rows meet by its whole key, so no value of a part of it is a hot one.
    """
    for k in key:
        rows = rows.where(F.col(f"`{k}`").isNotNull())
    return rows.groupBy(*[f"`{k}`" for k in key]).agg(F.count("*").alias("copies")).where("copies > 1")


def latest_records(rows: DataFrame, key: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """One row per record: of rows with the same ``key`` the one that is largest by ``newest``.

    Rows with a null in ``key`` name no record and are kept as they are. ``max_by`` keeps one row per key and task, so
    a record delivered often needs no more room than another.
    """
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(f"`{k}`").isNotNull()
    rest = [c for c in rows.columns if c not in key]
    best = rows.where(whole).groupBy(*[f"`{k}`" for k in key]).agg(F.max_by(F.struct(*[f"`{c}`" for c in rest]), F.struct(*newest)).alias("__row"))
    return best.select(*[f"`{k}`" for k in key], *[F.col("__row").getField(c).alias(c) for c in rest]).select(*[f"`{c}`" for c in rows.columns]).unionByName(rows.where(~whole))
