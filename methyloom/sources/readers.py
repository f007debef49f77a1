"""Readers of the domain's file formats, as Spark scans."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ALLC, ALLC_SNP, BED3, BED4, BEDGRAPH, FAIDX, GTF


def parse_paths(paths: str | Sequence[str], check: bool = True) -> list[str]:
    """A glob, the name of a text file that lists paths, or a list of paths, as a list. Local paths must exist."""
    import glob

    if isinstance(paths, str):
        if "*" in paths:
            found = sorted(glob.glob(paths))
        elif paths.endswith((".txt", ".list")) and os.path.isfile(paths):
            with open(paths) as f:
                found = [line.strip() for line in f if line.strip()]
        else:
            found = [paths]
    else:
        found = list(paths)
    if not found:
        raise FileNotFoundError(f"no files: {paths}")
    for p in found if check else []:
        if "://" not in p and not os.path.exists(p):
            raise FileNotFoundError(p)
    return found


def _tsv(spark: SparkSession, path: str | Sequence[str], schema: str, comment: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("sep", "\t").option("header", "false")
    if comment:
        r = r.option("comment", comment)
    return r.csv(path if isinstance(path, str) else list(path))


def read_allc(spark: SparkSession, path: str | Sequence[str], cell: str | None = None, snp: bool = False) -> DataFrame:
    """Base-level tables (plain or gzip): chrom, pos, strand, context, mc, cov, p. ``cell``: a pattern whose first group
    in the file's path is the cell. A gzip file is one task's scan; a header line is dropped, as its position is not a
    number."""
    schema = (ALLC_SNP if snp else ALLC).replace("pos BIGINT", "pos STRING")
    rows = _tsv(spark, path, schema)
    if cell:
        rows = rows.withColumn("cell", F.regexp_extract(F.input_file_name(), cell, 1))
    rows = rows.withColumn("pos", F.expr("try_cast(pos AS BIGINT)")).where("pos IS NOT NULL")
    if snp:
        rows = rows.withColumns({c: F.split(c, ",").cast("array<bigint>") for c in ("snp_match", "snp_mismatch")})
    return rows


def read_allc_table(spark: SparkSession, table: DataFrame) -> DataFrame:
    """The base-level rows of the files of ``table`` (file_uid, file_path), with file_uid as ``cell``. The list of paths
    goes to the scan; rows meet their file's id by a join on the path, not in a loop over files."""
    paths = [r.file_path for r in table.select("file_path").toLocalIterator()]
    rows = _tsv(spark, paths, ALLC).withColumn("__p", F.regexp_replace(F.input_file_name(), "^file:/*", "/"))
    ids = table.select(F.col("file_uid").alias("cell"), F.regexp_replace("file_path", "^file:/*", "/").alias("__p"))
    return rows.join(ids, "__p").drop("__p")


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """file, size, gzip, md5 of the files that ``path`` names: whether they begin like gzip, and the digest of their bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), (F.substring("content", 1, 2) == F.lit(b"\x1f\x8b")).alias("gzip"), F.md5("content").alias("md5"))


def read_chrom_sizes(spark: SparkSession, path: str, remove: Sequence[str] = ()) -> DataFrame:
    """chrom, size, chrom_order from a chrom.sizes or .fai file (further columns are ignored), in file order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("chrom_order", "line")).where("trim(line) <> ''")
    parts = F.split("line", r"\s+")
    rows = rows.select(parts[0].alias("chrom"), parts[1].cast("long").alias("size"), "chrom_order")
    return rows.where(~F.col("chrom").isin(list(remove))) if remove else rows


def read_faidx(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, FAIDX)


def read_bed(spark: SparkSession, path: str | Sequence[str], named: bool = True, region_dim: str = "region", chrom_sizes: DataFrame | None = None) -> DataFrame:
    """chrom, start, end, region of BED files. Without a name column regions are called ``<region_dim>_<i>`` in genome
    order (which ``chrom_sizes`` gives; unknown chromosomes are left out)."""
    rows = _tsv(spark, path, BED4 if named else BED3, comment="#")
    if chrom_sizes is not None:
        rows = rows.join(chrom_sizes.select("chrom", "chrom_order"), "chrom")
    if not named:
        from ..operators.ranking import global_rank

        order = [F.col(c) for c in (["chrom_order"] if chrom_sizes is not None else ["chrom"]) + ["start", "end"]]
        rows = global_rank(rows, None, order).withColumn("region", F.concat(F.lit(f"{region_dim}_"), F.col("rank").cast("string"))).drop("rank")
    return rows.select("chrom", "start", "end", "region")


def read_bedgraph(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _tsv(spark, path, BEDGRAPH, comment="#")


def read_gtf(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The nine columns of a GTF, and gene_id, gene_name, transcript_id, transcript_name from its annotation."""
    rows = _tsv(spark, path, GTF, comment="#")
    named = {k: F.nullif(F.regexp_extract("annotation", f'{k} "([^"]*)"', 1), F.lit("")) for k in ("gene_id", "gene_name", "transcript_id", "transcript_name")}
    return rows.withColumns(named)


def read_pileup(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """chrom, pos, ref_base, depth, bases, quals of mpileup text."""
    return spark.read.schema("chrom STRING, pos BIGINT, ref_base STRING, depth INT, bases STRING, quals STRING").option("sep", "\t").option("quote", "").csv(path if isinstance(path, str) else list(path))


def read_methylation_table(spark: SparkSession, path: str, columns: dict[str, int], sep: str = "\t", header: bool = False, chrom_sizes: DataFrame | None = None) -> DataFrame:
    """A table of any layout as sites: ``columns`` maps chrom, pos, strand, context and the counts a table has (mc, cov,
    uc, mc_frac, pseudo_count) to column numbers. Names without ``chr`` get it where the known chromosomes have it."""
    from ..operators.sites import counts_from, standardize

    raw = spark.read.option("sep", sep).option("header", str(header).lower()).csv(path)
    c = {k: F.col(f"`{raw.columns[i]}`") for k, i in columns.items()}
    for mode in ("mc+cov", "mc+uc", "uc+cov", "mc_frac+cov", "mc_frac+mc", "mc_frac+uc", "mc_frac+pseudo_count"):
        if all(k in c for k in mode.split("+")):
            break
    else:
        raise ValueError("no pair of columns gives counts")
    typed = {k: v.cast("double" if k == "mc_frac" else "long") for k, v in c.items() if k in ("mc", "cov", "uc", "mc_frac", "pseudo_count")}
    mc, cov = counts_from(mode, **typed)
    rows = raw.select(c["chrom"].alias("chrom"), c["pos"].cast("long").alias("pos"), c.get("strand", F.lit(None).cast("string")).alias("strand"), c.get("context", F.lit(None).cast("string")).alias("context"), mc.alias("mc"), cov.alias("cov"))
    return standardize(rows, chrom_sizes) if chrom_sizes is not None else rows


def read_snap(path: str):
    """SNAP HDF5 needs h5py, which is optional."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading SNAP files needs h5py") from e
    raise NotImplementedError("export the SNAP matrix as Parquet rows of cell, feature, count")


def read_motifs(path: str) -> list[dict]:
    """Motifs of a MEME file: name, nsites, width and the rows of base frequencies (A, C, G, T)."""
    motifs: list[dict] = []
    rows = 0
    with open(path) as f:
        for line in f:
            word = line.split()
            if line.startswith("MOTIF"):
                motifs.append({"name": word[1], "nsites": 0, "pfm": []})
            elif line.startswith("letter-probability matrix"):
                told = dict(zip(word[2::2], word[3::2]))
                rows, motifs[-1]["nsites"] = int(told.get("w=", 0)), float(told.get("nsites=", 0))
            elif rows and len(word) == 4:
                motifs[-1]["pfm"].append([float(x) for x in word])
                rows -= 1
    return motifs


def read_dmr_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Regions (dmr, chrom, start, end, ndms) and states (dmr, sample, state) of a table with the columns chr, start,
    end, number_of_dms, hypermethylated_samples, hypomethylated_samples (lists joined by commas) and one level column
    per sample. A sample that is in both lists has state 0; ends move by 2, to the end of the last CpG."""
    t = spark.read.option("sep", "\t").option("header", "true").csv(path)
    c = t.columns
    t = t.withColumn("dmr", F.concat_ws("-", F.col(f"`{c[0]}`"), F.col(f"`{c[1]}`"), F.col(f"`{c[2]}`")))
    regions = t.select("dmr", F.col(f"`{c[0]}`").alias("chrom"), F.col(f"`{c[1]}`").cast("long").alias("start"), (F.col(f"`{c[2]}`").cast("long") + 2).alias("end"), F.col(f"`{c[3]}`").cast("long").alias("ndms"))
    sides = [t.select("dmr", F.explode(F.split(F.col(f"`{c[i]}`"), ",")).alias("sample"), F.lit(s).alias("state")).where("trim(sample) <> ''") for i, s in ((4, 1), (5, -1))]
    states = sides[0].unionByName(sides[1]).groupBy("dmr", "sample").agg(F.sum("state").cast("tinyint").alias("state"))
    return regions, states


def read_project(path: str) -> dict:
    """A project's JSON: ``metadata`` (path of the cell table) and ``matrices`` (name to glob); relative paths are
    those beside the file."""
    import json

    with open(path) as f:
        told = json.load(f)
    at = os.path.dirname(os.path.abspath(path))
    whole = lambda p: p if "://" in p or os.path.isabs(p) else os.path.join(at, p)
    return {"metadata": whole(told["metadata"]) if told.get("metadata") else None, "matrices": {k: whole(v) for k, v in told.get("matrices", {}).items()}}
