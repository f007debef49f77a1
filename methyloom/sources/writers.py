"""Writers of the domain's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_allc(sites: DataFrame, path: str, chrom_sizes: DataFrame | None = None, compression: str = "gzip") -> None:
    """Seven tab-separated columns sorted by genome order and position, one file per range of the genome."""
    cols = ["chrom", "pos", "strand", "context", "mc", "cov"]
    rows = sites.select(*cols, *([F.col("p")] if "p" in sites.columns else [F.lit(1).alias("p")]))
    if chrom_sizes is not None:
        rows = rows.join(chrom_sizes.select("chrom", "chrom_order"), "chrom").orderBy("chrom_order", "pos").select(*cols, "p")
    else:
        rows = rows.orderBy("chrom", "pos")
    rows.write.option("sep", "\t").option("compression", compression).csv(path)


def write_site_store(sites: DataFrame, path: str, partitions: int | None = None) -> None:
    """The layout that region reads prune: partitioned by chrom, sorted by position within files, so that row groups
    carry narrow ranges of positions."""
    n = partitions or int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sites.repartitionByRange(n, "chrom", "pos").sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").parquet(path)


def write_extracts(extracted: DataFrame, path: str, fmt: str = "bed5") -> None:
    """One folder per pattern (and strand type) of :func:`methyloom.operators.sites.extract_contexts`, as allc or bed5."""
    keys = ["pattern", *(["strand_type"] if "strand_type" in extracted.columns else [])]
    if fmt == "bed5":
        rows = extracted.select(*keys, "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "mc", "cov")
    elif fmt == "allc":
        rows = extracted.select(*keys, "chrom", "pos", "strand", "context", "mc", "cov", F.lit(1).alias("p"))
    else:
        raise ValueError(f"unknown format: {fmt}")
    rows.sortWithinPartitions("chrom").write.partitionBy(*keys).option("sep", "\t").csv(path)


def write_bed(regions: DataFrame, path: str, *columns: str) -> None:
    regions.select("chrom", "start", "end", *(columns or ("region",))).orderBy("chrom", "start").write.option("sep", "\t").csv(path)


def write_bedgraph(tracks: DataFrame, path: str, by: tuple[str, ...] = ("pattern",), value: str = "frac") -> None:
    """One folder per track: chrom, start, end, value."""
    tracks.select(*by, "chrom", "start", "end", F.col(value).alias("value")).repartitionByRange(*[F.col(c) for c in (*by, "chrom", "start")]).sortWithinPartitions(*by, "chrom", "start").write.partitionBy(*by).option("sep", "\t").csv(path)


def write_fasta(regions: DataFrame, sequence: DataFrame, path: str) -> None:
    """The sequences of regions as FASTA records."""
    region_sequences(regions, sequence).select(F.concat(F.lit(">"), "region", F.lit("\n"), "seq").alias("value")).write.text(path)


def region_sequences(regions: DataFrame, sequence: DataFrame) -> DataFrame:
    """region, seq: pieces of the sequence chunks that a region touches, joined in order."""
    size = sequence.agg(F.max("size")).first()[0] or 1
    r = regions.where("end > start").select("region", "chrom", F.col("start").alias("rs"), F.col("end").alias("re"))
    r = r.withColumn("start", F.explode(F.transform(F.sequence(F.floor(F.col("rs") / size), F.floor((F.col("re") - 1) / size)), lambda i: i * size)))
    j = r.join(sequence, ["chrom", "start"])
    a = F.greatest(F.col("rs"), F.col("start"))
    z = F.least(F.col("re"), F.col("start") + F.col("length"))
    piece = F.substring("seq", (a - F.col("start") + F.col("lead") + 1).cast("int"), (z - a).cast("int"))
    pieces = j.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("start", piece.alias("s")))).alias("p"))
    return pieces.select("region", F.array_join(F.col("p.s"), "").alias("seq"))


def write_dataset(frames: dict[str, DataFrame], path: str, mode: str = "w-", sort: tuple[str, ...] = ("region",)) -> None:
    """Each matrix as a Parquet table of its own under ``path``. ``w-`` fails where one exists, ``w`` replaces it."""
    how = {"w-": "errorifexists", "w": "overwrite", "a": "append"}[mode]
    for name, frame in frames.items():
        n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        frame.repartitionByRange(n, *sort).sortWithinPartitions(*sort).write.mode(how).parquet(f"{path}/{name}")


def convert(spark, source: str, fmt: str, path: str, **options: str) -> None:
    """Any format Spark reads, as Parquet."""
    spark.read.format(fmt).options(**options).load(source).write.parquet(path)
