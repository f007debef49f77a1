"""Datasets that remember their key columns: cell by region matrices, annotated regions, base-level stores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sequence import clean_dim_name
from .functions.stats import count_m_value
from .operators import matrix as mx
from .operators import rangejoin as rj
from .operators import sites as so
from .sources.writers import write_dataset


class CellMatrix:
    """Counts of cells by regions (cell, region, mc_type, mc, cov) with tables of regions and of cells."""

    def __init__(self, counts: DataFrame, regions: DataFrame | None = None, cells: DataFrame | None = None, var_dim: str = "region"):
        self.counts, self.regions, self.cells, self.var_dim = counts, regions, cells, clean_dim_name(var_dim)

    @classmethod
    def open(cls, spark: SparkSession, path: str | Sequence[str], var_dim: str = "region", use_cells: DataFrame | None = None) -> CellMatrix:
        """One or several stores written by :meth:`write`, united on cells; ``use_cells`` (cell) restricts them."""
        paths = [path] if isinstance(path, str) else list(path)
        counts = spark.read.parquet(*[f"{p}/{var_dim}" for p in paths])
        regions = spark.read.parquet(*[f"{p}/{var_dim}_regions" for p in paths]).dropDuplicates([var_dim])
        out = cls(counts, regions, None, var_dim)
        return out.select_cells(use_cells) if use_cells is not None else out

    def write(self, path: str, mode: str = "w-") -> None:
        frames = {self.var_dim: self.counts}
        if self.regions is not None:
            frames[f"{self.var_dim}_regions"] = self.regions
        write_dataset(frames, path, mode)

    def _with(self, counts: DataFrame) -> CellMatrix:
        return CellMatrix(counts, self.regions, self.cells, self.var_dim)

    def select_cells(self, cells: DataFrame) -> CellMatrix:
        return self._with(self.counts.join(cells.select("cell"), "cell", "left_semi"))

    def select_regions(self, regions: DataFrame) -> CellMatrix:
        return self._with(self.counts.join(regions.select("region"), "region", "left_semi"))

    def union(self, other: CellMatrix) -> CellMatrix:
        return self._with(self.counts.unionByName(other.counts, allowMissingColumns=True))

    def add_cell_metadata(self, metadata: DataFrame) -> CellMatrix:
        cells = metadata if self.cells is None else self.cells.join(metadata, "cell", "left")
        return CellMatrix(self.counts, self.regions, cells, self.var_dim)

    def remove_chromosomes(self, exclude: Sequence[str] | None = None, include: Sequence[str] | None = None) -> CellMatrix:
        return self.select_regions(mx.remove_chromosomes(self.regions, exclude, include))

    def remove_blacklist(self, blacklist: DataFrame, fraction: float = 0.2) -> CellMatrix:
        return self.select_regions(rj.without_blacklist(self.regions, blacklist, fraction=fraction))

    def filter_by_cov_mean(self, low: float = 0, high: float = 999999) -> CellMatrix:
        return self._with(mx.filter_feature_by_cov_mean(self.counts, low, high))

    def add_frac(self, normalize_per_cell: bool = True, clip: float | None = 10.0) -> CellMatrix:
        return self._with(mx.posterior_frac(self.counts, normalize_per_cell, clip))

    def add_m_value(self, alpha: float = 0.01) -> CellMatrix:
        return self._with(mx.add_m_value(self.counts, alpha))

    def scores(self, kind: str = "hypo", cutoff: float = 0.9) -> DataFrame:
        return mx.scores(self.counts, kind, cutoff)

    def variable_features(self, mc_type: str, **options) -> DataFrame:
        fracs = self.counts.where((F.col("mc_type") == mc_type) & F.col("frac").isNotNull())
        return mx.highly_variable_features(fracs, mx.feature_cov_mean(self.counts), **options)

    def merge_cluster(self, clusters: DataFrame) -> DataFrame:
        return mx.merge_cluster(self.counts, clusters)

    def bed(self) -> DataFrame:
        return self.regions.select("chrom", "start", "end", "region")

    def to_regions(self) -> RegionSet:
        return RegionSet(self.regions)


class RegionSet:
    """Regions (region, chrom, start, end) with annotation tables keyed by region."""

    def __init__(self, regions: DataFrame, annotations: dict[str, DataFrame] | None = None):
        self.regions, self.annotations = regions, dict(annotations or {})

    @classmethod
    def open(cls, spark: SparkSession, path: str, names: Sequence[str] = ()) -> RegionSet:
        return cls(spark.read.parquet(f"{path}/regions"), {n: spark.read.parquet(f"{path}/{n}") for n in names})

    def save(self, path: str, mode: str = "w-") -> None:
        write_dataset({"regions": self.regions, **self.annotations}, path, mode)

    def annotate_by_beds(self, beds: DataFrame, name: str = "beds", fraction: float = 0.2, slop: int = 0) -> RegionSet:
        return RegionSet(self.regions, self.annotations | {name: rj.annotate_by_beds(self.regions, beds, fraction=fraction, slop=slop)})

    def annotate_by_tracks(self, tracks: DataFrame, name: str = "tracks", kind: str = "mean", slop: int = 0) -> RegionSet:
        return RegionSet(self.regions, self.annotations | {name: rj.annotate_by_tracks(self.regions, tracks, kind=kind, slop=slop)})

    def annotate(self, name: str, worker: Callable, schema: str) -> RegionSet:
        """``worker`` maps an iterator of pandas frames of regions to one of annotations (``schema``)."""
        return RegionSet(self.regions, self.annotations | {name: self.regions.mapInPandas(worker, schema)})

    def table(self, *names: str) -> DataFrame:
        """The regions with the named annotations beside them."""
        out = self.regions
        for n in names:
            out = out.join(self.annotations[n], "region", "left")
        return out

    def bed(self, chrom_sizes: DataFrame | None = None, slop: int | None = None, length: int | None = None) -> DataFrame:
        r = self.regions.select("region", "chrom", "start", "end")
        if length is not None:
            return rj.centred(r, chrom_sizes, length)
        return rj.slopped(r, chrom_sizes, slop) if slop is not None else r

    def chunks(self, rows: int = 100_000):
        """The regions in order of chrom and start, as pandas frames of ``rows`` rows; one partition at a time comes to the
        driver."""
        import itertools

        import pandas as pd

        it = self.regions.orderBy("chrom", "start", "region").toLocalIterator(prefetchPartitions=True)
        while part := list(itertools.islice(it, rows)):
            yield pd.DataFrame(part, columns=self.regions.columns)

    def without_blacklist(self, blacklist: DataFrame, fraction: float = 0.2) -> RegionSet:
        return RegionSet(rj.without_blacklist(self.regions, blacklist, fraction=fraction), self.annotations)


class BaseStore:
    """Base-level counts (chrom, pos, sample, mc, cov), with contexts and strands in ``codebook`` (chrom, pos, context, strand)."""

    def __init__(self, base: DataFrame, codebook: DataFrame):
        self.base, self.codebook = base, codebook

    def select_mc_type(self, pattern: str) -> BaseStore:
        from .functions.sequence import matches

        book = self.codebook.where(matches(F.col("context"), pattern))
        return BaseStore(self.base.join(book.select("chrom", "pos"), ["chrom", "pos"], "left_semi"), book)

    def fetch(self, chrom: str, start: int, end: int) -> BaseStore:
        return BaseStore(so.fetch(self.base, chrom, start, end), so.fetch(self.codebook, chrom, start, end))

    def fetch_regions(self, regions: DataFrame) -> BaseStore:
        return BaseStore(rj.fetch_regions(self.base, regions), self.codebook)

    def fetch_positions(self, positions: DataFrame) -> BaseStore:
        return BaseStore(so.fetch_positions(self.base, positions), self.codebook)

    def add_groups(self, groups: DataFrame) -> BaseStore:
        """Samples added up by ``group``; samples without one are left out."""
        j = self.base.join(groups.select("sample", "group"), "sample").groupBy("chrom", "pos", F.col("group").alias("sample")).agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
        return BaseStore(j, self.codebook)

    def merge_strands(self) -> BaseStore:
        j = self.base.join(self.codebook.select("chrom", "pos", "strand"), ["chrom", "pos"])
        merged = so.merge_strands(j, ["sample"]).drop("strand")
        return BaseStore(merged, self.codebook.where("strand = '+'"))

    def region_counts(self, regions: DataFrame) -> DataFrame:
        held = rj.sites_in_regions(self.base, regions)
        return held.groupBy("sample", "region").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))

    def values(self, kind: str = "frac") -> DataFrame:
        v = F.col("mc") / (F.col("cov") + 0.001) if kind == "frac" else count_m_value(F.col("mc"), F.col("cov"))
        return self.base.select("chrom", "pos", "sample", v.alias("value"))

    def positions_bed(self, merge_cpg: bool = False) -> DataFrame:
        book = self.codebook.where("strand = '+'") if merge_cpg else self.codebook
        return book.select("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") + (1 if merge_cpg else 0)).alias("end"))
