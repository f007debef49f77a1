"""Command line: ``spark-submit -m methyloom.cli COMMAND`` or ``python -m methyloom.cli COMMAND``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import matrix as mx
from .operators import sites as so
from .sources import readers, writers


def _common(p: argparse.ArgumentParser, *names: str) -> argparse.ArgumentParser:
    known = {
        "input": {"nargs": "+", "required": True},
        "output": {"required": True},
        "chrom-sizes": {"required": True},
        "contexts": {"nargs": "+", "default": ["CGN", "CHN"]},
        "cell": {"default": r"([^/]+?)(?:\.allc)?(?:\.tsv)?(?:\.gz)?$", "help": "pattern whose first group in a file's path is its cell"},
        "bin-size": {"type": int, "default": 100_000},
    }
    for n in names:
        p.add_argument(f"--{n}", **known[n])
    return p


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="methyloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *aliases, **k: sub.add_parser(name, aliases=list(aliases), **k)
    _common(add("bam-to-allc", "allc", "2allc", help="counts from mpileup text"), "input", "output").add_argument("--fasta", required=True)
    _common(add("standardize-allc", "standard"), "input", "output", "chrom-sizes").add_argument("--remove-additional", action="store_true")
    _common(add("tabix-allc", "tbi", help="sorted, chrom-partitioned copy for region reads"), "input", "output")
    _common(add("profile-allc", "profile"), "input", "output")
    _common(add("merge-allc", "merge"), "input", "output", "chrom-sizes")
    p = _common(add("extract-allc", "extract"), "input", "output", "contexts")
    p.add_argument("--strandness", default="both", choices=["both", "split", "merge"])
    p.add_argument("--format", default="allc", choices=["allc", "bed5"])
    p.add_argument("--cov-cutoff", type=int, default=9999)
    p = _common(add("allc-to-region-count", "region", "2region"), "input", "output", "chrom-sizes", "contexts", "cell", "bin-size")
    p.add_argument("--regions")
    p = _common(add("allc-to-bigwig", "bw", "2bw", help="bedGraph tracks"), "input", "output", "chrom-sizes", "contexts", "bin-size")
    p.add_argument("--stranded", action="store_true")
    p = _common(add("generate-mcds", "mcds"), "input", "output", "chrom-sizes", "contexts", "cell", "bin-size")
    p.add_argument("--split-strand", action="store_true")
    p = _common(add("generate-mcad", "mcad"), "input", "output", "contexts", "cell")
    p.add_argument("--regions", required=True)
    p.add_argument("--cutoff", type=float, default=0.9)
    p.add_argument("--hyper", action="store_true")
    p = _common(add("generate-dataset", "dataset"), "input", "output", "chrom-sizes", "cell")
    p.add_argument("--set", action="append", nargs="+", required=True, metavar=("NAME", "REGIONS"), help="NAME, a bin size or BED file, then contexts")
    p = add("convert-mcds-to-zarr", help="any table Spark reads, as Parquet")
    p.add_argument("--input", required=True)
    p.add_argument("--format", default="parquet")
    p.add_argument("--output", required=True)
    p = _common(add("table-to-allc"), "output")
    p.add_argument("--input", required=True)
    p.add_argument("--columns", nargs="+", required=True, help="name=number pairs")
    p.add_argument("--sep", default="\t")
    p.add_argument("--header", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"methyloom {a.command}").getOrCreate()
    paths = readers.parse_paths(a.input) if isinstance(a.input, list) else a.input
    sizes = readers.read_chrom_sizes(spark, a.chrom_sizes) if getattr(a, "chrom_sizes", None) else None
    allc = lambda: readers.read_allc(spark, paths, cell=getattr(a, "cell", None))
    c = a.command
    if c in ("bam-to-allc", "allc", "2allc"):
        from .sources.fasta import read_fasta

        counted = so.pileup_counts(readers.read_pileup(spark, paths))
        writers.write_allc(so.add_context(counted, read_fasta(spark, a.fasta)), a.output)
    elif c in ("standardize-allc", "standard"):
        writers.write_allc(so.standardize(allc(), sizes, a.remove_additional), a.output, sizes)
    elif c in ("tabix-allc", "tbi"):
        writers.write_site_store(allc(), a.output)
    elif c in ("profile-allc", "profile"):
        so.profile(allc()).write.option("header", "true").csv(a.output)
    elif c in ("merge-allc", "merge"):
        writers.write_allc(so.merge_sites(allc()), a.output, sizes)
    elif c in ("extract-allc", "extract"):
        writers.write_extracts(so.extract_contexts(allc(), a.contexts, a.strandness, a.cov_cutoff, keys=()).withColumn("context", _pattern_or_context(a.strandness)), a.output, a.format)
    elif c in ("allc-to-region-count", "region", "2region"):
        if a.regions:
            mx.count_regions(allc(), readers.read_bed(spark, a.regions), a.contexts).write.parquet(a.output)
        else:
            mx.count_bins(allc(), sizes, a.bin_size, a.contexts).write.parquet(a.output)
    elif c in ("allc-to-bigwig", "bw", "2bw"):
        tracks = so.binned_tracks(allc(), sizes, a.bin_size, a.contexts, a.stranded)
        writers.write_bedgraph(tracks, a.output, ("pattern", "strand") if a.stranded else ("pattern",))
    elif c in ("generate-mcds", "mcds"):
        mx.count_bins(allc(), sizes, a.bin_size, a.contexts, a.split_strand).write.parquet(a.output)
    elif c in ("generate-mcad", "mcad"):
        counts = mx.count_regions(allc(), readers.read_bed(spark, a.regions), a.contexts)
        mx.scores(counts, "hyper" if a.hyper else "hypo", a.cutoff).write.parquet(a.output)
    elif c in ("generate-dataset", "dataset"):
        for name, regions, *contexts in a.set:
            if regions.isdigit():
                made = mx.count_bins(allc(), sizes, int(regions), contexts or ["CGN", "CHN"])
            else:
                made = mx.count_regions(allc(), readers.read_bed(spark, regions), contexts or ["CGN", "CHN"])
            made.write.parquet(f"{a.output}/{name}")
    elif c == "convert-mcds-to-zarr":
        writers.convert(spark, a.input, a.format, a.output)
    elif c == "table-to-allc":
        columns = {k: int(v) for k, v in (x.split("=") for x in a.columns)}
        writers.write_allc(readers.read_methylation_table(spark, a.input, columns, a.sep, a.header), a.output)


def _pattern_or_context(strandness: str):
    """Merged strands have no concrete context any more; their pattern stands for it."""
    from pyspark.sql import functions as F

    return F.col("pattern") if strandness == "merge" else F.col("context")


if __name__ == "__main__":
    main()
