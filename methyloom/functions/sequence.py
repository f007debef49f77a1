"""String functions on nucleotide sequences, contexts and labels."""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table

# IUPAC nucleotide codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ATCGN",
}


def expand_pattern(pattern: str) -> list[str]:
    """The concrete contexts of an IUPAC pattern, sorted. N stands for any base and for one that is not known, so CAN
    belongs to CHN and CNN does not; CH, which also names the two-letter class itself, is one of its own contexts."""
    pattern = pattern.upper()
    unknown = [c for c in pattern if c not in IUPAC]
    if unknown:
        raise ValueError(f"not an IUPAC code: {unknown[0]}")
    found = {"".join(p) for p in itertools.product(*[IUPAC[c] for c in pattern])}
    return sorted(found | {"CH"} if pattern == "CH" else found)


def pattern_table(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """``pattern``, ``context``: as many rows as the patterns have concrete contexts."""
    rows = [(p, c) for p in dict.fromkeys(patterns) for c in expand_pattern(p)]
    return small_table(spark, pattern=[p for p, _ in rows], context=[c for _, c in rows])


def pattern_regex(pattern: str) -> str:
    return "^" + "".join(f"[{IUPAC[c]}]" if len(IUPAC[c]) > 1 else c for c in pattern.upper()) + "$"


def matches(context: Column, pattern: str) -> Column:
    return context.isin(expand_pattern(pattern))


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of A, C, G, T, N in either case; other characters stay."""
    return F.reverse(F.translate(seq, "ACGTacgtNn", "TGCAtgcaNn"))


def bin_size_label(size: Column) -> Column:
    """100000 as 100k, 1500 as 1500, sizes of whole or half thousands above 1000 with k or m."""
    return (
        F.when((size >= 1_000_000) & (size % 1_000_000 == 0), F.concat((size / 1_000_000).cast("long").cast("string"), F.lit("m")))
        .when((size > 1000) & (size % 1000 == 0), F.concat((size / 1000).cast("long").cast("string"), F.lit("k")))
        .when((size > 1000) & (size % 500 == 0), F.concat(F.format_string("%.1f", size / 1000), F.lit("k")))
        .otherwise(size.cast("string"))
    )


def number_label(x: Column) -> Column:
    """A number as a short text for axes and tables: up to two decimals between 0.01 and 1, whole from 1 to 100, else two
    decimals and a power of ten; 0 as 0, null as null. Digits are rounded from the number's exact binary value, half to
    even, which the JVM's formats do not do; equal numbers are formatted once a batch."""

    def one(v: float) -> str:
        if v == 0:
            return "0"
        if 0.01 < v < 1:
            return f"{v:.2f}".rstrip("0")
        return str(int(v)) if 1 <= v < 100 else re.sub(r"E([+-])0(?=\d)", r"E\1", f"{v:.2E}")

    @F.arrow_udf("string")
    def label(x: pa.Array) -> pa.Array:
        coded = x.dictionary_encode()
        return pa.array([one(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return label(x.cast("double"))


def zoomed_range(low: Column, high: Column, scale: float) -> tuple[Column, Column]:
    """The ends of a range ``scale`` times as wide about the same centre."""
    more = (high - low) * (scale - 1) / 2
    return low - more, high + more


def truth_word(word: Column) -> Column:
    """Whether a word says yes; null for null."""
    return F.lower(F.trim(word)).isin("true", "t", "yes", "y", "1")


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length ``k`` with their place, as an array of structs (at, kmer); empty for shorter texts."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(0), F.length(seq) - k), lambda i: F.struct(i.alias("at"), F.substring(seq, i + 1, F.lit(k)).alias("kmer")))).otherwise(F.array().cast("array<struct<at:int,kmer:string>>"))


def clean_dim_name(name: str, reserved: tuple[str, ...] = ("cell", "sample", "mc_type", "count_type", "strand_type", "chrom", "pos")) -> str:
    """A name for a region set: no reserved name, no name that begins with chrom, dashes removed."""
    name = name.replace("-", "")
    if name in reserved:
        raise ValueError(f"{name} is reserved")
    if name.startswith("chrom") and name != "chrom" and not any(c.isdigit() for c in name):
        raise ValueError(f"{name} begins with chrom")
    return name
