"""Table schemas and key-column conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLC = "chrom STRING, pos BIGINT, strand STRING, context STRING, mc BIGINT, cov BIGINT, p INT"
ALLC_SNP = ALLC + ", snp_match STRING, snp_mismatch STRING"
BED3 = "chrom STRING, start BIGINT, end BIGINT"
BED4 = BED3 + ", region STRING"
CHROM_SIZES = "chrom STRING, size BIGINT"
FAIDX = "NAME STRING, LENGTH BIGINT, OFFSET BIGINT, LINEBASES INT, LINEWIDTH INT"
GTF = "chrom STRING, source STRING, feature STRING, start BIGINT, end BIGINT, score STRING, strand STRING, phase STRING, annotation STRING"
BEDGRAPH = "chrom STRING, start BIGINT, end BIGINT, value DOUBLE"


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with each column that an operator is about to add (whatever its letter case) renamed to ``<name>_in``."""
    taken = {c.lower() for c in df.columns}
    for name in names:
        for c in df.columns:
            if c.lower() == name.lower():
                new = c + "_in"
                while new.lower() in taken:
                    new += "_in"
                taken.add(new.lower())
                df = df.withColumnRenamed(c, new)
    return df


def few_values(df: DataFrame, column: str, most: int = 100_000) -> list:
    """The distinct non-null values of a column that has few (labels, samples, datasets), in order, on the driver. Raises
    where there are more than ``most``: nothing is left out silently."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}")
    return sorted(found)


def chrom_key(chrom: Column) -> Column:
    """What spellings of one chromosome share: no blanks around, lower case, no ``chr`` prefix."""
    low = F.lower(F.trim(chrom))
    return F.when(F.startswith(low, F.lit("chr")), F.substring(low, 4, 1 << 30)).otherwise(low)


def spell_chrom(df: DataFrame, chrom_sizes: DataFrame, column: str = "chrom") -> DataFrame:
    """``df`` with ``column`` in the spelling of ``chrom_sizes``; rows that name none of its chromosomes are left out.

    ``chrom_sizes`` is joined without a hint: Spark broadcasts it while its size is under the session's threshold.
    """
    names = chrom_sizes.where(F.col("chrom").isNotNull()).groupBy(chrom_key(F.col("chrom")).alias("__chrom_key")).agg(F.min("chrom").alias("__spelt"))
    order = df.columns
    return df.withColumn("__chrom_key", chrom_key(F.col(f"`{column}`"))).join(names, "__chrom_key").drop("__chrom_key", column).withColumnRenamed("__spelt", column).select(*[f"`{c}`" for c in order])


def label_key(label: Column) -> Column:
    """Labels are compared in lower case without surrounding blanks."""
    return F.lower(F.trim(label))
