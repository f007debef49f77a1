"""The library's functions for SQL text."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .sequence import expand_pattern, pattern_table
from .stats import incomplete_beta, log_gamma


@pandas_udf(DoubleType())
def binom_sf(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
    """P(X > k) of n draws of probability p."""
    n, k, p = (x.to_numpy(dtype=float) for x in (n, k, p))
    inside = incomplete_beta(np.maximum(k, 0) + 1, np.maximum(n - k, 1e-9), np.clip(p, 0, 1))
    return pd.Series(np.where(k < 0, 1.0, np.where(k >= n, 0.0, inside)))


@pandas_udf(DoubleType())
def poisson_sf(k: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X > k) of mean ``mean``."""

    def below(x: float, m: float) -> float:
        i = np.arange(int(x) + 1)
        return float(np.exp(-m + i * math.log(m) - log_gamma(i + 1.0)).sum()) if m > 0 and x >= 0 else float(x >= 0)

    return pd.Series([1 - below(x, m) for x, m in zip(k, mean)])


@pandas_udf(DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    """P(X > z) of the standard normal."""
    return pd.Series([0.5 * math.erfc(x / math.sqrt(2)) for x in z])


@udtf(returnType=StructType([StructField("context", StringType())]))
class MatchingContexts:
    """The concrete contexts of an IUPAC pattern."""

    def eval(self, pattern: str):
        for c in expand_pattern(pattern):
            yield (c,)


def register_functions(spark: SparkSession) -> None:
    """SQL functions binom_sf(n, k, p), poisson_sf(k, mean), norm_sf(z), the table function matching_contexts(pattern)
    and the view mc_patterns (pattern, context)."""
    for name, f in (("binom_sf", binom_sf), ("poisson_sf", poisson_sf), ("norm_sf", norm_sf)):
        spark.udf.register(name, f)
    spark.udtf.register("matching_contexts", MatchingContexts)
    pattern_table(spark, ["CGN", "CHN", "HCHN", "GCYN", "CNN"]).createOrReplaceTempView("mc_patterns")
