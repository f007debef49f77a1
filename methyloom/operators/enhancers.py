"""Enhancer prediction: features per region and sample, a classifier, and calls from scored bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import periods_and_gaps
from .rangejoin import overlaps


def agreed_labels(training: DataFrame, dmrs: DataFrame) -> DataFrame:
    """dmr, label: regions that overlap training regions (region, chrom, start, end, label) which all agree."""
    hit = overlaps(dmrs.select("dmr", "chrom", "start", "end"), training.select("region", "chrom", "start", "end", "label"), "dmr", "region")
    return hit.groupBy("dmr").agg(F.min("b_label").alias("label"), F.max("b_label").alias("__hi")).where("label = __hi").drop("__hi")


def sample_features(values: DataFrame) -> DataFrame:
    """region, sample, modality, value, delta, mean, std: a sample's value and how it differs from the mean and
    deviation of the other samples of its region and modality."""
    w = Window.partitionBy("region", "modality")
    n, s, q = F.count("value").over(w) - 1, F.sum("value").over(w) - F.col("value"), F.sum(F.col("value") * F.col("value")).over(w) - F.col("value") * F.col("value")
    mean = F.try_divide(s, n)
    std = F.sqrt(F.greatest(F.try_divide(q, n) - mean * mean, F.lit(0.0)))
    return values.select("region", "sample", "modality", "value", (F.col("value") - mean).alias("delta"), mean.alias("mean"), std.alias("std"))


def feature_table(features: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """One row per region and sample with value and delta of every modality; missing ones stay null."""
    return features.groupBy("region", "sample").pivot("modality", list(modalities)).agg(F.first("value").alias("value"), F.first("delta").alias("delta"))


def train(table: DataFrame, columns: Sequence[str], label: str = "label", trees: int = 50, seed: int = 0):
    """A random forest on complete rows; also gives what :func:`predict` needs."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = table.dropna(subset=[*columns, label]).withColumn("__y", F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="__x"), RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, seed=seed)]).fit(rows)


def predict(model, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``table`` with ``score``: probability of the positive class, 0 where a feature is missing."""
    from pyspark.ml.functions import vector_to_array

    done = model.transform(table.dropna(subset=list(columns))).withColumn("score", vector_to_array("probability")[1]).select(*table.columns, "score")
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNull()
    return done.unionByName(table.where(some).withColumn("score", F.lit(0.0)))


def call_enhancers(bins: DataFrame, threshold: float, merge_dist: int, dmrs: DataFrame | None = None) -> DataFrame:
    """chrom, start, end (, dmrs): runs of bins (chrom, start, end, score) above ``threshold``, merged over gaps of up to
    ``merge_dist`` bases, with the ids of the regions they overlap joined by commas."""
    high = bins.where(F.col("score") > threshold).select("chrom", "start", (F.col("end") + merge_dist).alias("end"))
    found = periods_and_gaps(high, ["chrom"]).where("kind = 'period'").select("chrom", "start", (F.col("end") - merge_dist).alias("end"))
    if dmrs is None:
        return found
    named = found.withColumn("__e", F.concat_ws(":", "chrom", F.col("start").cast("string")))
    ids = overlaps(named.select("__e", "chrom", "start", "end"), dmrs.select("dmr", "chrom", "start", "end"), "__e", "dmr").groupBy("__e").agg(F.array_join(F.array_sort(F.collect_set("dmr")), ",").alias("dmrs"))
    return named.join(ids, "__e", "left").drop("__e")
