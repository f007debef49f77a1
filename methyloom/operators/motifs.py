"""Motif scan of sequences with position weight matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODE = np.full(256, 4, np.int8)
_CODE[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2


def weights(pfm: Sequence[Sequence[float]], pseudo: float = 0.1, background: float = 0.25) -> np.ndarray:
    """Log2 odds (width x 4) of base frequencies or counts."""
    m = np.asarray(pfm, np.float64) + pseudo
    return np.log2(m / m.sum(1, keepdims=True) / background)


def balanced_threshold(pwm: np.ndarray, precision: int = 100, fold: float = 1000.0) -> float:
    """The score above which background sequences are ``fold`` times rarer than motif sequences would pass; from the
    exact distribution of rounded scores."""
    steps = np.round(pwm * precision).astype(int)
    low = steps.min(1).sum()
    size = steps.max(1).sum() - low + 1
    back, own = np.zeros(size), np.zeros(size)
    back[0] = own[0] = 1
    for row in steps:
        p = 2.0 ** (row / precision) * 0.25
        nb, no = np.zeros(size), np.zeros(size)
        for b in range(4):
            s = row[b] - row.min()
            nb[s:] += back[: size - s] * 0.25
            no[s:] += own[: size - s] * p[b]
        back, own = nb, no
    false, miss = np.cumsum(back[::-1])[::-1], np.cumsum(own)
    return float((np.argmax(false * fold <= np.maximum(miss, 1e-12)) + low) / precision)


def score_sequence(codes: np.ndarray, pwm: np.ndarray) -> np.ndarray:
    """Scores of the motif at every place of a sequence; places with an unknown base score -inf."""
    w = len(pwm)
    if len(codes) < w:
        return np.zeros(0)
    table = np.hstack([pwm, np.full((w, 1), -np.inf)])
    total = np.zeros(len(codes) - w + 1)
    for i in range(w):
        total += table[i, codes[i : len(codes) - w + 1 + i]]
    return total


def scan_motifs(sequences: DataFrame, motifs: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    """region, motif, n_motifs, max_score, total_score of both strands: how many places reach the motif's threshold,
    their largest and total score, rounded and clipped to 0..65535. Pairs without a hit are absent. ``motifs`` (name to
    weights and threshold) goes to every task: some kilobytes each. Null sequences have no hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = {k: (p, p[::-1, ::-1], t) for k, (p, t) in motifs.items()}
        for b in batches:
            out: dict[str, list] = {"region": [], "motif": [], "n_motifs": [], "max_score": [], "total_score": []}
            for region, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not seq:
                    continue
                codes = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
                for name, (forward, backward, threshold) in both.items():
                    s = np.concatenate([score_sequence(codes, forward), score_sequence(codes, backward)])
                    s = s[s >= threshold]
                    if len(s):
                        for key, v in zip(out, (region, name, len(s), *(int(np.clip(np.round(x), 0, 65535)) for x in (s.max(), s.sum())))):
                            out[key].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["region"], b.column(0).type), pa.array(out["motif"], pa.string()), *[pa.array(out[c], pa.int32()) for c in ("n_motifs", "max_score", "total_score")]], names=list(out))

    kind = sequences.schema["region"].dataType.simpleString()
    return sequences.select("region", "seq").mapInArrow(run, f"region {kind}, motif STRING, n_motifs INT, max_score INT, total_score INT")


def cluster_maximum(hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """region, cluster and the largest of each value over the motifs of a cluster (motif, cluster)."""
    return hits.join(clusters, "motif").groupBy("region", "cluster").agg(*[F.max(c).alias(c) for c in ("n_motifs", "max_score", "total_score")])
