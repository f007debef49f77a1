"""Continuous covered periods and gaps of intervals per entity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rows of an Arrow batch are scanned together; state between batches is one open island.
_SUMMARY = "part INT, first STRING, last STRING, last_start BIGINT, last_max BIGINT"


class _Scan:
    """Running islands over rows sorted by entity and start."""

    def __init__(self, carry: tuple[str, int, int] | None):
        self.open = carry
        self.first: str | None = None

    def step(self, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        """Takes the next rows; gives the periods that are closed by now and the gaps between periods."""
        if self.first is None:
            self.first = key[0]
        if self.open is not None:
            key, start, end = np.r_[np.array([self.open[0]], dtype=object), key], np.r_[self.open[1], start], np.r_[self.open[2], end]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        top = pd.Series(end).groupby(np.cumsum(new)).cummax().to_numpy()
        island = new.copy()
        island[1:] |= start[1:] > top[:-1]
        at = np.flatnonzero(island)
        until = np.r_[at[1:] - 1, len(key) - 1]
        self.open = (key[at[-1]], int(start[at[-1]]), int(top[until[-1]]))
        inner = at[1:][~new[at[1:]]]
        return pd.concat(
            [
                pd.DataFrame({"key": key[at[:-1]], "kind": "period", "start": start[at[:-1]], "end": top[until[:-1]]}),
                pd.DataFrame({"key": key[inner], "kind": "gap", "start": top[inner - 1], "end": start[inner]}),
            ]
        )


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column(0).to_pandas().to_numpy(dtype=object), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = _Scan(None)
    for b in batches:
        if b.num_rows:
            scan.step(*_arrays(b))
    if scan.open is not None:
        row = {"part": [TaskContext.get().partitionId()], "first": [scan.first], "last": [scan.open[0]], "last_start": [scan.open[1]], "last_max": [scan.open[2]]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("last_start", pa.int64()), ("last_max", pa.int64())]))


def prefix_combine(summaries: Sequence[tuple]) -> tuple[dict[int, tuple[str, int, int]], set[int]]:
    """From the partitions' summaries, in order: the open island that enters each partition, and the partitions
    whose last island is left for the next one to close.

    A summary is (partition, first entity, last entity, start of the last entity's last island, its largest end).
    """
    carry: dict[int, tuple[str, int, int]] = {}
    left: set[int] = set()
    state: tuple[str, int, int] | None = None
    before = -1
    for part, first, last, start, top in summaries:
        if state is not None and state[0] == first:
            carry[part] = state
            left.add(before)
            if first == last:
                state = (last, state[1] if start <= state[2] else start, max(state[2], top))
            else:
                state = (last, start, top)
        else:
            state = (last, start, top)
        before = part
    return carry, left


def periods_and_gaps(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", partitions: int | None = None) -> DataFrame:
    """The longest stretches that the intervals of an entity cover without interruption, and the gaps between them.

    Returns ``by``, ``kind`` (``period`` or ``gap``), ``start``, ``end``. Intervals are half open; intervals that
    touch are continuous. Rows with a null start or end, or with an end not above the start, are left out. A null in
    ``by`` is an entity value of its own. Repeated rows change nothing; an empty table gives an empty result. Other
    columns, whatever their names, are not read.

    Plan: one global range sort by entity and start, kept in the shared folder; one row of maximum-end summary per
    partition; the driver combines these rows (as many as partitions, never data) into the island that enters each
    partition; a second scan of the sorted partitions, with that carried state, labels the islands. Ties of entity
    and start spread over partitions by end and a hash, so that neither a hot entity nor a repeated start makes a
    large task.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    rows = df.where(s.isNotNull() & e.isNotNull() & (e > s)).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in by])).alias("key"), s.alias("start"), e.alias("end"))
    rows = rows.withColumn("tie", F.xxhash64("key", "start", "end", F.monotonically_increasing_id()))
    ordered = cut(rows.repartitionByRange(n, "key", "start", "end", "tie").drop("tie").sortWithinPartitions("key", "start"))
    summaries = sorted(tuple(r) for r in ordered.mapInArrow(_summarise, _SUMMARY).collect())
    carry, left = prefix_combine(summaries)
    out = pa.schema([("key", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        scan = _Scan(carry.get(part))
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pandas(scan.step(*_arrays(b)), schema=out, preserve_index=False)
        if scan.first is not None and part not in left:
            key, a, z = scan.open
            yield pa.RecordBatch.from_pydict({"key": [key], "kind": ["period"], "start": [a], "end": [z]}, schema=out)

    found = ordered.mapInArrow(rescan, "key STRING, kind STRING, start BIGINT, end BIGINT")
    entity = df.select(*[f"`{c}`" for c in by]).schema
    keys = F.from_json("key", entity)
    return found.select(*[keys.getField(c).alias(c) for c in by], "kind", "start", "end")
