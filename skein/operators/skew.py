"""Joins and prefix sums that stay even when one key holds a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

#: Longest key, in bytes, that travels in the broadcast part as it is.
KEY_BYTES = 1024


def lookup_join(rows: DataFrame, table: DataFrame, on: str, freq: str, hot_rows: int = 10_000) -> DataFrame:
    """Inner join of many ``rows`` with a ``table`` of unique keys whose column ``freq`` counts the rows of a key.

    Keys that hold more than a ``hot_rows``-th of all rows meet their rows by broadcast: there are fewer than ``hot_rows``
    of them, since frequencies add up to the number of rows. Keys of more than KEY_BYTES are broadcast as SHA-256 digests,
    so each is at most that long and the broadcast is bounded whatever the data. All other keys are joined by shuffle,
    where none of them is hot. No row is lost or capped. ``table`` should be materialized: its total is read first. Null keys
    do not join. An empty table gives no rows.
    """
    text = lambda df: df[on].cast("string")
    long = F.octet_length(text(table)) > KEY_BYTES
    total, longest = table.agg(F.sum(freq), F.max(F.when(long, F.col(freq)))).first()
    total = total or 0
    hot = F.col(freq) > total / hot_rows
    near = table.where(hot & ~long)
    parts = [rows.join(F.broadcast(near), on)]
    rest = rows.join(F.broadcast(near.select(on)), on, "left_anti")
    if longest is not None and longest > total / hot_rows:
        digests = table.where(hot & long).select(F.sha2(text(table), 256).alias("_digest"), *[c for c in table.columns if c != on])
        is_long = F.octet_length(text(rows)) > KEY_BYTES
        parts.append(rows.where(is_long).join(F.broadcast(digests), F.sha2(text(rows), 256) == F.col("_digest")).drop("_digest"))
        rest = rest.join(F.broadcast(digests.select("_digest")), F.when(F.octet_length(text(rest)) > KEY_BYTES, F.sha2(text(rest), 256)) == F.col("_digest"), "left_anti")
    parts.append(rest.join(table.where(~hot), on))
    return reduce(DataFrame.unionByName, parts)


def running_total(df: DataFrame, order: list[str], value: str, out: str, label: str = "ranges") -> DataFrame:
    """Adds ``out``: the sum of ``value`` (bigint, not null) over all rows before this one in ``order``.

    Rows are range-partitioned and sorted by Spark, written once, summed within each range in one streaming pass, and
    shifted by the ranges' totals; only one number per range reaches the driver. ``order`` should be a total order, else
    ties are broken arbitrarily but only once. No single-task window.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    ranged = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).mapInArrow(_running(value), schema=_with(df, "_range int, _run bigint")), label)
    totals = {r["_range"]: r.t for r in ranged.groupBy("_range").agg(F.max(F.col("_run") + F.col(value)).alias("t")).collect()}
    shifts, at = [], 0
    for k in range(max(totals, default=-1) + 1):
        shifts.append(at)
        at += totals.get(k, 0)
    # one literal array, read by index: the cost of a row does not grow with the number of ranges
    base = F.get(F.array(*[F.lit(x).cast("bigint") for x in shifts or [0]]), F.col("_range"))
    return ranged.select(*cols, (F.col("_run") + base).alias(out))


def _with(df: DataFrame, more: str):
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def _running(value: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(v) + at
            if len(ends):
                at = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - v, pa.int64())], names=[*b.schema.names, "_run"])

    return run
