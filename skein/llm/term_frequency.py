"""How often every distinct term occurs and in how many records."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

#: Bits by which an oversized partition is split in one step.
STEP = 4
#: Bits of the hash that may be used for splitting.
MOST = 60


def term_frequencies(
    records: DataFrame,
    elements: str = "elements",
    *,
    rare_at_most: int = 2,
    common_share: float = 0.2,
    part_rows: int = 4_000_000,
    memory_mb: int = 192,
) -> DataFrame:
    """(term, n_records, n_occurrences, mark) of every distinct non-null string in the array column ``elements``.

    Method: recursive radix spilling. Every batch of records is reduced to one row per distinct term and written with the
    64-bit hash of the term. The top bits of the hash divide these runs into partitions of about ``part_rows`` rows;
    partitions that turn out more than twice as large are split by the next bits, again and again. One task takes one
    partition after another and aggregates each in DuckDB under ``memory_mb``, which spills to the folder that Spark gives
    its workers for spilling. A term in a third of all records arrives as one row per batch, not per record.
    No list of partitions reaches the driver: oversized ones are a small table.

    mark: "rare" if at most ``rare_at_most`` records hold the term, "common" if at least ``common_share`` of all records do
    (common wins), else null. n_records counts a record once, n_occurrences every element. Null arrays, null elements and
    empty tables give no terms; records without terms count in the share. No row is dropped, capped or sampled.
    """
    runs = materialize(records.select(F.col(elements).alias("e")).mapInArrow(_count_batch, "term string, n_records bigint, n_occurrences bigint").withColumn("h", F.xxhash64("term")), "runs")
    all_rows, n = runs.agg(F.count("term"), F.sum(F.when(F.col("term").isNull(), F.col("n_records")))).first()
    runs = runs.where(F.col("term").isNotNull())
    placed = _leaves(runs, all_rows, part_rows)
    folder = max(1, -(-all_rows // part_rows))
    parts = max(folder, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.select("term", "n_records", "n_occurrences", "leaf").repartition(parts, "leaf").sortWithinPartitions("leaf")
    counted = placed.mapInArrow(_aggregate(memory_mb), "term string, n_records bigint, n_occurrences bigint")
    # in whole numbers, so that a share of exactly a fifth counts
    least = F.lit(n or 0) * F.lit(round(common_share * 1_000_000)).cast("bigint")
    mark = F.when(F.col("n_records") * 1_000_000 >= least, "common").when(F.col("n_records") <= rare_at_most, "rare")
    return counted.withColumn("mark", mark)


def _leaves(runs: DataFrame, rows: int, part_rows: int) -> DataFrame:
    """The runs with the partition that each lies in (``leaf``: a number of its own for every depth and prefix).

    A level's oversized partitions are at most rows / (2 * part_rows): a broadcast table of one number each.
    """
    bits = max(6, (max(1, rows // part_rows) * 4 - 1).bit_length())
    top = lambda b: F.shiftrightunsigned("h", 64 - b)
    out, inside = runs.withColumn("leaf", top(bits).cast("decimal(38,0)")), F.lit(True)
    while bits + STEP <= MOST:
        sizes = out.where(inside).groupBy(top(bits).alias("_p")).agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("z"))
        # a partition that is one term alone cannot be split by its hash
        large = materialize(sizes.where((F.col("n") > 2 * part_rows) & (F.col("a") < F.col("z"))).select("_p"), "large")
        if large.isEmpty():
            break
        bits += STEP
        deeper = top(bits).cast("decimal(38,0)") + F.lit(str(1 << (64 + bits // STEP))).cast("decimal(38,0)")
        out = out.join(F.broadcast(large), top(bits - STEP) == F.col("_p"), "left").withColumn("leaf", F.when(F.col("_p").isNotNull(), deeper).otherwise(F.col("leaf"))).drop("_p")
        inside = F.col("leaf") >= F.lit(str(1 << (64 + bits // STEP))).cast("decimal(38,0)")
    return out


def _count_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct term of each batch; a row without term holds the number of records."""
    for b in batches:
        lists = b.column(0)
        flat = lists.flatten()
        sizes = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        codes = flat.dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        at = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        record = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
        at, k = at[at >= 0], len(codes.dictionary)
        occurrences = np.bincount(at, minlength=k)
        holders = np.bincount(np.unique(record * max(k, 1) + at) % max(k, 1), minlength=k)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([codes.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(np.append(holders, b.num_rows), pa.int64()), pa.array(np.append(occurrences, 0), pa.int64())],
            names=["term", "n_records", "n_occurrences"],
        )


def _aggregate(memory_mb: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # the folders that Spark hands its Python workers for spilling; they end with the application
        root = os.environ["SPARK_LOCAL_DIRS"].split(",")[0]
        scratch = tempfile.mkdtemp(prefix="radix-", dir=root)
        try:
            db = duckdb.connect(f"{scratch}/part.db", config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": f"{scratch}/spill", "preserve_insertion_order": False})
            db.execute("CREATE TABLE part (term VARCHAR, n_records BIGINT, n_occurrences BIGINT)")
            here = None

            def result():
                yield from db.sql("SELECT term, sum(n_records)::BIGINT AS n_records, sum(n_occurrences)::BIGINT AS n_occurrences FROM part GROUP BY term").to_arrow_reader(65536)
                db.execute("TRUNCATE part")

            for b in batches:
                leaf = b.column("leaf")
                ends = [0, *(i + 1 for i in np.flatnonzero(pa.compute.not_equal(leaf[1:], leaf[:-1]).to_numpy(zero_copy_only=False))), b.num_rows] if b.num_rows else []
                for lo, hi in zip(ends, ends[1:]):
                    if here is not None and leaf[lo] != here:
                        yield from result()
                    here = leaf[lo]
                    chunk = pa.Table.from_batches([b.slice(lo, hi - lo)])  # noqa: F841 (read by name)
                    db.execute("INSERT INTO part SELECT term, n_records, n_occurrences FROM chunk")
            if here is not None:
                yield from result()
            db.close()
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    return run
