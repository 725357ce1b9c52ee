"""Items of varying length laid into containers of a fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.skew import running_total
from skein.session import materialize

#: Largest size of each class, as a part of the capacity.
CLASSES = (1, 2, 4, 16, 64)
_ITEM = ["id", "n", "whole", "rest"]


def pack(items: DataFrame, id: str, size: str, capacity: int, *, rows_per_task: int = 50_000) -> DataFrame:
    """(id, part, n_parts, size, container): every item laid into containers of ``capacity``.

    An item larger than the capacity is cut into full containers and one rest (part 0, 1, ...); no other item is cut.

    Method: bulk-synchronous best fit. Rounds go over size classes, largest first. In a round the items of the class and the
    gaps that may take one are sorted together into ranges of size, and every range is swept at once, largest first: an
    item goes to its successor, the smallest gap of the range that takes it; what the gap has left comes up again where the
    sweep reaches its size. Items that find no gap in their range compete for the gaps left over in higher ranges: both have
    ranks, a driver-side pass over one count per range says which ranks meet, and a join by rank gives each its own
    place. The gaps are updated, and a second sweep over the items still left takes what has come free and opens containers
    for the rest. Gaps stay in the state for the smaller classes. There are at most two sweeps per class, and five classes,
    however many items; a round of fewer than ``rows_per_task`` rows is one range, and then exactly sequential best fit.

    Containers are numbered from 0, those of rests and whole items first. Only counts per class and range reach the driver.

    Defined cases: a size of 0 or null takes no room (container null, one part); negative sizes are an error; repeated ids
    are separate items; ties of size are spread over ranges, so one size may make up any share of the items; an empty table
    gives no rows; other columns are not looked at.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    checked = F.when(n < 0, F.raise_error(F.lit("negative size"))).otherwise(n)
    sized = items.select(F.col(id).alias("id"), checked.alias("n")).select("id", "n", F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(0).cast("bigint").alias("whole"))
    base = materialize(sized.withColumns({"rest": F.col("n") - F.col("whole") * capacity, "row": F.monotonically_increasing_id()}), "items")
    rests, made = _fit(base.where("rest > 0"), capacity, rows_per_task)
    parts = F.when(F.col("rest") > 0, F.col("whole") + 1).otherwise(F.col("whole"))
    ends = rests.select("id", F.col("whole").alias("part"), (F.col("whole") + 1).alias("n_parts"), F.col("rest").alias("size"), "container")
    cut = running_total(base.where("whole > 0"), ["id", "n", "row"], "whole", "before", "cut")
    pieces = cut.select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("part"), parts.alias("n_parts"), "before").select("id", "part", "n_parts", F.lit(capacity).cast("bigint").alias("size"), (F.lit(made) + F.col("before") + F.col("part")).cast("bigint").alias("container"))
    none = base.where("n = 0").select("id", F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("n_parts"), F.col("n").alias("size"), F.lit(None).cast("bigint").alias("container"))
    return ends.unionByName(pieces).unionByName(none).withColumnRenamed("id", id)


def _fit(items: DataFrame, capacity: int, rows_per_task: int) -> tuple[DataFrame, int]:
    """(items with their container, number of containers)."""
    spark = items.sparkSession
    tops = [capacity // c for c in CLASSES if capacity // c]
    bottoms = [*tops[1:], 0]
    level = lambda c: reduce(lambda rest, j: F.when(F.col(c) > bottoms[j], j).otherwise(rest), reversed(range(len(tops) - 1)), F.lit(len(tops) - 1))
    sizes = {r.j: r.k for r in items.groupBy(level("rest").alias("j")).agg(F.count("*").alias("k")).collect()}  # a row per class
    gaps, held = spark.range(0).select(F.col("id").alias("container"), F.col("id").alias("gap")), np.zeros(len(tops), int)  # and how many of each class at most
    most, made = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
    placed: list[DataFrame] = []
    for j, (top, bottom) in enumerate(zip(tops, bottoms)):
        left, k = items.where((F.col("rest") > bottom) & (F.col("rest") <= top)).select(*_ITEM, "row"), sizes.get(j, 0)
        last = False
        while k:
            n_gaps = int(held[: j + 1].sum())
            ranges = max(1, min(most, -(-(k + n_gaps) // rows_per_task)))
            opening = last or ranges == 1 or not n_gaps
            told = _sweep(left, gaps.where(F.col("gap") > bottom), capacity, top, ranges, opening, bottoms)
            by = {r.part: r for r in told.where("kind = 3").select("part", "opened", "missed", "slots", "held").collect()}  # one row per range
            first = [made + sum(by[q].opened for q in by if q < p) for p in range(ranges)]
            number = F.col("container") + F.when(F.col("local"), F.element_at(F.array(*[F.lit(x).cast("bigint") for x in first]), F.col("part") + 1)).otherwise(0)
            told = told.withColumn("container", number)
            placed.append(told.where("kind = 0").select(*_ITEM, "container"))
            made += sum(r.opened for r in by.values())
            swept, missed, k = told.where("kind = 2").select("container", "gap"), told.where("kind = 1").select(*_ITEM, "row"), sum(r.missed for r in by.values())
            if k and (ranks := _meeting_ranks(by)):
                met = _meet(told, *ranks)
                placed.append(met.select(*_ITEM, "container"))
                used = met.groupBy("container").agg(F.sum("rest").alias("used"))
                swept = swept.join(used, "container", "left").select("container", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
                missed, k = missed.join(met.select("row"), "row", "left_anti").select(*_ITEM, "row"), k - sum(z - a for _, a, z, _ in ranks[0])
            gaps, left, last = swept.unionByName(gaps.where(F.col("gap") <= bottom)), missed, True
            held[: j + 1] = 0
            held = reduce(np.add, [r.held for r in by.values()], held)
    empty = items.limit(0).select(*_ITEM, F.lit(0).cast("bigint").alias("container"))
    return reduce(DataFrame.unionByName, placed, empty), made


def _sweep(items: DataFrame, gaps: DataFrame, capacity: int, top: int, ranges: int, opening: bool, bottoms: list[int]) -> DataFrame:
    """One sweep over all ranges, written: kind 0 items with their container, 1 items without, by rank; 2 the gaps as they are
    then, with the rank of their first place for items of lower ranges; 3 the counts of a range. ``local``: the container was
    opened in this range and is numbered within it."""
    both = items.select(*_ITEM, "row", F.col("rest").alias("key"), F.lit(None).cast("bigint").alias("gap")).unionByName(
        gaps.select(F.col("container").alias("row"), F.least(F.col("gap"), F.lit(top)).cast("bigint").alias("key"), F.col("gap").cast("bigint").alias("gap")), allowMissingColumns=True
    )
    # gaps before items of their size, and of the gaps that take any item the smallest last
    order = [F.desc("key"), F.expr("gap IS NULL"), F.desc("gap"), F.asc("row")]
    ranged = both.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    extra = T.StructType.fromDDL("part int, kind int, container bigint, local boolean, gap bigint, rank bigint, opened bigint, missed bigint, slots bigint, held array<bigint>")
    schema = T.StructType([*[ranged.schema[c] for c in (*_ITEM, "row")], *extra.fields])
    return materialize(ranged.mapInArrow(_sweeper(capacity, opening, bottoms), schema), "sweep")


def _sweeper(capacity: int, opening: bool, bottoms: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, schema, key = TaskContext.get().partitionId(), None, 0
        stack: list[list] = []  # [gap, container, local], the smallest last
        later: list[tuple[int, int, bool]] = []  # gaps smaller than what is being placed, the largest first
        opened = missed = 0

        def come_up(size: int) -> None:
            while later and -later[0][0] >= size:
                g, c, own = heappop(later)
                stack.append([-g, c, own])

        def rows(count: int, sort: int, /, **columns) -> pa.RecordBatch:
            given = {"part": [part] * count, "kind": [sort] * count} | columns
            return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if isinstance(given.get(f.name), pa.Array) else pa.array(given.get(f.name, [None] * count), f.type) for f in schema], schema=schema)

        for b in batches:
            if schema is None:
                own = [b.schema.field(c) for c in (*_ITEM, "row")]
                schema = pa.schema([*own, pa.field("part", pa.int32()), pa.field("kind", pa.int32()), pa.field("container", pa.int64()), pa.field("local", pa.bool_()), *[pa.field(c, pa.int64()) for c in ("gap", "rank", "opened", "missed", "slots")], pa.field("held", pa.list_(pa.int64()))])
            at, container, local, out, rank = [], [], [], [], []
            for i, (row, key, gap) in enumerate(zip(b.column("row").to_pylist(), b.column("key").to_pylist(), b.column("gap").to_pylist())):
                come_up(key)
                if gap is not None:
                    stack.append([gap, row, False])
                    continue
                if not stack:
                    if not opening:
                        out.append(i)
                        rank.append(missed)
                        missed += 1
                        continue
                    stack.append([capacity, opened, True])
                    opened += 1
                best = stack[-1]
                best[0] -= key
                at.append(i)
                container.append(best[1])
                local.append(best[2])
                if best[0] < key:
                    stack.pop()
                    if best[0]:
                        heappush(later, (-best[0], best[1], best[2]))
            for kind, which, more in ((0, at, {"container": container, "local": local}), (1, out, {"rank": rank})):
                if which:
                    some = b.take(pa.array(which))
                    yield rows(len(which), kind, **{c: some.column(c) for c in (*_ITEM, "row")}, **more)
        if schema is None:
            return
        gaps = sorted([(g, c, own) for g, c, own in stack] + [(-g, c, own) for g, c, own in later])
        fits = np.array([g for g, _, _ in gaps], np.int64) // max(key, 1)  # places for items of lower ranges: none is larger than the last key
        ranks = np.cumsum(fits) - fits
        for lo in range(0, len(gaps), 65_536):
            g, c, own = zip(*gaps[lo : lo + 65_536])
            yield rows(len(g), 2, gap=list(g), container=list(c), local=list(own), rank=ranks[lo : lo + 65_536].tolist(), slots=fits[lo : lo + 65_536].tolist())
        above = [sum(g > x for g, _, _ in gaps) for x in bottoms]
        yield rows(1, 3, opened=[opened], missed=[missed], slots=[int(fits.sum())], held=[np.diff(above, prepend=0).tolist()])

    return run


def _meeting_ranks(by: dict) -> tuple[list, list] | None:
    """Which ranks of items without a place meet which ranks of places, as (range, from, to, shift to the number of the
    meeting) of both: an item looks in the nearest higher range that has places left. At most two per range."""
    free: list[list[int]] = []
    items, places, at = [], [], 0
    for p in sorted(by):
        done = 0
        while done < by[p].missed and free:
            q, lo, hi = free[-1]
            n = min(by[p].missed - done, hi - lo)
            items.append((p, done, done + n, at - done))
            places.append((q, lo, lo + n, at - lo))
            free[-1][1] += n
            done, at = done + n, at + n
            if free[-1][1] == hi:
                free.pop()
        if by[p].slots:
            free.append([p, 0, by[p].slots])
    return (items, places) if at else None


def _meet(told: DataFrame, items: list, places: list) -> DataFrame:
    """(item, row, container) of the items that found a place in a higher range."""
    spark = told.sparkSession
    ranks = lambda rows: F.broadcast(spark.createDataFrame(rows, "part int, lo bigint, hi bigint, shift bigint"))  # noqa: E731  # at most two rows per range
    asking = told.where("kind = 1").join(ranks(items), "part").where("rank >= lo AND rank < hi").select(*_ITEM, "row", (F.col("rank") + F.col("shift")).alias("meeting"))
    free = told.where("kind = 2 AND slots > 0").join(ranks(places), "part").where("rank < hi AND rank + slots > lo")
    one = free.select("container", "shift", F.explode(F.expr("sequence(greatest(lo, rank), least(hi, rank + slots) - 1)")).alias("at"))
    return materialize(asking.join(one.select("container", (F.col("at") + F.col("shift")).alias("meeting")), "meeting").drop("meeting"), "met")
