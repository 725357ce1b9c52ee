"""How often two items stand in the same record, and how far beyond chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.skew import lookup_join
from skein.session import materialize

#: An item's number is 11 bits of its hash and 20 bits of its place among the items of that hash.
GROUP_BITS, PLACE_BITS = 11, 20
#: So many items fit: beyond it places might run out in some group.
MOST_ITEMS = int(0.7 * (1 << GROUP_BITS + PLACE_BITS))
#: Pair codes that are sorted at once in a task.
RUN = 2_000_000


def item_pairs(records: DataFrame, items: str = "terms", *, at_least: int = 1, tile: int = 1024, most_items: int = MOST_ITEMS) -> DataFrame:
    """Every pair of different items that at least ``at_least`` records hold together, with measures of association.

    Method: external sort of packed 64-bit pair codes. Items held by fewer than ``at_least`` records can be in no such
    pair and are left out exactly. The others get 31-bit numbers, a pair is one bigint. Each task writes sorted runs of
    codes with their run lengths (a hot pair leaves a run as one row); Spark's external sorter spills and merges the runs
    of a partition; one streaming pass adds up equal neighbours. A record of more than ``tile`` items is cut into pairs of
    tiles that are spread over the tasks, so one long record does not fill one. More items than 31-bit numbers (``most_items``)
    get numbers of 63 bits, and pairs of them are counted by Spark's aggregation on both numbers instead. The numbers
    become items again by a join that splits items with many partners.

    Out: item_a < item_b in code point order, n_ab, n_a, n_b, n (records, those without items included), lift =
    n_ab n / (n_a n_b), log_odds and its standard error with 0.5 added to each cell, z = log_odds / error.
    ``items`` must hold distinct values per record (null ones are ignored, repeats are removed here). Null and empty arrays
    and empty tables give no pairs. Other columns are not looked at.
    """
    base = materialize(records.select(F.monotonically_increasing_id().alias("rec"), F.array_distinct(F.filter(items, lambda t: t.isNotNull())).alias("items")), "records")
    n = base.count()
    held = base.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= at_least)
    base_items = materialize(held.withColumn("hash", F.xxhash64("item")), "held")
    packed = base_items.count() <= most_items
    groups, places = (GROUP_BITS, PLACE_BITS) if packed else (2 * GROUP_BITS, 63 - 2 * GROUP_BITS)
    place = F.row_number().over(Window.partitionBy("grp").orderBy("item"))
    number = F.shiftleft(F.col("grp").cast("bigint"), places) + place
    vocabulary = materialize(base_items.withColumn("grp", F.pmod("hash", F.lit(1 << groups))).select("item", "n_item", number.alias("code")), "items")
    coded = lookup_join(base.where(F.size("items") > 1).select("rec", F.explode("items").alias("item")), vocabulary, "item", "n_item")
    sets = coded.groupBy("rec").agg(F.sort_array(F.collect_list("code")).alias("c")).where(F.size("c") > 1)
    short = sets.where(F.size("c") <= tile).select("c", F.lit(None).cast("array<bigint>").alias("d"))
    # one row per tile, then per pair of tiles; the whole record goes no further than the generator that cuts it
    cut = lambda i: f"slice(c, int({i}) * {tile} + 1, {tile})"
    last = f"int((size(c) - 1) div {tile})"
    firsts = sets.where(F.size("c") > tile).selectExpr("rec", f"explode(transform(sequence(0, {last}), i -> struct(i, {cut('i')} AS a, transform(sequence(i, {last}), j -> {cut('j')}) AS rest))) AS t")
    long = firsts.selectExpr("rec", "t.i AS i", "t.a AS c", "posexplode(t.rest) AS (j, d)").selectExpr("rec", "i", "j", "c", "IF(j > 0, d, NULL) AS d").repartition("rec", "i", "j").select("c", "d")
    rows = short.unionByName(long)
    if packed:
        runs = rows.mapInArrow(_runs, "pair bigint, n_ab bigint")
        merged = runs.repartition("pair").sortWithinPartitions("pair").mapInArrow(_merge, "pair bigint, n_ab bigint")
        numbers = merged.select("n_ab", F.shiftright("pair", 32).alias("x"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("y"))
    else:
        both = "IF(d IS NULL, flatten(transform(c, (x, i) -> transform(slice(c, i + 2, size(c)), y -> struct(x, y)))), flatten(transform(c, x -> transform(d, y -> struct(x, y)))))"
        numbers = rows.selectExpr(f"inline({both}) AS (x, y)").groupBy("x", "y").agg(F.count("*").alias("n_ab"))
    pairs = materialize(numbers.where(F.col("n_ab") >= at_least), "pairs")
    partners = pairs.select(F.explode(F.array("x", "y")).alias("code")).groupBy("code").agg(F.count("*").alias("n_partners"))
    named = materialize(vocabulary.join(partners, "code"), "named")
    side = lambda x: named.select(F.col("code").alias(x), F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}"), "n_partners")
    named = lookup_join(lookup_join(pairs, side("x"), "x", "n_partners").drop("n_partners"), side("y"), "y", "n_partners")
    swap = F.col("item_x") > F.col("item_y")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    flat = named.select(pick("item_x", "item_y").alias("item_a"), pick("item_y", "item_x").alias("item_b"), "n_ab", pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"), F.lit(n).cast("bigint").alias("n"))
    both, one, other = F.col("n_ab") + 0.5, F.col("n_a") - F.col("n_ab") + 0.5, F.col("n_b") - F.col("n_ab") + 0.5
    none = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab") + 0.5
    error = F.sqrt(1 / both + 1 / one + 1 / other + 1 / none)
    odds = F.log(both) + F.log(none) - F.log(one) - F.log(other)
    lift = F.col("n_ab") * F.col("n").cast("double") / F.col("n_a") / F.col("n_b")
    return flat.withColumns({"lift": lift, "log_odds": odds, "error": error, "z": odds / error})


def _lengths(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a sorted array and their counts."""
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
    return codes[first], np.add.reduceat(counts, first) if counts is not None else np.diff(first, append=len(codes))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted, counted runs of the pair codes of the records' items; d: another tile of the same record, or null."""
    held: list[np.ndarray] = []

    def run():
        codes, n = _lengths(np.sort(np.concatenate(held)))
        held.clear()
        for lo in range(0, len(codes), 262_144):
            yield pa.RecordBatch.from_arrays([pa.array(codes[lo : lo + 262_144]), pa.array(n[lo : lo + 262_144].astype(np.int64))], names=["pair", "n_ab"])

    size = 0
    for b in batches:
        c, d = b.column(0), b.column(1)
        start, flat = c.offsets.to_numpy(), c.values.to_numpy()
        crossed = d.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.diff(start)
        for k in np.unique(lengths[~crossed]):
            if k < 2:
                continue
            at = start[:-1][(lengths == k) & ~crossed]
            i, j = np.triu_indices(k, 1)
            step = max(1, RUN // len(i))
            for lo in range(0, len(at), step):
                m = flat[at[lo : lo + step, None] + np.arange(k)]
                held.append(((m[:, i] << 32) | m[:, j]).ravel())
                size += held[-1].size
                if size >= RUN:
                    yield from run()
                    size = 0
        for r in np.flatnonzero(crossed):
            held.append(((flat[start[r] : start[r + 1], None] << 32) | np.asarray(d[int(r)].values.to_numpy())).ravel())
            size += held[-1].size
            if size >= RUN:
                yield from run()
                size = 0
    if size:
        yield from run()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up equal neighbours of a sorted stream."""
    at, open_n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        codes, n = _lengths(b.column(0).to_numpy(), b.column(1).to_numpy())
        if at is not None and codes[0] == at:
            n = n.copy()
            n[0] += open_n
        elif at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([open_n], pa.int64())], names=["pair", "n_ab"])
        at, open_n = int(codes[-1]), int(n[-1])
        if len(codes) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(n[:-1].astype(np.int64))], names=["pair", "n_ab"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([open_n], pa.int64())], names=["pair", "n_ab"])
