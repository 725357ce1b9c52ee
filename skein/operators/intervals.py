"""Sets of 64-bit sequence numbers as disjoint closed intervals (lo, hi), kept as DataFrames.

Every step works within buckets of 2**16 consecutive numbers. A bucket holds at most 65,536 distinct numbers and as many
disjoint intervals, whatever the data, so no task grows with the input and nothing is collected. A second pass of the same
kind joins intervals that touch across buckets; the canonical form is cut only at multiples of 2**32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 16


def _pieces(iv: DataFrame) -> DataFrame:
    """The intervals cut at the buckets' edges: (b, lo, hi). Intervals of no number (lo > hi or null) vanish.

    Cut in three steps (2**48, 2**32, 2**16), so that no array has more than 65,536 elements however long an interval is.
    """
    cut = iv.where("lo <= hi").selectExpr("CAST(lo AS BIGINT) AS lo", "CAST(hi AS BIGINT) AS hi")
    for bits in (3 * BITS, 2 * BITS, BITS):
        edge = f"shiftleft(b, {bits})"
        cut = cut.selectExpr("lo", "hi", f"explode(sequence(shiftright(lo, {bits}), shiftright(hi, {bits}))) AS b").selectExpr("b", f"greatest(lo, {edge}) AS lo", f"least(hi, {edge} + {(1 << bits) - 1}) AS hi")
    return cut


def _islands(pieces: DataFrame, by: str) -> DataFrame:
    """Within each ``by``: overlapping or touching pieces joined."""
    w = f"PARTITION BY {by} ORDER BY lo, hi"
    told = pieces.selectExpr(by, "lo", "hi", f"max(hi) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before")
    starts = told.selectExpr(by, "lo", "hi", f"sum(IF(_before IS NULL OR lo > _before + 1, 1, 0)) OVER ({w}) AS _n")
    return starts.groupBy(by, "_n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def merge_intervals(iv: DataFrame) -> DataFrame:
    """Union of intervals (lo, hi) as disjoint ones that do not touch."""
    small = _islands(_pieces(iv), "b").select("lo", "hi")
    size = 1 << BITS
    at_edge = (F.pmod("lo", F.lit(size)) == 0) | (F.pmod(F.col("hi") + 1, F.lit(size)) == 0)
    across = _islands(small.where(at_edge).withColumn("s", F.shiftright(F.col("lo"), 2 * BITS)), "s").select("lo", "hi")
    return small.where(~at_edge).unionByName(across)


def _units(points: DataFrame, seq: str) -> DataFrame:
    """Each number as an interval of its own."""
    p = points.selectExpr(f"CAST(`{seq}` AS BIGINT) AS lo").where("lo IS NOT NULL").distinct()
    return p.selectExpr(f"shiftright(lo, {BITS}) AS b", "lo", "lo AS hi")


def to_intervals(points: DataFrame, seq: str) -> DataFrame:
    """The numbers in column ``seq`` (nulls ignored) as disjoint intervals; neighbours n, n+1 share one."""
    return merge_intervals(_units(points, seq).select("lo", "hi"))


def add_points(iv: DataFrame, points: DataFrame, seq: str) -> DataFrame:
    """``iv`` and the numbers in column ``seq`` as disjoint intervals that are cut at multiples of 65,536: the form of a
    stored state, which needs no second pass over the buckets' edges."""
    return _islands(_pieces(iv).unionByName(_units(points, seq)), "b").select("lo", "hi")


def subtract_intervals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Numbers of ``a`` that are not in ``b``, as intervals; both inputs disjoint."""
    turn = lambda iv, x, y: iv.select("b", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(x).alias("a"), F.lit(y).alias("c")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-x).alias("a"), F.lit(-y).alias("c")))).alias("t"))
    turns = turn(_pieces(a), 1, 0).unionByName(turn(_pieces(b), 0, 1)).groupBy("b", F.col("t.at").alias("at")).agg(F.sum("t.a").alias("a"), F.sum("t.c").alias("c"))
    w = Window.partitionBy("b").orderBy("at")
    swept = turns.select("at", F.sum("a").over(w).alias("a"), F.sum("c").over(w).alias("c"), F.lead("at").over(w).alias("next"))
    return merge_intervals(swept.where("a > 0 and c = 0 and next is not null").select(F.col("at").alias("lo"), (F.col("next") - 1).alias("hi")))


def points_in(points: DataFrame, seq: str, iv: DataFrame) -> DataFrame:
    """The distinct numbers of column ``seq`` that lie in an interval of ``iv`` (disjoint): one column ``seq``."""
    p = _units(points, seq).selectExpr("b", "lo AS at", "CAST(NULL AS BIGINT) AS hi")
    both = p.unionByName(_pieces(iv).selectExpr("b", "lo AS at", "hi"))
    seen = both.selectExpr("at", "hi", "last(hi, true) OVER (PARTITION BY b ORDER BY at, hi IS NULL ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _hi")
    return seen.where("hi IS NULL AND at <= _hi").selectExpr(f"at AS `{seq}`")
