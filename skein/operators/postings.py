"""An inverted index beside a snapshot: selective text queries read a few files of it instead of every row's tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Token column -> field letter in the postings.
FIELDS = {"tok_a": "title", "tok_b": "tags", "tok_c": "keywords", "tok_d": "payload"}
#: Buckets of the files; a few thousand for hundreds of terabytes. Writing and reading must agree on it.
BUCKETS = 32


def build_postings(view: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, token, field, entity_type, entity_id, tf) for every token of every row of a searchable view.

    Tokens of one row and field are counted within the row, so nothing is shuffled to make it.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("tokens")) for c, f in FIELDS.items()])
    rows = view.select("entity_type", "entity_id", F.explode(cells).alias("c"))
    count = F.transform(F.array_distinct("c.tokens"), lambda t: F.struct(t.alias("token"), F.size(F.filter("c.tokens", lambda x: x == t)).alias("tf")))
    flat = rows.select("entity_type", "entity_id", F.col("c.field").alias("field"), F.explode(count).alias("p"))
    return flat.select(F.pmod(F.xxhash64("p.token"), F.lit(buckets)).cast("int").alias("bucket"), "p.token", "field", "entity_type", "entity_id", "p.tf")


def save_postings(view: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the postings by bucket, sorted by token, so that a query prunes to its buckets and row groups.

    A token that a third of all rows hold is spread over tasks by a salt from the row's key.
    """
    p = build_postings(view, buckets)
    salt = F.pmod(F.xxhash64("entity_type", "entity_id"), F.lit(8))
    p.repartition(F.col("bucket"), salt).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)


def _bucket(spark, tokens: Sequence[str], buckets: int) -> list[int]:
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    return sorted({r.b for r in df.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("b")).collect()})


def candidates(postings: DataFrame, groups: Sequence[Sequence[Sequence[str]]], field: str = "_all", buckets: int = BUCKETS) -> DataFrame:
    """(entity_type, entity_id) of rows in which every group has an alternative all of whose tokens occur in the field.

    Filters on bucket and token reach the scan; one aggregation by row key, folded before the shuffle. The same result as
    predicates.matches. No groups: an error, since every row would match.
    """
    if not groups:
        raise ValueError("postings need at least one group")
    words = sorted({t for g in groups for alt in g for t in alt})
    rows = postings.where(F.col("bucket").isin(_bucket(postings.sparkSession, words, buckets)) & F.col("token").isin(words))
    if field != "_all":
        rows = rows.where(F.col("field") == field)
    have = rows.groupBy("entity_type", "entity_id").agg(*[F.max(F.col("token") == t).alias(f"_{i}") for i, t in enumerate(words)])
    at = {t: F.col(f"_{i}") for i, t in enumerate(words)}
    test = F.lit(True)
    for g in groups:
        any_alt = F.lit(False)
        for alt in g:
            whole = F.lit(True)
            for t in alt:
                whole = whole & at[t]
            any_alt = any_alt | whole
        test = test & any_alt
    return have.where(test).select("entity_type", "entity_id")


def matched_by_postings(view: DataFrame, postings: DataFrame, groups: Sequence[Sequence[Sequence[str]]], field: str = "_all", buckets: int = BUCKETS) -> DataFrame:
    """The view's rows that match, found through the postings: a semi join on the candidates' keys (AQE broadcasts few)."""
    return view.join(candidates(postings, groups, field, buckets), ["entity_type", "entity_id"], "left_semi")
