"""How much a term sets its record apart from the whole collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import lookup_join
from skein.session import materialize


def distinctive_terms(records: DataFrame, key: Sequence[str], terms: str = "terms", *, prior: float = 0.01) -> DataFrame:
    """(key, term, n_holders, log_odds, z) of every term of every record.

    Method: log-odds ratio of record against rest with an informative Dirichlet prior (Monroe, Colaresi and Quinn 2008).
    The prior of a term is ``prior`` times its count in the collection, so its total is that share of all tokens. With y
    the record's count of the term (1: a record holds a term once), n its number of terms, Y and N those of all records,
    a = prior Y and A = prior N:
      log_odds = log((y + a) / (n + A - y - a)) - log((Y - y + a) / (N - n + A - Y + y - a))
      z = log_odds / sqrt(1 / (y + a) + 1 / (Y - y + a))
    A term of one record alone has hardly any evidence and scores near 0; of shared terms the rarer scores higher.

    Counts cover all records. Terms of many records meet their counts by a broadcast of bounded size, the others by
    shuffle. Repeats and nulls in ``terms`` are removed; records without terms and empty tables give no rows; null keys
    are kept as they are; where the collection has no other term, or only one record, all scores are 0.
    """
    base = materialize(records.select(*key, F.array_distinct(F.filter(terms, lambda t: t.isNotNull())).alias("terms")).where(F.size("terms") > 0), "terms")
    counts = materialize(base.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_holders")), "counts")
    total = counts.agg(F.sum("n_holders")).first()[0] or 0
    rows = lookup_join(base.select(*key, F.size("terms").alias("_n"), F.explode("terms").alias("term")), counts, "term", "n_holders")
    y, a, others = F.lit(1.0), F.col("n_holders") * F.lit(prior), (F.lit(total) - F.col("n_holders")) * F.lit(prior)
    rest = F.col("n_holders") - y + a
    inside = F.col("_n") - y + others  # 0 exactly where the collection has no other term
    outside = F.lit(total) - F.col("_n") - (F.col("n_holders") - y) + others
    odds = F.when((inside > 0) & (outside > 0) & (F.col("_n") < total), F.log(y + a) - F.log(inside) - F.log(rest) + F.log(outside)).otherwise(0.0)
    return rows.select(*key, "term", "n_holders", odds.alias("log_odds"), (odds / F.sqrt(1 / (y + a) + 1 / rest)).alias("z"))


def most_distinctive(scored: DataFrame, key: Sequence[str], *, at_least: int, at_most: int) -> DataFrame:
    """(key, term): of each record's terms that ``at_least`` records hold, those of the highest z, if at most ``at_most`` do.

    One aggregation by record: the maximum of z folds before the shuffle, and only terms within the bounds travel along
    (a part of one record's own terms). Ties are all kept.
    """
    own = scored.where(F.col("n_holders") >= at_least)
    few = F.when(F.col("n_holders") <= at_most, F.struct("z", "term"))
    best = own.groupBy(*key).agg(F.max("z").alias("_top"), F.collect_list(few).alias("_few"))
    return best.select(*key, F.explode(F.filter("_few", lambda x: x.z == F.col("_top"))).alias("_t")).select(*key, F.col("_t.term").alias("term"))
