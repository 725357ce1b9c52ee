"""One ranking from several scores of unlike scales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import lookup_join, running_total
from skein.session import materialize


class Loadings(dict):
    """Loading of each score by name; ``turned``: the scores whose loading had the other sign before it took that of the
    declared direction; ``eigenvalues``: those of the correlation matrix, the greatest first."""

    turned: tuple[str, ...] = ()
    eigenvalues: tuple[float, ...] = ()


def fused_scores(rows: DataFrame, scores: Mapping[str, int], keep: Sequence[str]) -> tuple[DataFrame, Loadings]:
    """(keep..., r_<score>..., fused) per row of ``rows``, and the loading of each score.

    Method: first principal component of the rank-transformed scores. Each score is replaced by its rank among all rows
    (ties share the mean rank), so scale and outliers do not matter; the correlation matrix of the ranks is one
    aggregation; of its first eigenvector every loading takes the sign of the score's declared direction (1: higher is
    better, -1: lower is); ``fused`` is the projection. Sort by it, descending.

    Ranks are found without a single-task window: equal values fold to one row with their number, these are
    range-sorted and summed up, and go back to the rows by a join that broadcasts the few hot values and shuffles the rest.

    Defined cases: null and NaN are the worst of a score whatever its direction; a score that is the same everywhere has
    loading 0; if no score varies all loadings are equal; a component whose scores point against each other is still oriented
    score by score, and then no longer the direction of the greatest variance (Loadings.turned tells of which scores);
    if the two greatest eigenvalues are close the loadings are not well determined, and equal if they are the same
    (Loadings.eigenvalues); repeated rows are separate rows; an empty table gives no rows.
    """
    names = list(scores)
    # the worst becomes the lowest; a declared direction of -1 turns the score round
    value = lambda s: F.coalesce(F.nullif(F.col(s).cast("double"), F.lit(float("nan"))) * scores[s], F.lit(float("-inf")))
    base = materialize(rows.select(F.monotonically_increasing_id().alias("_row"), *keep, *[value(s).alias(f"_v{i}") for i, s in enumerate(names)]), "scores")
    n = base.count()
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"_v{i}").alias("v")) for i in range(len(names))])).alias("cell")
    cells = base.select("_row", cell)
    values = cells.groupBy("cell").agg(F.count("*").alias("n")).select(F.col("cell.k").alias("k"), F.col("cell.v").alias("v"), "n")
    below = running_total(values, ["k", "v"], "n", "before", "values")
    table = materialize(below.select(F.struct("k", "v").alias("cell"), "n", (F.col("before") - F.col("k").cast("bigint") * n + (F.col("n") + 1) / 2).alias("rank")), "ranks")
    ranked = lookup_join(cells, table, "cell", "n")
    centred = lambda i: F.sum(F.when(F.col("cell.k") == i, F.col("rank") - (n + 1) / 2)).alias(f"r_{names[i]}")
    wide = materialize(ranked.groupBy("_row").agg(*[centred(i) for i in range(len(names))]), "wide")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    unit = max(n, 1)
    sums = wide.agg(*[F.avg(F.col(f"r_{names[i]}") / unit * F.col(f"r_{names[j]}") / unit) for i, j in pairs]).first()
    cov = np.zeros((len(names), len(names)))
    for (i, j), x in zip(pairs, sums):
        cov[i, j] = cov[j, i] = x or 0.0
    told = Loadings()
    spread, weights = np.sqrt(np.diag(cov)), np.full(len(names), len(names) ** -0.5)
    if spread.max(initial=0) > 0:
        inv = np.divide(1, spread, out=np.zeros_like(spread), where=spread > 0)
        values, vectors = np.linalg.eigh(cov * np.outer(inv, inv))
        first = vectors[:, -1] * (spread > 0)
        if (spread > 0).sum() > 1 and values[-1] - values[-2] < 1e-9:
            first = (spread > 0) / np.sqrt((spread > 0).sum())
        first = first if first.sum() >= 0 else -first
        weights = np.abs(first)
        told.turned, told.eigenvalues = tuple(s for s, w in zip(names, first) if w < -1e-12), tuple(float(v) for v in values[::-1])
    else:
        inv = np.zeros(len(names))
    terms = [F.col(f"r_{s}") / unit * float(w * v) for s, w, v in zip(names, weights, inv)]
    fused = sum(terms[1:], terms[0]).alias("fused")
    out = base.select("_row", *keep).join(wide, "_row").select(*keep, *[f"r_{s}" for s in names], fused)
    told.update({s: float(w) * scores[s] for s, w in zip(names, weights)})
    return out, told


def first_per_group(ranked: DataFrame, group: str, key: Sequence[str], *, at_least: int) -> DataFrame:
    """(group, key...): the first row of each non-null group of at least so many rows; ties go to the lowest key.

    A minimum over structs: it folds before the shuffle, so a hot group is no burden.
    """
    best = F.min(F.struct((-F.col("fused")).alias("f"), *key)).alias("_b")
    return ranked.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"), best).where(F.col("_n") >= at_least).select(group, *[F.col(f"_b.{k}").alias(k) for k in key])
