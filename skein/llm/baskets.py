"""Records with their sets of terms: the common input of the term operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.terms import terms
from skein.operators.current import active_generation, listed_rows
from skein.session import load


def listed_terms(spark, folder: str, *arrays: str) -> DataFrame:
    """(entity_type, entity_id, terms) of every listed entity; terms are folded and distinct."""
    active = active_generation(load(spark, folder, "index_generations"))
    rows = listed_rows(load(spark, folder, "search_index"), active and active[0], list(arrays))
    return rows.select("entity_type", "entity_id", terms(*arrays).alias("terms"))


def listed_elements(spark, folder: str, *arrays: str) -> DataFrame:
    """(elements): the folded elements of every listed entity, repeats kept, blank ones dropped."""
    from skein.functions.terms import folded

    active = active_generation(load(spark, folder, "index_generations"))
    rows = listed_rows(load(spark, folder, "search_index"), active and active[0], list(arrays))
    empty = F.array().cast("array<string>")
    pooled = F.concat(*[F.coalesce(F.col(a), empty) for a in arrays])
    return rows.select(F.filter(F.transform(pooled, folded), lambda t: F.length(t) > 0).alias("elements"))
