"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.baskets import listed_elements, listed_terms
from skein.llm.cooccurrence import item_pairs
from skein.llm.distinctive import distinctive_terms, most_distinctive
from skein.llm.mixing import mix_sources
from skein.llm.packing import pack
from skein.llm.rank_fusion import first_per_group, fused_scores
from skein.llm.repetitive import repetitive_documents
from skein.llm.term_frequency import term_frequencies
from skein.llm.tokens import token_counts
from skein.operators.current import active_generation, listed_rows
from skein.queries.feed import BLANKS
from skein.session import load

ENTITY = ["entity_type", "entity_id"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = item_pairs(listed_terms(spark, folder, "tags"), at_least=20)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(whole("n_ab") * whole("n") >= whole("n_a") * whole("n_b") * 4).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = item_pairs(listed_terms(spark, folder, "tags"))
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"), F.round("z", 6).alias("z"))


SIGNALS = {"view_count": 1, "like_count": 1, "download_count": 1, "updated_at": 1}


def _resources(spark: SparkSession, folder: str) -> DataFrame:
    active = active_generation(load(spark, folder, "index_generations"))
    rows = listed_rows(load(spark, folder, "search_index").where(F.col("entity_type") == "resource"), active and active[0], ["author_id", *SIGNALS])
    return rows.withColumn("updated_at", F.unix_micros("updated_at"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    ranked, _ = fused_scores(_resources(spark, folder), SIGNALS, ["author_id", *ENTITY])
    return first_per_group(ranked, "author_id", ENTITY, at_least=12)


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Every listed resource with its centred ranks and fused score."""
    ranked, _ = fused_scores(_resources(spark, folder), SIGNALS, ["author_id", *ENTITY])
    return ranked.withColumn("fused", F.round("fused", 9))


def p4_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """The centred mean ranks that are fused."""
    return p4_ranking(spark, folder).drop("fused")


def p4_loadings(spark: SparkSession, folder: str) -> DataFrame:
    """(score, loading, turned, explained): what each score weighs, whether its sign had to be turned, and the share of the
    variance that the first component has."""
    _, told = fused_scores(_resources(spark, folder), SIGNALS, ["author_id", *ENTITY])
    explained = told.eigenvalues[0] / sum(told.eigenvalues) if told.eigenvalues else None
    return spark.createDataFrame([(s, w, s in told.turned, explained) for s, w in told.items()], "score string, loading double, turned boolean, explained double")


def _distinctive(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive_terms(listed_terms(spark, folder, "tags", "keywords"), ENTITY)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return most_distinctive(_distinctive(spark, folder), ENTITY, at_least=3, at_most=9)


def p5_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _distinctive(spark, folder).select(*ENTITY, "term", "n_holders", F.round("log_odds", 6).alias("log_odds"), F.round("z", 6).alias("z"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequencies(listed_elements(spark, folder, "tags", "keywords")).where(F.col("mark").isNotNull()).select("term")


def p6_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequencies(listed_elements(spark, folder, "tags", "keywords"))


CAPACITY = 4096


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(token_counts(load(spark, folder, "documents"), "text", "doc_id"), "doc_id", "n_tokens", CAPACITY)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the finished layout has in more than one container."""
    lies = _packed(spark, folder).groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return lies.where("a < b").select("doc_id")


def p7_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of every document with its container."""
    return _packed(spark, folder)


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, the least number that could do, tokens and the share of room that is used."""
    used = _packed(spark, folder).agg(F.count_distinct("container").alias("containers"), F.sum("size").alias("tokens"), F.count_if(F.expr("n_parts > 1 AND part = 0")).alias("cut"))
    return used.withColumns({"least": F.ceil(F.col("tokens") / CAPACITY), "fill": F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 6)})


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    mix = mix_sources(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))
    return mix.report.where("short").select("source")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and real shares of each source."""
    return mix_sources(load(spark, folder, "documents"), load(spark, folder, "mix_targets")).report


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is taken."""
    return mix_sources(load(spark, folder, "documents"), load(spark, folder, "mix_targets")).rates


def p8_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """The classifier of domains on held-out documents."""
    return mix_sources(load(spark, folder, "documents"), load(spark, folder, "mix_targets")).accuracy


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Own documents of each wanted source, and whether it stays short."""
    report = mix_sources(load(spark, folder, "documents"), load(spark, folder, "mix_targets")).report
    return report.select("source", "n_documents", "max_repeats", "short")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """What the learned list calls repetitive; no other test follows."""
    return repetitive_documents(load(spark, folder, "documents")).rows.where("repetitive").select("doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The features of every document and the verdict of the decision list."""
    return repetitive_documents(load(spark, folder, "documents")).rows


def p9_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The decision list, with its recall and precision on held-out examples by length."""
    found = repetitive_documents(load(spark, folder, "documents"))
    return found.report.withColumn("rules", F.lit(str(found.rules)))


QUERIES = {q.__name__: q for q in (p1_found, p1_pairs, p4_found, p4_ranking, p4_ranks, p4_loadings, p5_found, p5_scores, p6_found, p6_frequencies, p7_found, p7_layout, p7_report, p8_found, p8_report, p8_rates, p8_accuracy, p8_documents, p9_found, p9_shares, p9_rules)}

_LISTED = f"""
WITH g AS (SELECT id AS gid FROM index_generations WHERE status = 'active'),
cur AS (SELECT * FROM search_index JOIN g ON generation_id = gid
  QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY source_version DESC, indexed_at DESC) = 1),
listed AS (SELECT * FROM cur WHERE lower(trim(status, {BLANKS})) NOT IN ('hidden', 'deleted')),
"""
_held = lambda what: f"""{_LISTED}
elements AS (SELECT entity_type, entity_id, lower(trim(t, {BLANKS})) AS term FROM (SELECT entity_type, entity_id, unnest({what}) AS t FROM listed)),
held AS (SELECT DISTINCT * FROM elements WHERE term <> ''),
holders AS (SELECT term, count(*) AS n_holders FROM held GROUP BY term),
"""  # noqa: E731
_PAIRS = (
    _held("tags")
    + """size AS (SELECT count(*) AS n FROM listed),
pairs AS (SELECT a.term AS item_a, b.term AS item_b, count(*) AS n_ab FROM held a JOIN held b ON a.entity_type = b.entity_type AND a.entity_id = b.entity_id AND a.term < b.term GROUP BY ALL),
full_pairs AS (SELECT item_a, item_b, n_ab, x.n_holders AS n_a, y.n_holders AS n_b, n FROM pairs JOIN holders x ON item_a = x.term JOIN holders y ON item_b = y.term, size)
"""
)
_POOLED = _held("tags || keywords")
_SIZES = """
WITH d AS (SELECT regexp_replace(lower(trim(source, {BLANKS})), '[\\s_-]+', '-', 'g') AS key, strlen(text) AS size FROM documents),
s AS (SELECT source, target_share, max_repeats, regexp_replace(lower(trim(source, {BLANKS})), '[\\s_-]+', '-', 'g') AS key FROM mix_targets),
z AS (SELECT s.source, s.target_share, s.max_repeats, coalesce(sum(d.size), 0) AS size, count(d.key) AS n_documents FROM s LEFT JOIN d USING (key) GROUP BY ALL)
""".replace("{BLANKS}", BLANKS)

SQL = {
    "p1_found": _PAIRS + "SELECT item_a AS tag_a, item_b AS tag_b FROM full_pairs WHERE n_ab >= 20 AND n_ab * n >= 4 * n_a * n_b",
    "p1_pairs": _PAIRS
    + """SELECT item_a, item_b, n_ab, n_a, n_b, round(n_ab * n::DOUBLE / n_a / n_b, 6) AS lift,
  round(ln((n_ab + 0.5::DOUBLE) * (n - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE))), 6) AS log_odds,
  round(ln((n_ab + 0.5::DOUBLE) * (n - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)))
    / sqrt(1 / (n_ab + 0.5::DOUBLE) + 1 / (n - n_a - n_b + n_ab + 0.5::DOUBLE) + 1 / (n_a - n_ab + 0.5::DOUBLE) + 1 / (n_b - n_ab + 0.5::DOUBLE)), 6) AS z
FROM full_pairs""",
    # an independent ranking: the mean of the four shares of the author's resources that lie below
    "p4_found": _LISTED
    + """r AS (SELECT author_id, entity_type, entity_id,
  percent_rank() OVER (PARTITION BY author_id ORDER BY view_count NULLS FIRST) + percent_rank() OVER (PARTITION BY author_id ORDER BY like_count NULLS FIRST)
  + percent_rank() OVER (PARTITION BY author_id ORDER BY download_count NULLS FIRST) + percent_rank() OVER (PARTITION BY author_id ORDER BY updated_at NULLS FIRST) AS s,
  count(*) OVER (PARTITION BY author_id) AS n
FROM listed WHERE entity_type = 'resource' AND author_id IS NOT NULL)
SELECT author_id, entity_type, entity_id FROM r WHERE n >= 12
QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY s DESC, entity_id) = 1""",
    "p4_ranks": _LISTED
    + "r AS (SELECT author_id, entity_type, entity_id, view_count, like_count, download_count, updated_at, count(*) OVER () AS n FROM listed WHERE entity_type = 'resource') SELECT author_id, entity_type, entity_id, "
    + ", ".join(f"rank() OVER (ORDER BY {s} NULLS FIRST) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0::DOUBLE - (n + 1) / 2.0::DOUBLE AS r_{s}" for s in SIGNALS)
    + " FROM r",
    "p5_found": _POOLED
    + """good AS (SELECT * FROM held JOIN holders USING (term) WHERE n_holders >= 3),
least AS (SELECT entity_type, entity_id, min(n_holders) AS m FROM good GROUP BY ALL HAVING min(n_holders) <= 9)
SELECT entity_type, entity_id, term FROM good JOIN least USING (entity_type, entity_id) WHERE n_holders = m""",
    "p5_scores": _POOLED
    + """total AS (SELECT sum(n_holders)::DOUBLE AS t FROM holders),
sized AS (SELECT *, count(*) OVER (PARTITION BY entity_type, entity_id) AS n FROM held JOIN holders USING (term)),
odds AS (SELECT entity_type, entity_id, term, n_holders,
  ln((1 + 0.01::DOUBLE * n_holders) / (n + 0.01::DOUBLE * t - 1 - 0.01::DOUBLE * n_holders)) - ln((n_holders - 1 + 0.01::DOUBLE * n_holders) / (t - n + 0.01::DOUBLE * t - n_holders + 1 - 0.01::DOUBLE * n_holders)) AS o,
  sqrt(1 / (1 + 0.01::DOUBLE * n_holders) + 1 / (n_holders - 1 + 0.01::DOUBLE * n_holders)) AS e FROM sized, total)
SELECT entity_type, entity_id, term, n_holders, round(o, 6) AS log_odds, round(o / e, 6) AS z FROM odds""",
    "p6_found": _POOLED + "size AS (SELECT count(*) AS n FROM listed) SELECT term FROM holders, size WHERE n_holders <= 2 OR n_holders * 5 >= n",
    "p6_frequencies": _POOLED
    + """size AS (SELECT count(*) AS n FROM listed), occ AS (SELECT term, count(*) AS n_occurrences FROM elements WHERE term <> '' GROUP BY term)
SELECT term, n_holders AS n_records, n_occurrences, CASE WHEN n_holders * 5 >= n THEN 'common' WHEN n_holders <= 2 THEN 'rare' END AS mark FROM holders JOIN occ USING (term), size""",
    # four bytes for a token: no document lies near the line, whatever the tokenizer
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4 * 4096",
    # plain five-word runs that stood before, without changed words, sentences or lines: far from the line all agree
    "p9_found": r"""
WITH u AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{Han}|(?:[^\P{L}\p{Han}]|\p{M})+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w)::BIGINT - 3)) AS i FROM u)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, h) AS first FROM g) WHERE i > first),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY doc_id)
SELECT doc_id FROM covered JOIN u USING (doc_id) WHERE n >= 0.4::DOUBLE * len(w)""",
    # with bytes for tokens: no source lies near the line, whatever the tokenizer
    "p8_found": _SIZES + "SELECT source FROM z WHERE size * max_repeats < target_share * (SELECT sum(size) FROM z)",
    "p8_documents": _SIZES + "SELECT source, n_documents, max_repeats, size * max_repeats < target_share * (SELECT sum(size) FROM z) AS short FROM z",
}
