"""Queries over the search index: text, filters, ranking, paging, facets, tags."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import tokens
from skein.operators import postings, predicates, scoring, search, tags
from skein.operators.catalog import Catalog
from skein.operators.current import active_generation
from skein.operators.view import open_view
from skein.plans.config import Config, Scoring
from skein.plans.request import Clause, Filters, Range, Request, checked
from skein.plans.textquery import parse
from skein.queries.feed import BLANKS
from skein.queries.registry import Registry
from skein.session import load, scratch

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
CONFIG = Config(synonyms={"tech": ["redwire", "solar gate"], "magic": ["魔法"], "quest": ["adventure"]})
KEY = ["entity_type", "entity_id"]
_TAG_COLUMNS = ("status", "category_id", "tags", "created_at", "updated_at", "indexed_at")


def view(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The active generation's rows; ``columns``: the stored ones that are wanted (none: all)."""
    active = active_generation(load(spark, folder, "index_generations"))
    return open_view(load(spark, folder, "search_index"), active and active[0], columns or None)


_SNAPSHOTS: dict[tuple[str, str], Catalog] = {}


def snapshot(spark: SparkSession, folder: str) -> Catalog:
    """The active generation as a snapshot of a catalogue: one row per key, with its tokens. Written once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SNAPSHOTS or _SNAPSHOTS[key].log.last()[1] is None:
        active = active_generation(load(spark, folder, "index_generations"))
        c = Catalog(spark, scratch(spark, "snapshot"))
        id = c.create(active[1] if active else 0)
        c.put(id, c.save(view(spark, folder), id))
        c.activate(id)
        _SNAPSHOTS[key] = c
    return _SNAPSHOTS[key]


# The same view in SQL.
_RE = r"\p{Han}|(?:[^\P{L}\p{Han}]|\p{Nd})(?:[^\P{L}\p{Han}]|\p{Nd}|\p{M}|[_.\-])*"
tok_sql = lambda x: f"list_filter(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '{_RE}'), lambda t: regexp_replace(t, '[._\\-]+$', '')), lambda t: t <> '')"
list_sql = lambda x: f"list_sort(list_distinct(list_filter(list_transform({x}, lambda t: lower(trim(t, {BLANKS}))), lambda t: t <> '')))"
VIEW = f"""
WITH g AS (SELECT id AS gid, source_high_watermark AS mark FROM index_generations WHERE status = 'active'),
cur AS (SELECT * EXCLUDE (gid, mark) FROM search_index JOIN g ON generation_id = gid
  QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY source_version DESC, indexed_at DESC) = 1),
v0 AS (SELECT * EXCLUDE (status, tags, keywords), coalesce(nullif(lower(trim(status, {BLANKS})), ''), 'active') AS status, {list_sql("tags")} AS tags, {list_sql("keywords")} AS keywords,
  coalesce(updated_at, created_at, indexed_at) AS sort_time, lower(coalesce(payload->>'$.platform', '')) AS platform,
  coalesce(' ' || nullif(array_to_string(CAST(payload->'$.mcVersions' AS VARCHAR[]), ' '), ''), '') || coalesce(' ' || nullif(payload->>'$.platform', ''), '') AS payload_text,
  list_transform(list_filter(coalesce(CAST(payload->'$.mcVersions' AS VARCHAR[]), []), lambda x: regexp_full_match(x, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{0,2}}')),
    lambda x: split_part(x, '.', 1)::INT * 1000000 + coalesce(nullif(split_part(x, '.', 2), '')::INT, 0) * 1000 + coalesce(nullif(split_part(x, '.', 3), '')::INT, 0)) AS version_keys
  FROM cur),
v AS (SELECT *, {tok_sql("title")} AS tok_a, {tok_sql("array_to_string(tags, ' ')")} AS tok_b, {tok_sql("array_to_string(keywords, ' ')")} AS tok_c, {tok_sql("payload_text")} AS tok_d FROM v0),
open AS (SELECT *, tok_a || tok_b || tok_c || tok_d AS tok FROM v WHERE status NOT IN ('hidden', 'deleted'))
"""
_KEYS = VIEW + "SELECT entity_type, entity_id FROM open WHERE "

_REGISTRY = Registry()
QUERIES, SQL, add = _REGISTRY.queries, _REGISTRY.sql, _REGISTRY.add


def _request(name: str, sql: str, **parts) -> None:
    """A query that gives the keys of the rows that answer a request."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        r = checked(Request(**parts))
        return search.matched(view(spark, folder, *search.needed_columns(r)), r, parse(r.query, CONFIG.synonyms), CONFIG).select(*KEY)

    QUERIES[name] = run
    SQL[name] = _KEYS + sql


# text
@add(
    "tokenize",
    f"SELECT doc_id, len({tok_sql('text')})::INT AS n, md5(array_to_string({tok_sql('text')}, ' ')) AS digest FROM documents",
)
def tokenize(spark, folder):
    t = load(spark, folder, "documents").select("doc_id", tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@add(
    "token_stats",
    VIEW + "SELECT t AS token, count(*) AS n_uses, count(DISTINCT entity_type || ':' || entity_id) AS n_rows FROM (SELECT entity_type, entity_id, unnest(tok) AS t FROM open) GROUP BY t",
)
def token_stats(spark, folder):
    rows = view(spark, folder).where(~F.col("status").isin("hidden", "deleted"))
    per_row = rows.select(F.explode(predicates.field_tokens("_all")).alias("token"), *KEY).groupBy("token", *KEY).agg(F.count("*").alias("n"))
    return per_row.groupBy("token").agg(F.sum("n").alias("n_uses"), F.count("*").alias("n_rows"))


_TECH = "(list_has_any({t}, ['tech', 'redwire']) OR (list_contains({t}, 'solar') AND list_contains({t}, 'gate')))"
_request("match_all_fields", "list_contains(tok, 'harbor') AND list_contains(tok, '1.20.1')", query="harbor 1.20.1")
_request("match_han", "list_contains(tok, '森') AND list_contains(tok, '林')", query="森林")
_request("match_title", "list_contains(tok_a, 'guides')", must=(Clause("title", "guides"),))
_request("match_tags", "list_contains(tok_b, 'survival')", must=(Clause("tags", "Survival"),))
_request("match_keywords", "list_contains(tok_c, 'chunk')", must=(Clause("keywords", "chunk"),))
_request("match_synonyms", _TECH.format(t="tok"), query="tech")
_request("phrase", "instr(' ' || array_to_string(tok_a, ' ') || ' ', ' for the ') > 0", must=(Clause("title", "for the", "phrase"),))
_request("phrase_all_fields", "instr(' ' || array_to_string(tok, ' ') || ' ', ' dark harbor ') > 0 OR instr(' ' || array_to_string(tok, ' ') || ' ', ' the wooden ') > 0", should=(Clause("_all", "dark harbor", "phrase"), Clause("_all", "the wooden", "phrase")))
_request("prefix", "len(list_filter(tok_b, lambda t: starts_with(t, 'sol'))) > 0", must=(Clause("tags", "sol", "prefix"),))
_request("prefix_all_fields", "len(list_filter(tok, lambda t: starts_with(t, 'dr'))) > 0 AND len(list_filter(tok, lambda t: starts_with(t, 'qu'))) > 0", must=(Clause("_all", "dr qu", "prefix"),))


def _similar(text: str, value: str) -> str:
    grams = lambda x: f"list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: list_transform(range(1, length(w)::BIGINT + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
    a, b = grams(text), grams(f"'{value}'")
    return f"(CASE WHEN len({a}) + len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0 END >= 0.35)"


_request("fuzzy_title", _similar("coalesce(title, '')", "rusty boiler for the wooden"), must=(Clause("title", "rusty boiler for the wooden", "fuzzy"),))
_request("fuzzy_tags", _similar("array_to_string(tags, ' ')", "drift-gate survival tech"), must=(Clause("tags", "drift-gate survival tech", "fuzzy"),))
_request(
    "fuzzy_all",
    _similar("coalesce(title, '') || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(keywords, ' ') || ' ' || coalesce(payload, '')", 'harbor chunk survival tech resource world platform java drift-gate'),
    must=(Clause("_all", "harbor chunk survival tech resource world platform java drift-gate", "fuzzy"),),
)
_request(
    "must_should_must_not",
    f"{_TECH.format(t='tok_b')} AND (list_contains(tok_c, 'harbor') OR len(list_filter(tok_a, lambda t: starts_with(t, 'ma'))) > 0) AND NOT list_has_any(tok, ['quest', 'adventure'])",
    must=(Clause("tags", "tech"),),
    should=(Clause("keywords", "harbor"), Clause("title", "ma", "prefix")),
    must_not=(Clause("_all", "quest"),),
)



@add("postings_match", _KEYS + _TECH.format(t="tok") + " AND list_has_any(tok, ['quest', 'adventure'])")
def postings_match(spark, folder):
    v = view(spark, folder)
    postings.save_postings(v, path := scratch(spark, "postings"))
    found = postings.matched_by_postings(v, spark.read.parquet(path), parse("tech quest", CONFIG.synonyms).groups)
    return found.where(~F.col("status").isin("hidden", "deleted")).select(*KEY)


# filters
_request("filter_entity_types", "entity_type IN ('post', 'video')", filters=Filters(entity_types=(" Post", "video")))
_request("filter_category_literal", "category_id IN ('cat-maps', 'CAT-WORLD')", filters=Filters(category_ids=("cat-maps ", "CAT-WORLD")))
_request("filter_status_default", "true")
QUERIES["filter_status_explicit"] = lambda spark, folder: search.matched(view(spark, folder, "status"), checked(Request(status=" Hidden")), parse("", {}), CONFIG).select(*KEY)
SQL["filter_status_explicit"] = VIEW + "SELECT entity_type, entity_id FROM v WHERE status = 'hidden'"
_request("tags_any", "list_has_any(tags, ['magic', '魔法', 'economy'])", filters=Filters(tags_any=("Magic", "魔法", "economy")))
_request("tags_all", "list_has_all(tags, ['survival', 'tech'])", tags=("tech", " SURVIVAL "))
_request("platform_json", "platform IN ('bedrock', 'cross')", filters=Filters(platforms=("Bedrock", "cross")))
_request("numeric_range", "view_count >= 100 AND view_count < 10000 AND like_count > 3 AND download_count <= 500", filters=Filters(view_count=Range(gte=100, lt=10000), like_count=Range(gt=3), download_count=Range(lte=500)))
_request(
    "time_range",
    "created_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00' AND updated_at < TIMESTAMPTZ '2025-06-01 00:00:00+00'",
    filters=Filters(created_at=Range(gte=datetime(2024, 1, 1, tzinfo=timezone.utc)), updated_at=Range(lt=datetime(2025, 6, 1, tzinfo=timezone.utc))),
)
_request("version_range_exists", "len(list_filter(version_keys, lambda k: k >= 1013000 AND k < 1016002)) > 0", filters=Filters(version=Range(gte="v1.13", lt="1.16.2")))


@add("version_keys", VIEW + "SELECT entity_type, entity_id, unnest(version_keys) AS k FROM v")
def version_key_rows(spark, folder):
    return view(spark, folder, "payload").select(*KEY, F.explode("version_keys").alias("k"))


@add("tag_literal_search", VIEW + "SELECT DISTINCT t AS tag FROM (SELECT unnest(tags) AS t FROM open) WHERE contains(t, '-gate')")
def tag_literal_search(spark, folder):
    rows = view(spark, folder, "status", "tags").where(~F.col("status").isin("hidden", "deleted")).select(F.explode("tags").alias("tag"))
    return rows.where(tags.contains_text("tag", "-GATE")).distinct()


# ranking
_FRESH = "exp(-greatest(0, (epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us(sort_time)) / 86400000000.0::DOUBLE) / 30.0::DOUBLE)"
_POP = "(ln(1 + greatest(view_count::DOUBLE, 0)) * 0.3::DOUBLE + ln(1 + greatest(download_count::DOUBLE, 0)) * 0.5::DOUBLE + ln(1 + greatest(like_count::DOUBLE, 0)) * 0.7::DOUBLE + ln(1 + greatest(weight::DOUBLE, 0)) * 0.05::DOUBLE)"
_count = lambda t, words: f"len(list_filter({t}, lambda t: list_contains([{words}], t)))"
_rank = lambda words: f"({_count('tok_a', words)} * (8.0::DOUBLE / 17) + {_count('tok_b', words)} * (5.0::DOUBLE / 17) + {_count('tok_c', words)} * (3.0::DOUBLE / 17) + {_count('tok_d', words)} * (1.0::DOUBLE / 17))"


def _ranked(spark, folder, r: Request, config: Config = CONFIG) -> DataFrame:
    return search.ranked(view(spark, folder), checked(r), config, NOW)[0]


_SCORED = VIEW + f", scored AS (SELECT *, round({_POP} * 0.2::DOUBLE + {_FRESH} * 0.08::DOUBLE, 9) AS score FROM open)"


@add("freshness", VIEW + f"SELECT entity_type, entity_id, round({_FRESH}, 6) AS freshness FROM open")
def freshness(spark, folder):
    rows = view(spark, folder, "status", "created_at", "updated_at", "indexed_at").where(~F.col("status").isin("hidden", "deleted"))
    return rows.select(*KEY, F.round(scoring.freshness(NOW, 30.0), 6).alias("freshness"))


@add("popularity", VIEW + f"SELECT entity_type, entity_id, round({_POP}, 6) AS popularity FROM open")
def popularity(spark, folder):
    rows = view(spark, folder, "status", "weight", "view_count", "like_count", "download_count").where(~F.col("status").isin("hidden", "deleted"))
    return rows.select(*KEY, F.round(scoring.popularity(Scoring()), 6).alias("popularity"))


@add("sort_latest", VIEW + "SELECT entity_type, entity_id FROM open ORDER BY sort_time DESC, entity_type, entity_id LIMIT 20")
def sort_latest(spark, folder):
    return _ranked(spark, folder, Request()).orderBy(*search.order("latest")).limit(20).select(*KEY)


@add("sort_popular", _SCORED + "SELECT entity_type, entity_id, round(scored.score, 6) AS score FROM scored ORDER BY scored.score DESC, sort_time DESC, entity_type, entity_id LIMIT 20")
def sort_popular(spark, folder):
    return _ranked(spark, folder, Request(sort="popular")).orderBy(*search.order("popular")).limit(20).select(*KEY, F.round("score", 6).alias("score"))


_QUEST = "'quest', 'adventure'"
_REL = VIEW + f", r AS (SELECT *, {_rank(_QUEST)} AS raw FROM open WHERE list_has_any(tok, [{_QUEST}])), scored AS (SELECT *, (raw / (raw + 1)) * 0.72::DOUBLE + {_POP} * 0.2::DOUBLE + {_FRESH} * 0.08::DOUBLE AS score FROM r)"


@add("relevance_single_term", _REL + "SELECT entity_type, entity_id, round(round(score, 9), 6) AS score FROM scored")
def relevance_single_term(spark, folder):
    return _ranked(spark, folder, Request(query="quest")).select(*KEY, F.round("score", 6).alias("score"))


@add("topk", _REL + "SELECT entity_type, entity_id FROM scored ORDER BY round(score, 9) DESC, sort_time DESC, entity_type, entity_id LIMIT 10")
def topk(spark, folder):
    page = search.search(view(spark, folder), Request(query="quest", limit=10, scoring_time=NOW), generation=1, config=CONFIG, with_facets=False)
    return page.items.select(*KEY)


# covers of two words: neighbours among the places of either, ended by the other word
_MULTI = (
    VIEW
    + """, r AS (SELECT * FROM open WHERE list_contains(tok, 'harbor') AND list_contains(tok, 'survival')),
places AS (SELECT entity_type, entity_id, i, tok[i] AS t, CASE WHEN i <= len(tok_a) THEN 8.0::DOUBLE / 17 WHEN i <= len(tok_a) + len(tok_b) THEN 5.0::DOUBLE / 17 WHEN i <= len(tok_a) + len(tok_b) + len(tok_c) THEN 3.0::DOUBLE / 17 ELSE 1.0::DOUBLE / 17 END AS w
  FROM (SELECT *, unnest(range(1, len(tok)::BIGINT + 1)) AS i FROM r)),
pairs AS (SELECT *, lag(t) OVER p AS t0, lag(i) OVER p AS i0, lag(w) OVER p AS w0 FROM places WHERE t IN ('harbor', 'survival') WINDOW p AS (PARTITION BY entity_type, entity_id ORDER BY i)),
dense AS (SELECT entity_type, entity_id, sum(2 / (1 / w + 1 / w0) / (i - i0)) AS raw FROM pairs WHERE t <> t0 GROUP BY ALL)
"""
)
_MULTI_SCORE = f"SELECT entity_type, entity_id, round(round(raw / (raw + 1) * 0.72::DOUBLE + {_POP} * 0.2::DOUBLE + {_FRESH} * 0.08::DOUBLE, 9), 6) AS score FROM r JOIN dense USING (entity_type, entity_id)"


@add("relevance_multi_term", _MULTI + _MULTI_SCORE)
def relevance_multi_term(spark, folder):
    return _ranked(spark, folder, Request(query="harbor survival")).select(*KEY, F.round("score", 6).alias("score"))


# the same over a snapshot: no fold of the generation comes before the filter
@add("snapshot_match", _KEYS + "list_contains(tok, 'harbor') AND list_contains(tok, '1.20.1')")
def snapshot_match(spark, folder):
    r = checked(Request(query="harbor 1.20.1"))
    return search.matched(snapshot(spark, folder).rows(), r, parse(r.query, CONFIG.synonyms), CONFIG).select(*KEY)


@add("snapshot_relevance", _MULTI + _MULTI_SCORE)
def snapshot_relevance(spark, folder):
    return search.ranked(snapshot(spark, folder).rows(), checked(Request(query="harbor survival")), CONFIG, NOW)[0].select(*KEY, F.round("score", 6).alias("score"))


@add("snapshot_page", _REL + "SELECT entity_type, entity_id FROM scored ORDER BY round(score, 9) DESC, sort_time DESC, entity_type, entity_id LIMIT 10")
def snapshot_page(spark, folder):
    c = snapshot(spark, folder)
    return search.search(c.rows(), Request(query="quest", limit=10, scoring_time=NOW), generation=c.active()["id"], config=CONFIG).items.select(*KEY)


@add("snapshot_tags", VIEW + "SELECT t AS tag, count(*) AS total_count FROM (SELECT unnest(tags) AS t FROM open WHERE entity_type NOT IN ('tag', 'official_tag')) WHERE NOT regexp_full_match(t, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') GROUP BY t")
def snapshot_tags(spark, folder):
    return snapshot(spark, folder).tags().select("tag", "total_count")


_TEXT = "lower(coalesce(title, '') || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(keywords, ' ') || ' ' || coalesce(payload, ''))"


@add(
    "boosts",
    VIEW + f"SELECT entity_type, entity_id, round(CASE WHEN instr({_TEXT}, '1.20.1') > 0 THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN instr({_TEXT}, 'bedrock') > 0 THEN 0.65::DOUBLE ELSE 0 END, 6) AS boost FROM open",
)
def boosts(spark, folder):
    rows = view(spark, folder, "status", "title", "tags", "keywords", "payload").where(~F.col("status").isin("hidden", "deleted"))
    return rows.select(*KEY, F.round(scoring.boost(parse("bedrock 1.20.1", {})), 6).alias("boost"))


@add(
    "matched_fields",
    VIEW
    + """SELECT entity_type, entity_id, array_to_string(list_filter([
  CASE WHEN contains(lower(coalesce(title, '')), 'quest') OR contains(lower(coalesce(title, '')), 'adventure') THEN 'title' END,
  CASE WHEN contains(lower(array_to_string(tags, ' ')), 'quest') OR contains(lower(array_to_string(tags, ' ')), 'adventure') THEN 'tags' END,
  CASE WHEN contains(lower(array_to_string(keywords, ' ')), 'quest') OR contains(lower(array_to_string(keywords, ' ')), 'adventure') THEN 'keywords' END,
  CASE WHEN contains(lower(payload_text), 'quest') OR contains(lower(payload_text), 'adventure') THEN 'payload' END], lambda x: x IS NOT NULL), ',') AS matched
FROM open WHERE list_has_any(tok, ['quest', 'adventure'])""",
)
def matched_fields(spark, folder):
    return _ranked(spark, folder, Request(query="quest")).select(*KEY, F.array_join("matched", ",").alias("matched"))


@add(
    "explain_breakdown",
    _REL + f"SELECT entity_type, entity_id, round(raw / (raw + 1), 6) AS text_score, round({_POP}, 6) AS popularity_score, round({_FRESH}, 6) AS freshness_score FROM scored",
)
def explain_breakdown(spark, folder):
    return _ranked(spark, folder, Request(query="quest", explain=True)).select(*KEY, *[F.round(c, 6).alias(c) for c in ("text_score", "popularity_score", "freshness_score")])


_TEXTS = {"8.0": "coalesce(title, '')", "5.0": "array_to_string(tags, ' ')", "3.0": "array_to_string(keywords, ' ')", "1.0": "payload_text"}
_SHARES = " + ".join(f"(CASE WHEN contains(lower(trim({t})), 'quest') THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN contains(lower(trim({t})), 'adventure') THEN 1 ELSE 0 END) / 3 * {w}::DOUBLE" for w, t in _TEXTS.items())
_FRESH_UPDATED = _FRESH.replace("sort_time", "updated_at")


@add("substring_score", VIEW + f"SELECT entity_type, entity_id, round(({_SHARES}) * 0.72::DOUBLE + {_POP} * 0.2::DOUBLE + CASE WHEN updated_at IS NULL THEN 0 ELSE {_FRESH_UPDATED} END * 0.08::DOUBLE, 6) AS score FROM open")
def substring_score(spark, folder):
    rows = view(spark, folder).where(~F.col("status").isin("hidden", "deleted"))
    return rows.select(*KEY, scoring.substring_score(parse("quest", CONFIG.synonyms), Scoring(), NOW).alias("score"))


@add("highlight")
def highlight(spark, folder):
    page = search.search(view(spark, folder), Request(query="magic", limit=20, highlight=True, scoring_time=NOW), generation=1, config=CONFIG, with_facets=False)
    return page.items.select(*KEY, "hl_title", F.array_join("hl_tags", "|").alias("hl_tags"), F.array_join("hl_keywords", "|").alias("hl_keywords"), "hl_payload")


_ESCAPED = lambda x: f"replace(replace(replace(replace(replace(trim({x}), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
_MARKED = lambda x: f"regexp_replace({_ESCAPED(x)}, '((?:quest|adventure)+)', '<mark>\\1</mark>', 'gi')"
_HIT = lambda x: f"regexp_matches({x}, '(?i)quest|adventure')"


@add(
    "highlight_page",
    _REL
    + f""", top AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, sort_time DESC, entity_type, entity_id LIMIT 20)
SELECT entity_type, entity_id, CASE WHEN {_HIT("title")} THEN {_MARKED("title")} END AS hl_title, nullif(array_to_string(list_transform(list_filter(tags, lambda t: {_HIT("t")}), lambda t: {_MARKED("t")}), '|'), '') AS hl_tags,
  nullif(array_to_string(list_transform(list_filter(keywords, lambda t: {_HIT("t")}), lambda t: {_MARKED("t")}), '|'), '') AS hl_keywords, CASE WHEN {_HIT("payload_text")} THEN {_MARKED("payload_text")} END AS hl_payload FROM top""",
)
def highlight_page(spark, folder):
    page = search.search(view(spark, folder), Request(query="quest", limit=20, highlight=True, scoring_time=NOW), generation=1, config=CONFIG, with_facets=False)
    return page.items.select(*KEY, "hl_title", F.array_join("hl_tags", "|").alias("hl_tags"), F.array_join("hl_keywords", "|").alias("hl_keywords"), "hl_payload")


# paging
@add("keyset_page2", _SCORED + "SELECT entity_type, entity_id FROM scored ORDER BY score DESC, sort_time DESC, entity_type, entity_id LIMIT 20 OFFSET 20")
def keyset_page2(spark, folder):
    v, r = view(spark, folder), Request(sort="popular", scoring_time=NOW)
    first = search.search(v, r, generation=1, secret=b"s", with_facets=False)
    return search.search(v, Request(sort="popular", cursor=first.next), generation=1, secret=b"s", with_facets=False).items.select(*KEY)


_USES = """, uses AS (SELECT entity_type, entity_id, category_id, sort_time, t AS tag FROM (SELECT *, unnest(tags) AS t FROM open WHERE entity_type NOT IN ('tag', 'official_tag'))
  WHERE NOT regexp_full_match(t, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}'))
"""


@add("tags_offset_page", VIEW + _USES + "SELECT tag, count(*) AS total_count FROM uses GROUP BY tag ORDER BY total_count DESC, tag LIMIT 50 OFFSET 100")
def tags_offset_page(spark, folder):
    return tags.tag_page(tags.tag_index(view(spark, folder, *_TAG_COLUMNS)), offset=100).select("tag", "total_count")


@add("tags_search_page", VIEW + _USES + "SELECT tag, count(*) AS total_count FROM uses WHERE contains(tag, 'solar') GROUP BY tag ORDER BY tag LIMIT 30")
def tags_search_page(spark, folder):
    return tags.tag_page(tags.tag_index(view(spark, folder, *_TAG_COLUMNS)), "SOLAR", "name", 30).select("tag", "total_count")


# aggregation
@add("total_count", VIEW + "SELECT count(*) AS n FROM open WHERE list_has_any(tok, ['quest', 'adventure'])")
def total_count(spark, folder):
    r = checked(Request(query="quest"))
    return search.matched(view(spark, folder, *search.needed_columns(r)), r, parse(r.query, CONFIG.synonyms), CONFIG).agg(F.count("*").alias("n"))


def _facet(name: str, value, sql: str) -> None:
    QUERIES[name] = lambda spark, folder: search.facet(search.matched(view(spark, folder, "status", "category_id", "tags"), checked(Request()), parse("", {}), CONFIG), value())
    SQL[name] = VIEW + f"SELECT value, count(*) AS n FROM (SELECT {sql} AS value FROM open) WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC, value LIMIT 20"


_facet("facet_entity", lambda: "entity_type", "entity_type")
_facet("facet_category", lambda: "category_id", "category_id")
_facet("facet_tag", lambda: F.explode("tags"), "unnest(tags)")


@add(
    "tag_index",
    VIEW
    + _USES
    + """SELECT tag, array_to_string(list_sort(list(DISTINCT entity_type)), ',') AS entity_types, count(*) AS total_count,
  count(*) FILTER (entity_type = 'resource') AS resource_count, count(*) FILTER (entity_type = 'post') AS post_count, count(*) FILTER (entity_type = 'server') AS server_count,
  count(*) FILTER (entity_type = 'video') AS video_count, count(*) FILTER (entity_type = 'document') AS document_count, count(*) FILTER (entity_type = 'user') AS user_count,
  count(*) FILTER (entity_type = 'organization') AS organization_count, 0::BIGINT AS tag_count, 0::BIGINT AS official_tag_count, epoch_us(max(sort_time)) AS updated_us
FROM uses GROUP BY tag""",
)
def tag_index(spark, folder):
    t = tags.tag_index(view(spark, folder, *_TAG_COLUMNS))
    return t.select("tag", F.array_join("entity_types", ",").alias("entity_types"), "total_count", *[c for c in t.columns if c.endswith("_count") and c != "total_count"], F.unix_micros("updated_at").alias("updated_us"))


@add("tag_index_selected", VIEW + _USES + "SELECT tag, count(*) AS total_count FROM uses WHERE tag IN ('magic', 'economy', 'survival') GROUP BY tag")
def tag_index_selected(spark, folder):
    return tags.tag_index(view(spark, folder, *_TAG_COLUMNS), ["magic", "economy", "survival"]).select("tag", "total_count")


@add("category_counts", VIEW + _USES + "SELECT tag, category_id, count(*) AS n FROM uses WHERE coalesce(category_id, '') <> '' GROUP BY ALL")
def category_counts(spark, folder):
    t = tags.tag_index(view(spark, folder, *_TAG_COLUMNS))
    return t.select("tag", F.explode("category_counts").alias("category_id", "n"))
