"""Queries on building and maintaining the index: sources, builder, feed, gated writes, checks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.terms import folded, trimmed
from skein.operators import metrics, writes
from skein.operators.current import active_generation
from skein.operators.catalog import index_rows
from skein.operators.documents import build_documents, normal_status, weight
from skein.operators.search import RESULT, by_category_or_slug, ranked
from skein.operators.view import STORED
from skein.plans.request import Request, checked
from skein.queries.feed import BLANKS
from skein.queries.registry import Registry
from skein.queries.search import CONFIG, KEY, NOW, VIEW, list_sql, tok_sql, view
from skein.session import load
from skein.sources import adapters, outbox
from skein.sources.star import source_tables

_REGISTRY = Registry()
QUERIES, SQL, add = _REGISTRY.queries, _REGISTRY.sql, _REGISTRY.add
_fold = lambda x: f"lower(trim({x}, {BLANKS}))"


# sources
def _source(name: str, kind: str, sql: str) -> None:
    def run(spark, folder):
        rows = adapters.ADAPTERS[kind](source_tables(spark, folder))
        return rows.select(*[F.col(c).cast("string").alias(c) for c in ("entity_type", "entity_id", "title", "status", "visibility", "category_id", "author_id", "tags_json", "extra_tags_json", "view_count", "like_count", "download_count")])

    add(name, sql)(run)


_P = "SELECT 'post' AS entity_type, o_orderkey::VARCHAR AS entity_id, o_orderpriority AS title,"
_source(
    "source_post",
    "post",
    f"""{_P} CASE WHEN o_orderstatus <> 'P' AND o_totalprice <= 300000 THEN 'published' ELSE 'hidden' END AS status, 'public' AS visibility, o_orderstatus AS category_id, o_custkey::VARCHAR AS author_id,
  o_orderpriority AS tags_json, '[]' AS extra_tags_json, '0' AS view_count, '0' AS like_count, '0' AS download_count FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
_source(
    "source_resource",
    "resource",
    """SELECT 'resource' AS entity_type, p_partkey::VARCHAR AS entity_id, p_name AS title, 'Published' AS status, CASE WHEN p_size < 3 THEN 'private' ELSE 'public' END AS visibility, p_brand AS category_id, NULL::VARCHAR AS author_id,
  '["' || array_to_string(list_transform(range(1, len(w)::BIGINT + 1), lambda i: w[i]), '","') || '"]' AS tags_json,
  CASE WHEN n_regionkey <> 4 THEN '["' || n_name || '"]' ELSE '[]' END AS extra_tags_json, coalesce(uses, 0)::VARCHAR AS view_count, p_size::VARCHAR AS like_count, coalesce(returns, 0)::VARCHAR AS download_count
FROM (SELECT *, list_filter(s, lambda x, i: list_position(s, x) = i) AS w FROM (SELECT *, string_split(lower(p_name || ' ' || p_type), ' ') AS s FROM part))
LEFT JOIN (SELECT l_partkey, count(*) AS uses, count(*) FILTER (l_returnflag = 'R') AS returns FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
LEFT JOIN nation ON n_nationkey = p_partkey % 25""",
)
_source(
    "source_user",
    "user",
    """SELECT 'user' AS entity_type, c_custkey::VARCHAR AS entity_id, c_name AS title, CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'hidden' END AS status, 'public' AS visibility, lower(c_mktsegment) AS category_id, c_custkey::VARCHAR AS author_id,
  '[]' AS tags_json, '["user","' || lower(c_mktsegment) || '"]' AS extra_tags_json, '0' AS view_count, '0' AS like_count, '0' AS download_count FROM customer""",
)
_source(
    "source_organization",
    "organization",
    """SELECT 'organization' AS entity_type, s_suppkey::VARCHAR AS entity_id, s_name AS title, 'active' AS status, 'public' AS visibility, n_name AS category_id, s_nationkey::VARCHAR AS author_id,
  '[]' AS tags_json, '["organization","' || n_name || '"]' AS extra_tags_json, '0' AS view_count, '0' AS like_count, '0' AS download_count FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
_source(
    "source_official_tag",
    "official_tag",
    """SELECT 'official_tag' AS entity_type, n_nationkey::VARCHAR AS entity_id, n_name AS title, CASE WHEN r_regionkey <> 4 THEN 'active' ELSE 'hidden' END AS status, CASE WHEN r_regionkey <> 4 THEN 'public' ELSE 'private' END AS visibility,
  n_regionkey::VARCHAR AS category_id, '' AS author_id, '["' || n_name || '","' || r_name || '"]' AS tags_json, '[]' AS extra_tags_json, '0' AS view_count, '0' AS like_count, '0' AS download_count
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
)
_source(
    "source_tag",
    "tag",
    """SELECT 'tag' AS entity_type, md5(p_type) AS entity_id, p_type AS title, 'active' AS status, 'public' AS visibility, 'tag' AS category_id, '' AS author_id, '["' || p_type || '"]' AS tags_json, '[]' AS extra_tags_json,
  count(*)::VARCHAR AS view_count, '0' AS like_count, '0' AS download_count FROM part GROUP BY p_type""",
)
_source(
    "source_document",
    "document",
    """SELECT 'document' AS entity_type, doc_id::VARCHAR AS entity_id, string_split(text, chr(10))[1] AS title, CASE WHEN source IS NOT NULL THEN 'published' ELSE 'draft' END AS status, CASE WHEN source IS NOT NULL THEN 'public' ELSE 'private' END AS visibility,
  coalesce(lower(source), '') AS category_id, '' AS author_id, '[]' AS tags_json, to_json([coalesce(nullif(lower(source), ''), 'document')])::VARCHAR AS extra_tags_json, '0' AS view_count, '0' AS like_count, '0' AS download_count FROM documents""",
)
_TITLE = "string_split(text, chr(10))[1] AS title"
_source(
    "source_server",
    "server",
    f"""SELECT 'server' AS entity_type, doc_id::VARCHAR AS entity_id, {_TITLE}, 'Published' AS status, 'public' AS visibility, coalesce(lower(lang), '') AS category_id, author_id, '[]' AS tags_json,
  CASE WHEN lang IS NOT NULL THEN to_json([lower(lang)])::VARCHAR ELSE '[]' END AS extra_tags_json, n_chars::VARCHAR AS view_count, '0' AS like_count, '0' AS download_count
FROM (SELECT * REPLACE (coalesce(n_chars, 0) AS n_chars) FROM documents) WHERE {_fold('source')} = 'server-page'""",
)
_source(
    "source_video",
    "video",
    f"""SELECT 'video' AS entity_type, doc_id::VARCHAR AS entity_id, {_TITLE}, 'Published' AS status, CASE WHEN lang IS NULL THEN 'private' ELSE 'public' END AS visibility, lower(lang) AS category_id, author_id, lang AS tags_json,
  '[]' AS extra_tags_json, n_chars::VARCHAR AS view_count, '0' AS like_count, '0' AS download_count FROM (SELECT * REPLACE (coalesce(n_chars, 0) AS n_chars) FROM documents) WHERE {_fold('source')} = 'video-notes'""".replace("lang AS tags_json", "coalesce(lang, '[]') AS tags_json"),
)


@add(
    "category_id_or_slug",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN n_name ELSE 'slug of ' || n_name END AS ref, n_name AS id FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 WHERE n_regionkey <> 4 "
    "UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN n_name ELSE 'slug of ' || n_name END, NULL FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 WHERE n_regionkey = 4",
)
def category_id_or_slug(spark, folder):
    n = load(spark, folder, "nation")
    rows = load(spark, folder, "orders").withColumn("n_nationkey", (F.col("o_orderkey") % 25).cast("int")).join(n, "n_nationkey")
    rows = rows.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("slug of "), "n_name")).alias("ref"))
    groups = n.where("n_regionkey <> 4").select(F.col("n_name").alias("id"), F.concat(F.lit("slug of "), "n_name").alias("slug"))
    return by_category_or_slug(rows, groups, "ref", []).select("o_orderkey", "ref", F.col("category_row.id").alias("id"))


@add("official_tags_agg", "SELECT p_partkey::VARCHAR AS id, n_name AS names FROM part JOIN nation ON n_nationkey = p_partkey % 25 WHERE n_regionkey <> 4")
def official_tags_agg(spark, folder):
    t = source_tables(spark, folder)
    return adapters.official_tags(t["Resource"], t["OfficialTag"], t["OfficialTagGroup"]).select("id", F.array_join("official_tags", ",").alias("names"))


# builder
_WORDS = lambda x: f"list_concat(regexp_extract_all({x}, '[a-z0-9_]+'), CASE WHEN length({x}) BETWEEN 1 AND 64 THEN [{x}] ELSE [] END)"


@add(
    "built_resources",
    f"""WITH r AS (SELECT p_partkey::VARCHAR AS entity_id, lower(p_name) AS name, lower(p_type) AS kind, lower(p_brand) AS brand, CASE WHEN n_regionkey <> 4 THEN [lower(n_name)] ELSE [] END AS extra, p_size,
  string_split(lower(p_name || ' ' || p_type), ' ') AS words, coalesce(uses, 0) AS uses, coalesce(returns, 0) AS returns FROM part
  LEFT JOIN (SELECT l_partkey, count(*) AS uses, count(*) FILTER (l_returnflag = 'R') AS returns FROM lineitem GROUP BY 1) ON l_partkey = p_partkey LEFT JOIN nation ON n_nationkey = p_partkey % 25)
SELECT 'resource:' || entity_id AS doc_id, CASE WHEN p_size < 3 THEN 'hidden' ELSE 'active' END AS status, CASE WHEN p_size < 3 THEN 0 ELSE uses + 5 * p_size + 3 * returns END::BIGINT AS weight,
  array_to_string(list_sort(list_distinct(list_concat(words, extra))), ',') AS tags,
  array_to_string(list_sort(list_distinct(list_concat(list_concat(words, extra), list_concat(list_concat({_WORDS("name")}, {_WORDS("kind")}), [brand, 'resource'])))), ',') AS keywords FROM r""",
)
def built_resources(spark, folder):
    d = build_documents(adapters.resource(source_tables(spark, folder)))
    return d.select("doc_id", "status", F.col("weight").cast("bigint").alias("weight"), F.array_join("tags", ",").alias("tags"), F.array_join("keywords", ",").alias("keywords"))


_KINDS = ("resource", "post", "user", "organization", "official_tag", "tag", "document", "server", "video")
_NAMES = lambda x: f"CASE WHEN starts_with(trim({x}), '[') THEN CAST({x}::JSON AS VARCHAR[]) WHEN coalesce(trim({x}), '') = '' THEN [] ELSE string_split({x}, ',') END"


@add(
    "entity_union_documents",
    "WITH r AS ("
    + " UNION ALL ".join(f"SELECT * FROM ({SQL[f'source_{k}']})" for k in _KINDS)
    + f"""), n AS (SELECT *, CASE WHEN {_fold("status")} IN ('deleted', 'removed') THEN 'deleted' WHEN {_fold("visibility")} NOT IN ('', 'public') THEN 'hidden' WHEN {_fold("status")} IN ('approved', 'published', 'active') THEN 'active' ELSE 'hidden' END AS told FROM r)
SELECT entity_type || ':' || entity_id AS doc_id, told AS status, CASE WHEN told = 'active' THEN view_count::BIGINT + 5 * like_count::BIGINT + 3 * download_count::BIGINT + (CASE WHEN entity_type = 'organization' THEN 2 ELSE 0 END) ELSE 0 END AS weight,
  array_to_string(list_filter({list_sql(f"{_NAMES('tags_json')} || (CASE WHEN entity_type = 'resource' THEN {_NAMES('extra_tags_json')} ELSE [] END)")}, lambda t: length(t) <= 64), '|') AS tags FROM n""",
)
def entity_union_documents(spark, folder):
    """Every document of all nine kinds."""
    d = build_documents(adapters.all_rows(source_tables(spark, folder)))
    return d.select("doc_id", "status", F.col("weight").cast("bigint").alias("weight"), F.array_join("tags", "|").alias("tags"))


@add(
    "private_bodies",
    f"SELECT 'post' AS entity_type, doc_id::VARCHAR AS entity_id, false AS told FROM documents WHERE list_contains({tok_sql('text')}, 'harbor')",
)
def private_bodies(spark, folder):
    """All documents as bodies of posts: found by a word of the body, which stands in no column that a search returns."""
    bodies = load(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("a post").alias("title"), F.lit("published").alias("status"), F.lit("public").alias("visibility"), F.lit("b").alias("boardId"), F.lit("u").alias("authorId"), F.lit("[]").alias("tags"), F.lit("[]").alias("topicTags"), F.col("text").alias("content"),
        F.lit("none").alias("accessMode"), F.col("created_at").alias("publishedAt"), *[F.lit(0).alias(c) for c in ("views", "likeCount", "favoriteCount")], F.col("created_at").alias("createdAt"), F.col("created_at").alias("updatedAt"))
    t = source_tables(spark, folder)
    rows = index_rows(build_documents(adapters.post({"Post": bodies, "User": t["User"], "Board": t["Board"]})), NOW)
    r = checked(Request(query="harbor"))
    found, _ = ranked(rows, r, CONFIG, NOW)
    shown = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in (*RESULT, "payload_text", "matched")]))
    return found.select(*KEY, F.contains(shown, F.lit("harbor")).alias("told"))


_INDEX = "SELECT generation_id, entity_type, entity_id, source_version,"


@add(
    "normalize_status",
    f"{_INDEX} CASE WHEN {_fold('status')} IN ('deleted', 'removed') THEN 'deleted' WHEN {_fold('status')} IN ('approved', 'published', 'active') THEN 'active' ELSE 'hidden' END AS open_status, CASE WHEN {_fold('status')} IN ('deleted', 'removed') THEN 'deleted' ELSE 'hidden' END AS closed_status FROM search_index",
)
def normalize_status(spark, folder):
    keys = ["generation_id", *KEY, "source_version"]
    return load(spark, folder, "search_index").select(*keys, normal_status("status", F.lit(" Public")).alias("open_status"), normal_status("status", F.lit("private")).alias("closed_status"))


@add("weight", f"{_INDEX} CASE WHEN status IN ('hidden', 'deleted') THEN 0 ELSE view_count::BIGINT + 5 * like_count::BIGINT + 3 * download_count::BIGINT END AS w FROM search_index")
def weights(spark, folder):
    rows = load(spark, folder, "search_index").withColumn("favorite_count", F.lit(0))
    return rows.select("generation_id", *KEY, "source_version", weight("status").alias("w"))


@add("keyword_tokens", f"{_INDEX} array_to_string({_WORDS(_fold('coalesce(title, ' + chr(39) * 2 + ')'))}, '|') AS words FROM search_index")
def keyword_tokens(spark, folder):
    return load(spark, folder, "search_index").select("generation_id", *KEY, "source_version", F.array_join(text.keyword_tokens("title"), "|").alias("words"))


@add("merge_strings", f"{_INDEX} array_to_string(list_filter({list_sql('tags || keywords')}, lambda t: length(t) <= 64 AND NOT regexp_full_match(t, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}')), '|') AS merged FROM search_index")
def merge_strings(spark, folder):
    return load(spark, folder, "search_index").select("generation_id", *KEY, "source_version", F.array_join(text.merged_strings(F.col("tags"), F.col("keywords")), "|").alias("merged"))


@add("parse_string_array", f"{_INDEX} array_to_string(tags, '|') AS parsed FROM search_index")
def parse_string_array(spark, folder):
    rows = load(spark, folder, "search_index")
    return rows.select("generation_id", *KEY, "source_version", F.array_join(text.parse_strings(F.to_json("tags")), "|").alias("parsed"))


@add(
    "parse_lenient_lists",
    f"{_INDEX} array_to_string(list_transform(tags, lambda t: trim(t, ' ')), '|') AS objects, array_to_string(CASE WHEN trim(array_to_string(tags, ',')) = '' THEN [] ELSE list_transform(string_split(trim(array_to_string(tags, ','), ' '), ','), lambda t: trim(t, ' ')) END, '|') AS commas FROM search_index",
)
def parse_lenient_lists(spark, folder):
    """Lists of objects, whose first name that is not blank counts, and lists with commas."""
    objects = F.to_json(F.transform("tags", lambda t: F.struct(F.lit(" ").alias("name"), t.alias("tag"), F.lit("x").alias("slug"))))
    named = F.transform(text.parse_strings(objects), lambda t: F.when(t == "x", "").otherwise(t))
    commas = text.parse_strings(F.array_join("tags", ","))
    return load(spark, folder, "search_index").select("generation_id", *KEY, "source_version", F.array_join(named, "|").alias("objects"), F.array_join(commas, "|").alias("commas"))


@add("number_text", "SELECT o_orderkey, ' ' || (o_orderkey * 1000) || ' -' || (o_orderkey // 100) || '.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || ' ' || o_orderkey || '.50' || ' 1e20001' AS numbers FROM orders")
def number_text(spark, folder):
    payload = F.format_string('{"a":%se3,"b":[-%se-2,%s.50],"c":{"d":1e20001,"e":null}}', *[F.col("o_orderkey").cast("string")] * 3)
    return load(spark, folder, "orders").select("o_orderkey", text.flatten_payload(payload).alias("numbers"))


@add("version_keys_second", VIEW + "SELECT entity_type, entity_id, len(version_keys)::INT AS n, coalesce(list_sum(version_keys), 0)::BIGINT AS s FROM v")
def version_keys_second(spark, folder):
    """Versions that stand under ``versions``, beside an mcVersions that is no array."""
    moved = F.regexp_replace(F.regexp_replace("payload", '"mcVersions"', '"versions"'), r"^\{", '{"mcVersions":"1.2.3",')
    keys = text.version_keys(F.regexp_replace(moved, ",}$", "}"))
    return view(spark, folder, "payload").select(*KEY, F.size(keys).alias("n"), F.aggregate(keys, F.lit(0).cast("bigint"), lambda a, k: a + k).alias("s"))


@add("flatten_payload", VIEW + "SELECT entity_type, entity_id, payload_text FROM v")
def flatten_payload(spark, folder):
    return view(spark, folder, "payload").select(*KEY, "payload_text")


# the feed
_EVENTS = "SELECT DISTINCT * FROM search_index_events"


def _events(spark, folder) -> DataFrame:
    return load(spark, folder, "search_index_events")


_LOOK = "WITH look AS (SELECT * FROM search_index_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY processed_at IS NOT NULL DESC, updated_at DESC, attempts DESC, event_order DESC) = 1)"


_EKEY = f"trim(entity_type, {BLANKS}) AS entity_type, trim(entity_id, {BLANKS}) AS entity_id"


@add(
    "latest_event_per_key",
    f"SELECT {_EKEY}, max(event_order) AS event_order, arg_max(id, {{'a': event_order, 'b': created_at, 'c': id}}) AS id FROM search_index_events GROUP BY 1, 2",
)
def latest_event_per_key(spark, folder):
    return outbox.latest_per_entity(_events(spark, folder).select(*KEY, "event_order", "created_at", "id")).select(*KEY, "event_order", "id")


@add("events_of_key", f"SELECT DISTINCT {_EKEY}, id FROM search_index_events")
def events_of_key(spark, folder):
    return outbox.events_per_entity(_events(spark, folder))


@add(
    "claim_eligible",
    _LOOK
    + """ SELECT id, event_order FROM look WHERE processed_at IS NULL AND (locked_at IS NULL OR locked_at < TIMESTAMPTZ '2025-12-01 00:00:00+00' - INTERVAL 120 SECOND) AND coalesce(attempts, 0) < 10
  AND (failed_at IS NULL OR failed_at <= TIMESTAMPTZ '2025-12-01 00:00:00+00' - INTERVAL 30 SECOND) ORDER BY event_order, id LIMIT 200""",
)
def claim_eligible(spark, folder):
    return outbox.claim(outbox.latest_look(_events(spark, folder)), datetime(2025, 12, 1, tzinfo=timezone.utc)).select("id", "event_order")


@add("outbox_range", _LOOK + ", g AS (SELECT max(source_high_watermark) FILTER (status = 'active') AS lo, coalesce(max(source_high_watermark) FILTER (status = 'building'), (SELECT max(event_order) FROM search_index_events)) AS hi FROM index_generations) SELECT id, event_order FROM look, g WHERE event_order > lo AND event_order <= hi AND NOT (coalesce(attempts, 0) >= 10 AND failed_at IS NOT NULL AND processed_at IS NULL)")
def outbox_range(spark, folder):
    bounds = outbox.catch_up_bounds(load(spark, folder, "index_generations"), _events(spark, folder))
    return outbox.outbox_range(outbox.latest_look(_events(spark, folder)), *bounds).select("id", "event_order")


@add("source_versions", VIEW + f"SELECT v.entity_type, v.entity_id, coalesce(max(event_order), 0) AS version FROM v LEFT JOIN (SELECT {_EKEY}, event_order FROM search_index_events) e ON v.entity_type = e.entity_type AND v.entity_id = e.entity_id GROUP BY ALL")
def source_versions(spark, folder):
    return outbox.versions_of(view(spark, folder, "status").select(*KEY), _events(spark, folder)).select(*KEY, "version")


@add("version_per_entity", f"SELECT trim(entity_type, {BLANKS}) AS entity_type, trim(entity_id, {BLANKS}) AS entity_id, max(event_order) AS version FROM search_index_events GROUP BY 1, 2")
def version_per_entity(spark, folder):
    return metrics.version_per_entity(_events(spark, folder))


@add("expectations", f"SELECT trim(entity_type, {BLANKS}) AS entity_type, trim(entity_id, {BLANKS}) AS entity_id, max(event_order) AS version, bool_and({_fold('action')} <> 'delete') AS only_writes FROM search_index_events GROUP BY 1, 2")
def expectations(spark, folder):
    return metrics.expectations(_events(spark, folder))


# writes
def _current(spark, folder) -> DataFrame:
    active = active_generation(load(spark, folder, "index_generations"))
    rows = load(spark, folder, "search_index")
    return writes.latest_per_key(rows.where(F.col("generation_id") == (active[0] if active else -1)).select(*KEY, *STORED), KEY, ["source_version", "indexed_at"])


def _others(spark, folder) -> DataFrame:
    """The rows of all generations but the active one."""
    active = active_generation(load(spark, folder, "index_generations"))
    rows = load(spark, folder, "search_index")
    return rows.where(~F.col("generation_id").eqNullSafe(active[0] if active else None)).select(*KEY, *STORED)


_MERGE = f"""
WITH cur AS (SELECT * FROM search_index WHERE generation_id = (SELECT id FROM index_generations WHERE status = 'active')
  QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY source_version DESC, indexed_at DESC) = 1),
inc AS (SELECT * REPLACE (coalesce(nullif({_fold('status')}, ''), 'active') AS status) FROM search_index WHERE generation_id IS DISTINCT FROM (SELECT id FROM index_generations WHERE status = 'active')
  QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY source_version DESC, updated_at DESC NULLS LAST) = 1)
"""


@add(
    "versioned_upsert",
    _MERGE
    + """SELECT coalesce(i.entity_type, c.entity_type) AS entity_type, coalesce(i.entity_id, c.entity_id) AS entity_id,
  CASE WHEN i.entity_id IS NOT NULL AND (c.entity_id IS NULL OR c.source_version <= i.source_version) THEN i.source_version ELSE c.source_version END AS source_version,
  CASE WHEN i.entity_id IS NOT NULL AND (c.entity_id IS NULL OR c.source_version <= i.source_version) THEN i.status ELSE c.status END AS status,
  CASE WHEN i.entity_id IS NOT NULL AND (c.entity_id IS NULL OR c.source_version <= i.source_version) THEN epoch_us(coalesce(i.created_at, c.created_at, TIMESTAMPTZ '2026-01-01 00:00:00+00')) ELSE epoch_us(c.created_at) END AS created_us
FROM cur c FULL JOIN inc i ON c.entity_type = i.entity_type AND c.entity_id = i.entity_id""",
)
def versioned_upsert(spark, folder):
    state, _ = writes.upsert(_current(spark, folder), _others(spark, folder), NOW)
    return state.select(*KEY, "source_version", "status", F.unix_micros("created_at").alias("created_us"))


@add("rejected_writes", _MERGE + "SELECT i.entity_type, i.entity_id, c.entity_id IS NULL OR c.source_version <= i.source_version AS applied FROM inc i LEFT JOIN cur c ON c.entity_type = i.entity_type AND c.entity_id = i.entity_id")
def rejected_writes(spark, folder):
    return writes.upsert(_current(spark, folder), _others(spark, folder), NOW)[1]


@add(
    "unversioned_upsert",
    _MERGE
    + """SELECT coalesce(i.entity_type, c.entity_type) AS entity_type, coalesce(i.entity_id, c.entity_id) AS entity_id, CASE WHEN c.entity_id IS NULL THEN 0 ELSE c.source_version END AS source_version
FROM cur c FULL JOIN inc i ON c.entity_type = i.entity_type AND c.entity_id = i.entity_id""",
)
def unversioned_upsert(spark, folder):
    return writes.upsert(_current(spark, folder), _others(spark, folder), NOW, versioned=False)[0].select(*KEY, "source_version")


@add(
    "tombstone",
    _MERGE
    + f""", d AS (SELECT {_EKEY}, max(event_order) AS v FROM search_index_events WHERE {_fold('action')} = 'delete' AND trim(entity_id, {BLANKS}) <> '' GROUP BY 1, 2)
SELECT coalesce(d.entity_type, c.entity_type) AS entity_type, coalesce(d.entity_id, c.entity_id) AS entity_id, CASE WHEN d.v IS NOT NULL AND (c.entity_id IS NULL OR c.source_version <= d.v) THEN 'deleted' ELSE c.status END AS status,
  CASE WHEN d.v IS NOT NULL AND (c.entity_id IS NULL OR c.source_version <= d.v) THEN d.v ELSE c.source_version END AS source_version, CASE WHEN c.entity_id IS NULL THEN '' ELSE c.title END AS title,
  CASE WHEN d.v IS NOT NULL AND (c.entity_id IS NULL OR c.source_version <= d.v) THEN 'gone' ELSE c.payload->>'$.reason' END AS reason
FROM cur c FULL JOIN d ON c.entity_type = d.entity_type AND c.entity_id = d.entity_id""",
)
def tombstones(spark, folder):
    e = _events(spark, folder).where((folded("action") == "delete") & (F.length(trimmed("entity_id")) > 0))
    keys = e.select(*KEY, F.col("event_order").alias("source_version"), F.lit("gone").alias("reason"))
    state, _ = writes.tombstone(_current(spark, folder), keys, NOW)
    return state.select(*KEY, "status", "source_version", "title", F.get_json_object("payload", "$.reason").alias("reason"))


# checks
@add("status_counts", VIEW + "SELECT entity_type, count(*) AS n FROM v GROUP BY 1")
def status_counts(spark, folder):
    return metrics.status_counts(view(spark, folder, "status"))


@add("job_summary", "SELECT epoch_us(max(finished_at) FILTER (status = 'success')) AS last_success_us, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, arg_max(coalesce(error, message), {'a': started_at, 'b': id}) FILTER (status = 'failed') AS last_failure FROM index_sync_log")
def job_summary(spark, folder):
    return metrics.job_summary(load(spark, folder, "index_sync_log")).select(F.unix_micros("last_success").alias("last_success_us"), "failed", "running", "last_failure")


@add("index_lag", "SELECT greatest(0, (epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - min(t) FILTER (NOT done)) / 1000000)::DOUBLE AS lag_seconds FROM (SELECT min(epoch_us(created_at)) AS t, count(processed_at) > 0 AS done FROM search_index_events GROUP BY id)")
def index_lag(spark, folder):
    return metrics.feed_lag(_events(spark, folder), NOW)


@add(
    "event_stats",
    "WITH e AS (SELECT id, count(processed_at) > 0 AS d, count(failed_at) > 0 AS f, count(locked_at) > 0 AS l FROM search_index_events GROUP BY id) SELECT count(*) AS events, count(*) FILTER (d) AS processed, count(*) FILTER (f AND NOT d) AS failed, count(*) FILTER (l AND NOT d) AS locked, count(*) FILTER (NOT d) AS backlog FROM e",
)
def event_stats(spark, folder):
    return metrics.event_stats(_events(spark, folder))


@add(
    "validate_generation",
    "WITH r AS (SELECT * FROM search_index WHERE generation_id = (SELECT id FROM index_generations WHERE status = 'active')) SELECT count(*) AS rows, count(DISTINCT entity_type || chr(0) || entity_id) AS keys, count(*) FILTER (trim(entity_type) = '' OR trim(entity_id) = '') AS blank_keys, false AS valid FROM r",
)
def validate_generation(spark, folder):
    active = active_generation(load(spark, folder, "index_generations"))
    return metrics.validate_generation(load(spark, folder, "search_index").where(F.col("generation_id") == active[0]))


@add("latency_percentiles", "SELECT quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.95) AS p95, quantile_disc(d, 0.99) AS p99 FROM (SELECT epoch_us(finished_at) - epoch_us(started_at) AS d FROM index_sync_log WHERE finished_at IS NOT NULL)")
def latency_percentiles(spark, folder):
    rows = load(spark, folder, "index_sync_log").where(F.col("finished_at").isNotNull())
    p = metrics.nearest_rank(rows, F.unix_micros("finished_at") - F.unix_micros("started_at"))
    return p.select(*[F.col(c).cast("bigint").alias(c) for c in p.columns])


@add(
    "hit_ratio",
    "SELECT event_type AS kind, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, round(coalesce(avg(CASE WHEN event_type <> 'error' THEN (user_id % 3 = 0)::INT::DOUBLE END), 0), 9) AS hit_ratio FROM events GROUP BY ROLLUP (event_type)",
)
def hit_ratio(spark, folder):
    calls = load(spark, folder, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3 == 0).cast("int").alias("hit"), (F.col("event_type") == "error").alias("failed"))
    return metrics.hit_ratio(calls).withColumn("hit_ratio", F.round("hit_ratio", 9))


@add("source_identities", "SELECT 'user' AS entity_type, c_custkey::VARCHAR AS entity_id, c_name AS title FROM customer ORDER BY entity_id LIMIT 100")
def source_identities(spark, folder):
    return adapters.identities(adapters.user(source_tables(spark, folder)), 100).select(*KEY, "title")
