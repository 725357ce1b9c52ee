"""Source tables of the nine entity kinds brought to one row shape, as left joins and projections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.search import by_category_or_slug

#: The row shape of every adapter, in order. The names of source columns below are fixed by the tables.
ROW = ["entity_type", "entity_id", "title", "status", "visibility", "category_id", "author_id", "tags_json", "extra_tags_json", "keywords_json", "description",
       "view_count", "like_count", "download_count", "favorite_count", "created_at", "updated_at", "payload"]
PERSON = ("id", "uid", "username", "slug", "avatar", "role")
GROUP = ("id", "name", "slug", "icon", "color")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))


def _json(*cs: Column) -> Column:
    """A JSON array of strings."""
    return F.to_json(F.array(*cs))


def _payload(rows: DataFrame, plain: list[str], **nested: Column) -> Column:
    """A JSON object of the columns that the table has, and of nested rows; null fields are kept out."""
    own = [F.col(c) for c in plain if c in rows.columns]
    return F.to_json(F.struct(*own, *[v.alias(k) for k, v in nested.items()]))


def _part(table: DataFrame, columns: tuple[str, ...], alias: str) -> DataFrame:
    have = [c for c in columns if c in table.columns]
    return table.select(F.col("id").alias(f"_{alias}_id"), F.struct(*have).alias(alias))


def _with(rows: DataFrame, table: DataFrame, ref: str, columns: tuple[str, ...], alias: str) -> DataFrame:
    """Left join on the table's id; Catalyst broadcasts it if it is small enough, else shuffles."""
    p = _part(table, columns, alias)
    return rows.join(p, rows[ref] == p[f"_{alias}_id"], "left").drop(f"_{alias}_id")


def _row(rows: DataFrame, kind: str, **v: Column) -> DataFrame:
    """Fills what an entity kind lacks: empty text and lists, zero counters."""
    empty, none, zero = F.lit(""), F.lit("[]"), F.lit(0).cast("bigint")
    base = {c: empty for c in ("title", "category_id", "author_id", "description")} | {c: none for c in ("tags_json", "extra_tags_json", "keywords_json")} | {c: zero for c in ("view_count", "like_count", "download_count", "favorite_count")}
    base |= {"entity_type": F.lit(kind), "entity_id": F.col("id").cast("string"), "created_at": F.col("createdAt"), "updated_at": F.col("updatedAt") if "updatedAt" in rows.columns else F.col("createdAt"), "status": F.col("status") if "status" in rows.columns else empty, "visibility": F.col("visibility") if "visibility" in rows.columns else empty}
    base |= v
    return rows.select(*[base[c].alias(c) for c in ROW])


def _counters(downloads: str | None = None) -> dict[str, Column]:
    return {"view_count": _number("views"), "like_count": _number("likeCount"), "favorite_count": _number("favoriteCount")} | ({"download_count": _number(downloads)} if downloads else {})


def official_tags(rows: DataFrame, tags: DataFrame, groups: DataFrame, ref: str = "officialTags") -> DataFrame:
    """(id, official_tags): the distinct names of the enabled tags, of enabled groups, whose ids a row lists as JSON."""
    used = rows.select("id", F.explode(F.from_json(F.coalesce(F.nullif(ref, F.lit("")), F.lit("[]")), "array<string>")).alias("tag_id"))
    open_tags = tags.where("enabled").join(groups.where("enabled").select(F.col("id").alias("groupId")), "groupId").select(F.col("id").cast("string").alias("tag_id"), "name")
    return used.join(open_tags, "tag_id").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("official_tags"))


def resource(t: Mapping[str, DataFrame]) -> DataFrame:
    rows = by_category_or_slug(t["Resource"], t["Category"], "category", [c for c in GROUP[1:] if c in t["Category"].columns])
    rows = _with(rows, t["User"], "authorId", PERSON, "author").join(official_tags(t["Resource"], t["OfficialTag"], t["OfficialTagGroup"]), "id", "left")
    extra = F.coalesce(F.to_json("official_tags"), F.lit("[]"))
    plain = ["publicId", "slug", "customSlug", "description", "platform", "subCategory", "thirdLevelCats", "mcVersions", "officialTags", "coverImage", "ratingAverage", "ratingCount", "version", "isPaid", "attributionType"]
    return _row(rows, "resource", title=F.col("title"), category_id=_text("category"), author_id=F.col("authorId"), tags_json=F.coalesce("tags", F.lit("[]")), extra_tags_json=extra, keywords_json=F.coalesce("mcVersions", F.lit("[]")), description=_text("description"), payload=_payload(rows, plain, author=F.col("author"), category=F.col("category_row")), **_counters("downloadCount"))


def post(t: Mapping[str, DataFrame]) -> DataFrame:
    """Only published posts of free access keep their status, all others are hidden."""
    rows = _with(_with(t["Post"], t["User"], "authorId", PERSON, "author"), t["Board"], "boardId", GROUP, "category")
    status = F.when(F.col("publishedAt").isNotNull() & (F.col("accessMode") == "none"), F.col("status")).otherwise("hidden")
    plain = ["publicId", "slug", "customSlug", "postType", "isPinned", "isHighlighted", "topicTagId", "topicTagName", "publishedAt", "accessMode"]
    return _row(rows, "post", title=F.col("title"), status=status, category_id=F.col("boardId"), author_id=F.col("authorId"), tags_json=F.coalesce("tags", F.lit("[]")), extra_tags_json=F.coalesce("topicTags", F.lit("[]")), description=_text("content"), payload=_payload(rows, plain, author=F.col("author"), category=F.col("category")), **_counters())


def server(t: Mapping[str, DataFrame]) -> DataFrame:
    rows = by_category_or_slug(t["PlayerServer"], t["PlayerServerCategory"], "category", [c for c in GROUP[1:] if c in t["PlayerServerCategory"].columns])
    rows = _with(rows, t["User"], "authorId", PERSON, "author")
    plain = ["publicId", "slug", "customSlug", "description", "platform", "versions", "networkEnvironments", "onlineMode", "hideConnectionAddress", "website", "coverImage", "onlineCount", "maxPlayers", "ratingAverage", "ratingCount"]
    return _row(rows, "server", title=F.col("title"), category_id=_text("category"), author_id=F.col("authorId"), tags_json=F.coalesce("tags", F.lit("[]")), extra_tags_json=F.coalesce("versions", F.lit("[]")), keywords_json=F.coalesce("networkEnvironments", F.lit("[]")), description=_text("description"), payload=_payload(rows, plain, author=F.col("author"), category=F.col("category_row")), **_counters())


def video(t: Mapping[str, DataFrame]) -> DataFrame:
    rows = _with(_with(t["Video"], t["User"], "authorId", PERSON, "author"), t["VideoCategory"], "categoryId", GROUP, "category")
    plain = ["publicId", "slug", "customSlug", "description", "sourceUrl", "sourceType", "sourceId", "coverImage", "replyCount"]
    return _row(rows, "video", title=F.col("title"), category_id=F.col("categoryId"), author_id=F.col("authorId"), tags_json=F.coalesce("tags", F.lit("[]")), description=_text("description"), payload=_payload(rows, plain, author=F.col("author"), category=F.col("category")), **_counters())


def document(t: Mapping[str, DataFrame]) -> DataFrame:
    rows = t["CustomPage"]
    shown = lambda yes, no: F.when(F.col("published"), yes).otherwise(no)
    return _row(rows, "document", title=F.col("title"), status=shown("published", "draft"), visibility=shown("public", "private"), category_id=_text("category"), extra_tags_json=_json(F.coalesce(F.nullif("category", F.lit("")), F.lit("document"))), description=F.concat(_text("description"), F.lit(" "), _text("content")), payload=_payload(rows, ["slug", "description", "category", "icon", "published", "sortOrder"]))


def user(t: Mapping[str, DataFrame]) -> DataFrame:
    """Public profile only: no address, mail or phone reaches the payload."""
    rows = t["User"]
    return _row(rows, "user", title=F.col("username"), visibility=F.lit("public"), category_id=_text("role"), author_id=F.col("id").cast("string"), extra_tags_json=_json(F.lit("user"), F.coalesce("role", F.lit("user"))), keywords_json=_json(_text("username"), _text("slug"), _text("uid")), description=F.concat(_text("bio"), F.lit(" "), _text("profileReadme")), payload=_payload(rows, ["id", "uid", "username", "slug", "avatar", "bio", "profileReadme", "role", "status", "createdAt"]))


def organization(t: Mapping[str, DataFrame]) -> DataFrame:
    rows = _with(t["Organization"], t["User"], "ownerId", PERSON, "owner")
    plain = ["slug", "name", "tagline", "description", "avatarImage", "coverImage", "category", "joinPolicy", "memberCount"]
    return _row(rows, "organization", title=F.col("name"), category_id=_text("category"), author_id=F.col("ownerId"), extra_tags_json=_json(F.lit("organization"), F.coalesce(F.nullif("category", F.lit("")), F.lit("general"))), keywords_json=_json(_text("name"), _text("slug"), _text("tagline")), description=F.concat_ws(" ", _text("tagline"), _text("description"), _text("homepageContent")), favorite_count=_number("memberCount"), payload=_payload(rows, plain, owner=F.col("owner")))


def tag(t: Mapping[str, DataFrame]) -> DataFrame:
    rows = t["Tag"]
    return _row(rows, "tag", title=F.col("name"), status=F.lit("active"), visibility=F.lit("public"), category_id=F.lit("tag"), tags_json=_json(_text("name")), keywords_json=_json(_text("name"), _text("slug")), description=_text("name"), view_count=_number("count"), updated_at=F.col("createdAt"), payload=_payload(rows, ["name", "slug", "count"]))


def official_tag(t: Mapping[str, DataFrame]) -> DataFrame:
    """Shown only if both the tag and its group are enabled."""
    rows = _with(t["OfficialTag"], t["OfficialTagGroup"], "groupId", ("id", "name", "slug", "description", "enabled"), "group")
    on = lambda yes, no: F.when(F.col("enabled") & F.col("group.enabled"), yes).otherwise(no)
    return _row(rows, "official_tag", title=F.col("name"), status=on("active", "hidden"), visibility=on("public", "private"), category_id=F.col("groupId"), tags_json=_json(_text("name"), _text("group.name")), keywords_json=_json(_text("name"), _text("slug"), _text("group.name"), _text("group.slug")), description=F.concat(_text("description"), F.lit(" "), _text("group.description")), payload=_payload(rows, ["name", "slug", "icon", "description", "sortOrder", "enabled"], group=F.col("group")))


ADAPTERS = {"resource": resource, "post": post, "server": server, "video": video, "document": document, "user": user, "organization": organization, "tag": tag, "official_tag": official_tag}


def all_rows(t: Mapping[str, DataFrame]) -> DataFrame:
    """The adapter rows of all nine kinds; kinds whose tables are not given are left out."""
    need = {"resource": ["Resource", "Category", "User", "OfficialTag", "OfficialTagGroup"], "post": ["Post", "User", "Board"], "server": ["PlayerServer", "PlayerServerCategory", "User"], "video": ["Video", "User", "VideoCategory"], "document": ["CustomPage"], "user": ["User"], "organization": ["Organization", "User"], "tag": ["Tag"], "official_tag": ["OfficialTag", "OfficialTagGroup"]}
    parts = [f(t) for k, f in ADAPTERS.items() if all(n in t for n in need[k])]
    cast = {"category_id": "string", "author_id": "string", "created_at": "timestamp", "updated_at": "timestamp", "title": "string", "status": "string", "visibility": "string", "view_count": "bigint", "like_count": "bigint", "download_count": "bigint", "favorite_count": "bigint"}
    parts = [p.select(*[F.col(c).cast(cast[c]).alias(c) if c in cast else F.col(c) for c in ROW]) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def identities(rows: DataFrame, limit: int) -> DataFrame:
    """(entity_type, entity_id, title, updated_at) of the first rows by id; limit 1..10,000."""
    if limit < 1:
        raise ValueError("source entity reference limit must be positive")
    return rows.select("entity_type", "entity_id", "title", "updated_at").orderBy("entity_type", "entity_id").limit(min(limit, 10_000))
