"""Golden cases of tokens, query texts, versions, numbers, snippets, cursors, settings and limits."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.terms import SPACES, folded, terms, trimmed
from skein.operators.documents import normal_status
from skein.operators.highlight import snippet
from skein.operators.metrics import nearest_rank
from skein.plans import cursor as cursors
from skein.plans.config import Config
from skein.plans.request import Clause, Filters, QueryError, Range, Request, checked, version_key
from skein.plans.textquery import normalize_text, parse, tokenize


def values(spark, column, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens_on_both_sides(spark):
    cases = {
        "hello世界": ["hello", "世", "界"],
        " 1.20.1 ": ["1.20.1"],
        "fabric api fabric": ["fabric", "api", "fabric"],
        "foo_bar- baz.": ["foo_bar", "baz"],
        "a'b/c": ["a", "b", "c"],
        "テスト": ["テスト"],
        "_x -y": ["x", "y"],
        "???": [],
        "": [],
    }
    assert [tokenize(k) for k in cases] == list(cases.values())
    assert values(spark, text.tokens, *cases, None) == [*cases.values(), []]


def test_query_text():
    words = {"模组": ["mod", "mods"], "整合包": ["modpack", "mod pack"], "java版": ["java edition"]}
    assert normalize_text("  Fabric,  API/1.20!世 ") == "fabric api/1.20 世"
    assert parse("模组", words).rendered() == "(('模' & '组') | 'mod' | 'mods')"
    assert parse("整合包 x", words).rendered() == "(('整' & '合' & '包') | 'modpack' | ('mod' & 'pack')) & 'x'"
    assert parse("modern", {"mod": ["模组"]}).terms == ["modern"]
    assert parse("mod 模组", {"mod": ["y"]}).terms == ["mod", "模", "组"]
    q = parse("Fabric 1.20.1 / 1.8", Config().synonyms)
    assert (q.versions, q.loaders) == (["1.20.1", "1.8"], ["fabric"]) and q.boosts() == {"1.20.1": 0.8, "1.8": 0.8, "fabric": 0.65}
    assert parse("插件", Config().synonyms).loaders == ["bukkit", "paper", "spigot"]
    assert parse("???", {}).groups == []


def test_versions(spark):
    assert version_key("1.8.10") == 1008010 < version_key("v1.20.1")
    assert [version_key(x) for x in ("1.20.1junk", "2148.0.0", "1.+20.1", "1.20.-1", "1.20.1.0", "")] == [None] * 6
    rows = ['{"mcVersions":["1.8","x","1.21.5"]}', '{"mcVersions":"1.8","versions":["1.2.3"]}', '{"versions":"1.2"}', "{}", "broken", None]
    assert values(spark, text.version_keys, *rows) == [[1008000, 1021005], [1002003], [], [], [], []]


def test_numbers_and_payload_text():
    assert [text.number_text(x) for x in ("1.234567e6", "9007199254740993", "1e-3", "-2.5E1", "1e99999")] == ["1234567", "9007199254740993", "0.001", "-25", "1e99999"]
    assert text.payload_text('{"b":{"z":"q","y":null},"a":[1.50,true,"  ","x"]}') == " 1.50 true x q"
    assert text.payload_text(None) == text.payload_text("{") == text.payload_text("null") == ""
    deep = "1"
    for _ in range(12):
        deep = "[" + deep + "]"
    assert text.payload_text(deep) == "" and len(text.payload_text('{"a":"' + "x" * 30_000 + '"}')) == 20_000


def test_lists(spark):
    assert values(spark, text.parse_strings, '["a", {"name":" ", "tag":"b"}, 3, null, {"x":1}]', "a, b ,", "", None, "[broken") == [["a", "b", ""], ["a", "b", ""], [], [], ["[broken"]]
    assert values(spark, text.keyword_tokens, "Fast_1 Ofen!", "世界", "x" * 65, None) == [["fast_1", "ofen", "fast_1 ofen!"], ["世界"], ["x" * 65], []]
    opaque = "0123abcd-0123-0123-0123-0123456789ab"
    assert values(spark, lambda c: text.merged_strings(c, F.array(F.lit("B"))), [" a ", opaque, "", "y" * 65, "b", None], None, kind="array<string>") == [["a", "b"], ["b"]]
    assert values(spark, lambda c: terms(c), [" A\xa0", "a", "　", None, "B\t"], None, [], kind="array<string>") == [["a", "b"], [], []]
    assert values(spark, trimmed, SPACES + "x y" + SPACES) == ["x y"]
    assert values(spark, folded, " ÄB ", None) == ["äb", None]


def test_similarity(spark):
    got = values(spark, lambda c: text.similarity(c, "two words"), "word", "two words", "", None)
    assert round(got[0], 4) == 0.3636 and got[1:] == [1.0, 0.0, 0.0]


def test_status(spark):
    df = spark.createDataFrame([("Approved", "Public"), ("removed", "private"), ("active", "friends"), ("draft", ""), (None, None)], "s string, v string")
    assert [r.x for r in df.select(normal_status("s", "v").alias("x")).collect()] == ["active", "deleted", "hidden", "hidden", "hidden"]


def test_snippets():
    assert snippet("Fabric API", ["fabric", "api"], 160) == "<mark>Fabric</mark> <mark>API</mark>"
    assert snippet("<b> abcd", ["ab", "bc"], 160) == "&lt;b&gt; <mark>abc</mark>d"
    assert snippet("Ⱥ mod", ["mod"], 160) == "Ⱥ <mark>mod</mark>"
    assert snippet("aaa", ["aa"], 9) == "<mark>aaa</mark>"
    long = "x" * 100 + "hit" + "y" * 100
    assert snippet(long, ["hit"], 30) == "..." + "x" * 10 + "<mark>hit</mark>" + "y" * 17 + "..."
    assert snippet("plain", [], 3) == "pla..."


def test_cursor():
    c = cursors.Cursor("popular", 1.5, "2025-01-01T00:00:00+00:00", "post", "1", 6, "cfg", "q", "2026-01-01T00:00:00+00:00")
    t = cursors.encode(c, b"k")
    assert cursors.decode(t, b"k") == c and "=" not in t
    for bad, key in ((t, b"other"), (t[:-2] + "AA", b"k"), ("x", b"k"), ("", b"k"), ("a.b.c", b"k")):
        with pytest.raises(cursors.CursorError):
            cursors.decode(bad, key)
    with pytest.raises(cursors.CursorError):
        cursors.bind(c, sort="popular", generation=7, config="cfg", query="q")
    assert cursors.query_digest(Request(query="a")) != cursors.query_digest(Request(query="b")) and cursors.query_digest(Request(limit=3)) == cursors.query_digest(Request())


def test_settings():
    c = Config().patched({"scoring": {"title_weight": 0, "like_count_weight": 99, "time_decay_factor": float("nan")}, "query": {"synonyms": {" New!": ["B", "a", ""]}}}).clamped()
    assert (c.scoring.title_weight, c.scoring.like_count_weight, c.scoring.time_decay_factor, c.scoring.tags_weight) == (0, 10, 30, 5)
    assert c.synonyms["new"] == ["a", "b"] and "mod" in c.synonyms and c.digest() != Config().digest()


@pytest.mark.parametrize(
    "code, request_",
    [
        ("query_too_long", Request(query="x" * 257)),
        ("query_term_limit_exceeded", Request(query=" ".join(f"t{i}" for i in range(25)))),
        ("invalid_query_text", Request(query="???")),
        ("invalid_sort", Request(sort="best")),
        ("invalid_sort_for_query", Request(sort="relevance")),
        ("invalid_query_field", Request(must=(Clause("body", "x"),))),
        ("invalid_query_operator", Request(must=(Clause("title", "x", "regex"),))),
        ("invalid_query_clause", Request(must=(Clause("title", " !"),))),
        ("prefix_too_short", Request(must=(Clause("title", "x", "prefix"),))),
        ("fuzzy_too_short", Request(must=(Clause("title", "xy", "fuzzy"),))),
        ("fuzzy_limit_exceeded", Request(should=(Clause("title", "xyz", "fuzzy"),) * 3)),
        ("must_not_limit_exceeded", Request(must_not=(Clause("title", "x"),) * 9)),
        ("query_clause_limit_exceeded", Request(must=(Clause("title", "x"),) * 33)),
        ("filter_value_limit_exceeded", Request(filters=Filters(tags_any=("x",) * 51))),
        ("filter_value_limit_exceeded", Request(filters=Filters(tags_any=("x",) * 50, tags_all=("x",) * 50, platforms=("x",) * 29))),
        ("invalid_minecraft_version", Request(filters=Filters(version=Range(gte="1.x")))),
    ],
)
def test_limits(code, request_):
    with pytest.raises(QueryError) as e:
        checked(request_)
    assert e.value.code == code


def test_request_defaults():
    r = checked(Request(entity_type="post", tags=("A",), category_id="C", status="Hidden"))
    assert (r.sort, r.limit, r.filters.entity_types, r.filters.tags_all, r.filters.category_ids, r.filters.statuses) == ("latest", 20, ("post",), ("A",), ("C",), ("Hidden",))
    assert checked(Request(query="x", limit=500)).limit == 100 and checked(Request(query="x")).sort == "relevance"


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "v double")
    assert tuple(nearest_rank(df, "v").first()) == (50.0, 95.0, 99.0) and tuple(nearest_rank(df.where("v < 0"), "v").first()) == (0.0, 0.0, 0.0)
    assert datetime.now(timezone.utc)
