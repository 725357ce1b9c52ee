"""Packing, mixing and repetition against brute force, known shares and odd inputs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import mixing
from skein.llm.decision_list import DecisionList, learn
from skein.llm.mixing import mix_sources, source_key
from skein.llm.packing import _meeting_ranks, pack
from skein.llm.repetition import FEATURES, measure_repetition, repetition_features
from skein.llm.repetitive import labelled_examples, repetitive_documents
from skein.llm.tokens import encoder, token_counts


def best_fit(sizes, capacity):
    """Gaps left by plain best fit, largest items first."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        room = [g for g in gaps if g >= s]
        if room:
            gaps.remove(min(room))
        gaps.append((min(room) if room else capacity) - s)
    return sorted(gaps)


def laid(out):
    """Containers as lists of sizes; checks that none is too full and that they are numbered without holes."""
    load = {}
    for r in out:
        if r.container is not None:
            load.setdefault(r.container, []).append(r.size)
    assert sorted(load) == list(range(len(load)))
    return load


@pytest.mark.parametrize("capacity", [1, 5, 37, 1000])
def test_one_range_is_best_fit_by_class(spark, capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 9)) for _ in range(400)]
    load = laid(pack(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id int, size int"), "id", "size", capacity).collect())
    assert sorted(x for v in load.values() for x in v) == sorted(sizes) and max(map(sum, load.values())) <= capacity
    assert sorted(capacity - sum(v) for v in load.values()) == best_fit(sizes, capacity)


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_many_ranges_lose_little_room(spark, share):
    rng = random.Random(5)
    sizes = [13 if rng.random() < share else int(min(1000, rng.paretovariate(0.8) * 8)) for _ in range(3000)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id int, size int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        load = laid(pack(df, "id", "size", 1000, rows_per_task=100).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted(x for v in load.values() for x in v) == sorted(sizes) and max(map(sum, load.values())) <= 1000
    assert len(load) <= 1.02 * len(best_fit(sizes, 1000)) + 9


def test_ranks_that_meet():
    class Row:
        def __init__(self, missed, slots):
            self.missed, self.slots = missed, slots

    items, places = _meeting_ranks({0: Row(5, 3), 1: Row(0, 2), 2: Row(4, 9), 3: Row(2, 0)})
    meet = lambda rows: {r + shift: (p, r) for p, lo, hi, shift in rows for r in range(lo, hi)}
    a, b = meet(items), meet(places)
    assert a.keys() == b.keys() == set(range(6)) and all(a[m][0] > b[m][0] for m in a)
    assert sorted(b.values()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)] and len(set(a.values())) == 6
    assert _meeting_ranks({0: Row(5, 0), 1: Row(0, 4)}) is None


def test_pack_whole_tables(spark):
    rng = random.Random(2)
    sizes = [rng.choice([7, 7, 7, rng.randint(0, 40), rng.randint(1, 320)]) for _ in range(900)] + [100, 200, None]
    df = spark.createDataFrame([(i // 2, s, "clash", 1) for i, s in enumerate(sizes)], "doc long, size int, part string, container int")
    out = pack(df, "doc", "size", 100).collect()
    load, parts = Counter(), Counter()
    for r in out:
        if r.container is not None:
            load[r.container] += r.size
        parts[r.doc] += r.size
        assert 0 <= r.part < r.n_parts and (r.n_parts == 1 or r.size == 100 or r.part == r.n_parts - 1)
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    want = Counter()
    for i, s in enumerate(sizes):
        want[i // 2] += s or 0
    assert parts == want
    rests = [s % 100 if s > 100 else s for s in sizes if s]
    assert len(load) == len(best_fit([r for r in rests if r], 100)) + sum(s // 100 for s in sizes if s and s > 100)
    assert pack(df.limit(0), "doc", "size", 100).count() == 0
    assert [r.container for r in pack(df.where("size = 0").limit(1), "doc", "size", 100).collect()] == [None]
    with pytest.raises(Exception):
        pack(df.withColumn("size", F.lit(-1)), "doc", "size", 100).collect()


def test_token_counts_round_trip(spark):
    texts = ["hello world", "", None, "世界 ok\r\n", "x" * 20_000, "a\x00b", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in token_counts(df, "text", "id").collect()}
    e = encoder()
    for i, t in enumerate(texts):
        ids = e.encode_ordinary(t or "")
        assert got[i] == len(ids) and e.decode(ids) == (t or "")


def corpus(spark, counts):
    words = {"wiki": "history castle river kingdom", "chat-log": "lol hey brb omg", "guide": "step click install open"}
    rng, rows = random.Random(4), []
    for source, n in counts.items():
        own = words.get((source or "wiki").strip().lower().replace("_", "-").replace(" ", "-"), "lol hey").split()
        rows += [(len(rows) + i, " ".join(rng.choice(own) for _ in range(rng.randint(5, 30))), source) for i in range(n)]
    return spark.createDataFrame([(*r, 0) for r in rows] + [(9_999, None, "guide", 0), (9_998, "", "wiki", 0)], "doc_id long, text string, source string, n_tokens int")


def test_mix_reaches_targets_and_reports_shortage(spark):
    docs = corpus(spark, {"wiki": 120, " WIKI": 20, "Chat Log": 60, "chat_log": 20, "guide": 8, None: 15, "unknown": 5, " ": 3})
    targets = spark.createDataFrame([("wiki", 0.4, 2), ("chat-log", 0.4, 3), ("guide", 0.15, 2), ("faq", 0.05, 9)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets)
    report = {r.source: r for r in mix.report.collect()}
    e = encoder()
    size = Counter()
    for r in docs.withColumn("key", source_key("source")).collect():
        size[r.key] += len(e.encode_ordinary(r.text or ""))
    total = sum(size[k] for k in report)
    for k, r in report.items():
        assert r.size == size[k] and r.wanted == pytest.approx(r.target_share * total) and r.short == (r.size * r.max_repeats < r.wanted)
        if not r.short:
            assert r.expected == pytest.approx(r.wanted, rel=0.02)
    assert report["guide"].short and report["faq"].short and report["faq"].n_documents == 0 and not report["wiki"].short
    rates = mix.rates.collect()
    assert len(rates) == docs.count() and all(0 <= r.repeats <= 3 and r.repeats <= np.ceil(r.rate) for r in rates)
    assert sum(r.actual_share for r in report.values()) <= 1 + 1e-9
    soft = [r for r in rates if r.source is None]
    assert len(soft) == 23


def test_mix_reports_soft_members(spark):
    docs = corpus(spark, {"wiki": 40, "guide": 30, None: 30, "unknown": 5})
    targets = spark.createDataFrame([("wiki", 0.5, 2), ("guide", 0.5, 3)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets)
    report, drawn = mix.report.collect(), Counter()
    for r in mix.rates.collect():
        drawn[r.source] += r.n_tokens * r.repeats
    assert drawn[None] > 0 and sum(r.drawn_soft for r in report) == pytest.approx(drawn[None])
    assert all(r.drawn == drawn[r.source] and r.actual_share == pytest.approx((r.drawn + r.drawn_soft) / sum(drawn.values())) for r in report)
    assert sum(r.actual_share for r in report) == pytest.approx(1)


def test_short_sources_come_from_the_fitted_rates(spark, monkeypatch):
    docs = corpus(spark, {"wiki": 60, "guide": 5})
    targets = spark.createDataFrame([("wiki", 0.5, 2), ("guide", 0.5, 3)], "source string, target_share double, max_repeats int")
    short = lambda: [r.source for r in mix_sources(docs, targets).report.collect() if r.short]
    assert short() == ["guide"]
    monkeypatch.setattr(mixing, "_step", lambda rate, *_: rate)  # without the descent no rate reaches its cap
    assert short() == []


def test_first_fit_is_one_exact_step(spark, monkeypatch):
    docs = corpus(spark, {"wiki": 60, "guide": 5, None: 9})
    targets = spark.createDataFrame([("wiki", 0.7, 2), ("guide", 0.3, 3), ("faq", 5e-7, 9)], "source string, target_share double, max_repeats int")
    fits, step = [], mixing._step
    monkeypatch.setattr(mixing, "_step", lambda *a: fits.append(step(*a)) or fits[-1])
    report = mix_sources(docs, targets).report.collect()
    assert len(fits) == 1  # what further steps would leave as it is, none is made for
    assert {r.source: x for r, x in zip(sorted(report, key=lambda r: r.source), fits[0])} == {r.source: min(r.max_repeats, r.wanted / r.size if r.size else np.inf) for r in report}
    total = sum(r.size for r in report)
    assert {r.source for r in report if r.short} == {r.source for r in report if r.size * r.max_repeats < r.target_share * total} == {"guide", "faq"}


def test_classifier_on_held_out_documents_of_a_rare_source(spark):
    mix = mix_sources(corpus(spark, {"wiki": 900, "chat-log": 60, None: 9}), spark.createDataFrame([("wiki", 0.5, 1), ("chat-log", 0.5, 2), ("faq", 0.0, 1)], "source string, target_share double, max_repeats int"), sample=180)
    told = {r.source: r for r in mix.accuracy.collect()}
    assert 5 < told["chat-log"].held_out <= 30 and told["wiki"].held_out < 40  # each source up to an equal part
    assert all(told[s].right == told[s].held_out and told[s].confidence > 0.8 for s in ("wiki", "chat-log")) and told["faq"].held_out == 0


def test_mix_of_odd_tables(spark):
    targets = spark.createDataFrame([("wiki", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix = mix_sources(corpus(spark, {}).limit(0), targets)
    assert [(r.size, r.short) for r in mix.report.collect()] == [(0, False)] and mix.rates.count() == 0
    with pytest.raises(ValueError):
        mix_sources(corpus(spark, {}), targets.union(targets))
    only = mix_sources(corpus(spark, {"wiki": 5}), targets).report.first()
    assert only.actual_share == 1.0 and not only.short
    keys = spark.createDataFrame([(" Forum_Post ",), ("forum post",), ("FORUM--post",), ("",), (None,)], "s string").select(source_key("s").alias("k")).collect()
    assert [r.k for r in keys] == ["forum-post"] * 3 + [None, None]


def shares(*texts):
    return [float(x) for x in repetition_features(texts)["share"]]


def test_repetition_of_known_texts():
    line = "Although the heavy window buys a golem along the roof we stay"
    other = "Until the floating quest darkens an airship around the quiet dock"
    assert shares(f"{line}. {other}.", "", None, "... 123 ​", "word") == [0.0] * 5
    assert shares(f"{line}.\n{line.upper()} 17!") == [0.5]
    changed = line.replace("golem", "dragon")
    assert shares(f"{line}. {changed}.") == [0.5]
    assert shares(f"{line}. {other}. {line}. {other}.")[0] == pytest.approx(0.5, abs=0.01)
    assert shares("buy now! " * 50)[0] > 0.9 and shares("垃圾广告快来买" * 30)[0] > 0.9
    assert shares("今天天气很好我们去公园。" + "今天 天气，很好我们去公园！")[0] == 0.5
    # texts in one call do not see each other
    assert shares(line, line, line) == [0.0] * 3


def test_repetition_features_against_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randrange(60))) for _ in range(60)]
    got = repetition_features(texts)
    for i, t in enumerate(texts):
        w = t.split()
        for n in (3, 5, 8):
            seen, cover = set(), [False] * len(w)
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in seen:
                    cover[k : k + n] = [True] * n
                seen.add(g)
            assert got[f"rep_{n}"][i] == pytest.approx(sum(cover) / max(1, len(w)))
        assert got["units"][i] == len(w)


def test_decision_list_learns_and_holds_out():
    rng = np.random.default_rng(1)
    x = rng.random((900, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)) | (x[:, 2] > 0.9)
    rules = learn(x[:600], y[:600], ["a", "b", "c"])
    assert (rules.predict(x[600:], ["a", "b", "c"]) == y[600:]).mean() > 0.95
    assert learn(x, np.zeros(900, bool), ["a", "b", "c"]) == DecisionList(()) and learn(x[:0], y[:0], ["a"]).rules == ()


def test_decision_list_in_spark(spark):
    rng = np.random.default_rng(2)
    x = rng.random((200, 2))
    y = x[:, 0] > 0.5
    rules = learn(x, y, ["a", "b"])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x] + [(None, 1.0)], "a double, b double")
    got = [r.yes for r in df.select(rules.column().alias("yes")).collect()]
    assert got[:-1] == list(rules.predict(x, ["a", "b"])) and got[-1] is False
    assert [r.yes for r in df.limit(2).select(DecisionList(()).column().alias("yes")).collect()] == [False, False]


def story(rng, sentences):
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nd", "rt", "ls", "mp")]
    return " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(8, 16))).capitalize() + "." for _ in range(sentences))


def test_held_out_accuracy_of_the_list():
    rng = random.Random(8)
    x, y, share = labelled_examples([story(rng, rng.randint(6, 25)) for _ in range(120)], seed=1)
    x2, y2, share2 = labelled_examples([story(rng, rng.randint(6, 25)) for _ in range(120)], seed=2)
    assert np.abs(share - 0.4).min() >= 0.02 and (np.abs(share - 0.4) < 0.1).any()
    said = learn(x, y, FEATURES, upward=True).predict(x2, list(FEATURES))
    assert (said == y2).mean() > 0.95 and (said == y2)[np.abs(share2 - 0.4) > 0.15].all()


def test_conditions_only_upward_and_no_cap_on_rules():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 12))
    y = (x > 0.97).any(axis=1)  # twelve rules are needed
    names = [f"f{i}" for i in range(12)]
    rules = learn(x, y, names, upward=True)
    assert len(rules.rules) == 12 and all(c.above for r in rules.rules for c in r) and (rules.predict(x, names) == y).mean() > 0.99
    heavy = np.where(x[:, 0] > 0.97, 0.0, 1.0)
    assert all(c.feature != "f0" for r in learn(x, y, names, weight=heavy, upward=True).rules for c in r)


def test_repetitive_documents(spark):
    rng = random.Random(5)
    texts = [story(rng, rng.randint(5, 20)) for _ in range(60)]
    texts += [t + "\n" + t.lower() + "\n" + t for t in texts[:8]] + ["", None, "short", "7 7 7"]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, share double")
    found = repetitive_documents(df)
    assert {r.doc_id for r in found.rows.collect() if r.repetitive} == set(range(60, 68)) and found.rules.rules
    told = found.report.collect()
    assert sum(r.examples for r in told) > 20 and all(r.found + r.wrong <= r.examples and (r.recall is None or r.recall > 0.9) for r in told)
    few = repetitive_documents(df, sample=20)  # a sample of the documents, the verdict on all
    assert few.rows.count() == df.count() and few.rules.rules
    none = repetitive_documents(df.limit(0))
    assert none.rows.count() == 0 and none.rules.rules == () and none.report.count() == 0
    same = repetitive_documents(spark.createDataFrame([(None, texts[60])] * 30, "doc_id long, text string"), sample=5)
    assert same.rows.count() == 30
    assert measure_repetition(spark.createDataFrame([(None, "a " * 200_000)], "doc_id long, text string")).first().share > 0.99
