"""Pairs, frequencies, distinctive terms and fused ranks against brute force and odd inputs."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.cooccurrence import item_pairs
from skein.llm.distinctive import distinctive_terms, most_distinctive
from skein.llm.rank_fusion import first_per_group, fused_scores
from skein.llm.term_frequency import term_frequencies


def lists(spark, rows):
    return spark.createDataFrame([(i, r, "clash", i) for i, r in enumerate(rows)], "id int, terms array<string>, rec string, code int")


def zipf(n, seed=1, size=60):
    rng = random.Random(seed)
    return [[("hot" if rng.random() < 0.4 else f"t{int(rng.paretovariate(0.8)) % size}") for _ in range(rng.randrange(9))] for _ in range(n)]


ODD = [None, [], [None], ["a", "a", None], ["é", "世界", ""], ["x" * 3000, "a"], ["only"]]


@pytest.mark.parametrize("tile, least, most", [(1024, 1, 10**9), (3, 1, 10**9), (2, 3, 10**9), (3, 1, 5)])
def test_pairs_against_brute_force(spark, tile, least, most):
    rows = zipf(300) + ODD + [[f"long{i}" for i in range(40)]]
    sets = [set(x for x in r or [] if x is not None) for r in rows]
    held, both = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    got = {(r.item_a, r.item_b): r for r in item_pairs(lists(spark, rows), at_least=least, tile=tile, most_items=most).collect()}
    assert {k: r.n_ab for k, r in got.items()} == {k: n for k, n in both.items() if n >= least}
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n) == (held[a], held[b], len(rows)) and a < b
        c = [r.n_ab + 0.5, r.n_a - r.n_ab + 0.5, r.n_b - r.n_ab + 0.5, r.n - r.n_a - r.n_b + r.n_ab + 0.5]
        assert r.z == pytest.approx(math.log(c[0] * c[3] / c[1] / c[2]) / math.sqrt(sum(1 / x for x in c)))
        assert r.lift == pytest.approx(r.n_ab * r.n / r.n_a / r.n_b)


def test_pairs_of_nothing(spark):
    for rows in ([], ODD[:3], [["a"], ["b"]]):
        assert item_pairs(lists(spark, rows)).count() == 0


@pytest.mark.parametrize("part_rows", [4_000_000, 20])
def test_frequencies_against_brute_force(spark, part_rows):
    rows = zipf(400, 2, 400) + ODD
    uses = Counter(x for r in rows for x in r or [] if x is not None)
    held = Counter(x for r in rows for x in set(r or []) if x is not None)
    got = {r.term: r for r in term_frequencies(lists(spark, rows).repartition(9), "terms", part_rows=part_rows).collect()}
    assert {t: (r.n_records, r.n_occurrences) for t, r in got.items()} == {t: (held[t], uses[t]) for t in uses}
    assert {t: r.mark for t, r in got.items()} == {t: "common" if held[t] * 5 >= len(rows) else "rare" if held[t] <= 2 else None for t in uses}
    assert sum(1 for _ in got) == len(got)


def test_frequencies_of_nothing(spark):
    assert term_frequencies(lists(spark, []), "terms").count() == 0 and term_frequencies(lists(spark, [None, []]), "terms").count() == 0
    assert [tuple(r) for r in term_frequencies(lists(spark, [["a"], [], None, [], []]), "terms").collect()] == [("a", 1, 1, "common")]


def test_distinctive_against_brute_force(spark):
    rows = zipf(200, 3) + ODD
    sets = [set(x for x in r or [] if x is not None) for r in rows]
    held = Counter(x for s in sets for x in s)
    total = sum(held.values())
    got = {(r.id, r.term): r for r in distinctive_terms(lists(spark, rows), ["id"]).collect()}
    assert got.keys() == {(i, x) for i, s in enumerate(sets) for x in s}
    for (i, t), r in got.items():
        n, a = len(sets[i]), 0.01 * held[t]
        odds = math.log((1 + a) / (n + 0.01 * total - 1 - a)) - math.log((held[t] - 1 + a) / (total - n + 0.01 * total - held[t] + 1 - a))
        assert r.n_holders == held[t] and r.log_odds == pytest.approx(odds) and r.z == pytest.approx(odds / math.sqrt(1 / (1 + a) + 1 / (held[t] - 1 + a)))


def test_rare_shared_terms_win_and_ties_stay(spark):
    rows = [["hot", "rare", "twin", "lone", "mid"]] + [["hot", "rare", "twin"]] * 2 + [["hot", "mid"]] * 4 + [["hot"]] * 30
    best = most_distinctive(distinctive_terms(lists(spark, rows), ["id"]), ["id"], at_least=3, at_most=9)
    assert {(r.id, r.term) for r in best.collect()} == {(i, t) for i in range(3) for t in ("rare", "twin")} | {(i, "mid") for i in range(3, 7)}
    assert distinctive_terms(lists(spark, []), ["id"]).count() == 0 and distinctive_terms(lists(spark, [["a"]]), ["id"]).first().z == 0.0


SCORES = {"a": 1, "b": 1, "c": -1, "d": 1}


def scored(spark, rows):
    return spark.createDataFrame(rows, "who string, id string, a double, b int, c double, d bigint, _row string, cell int")


def test_fused_ranks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 300
    base = rng.normal(size=n)
    a, b, c, d = np.exp(3 * base + rng.normal(size=n)), np.maximum(0, (base * 3 + rng.normal(size=n)).astype(int)), -base * 5 + rng.normal(size=n), (base * 1e15 + rng.normal(size=n) * 1e15).astype(int)
    rows = [("g", f"r{i:03}", float(a[i]) if i % 7 else None, int(b[i]), float("nan") if i % 11 == 0 else float(c[i]), int(d[i]), "x", 1) for i in range(n)]
    out, loadings = fused_scores(scored(spark, rows), SCORES, ["who", "id"])
    got = {r.id: r.fused for r in out.collect()}
    low = -np.inf
    cols = np.array([[r[2] if r[2] is not None else low, r[3], low if math.isnan(r[4]) else -r[4], r[5]] for r in rows], float)
    ranks = np.array([[(col < x).sum() + ((col == x).sum() + 1) / 2 for x in col] for col in cols.T]).T
    z = (ranks - ranks.mean(0)) / ranks.std(0)
    w = np.abs(np.linalg.eigh(np.corrcoef(z.T))[1][:, -1])
    want = z @ w
    assert sorted(got, key=got.get) == [rows[i][1] for i in np.argsort(want, kind="stable")] or np.allclose([got[r[1]] for r in rows], want * 1.0, atol=1e-9)
    assert np.allclose([abs(loadings[s]) for s in SCORES], w) and loadings["c"] < 0 < loadings["a"]


def test_fused_ranks_of_odd_tables(spark):
    one = [("g", "x", 1.0, 1, 1.0, 1, "", 0)]
    for rows in ([], one, one * 5):
        out, loadings = fused_scores(scored(spark, rows), SCORES, ["who", "id"])
        assert [r.fused for r in out.collect()] == [0.0] * len(rows) and [abs(v) for v in loadings.values()] == [0.5] * 4
    flat = [("g", f"{i}", float(i), 0, None, 0, "", 0) for i in range(6)] + [(None, "n", 99.0, 0, None, 0, "", 0)]
    out, loadings = fused_scores(scored(spark, flat), SCORES, ["who", "id"])
    assert loadings == {"a": 1.0, "b": 0.0, "c": -0.0, "d": 0.0}
    assert [tuple(r) for r in first_per_group(out, "who", ["id"], at_least=6).collect()] == [("g", "5")]
    assert first_per_group(out, "who", ["id"], at_least=7).count() == 0
    ties = scored(spark, [("g", i, 1.0, 1, 1.0, 1, "", 0) for i in "cab"])
    assert first_per_group(fused_scores(ties, SCORES, ["who", "id"])[0], "who", ["id"], at_least=1).first().id == "a"
    assert F is not None
