"""Ordered lists of threshold rules learned from labelled rows, as Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v >= self.value if self.above else v < self.value

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.value if self.above else c < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:.4g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules (conjunctions) in order; the first that holds says yes, none says no."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self) -> Column:
        """CASE WHEN rule 1 THEN true ... ELSE false; a null feature makes its rule fail."""
        out = None
        for rule in self.rules:
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, True) if out is None else out.when(test, True)
        return F.lit(False) if out is None else out.otherwise(False)

    def predict(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        yes = np.zeros(len(x), bool)
        for rule in self.rules:
            yes |= np.logical_and.reduce([c.holds(x, names) for c in rule])
        return yes

    def __str__(self) -> str:
        return "\n".join(f"{i + 1}. if " + " and ".join(map(str, r)) for i, r in enumerate(self.rules))


def _best_cut(v: np.ndarray, p: np.ndarray, n: np.ndarray, base: float, upward: bool) -> tuple[float, float, bool]:
    """(gain, cut, above) of the best threshold of one feature; every middle between neighbouring values is tried.
    p, n: weights of the rows as positive and negative ones."""
    order = np.argsort(v, kind="stable")
    v, p, n = v[order], p[order], n[order]
    at = np.flatnonzero(v[1:] > v[:-1])
    if not len(at):
        return 0.0, 0.0, True
    below_p, below_n = np.cumsum(p)[at], np.cumsum(n)[at]

    def gain(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        some = p > 1e-9
        return np.where(some, p * (np.log2(np.where(some, p, 1) / np.where(some, p + np.maximum(n, 0), 1)) - base), -np.inf)

    up = gain(p.sum() - below_p, n.sum() - below_n)
    down = np.full(len(at), -np.inf) if upward else gain(below_p, below_n)
    k = int(np.argmax(np.maximum(up, down)))
    return float(max(up[k], down[k])), float((v[at[k]] + v[at[k] + 1]) / 2), bool(up[k] >= down[k])


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, names: Sequence[str], upward: bool) -> tuple[Condition, ...]:
    """Adds the condition of the highest information gain until no negative row is left."""
    rule: tuple[Condition, ...] = ()
    live = np.ones(len(x), bool)
    while (live & ~y).any() and (live & y).any():
        p, n = np.where(y, w, 0)[live], np.where(y, 0, w)[live]
        if not p.sum():
            break
        base = np.log2(p.sum() / (p.sum() + n.sum()))
        found = [(*_best_cut(x[live, i], p, n, base, upward), f) for i, f in enumerate(names)]
        gain, cut, above, feature = max(found, key=lambda t: t[0])
        if gain <= 1e-9:
            break
        rule += (Condition(feature, above, cut),)
        live &= rule[-1].holds(x, names)
    return rule


def _hits(rule: tuple[Condition, ...], x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x, names) for c in rule])


def _prune(rule: tuple[Condition, ...], x: np.ndarray, y: np.ndarray, w: np.ndarray, names: Sequence[str]) -> tuple[Condition, ...]:
    """Drops last conditions as long as (p - n) / (p + n) on held-out rows does not fall."""

    def worth(r: tuple[Condition, ...]) -> float:
        hit = _hits(r, x, names)
        p, n = w[hit & y].sum(), w[hit & ~y].sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def _prune_list(rules: list[tuple[Condition, ...]], x: np.ndarray, y: np.ndarray, w: np.ndarray, names: Sequence[str]) -> list[tuple[Condition, ...]]:
    """Drops whole rules, last ones first, and single conditions as long as the list makes no more errors on ``x``."""
    errors = lambda rs: float(w[DecisionList(tuple(rs)).predict(x, names) != y].sum())
    least, moved = errors(rules), True
    while moved:
        moved = False
        shorter = [rules[:i] + rules[i + 1 :] for i in reversed(range(len(rules)))]
        shorter += [[*rules[:i], r[:j] + r[j + 1 :], *rules[i + 1 :]] for i, r in enumerate(rules) for j in range(len(r)) if len(r) > 1]
        for rs in shorter:
            if (e := errors(rs)) <= least + 1e-9:
                rules, least, moved = rs, e, True
                break
    return rules


def learn(x: np.ndarray, y: np.ndarray, names: Sequence[str], *, weight: np.ndarray | None = None, seed: int = 1, upward: bool = False) -> DecisionList:
    """Sequential covering with incremental reduced-error pruning (Fuernkranz and Widmer 1994), and pruning of the list.

    One split for all rules: two thirds of the rows grow the rules, one third prunes them. A rule's rows leave and the next
    is grown, until no positive row is left or a rule is wrong on most held-out rows it covers; each rule takes rows away, so
    there are at most as many as positive rows. Last, rules and conditions without which the held-out rows are decided
    as well are dropped from the whole list. ``upward``: only conditions of the kind feature >= cut, for features
    of which more can never mean less. ``weight``: what a row counts (1). Without positive rows the list is empty (always no).
    """
    rng = np.random.default_rng(seed)
    names, y, rules = list(names), y.astype(bool), []
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    grow = rng.random(len(y)) < 2 / 3
    if not (grow & y).any():
        grow[:] = True
    held, live = ~grow if (~grow & y).any() else grow, np.ones(len(y), bool)
    while (live & grow & y).any():
        at = live & grow
        rule = _grow(x[at], y[at], w[at], names, upward)
        if not rule:
            break
        at = live & held
        rule = _prune(rule, x[at], y[at], w[at], names)
        hit = live & _hits(rule, x, names)
        if w[hit & y & held].sum() <= w[hit & ~y & held].sum() or not (hit & y & grow).any():
            break
        rules.append(rule)
        live &= ~hit
    return DecisionList(tuple(_prune_list(rules, x[held], y[held], w[held], names)))
