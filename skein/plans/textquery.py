"""A query text turned into groups of alternatives: every group must match, by any of its alternatives."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass, field

import regex

_HAN = regex.compile(r"\p{Han}")
_TOKEN = regex.compile(r"\p{Han}|[[\p{L}\p{Nd}]--\p{Han}][[\p{L}\p{Nd}\p{M}_.\-]--\p{Han}]*", regex.V1)
#: Fixed value: what counts as a version in a query.
_VERSION = re.compile(r"\b1\.\d+(?:\.\d+)?\b")

#: Platforms and loaders whose mention raises records that name them.
LOADERS = ("fabric", "forge", "neoforge", "quilt", "paper", "spigot", "bukkit", "velocity", "bungeecord", "bedrock", "java")
#: What a mention adds to the text score.
VERSION_BOOST, LOADER_BOOST, SLASH_BOOST = 0.80, 0.65, 0.20


def tokenize(text: str) -> list[str]:
    """The tokens of a text; the same rule as functions.text.tokens."""
    return [t for t in (x.rstrip("._-") for x in _TOKEN.findall(text.strip().lower())) if t]


def normalize_text(text: str) -> str:
    """Lower case; letters, digits, marks and . - _ / stay, anything else is one blank."""
    keep = (c if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd" or c in ".-_/" else " " for c in text.strip().lower())
    return " ".join("".join(keep).split())


def distinct(values) -> list[str]:
    """Folded, blank ones dropped, first appearance kept."""
    return list(dict.fromkeys(v for v in (x.strip().lower() for x in values) if v))


def _joins(c: str) -> bool:
    """Whether a sign continues a word."""
    return not _HAN.match(c) and (unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd" or c in "_-.")


def tokenize_known(text: str, known) -> list[str]:
    """Like tokenize, but known words (the longest first) that stand free are one token; a Han edge is always free."""
    text, words = text.strip().lower(), sorted((w.strip() for w in known if w.strip()), key=lambda w: (-len(w), w))
    out, plain, i = [], 0, 0

    def free(word: str, at: int) -> bool:
        end = at + len(word)
        left = at == 0 or _HAN.match(word[0]) or not _joins(text[at - 1])
        return bool(left) and bool(end == len(text) or _HAN.match(word[-1]) or not _joins(text[end]))

    while i < len(text):
        word = next((w for w in words if text.startswith(w, i) and free(w, i)), None)
        if word:
            out, i = out + tokenize(text[plain:i]) + [word], i + len(word)
            plain = i
        else:
            m = _TOKEN.match(text, i)
            i = m.end() if m else i + 1
    return out + tokenize(text[plain:])


@dataclass(frozen=True)
class TextQuery:
    raw: str
    normalized: str
    terms: list[str]
    expanded: list[str]
    #: AND of groups, a group is an OR of alternatives, an alternative is an AND of tokens.
    groups: list[list[list[str]]]
    versions: list[str] = field(default_factory=list)
    loaders: list[str] = field(default_factory=list)

    def boosts(self) -> dict[str, float]:
        """Words whose literal mention in a record adds to the text score. A slash is noted but never scored."""
        return {**{v: VERSION_BOOST for v in self.versions}, **{x: LOADER_BOOST for x in self.loaders}}

    def rendered(self) -> str:
        """The groups as one line, for tests and explanations."""
        quote = lambda alt: " & ".join("'" + t.replace("\\", "\\\\").replace("'", "''") + "'" for t in alt)
        one = lambda g: quote(g[0]) if len(g) == 1 else "(" + " | ".join(f"({quote(a)})" if len(a) > 1 else quote(a) for a in g) + ")"
        return " & ".join(map(one, self.groups))


def parse(raw: str, synonyms: Mapping[str, list[str]]) -> TextQuery:
    """Terms of the text, each with its synonyms as alternatives; mentioned versions and loaders."""
    normal = normalize_text(raw)
    terms = distinct(tokenize_known(normal, synonyms))
    groups = [[alt for alt in [tokenize(t), *map(tokenize, synonyms.get(t, []))] if alt] for t in terms]
    groups = [g for g in groups if g]
    expanded = distinct(t for g in groups for alt in g for t in alt)
    return TextQuery(raw, normal, terms, expanded, groups, sorted(set(_VERSION.findall(normal))), sorted(set(expanded) & set(LOADERS)))
