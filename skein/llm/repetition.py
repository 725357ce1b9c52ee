"""The share of a text that repeats what the same text has said before."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters handled at once; a longer text is handled alone, and whole.
CHUNK = 1_000_000
#: Word runs that count as a repetition.
GRAMS = (3, 5, 8)
FEATURES = ("rep_3", "rep_5", "rep_8", "rep_changed", "dup_sentence", "dup_line", "dup_paragraph", "share")

_BREAK, _WORD, _SIGN, _SKIP, _LINE, _STOP, _BLANK = range(7)
_STOPS = ".!?;。！？；…؟।"
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: signs of scripts without spaces are units of their own, digits and punctuation break."""
    kind = np.full(0x110000, _WORD, np.uint8)
    for c in range(0x30000):
        g = unicodedata.category(chr(c))
        if g in ("Cf", "Cc") and chr(c) not in "\n\t\r\x0b\x0c\x85\x00":
            kind[c] = _SKIP
        elif g[0] not in "LM":
            kind[c] = _BREAK
    for a, z in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF), (0x30000, 0x323AF)):
        kind[a : z + 1][kind[a : z + 1] == _WORD] = _SIGN
    kind[[ord(c) for c in " \t\r 　"]] = _BLANK
    kind[[ord(c) for c in "\n  \x0b\x0c\x85"]] = _LINE
    kind[[ord(c) for c in _STOPS]] = _STOP
    kind[0] = _BREAK
    return kind


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order-dependent hash of each run of ``values``."""
    at = np.arange(len(values)) - np.repeat(starts, np.diff(starts, append=len(values)))
    power = (np.arange(4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(_ODD)
    with np.errstate(over="ignore"):
        return np.add.reduceat(_mix(values + np.uint64(1)) * (power[at & 4095] | np.uint64(1)), starts)


def _seen(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    k = keys[order]
    same[order[1:]] = k[1:] == k[:-1]
    return same


def repetition_features(texts: Sequence[str | None]) -> dict[str, np.ndarray]:
    """Per text: number of units (words; signs of Chinese, Japanese) and shares of units that repeat earlier ones.

    rep_n: within a run of n units that stood before in the text; rep_changed: the same for 5 units, single changed units
    between repeated ones included; dup_*: within a sentence, line or paragraph that stood before (compared by its units, so
    case, digits, punctuation, white space and invisible characters do not matter); share: units repeated in any of the ways
    rep_changed and dup_*. A text without units has all shares 0.
    """
    out = {f: np.zeros(len(texts)) for f in FEATURES} | {"units": np.zeros(len(texts), np.int64)}
    if not len(texts):
        return out
    kind = _classes()
    joined = "\0".join([(t or "").replace("\0", " ").lower() for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = kind[points]
    if (skip := cls == _SKIP).any():
        points, cls = points[~skip], cls[~skip]
    if not len(points):
        return out
    before = np.concatenate([[np.uint8(_BREAK)], cls[:-1]])
    starts_at = (cls == _SIGN) | ((cls == _WORD) & (before != _WORD))
    inside = (cls == _WORD) | (cls == _SIGN)
    starts = np.flatnonzero(starts_at)
    if not len(starts):
        return out
    doc = np.cumsum(points == 0)[starts].astype(np.uint64)
    end = points == 0
    line = np.cumsum((cls == _LINE) | end)[starts]
    sentence = np.cumsum((cls == _LINE) | (cls == _STOP) | end)[starts]
    dense = np.flatnonzero(cls != _BLANK)
    lines = cls[dense] == _LINE
    empty = np.zeros(len(points), bool)
    empty[dense[1:]] = lines[1:] & lines[:-1]
    paragraph = np.cumsum(empty | end)[starts]
    # hashes of the units
    chars = points[inside].astype(np.uint64)
    unit = _mix(_sums(chars, np.searchsorted(np.flatnonzero(inside), starts)))
    n = len(unit)
    size = np.bincount(doc.astype(np.int64), minlength=len(texts))
    out["units"][:] = size
    whole = np.maximum(size, 1)
    of_doc = _mix(doc + np.uint64(77))
    part = lambda cover: np.bincount(doc.astype(np.int64), weights=cover, minlength=len(texts)) / whole
    total = np.zeros(n, bool)
    for g in GRAMS:
        cover = np.zeros(n, bool)
        if n >= g:
            key = np.zeros(n - g + 1, np.uint64)
            for k in range(g):
                key = _mix(key * np.uint64(_ODD) + unit[k : n - g + 1 + k])
            here = doc[: n - g + 1] == doc[g - 1 :]
            key ^= of_doc[: n - g + 1]
            hit = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(here)
            at = at[_seen(key[at])]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + g, -1)
            cover = np.cumsum(hit)[:n] > 0
        out[f"rep_{g}"][:] = part(cover)
        if g == 5:
            bridge = cover.copy()
            if n > 2:
                bridge[1:-1] |= cover[:-2] & cover[2:] & (doc[:-2] == doc[2:])
            out["rep_changed"][:] = part(bridge)
            total |= bridge
    for name, ids in (("sentence", sentence), ("line", line), ("paragraph", paragraph)):
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        key = _mix(_sums(unit, first)) ^ of_doc[first]
        cover = np.repeat(_seen(key), np.diff(first, append=n))
        out[f"dup_{name}"][:] = part(cover)
        total |= cover
    out["share"][:] = part(total)
    return out


def chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges (lo, hi) of rows of at most CHUNK characters together; a longer text is a range of its own."""
    lo = 0
    while lo < len(sizes):
        hi, chars = lo + 1, sizes[lo]
        while hi < len(sizes) and chars + sizes[hi] <= CHUNK:
            chars += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def measure_repetition(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, units, FEATURES...) of every document, whole texts; see repetition_features.

    One pass without a shuffle, vectorised over chunks of texts. Null and empty texts have 0 units and shares of 0; ids may
    repeat or be null; other columns are not read.
    """
    from pyspark.sql import types as T

    rows = documents.select(F.col(id), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("units", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(lengths(b.column(1))):
                f = repetition_features(b.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(f["units"], pa.int64()), *[pa.array(f[x], pa.float64()) for x in FEATURES]], names=schema.names)

    return rows.mapInArrow(run, schema)


def lengths(texts: pa.Array) -> np.ndarray:
    """Characters of each text; 0 for null."""
    return np.nan_to_num(pc.utf8_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
