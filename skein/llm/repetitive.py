"""Which documents mostly repeat themselves: a decision list over repetition features."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.decision_list import DecisionList, learn
from skein.llm.repetition import FEATURES, chunks, lengths, repetition_features
from skein.session import materialize

#: A document of so many thousand characters, and any longer one, is so many times as likely to be drawn as a short one.
MOST_WEIGHT = 16.0
#: From which share of repeated content on a text is repetitive.
REPEATED = 0.4

#: Sentences and lines with what ends them.
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？\n]*\s*")
_UNIT = re.compile("[぀-ヿ㐀-鿿豈-﫿]|[^\\W\\d_぀-ヿ㐀-鿿豈-﫿]+")


def _units(text: str) -> int:
    return len(_UNIT.findall(text))


def _blurred(piece: str, rng: random.Random) -> str:
    """A copy with other case, digits, white space, punctuation or one changed word."""
    way = rng.randrange(6)
    if way == 0:
        return piece.upper()
    if way == 1:
        return re.sub(r"\d", lambda m: str(rng.randrange(10)), piece)
    if way == 2:
        return piece.replace(" ", "  ")
    if way == 3:
        return re.sub(r"[,.!?，。！？]+(?=\s|$)", lambda m: rng.choice([" !", "...", "?!"]), piece)
    if way == 4:
        found = list(_UNIT.finditer(piece))
        if len(found) > 8:
            m = rng.choice(found)
            return piece[: m.start()] + ("另" if len(m[0]) == 1 and ord(m[0]) > 0x3000 else "otherwise") + piece[m.end() :]
    return piece


def labelled_examples(texts: Sequence[str], *, repeated: float = 0.4, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, true share) of texts built from ``texts`` with a known share of repeated content.

    Each text is cut into sentences and freed of repeated ones; then copies of phrases, sentences, lines or paragraphs,
    some blurred, are put in behind until they make up a wanted share: none, less than ``repeated``, about it, more. What
    phrases the text repeats by nature counts as its own. Label: share >= ``repeated``; shares within 0.02 of it are not used.
    """
    rng, made, shares = random.Random(seed), [], []
    for text in texts:
        seen, pieces = set(), []
        for m in _SENTENCE.finditer(text or ""):
            key = tuple(u.lower() for u in _UNIT.findall(m[0]))
            if key and key not in seen:
                seen.add(key)
                pieces.append(m[0])
        size = sum(map(_units, pieces))
        if size < 20:
            continue
        for share in (0.0, rng.uniform(0.05, repeated), rng.uniform(repeated - 0.15, repeated + 0.15), rng.uniform(repeated + 0.1, 0.9)):
            copies, extra = [], 0
            way = rng.randrange(4)
            while extra < size * share / (1 - share):
                if way == 0:  # one phrase again and again
                    words = _UNIT.findall(pieces[0])[: rng.randint(2, 6)]
                    piece = (" " if ord(words[0][0]) < 0x3000 else "").join(words) + " "
                elif way == 1:
                    piece = _blurred(rng.choice(pieces), rng)
                elif way == 2:
                    piece = "\n" + _blurred(rng.choice(pieces), rng).strip() + "\n"
                else:
                    k = rng.randrange(len(pieces))
                    piece = "\n\n" + "".join(_blurred(x, rng) for x in pieces[k : k + 4])
                copies.append(piece)
                extra += max(1, _units(piece))
            share = extra / (size + extra)
            if abs(share - repeated) < 0.02:
                continue
            made.append("".join(pieces) + " " + "".join(copies))
            shares.append(share)
    f = repetition_features(made)
    x = np.column_stack([f[n] for n in FEATURES]) if made else np.zeros((0, len(FEATURES)))
    return x, np.array(shares) >= repeated, np.array(shares)


def _example_rows(text: str) -> list[list[float]]:
    """Features and true share of the examples that are made of a text."""
    x, _, shares = labelled_examples([text], repeated=REPEATED, seed=zlib.crc32(text.encode("utf-8", "surrogatepass")))
    return np.column_stack([x, shares]).tolist() if len(x) else []


def _measured(documents: DataFrame, id: str, text: str, sample: int) -> DataFrame:
    """(id, units, FEATURES..., _held, _lot, _examples), written once. Texts are read once: a drawn document gives its
    examples in the same pass, as numbers."""
    from pyspark.sql import types as T

    n = documents.count()
    # of weighted lots the lowest are a sample in which a document's chance grows with its weight
    heavy = F.greatest(F.lit(1.0), F.least(F.lit(MOST_WEIGHT), F.length(F.col(text).cast("string")) / 1000))
    lot = -F.log((F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))) / heavy
    drawn = lot <= 0.75 * sample / max(n, 1)  # weights are at least 1, and well above it on average
    held = F.pmod(F.xxhash64(F.col(id).cast("string"), F.lit("held")), F.lit(3)) == 0
    rows = documents.select(F.col(id), F.col(text).cast("string").alias("_text"), held.alias("_held"), (F.when(drawn, lot) if n > sample else lot).alias("_lot"))
    schema = T.StructType([rows.schema[0], T.StructField("units", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES], rows.schema["_held"], rows.schema["_lot"], T.StructField("_examples", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = 2 * sample  # documents of one id, or copies of it, lie in one lot: no task makes more examples than are used
        for b in batches:
            for lo, hi in chunks(lengths(b.column(1))):
                part = b.slice(lo, hi - lo)
                texts = part.column(1).to_pylist()
                f = repetition_features(texts)
                examples = []
                for t, lot in zip(texts, part.column(3).to_pylist()):
                    use = lot is not None and bool(t) and left > 0
                    left -= use
                    examples.append(_example_rows(t) if use else None)
                measured = [pa.array(f[x], pa.float64()) for x in FEATURES]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f["units"], pa.int64()), *measured, part.column(2), part.column(3), pa.array(examples, pa.list_(pa.list_(pa.float64())))], names=schema.names)

    return materialize(rows.mapInArrow(run, schema), "repetition")


@dataclass
class Repetitive:
    """rows: every document with its features and ``repetitive``; rules: the list that decides; report: what the rules do on
    held-out examples, per length."""

    rows: DataFrame
    rules: DecisionList
    report: DataFrame


def repetitive_documents(documents: DataFrame, id: str = "doc_id", text: str = "text", *, sample: int = 400, seed: int = 1) -> Repetitive:
    """All documents with their features and ``repetitive``, the list that decides it, and its figures.

    Method: learned decision list. Labelled statistics come from texts with a known share of repeats, built from a bounded
    sample (about ``sample`` documents, and no more, by weighted hashes of their ids, so that long ones are among them; four texts each; a third
    of the documents is held out; each power of ten of lengths counts alike); sequential covering grows and prunes
    conjunctions of thresholds on the rest, of the kind that more repetition never speaks against; the list becomes one ordered CASE expression over
    the features, which are measured on every whole text. Documents are read once and not shuffled; of the sample
    only features reach the driver.

    report: (units_from, examples, repetitive, found, wrong, recall, precision) of the held-out examples, by the power of ten
    of the units of the documents they are made of.

    Defined cases: null, empty or unit-less texts are not repetitive; no usable sample gives an empty list (none is);
    documents of one id are drawn together, of which the sample takes as many as there is room for.
    """
    measured = _measured(documents, id, text, sample)
    drawn = measured.where(F.col("_examples").isNotNull()).select("_lot", "_held", "units", "_examples").orderBy("_lot", "units").limit(sample).collect()
    table = np.array([[*e, float(r["_held"]), r["units"]] for r in drawn for e in r["_examples"]], float).reshape(-1, len(FEATURES) + 3)
    x, y, held, units = table[:, : len(FEATURES)], table[:, -3] >= REPEATED, table[:, -2] > 0, table[:, -1]
    size, told = np.floor(np.log10(np.maximum(units, 1))).astype(int), []
    weight = 1 / np.maximum(np.bincount(size[~held]), 1)[size] if (~held).any() and size[~held].max() == size.max() else np.ones(len(x))
    rules = learn(x[~held], y[~held], FEATURES, weight=weight[~held], seed=seed, upward=True)
    said = rules.predict(x, list(FEATURES)) if len(x) else np.zeros(0, bool)
    for k in np.unique(size[held]):
        at = held & (size == k)
        n, found, wrong = int((y & at).sum()), int((y & said & at).sum()), int((~y & said & at).sum())
        told.append((10 ** int(k), int(at.sum()), n, found, wrong, found / n if n else None, found / (found + wrong) if found + wrong else None))
    report = documents.sparkSession.createDataFrame(told, "units_from bigint, examples bigint, repetitive bigint, found bigint, wrong bigint, recall double, precision double")
    return Repetitive(measured.drop("_held", "_lot", "_examples").withColumn("repetitive", rules.column()), rules, report)
