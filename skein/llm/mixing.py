"""Records of several sources drawn in wanted shares of the total size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.terms import folded
from skein.llm.tokens import VOCABULARY, encoder
from skein.session import materialize

#: Token ids are hashed into so many features for the classifier.
WIDTH = 1024
#: One in so many sampled documents is held out to measure the classifier.
HELD_OUT = 5


def source_key(c: Column | str) -> Column:
    """Lower case, no outer blanks, one hyphen for any signs between two words; blank is null."""
    x = F.regexp_replace(folded(c), r"[\s_\-]+", "-")
    return F.when(F.length(x) > 0, x)


@dataclass
class Mix:
    """rates: (id, source, n_tokens, rate, repeats) of every document; report: one row per wanted source; accuracy: the
    classifier on held-out documents, per wanted source."""

    rates: DataFrame
    report: DataFrame
    accuracy: DataFrame


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    vocabulary: str = VOCABULARY,
    sample: int = 4000,
    iterations: int = 12,
) -> Mix:
    """How often to take each document so that every source has its share of the tokens.

    Method: soft-membership mixing. A document of a wanted source belongs to it; for all others (no source, or one that is
    not wanted) a softmax classifier on hashed token counts, fitted on about ``sample`` documents with a source, as many
    from each source as it has up to an equal part, gives the posterior of each wanted source. Rates between 0 and the
    source's ``max_repeats`` (for soft members the posterior mean of it) are fitted by projected gradient on
        1/2 sum over sources (expected tokens - target_share * total)^2,
    scaled by each source's size, where total is the size of all wanted sources. First the sources' own documents alone:
    all documents of a source have the same gradient, so a source is one number, and no source moves another, so the first
    step is the exact fit, goal / size up to the cap, and further ones would change nothing. A source is ``short`` if this
    rate has run into the cap and the tokens at it lie below the goal, however little. Then the soft members join in, which
    changes the rates but not ``short``, as that is about a source's own documents; one aggregation per iteration sends one
    number per source to the driver. ``repeats`` is the rate rounded up or down by a hash of the id.

    report: source (as spelt in ``targets``), target_share, max_repeats, n_documents, size (tokens of its own documents),
    capacity = size * max_repeats, wanted = target_share * total, expected (with soft members), drawn (tokens of its own
    documents times repeats), drawn_soft (those of soft members times repeats, by their posterior), actual_share (of both
    in all drawn tokens: the shares add up to 1 unless nothing is drawn; where sources are short the others' shares
    exceed their targets by what these lack), met_share (of both in total: never much above the target), short.
    accuracy: source, held_out (sampled documents, one in HELD_OUT, that the classifier has not seen), right, and
    confidence, the mean posterior of the true source.

    Defined cases: a source without documents has size 0; null and empty texts have size 0; null or doubled rows of
    ``targets`` are an error; without documents all sizes are 0 and nothing is short; ids may repeat.
    """
    wanted = targets.select("source", source_key("source").alias("key"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("double").alias("cap")).orderBy("key").collect()
    keys = [r.key for r in wanted]
    if None in keys or len(set(keys)) < len(keys):
        raise ValueError("targets must name each source once")
    k, shares, caps = len(keys), np.array([r.share for r in wanted], float), np.array([r.cap for r in wanted], float)
    class_of = F.create_map(*[F.lit(x) for i, s in enumerate(keys) for x in (s, i)]) if k else F.lit(None)
    named = documents.select(F.col(id).alias("id"), source_key(source).alias("source"), F.col(text).cast("string").alias("text"))
    named = named.select("id", "source", (F.element_at(class_of, F.col("source")) if k else F.lit(None).cast("int")).alias("class"), "text")
    n_own = {r.s: r.n for r in documents.select(source_key(source).alias("s")).where(F.col("s").isin(keys)).groupBy("s").agg(F.count("*").alias("n")).collect()} if k else {}  # a row per wanted source
    share_of = [min(1.0, sample / k / n_own[s]) if s in n_own else 0.0 for s in keys]
    bound = F.element_at(F.array(*[F.lit(int(x * (1 << 53))) for x in share_of]), F.col("class") + 1) if k else F.lit(0)
    lot = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 53)) < bound
    fields = "class int, n_tokens bigint, features array<int>, times array<int>"
    sized = materialize(named.select("id", "source", "class", "text", (F.col("class").isNull() | lot).alias("need")).mapInArrow(_sizes(vocabulary), _with_id(named, fields)), "sizes")

    by_class = {r["class"]: (r.t, r.n) for r in sized.where(F.col("class").isNotNull()).groupBy("class").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    size = np.array([by_class.get(i, (0, 0))[0] or 0 for i in range(k)], float)
    total = size.sum()
    goal = shares * total

    own = _step(np.zeros(k), -goal, size, caps)  # rates of the sources' own documents
    short = (own >= caps) & (size * own < goal)

    held = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("held")), F.lit(HELD_OUT)) == 0
    drawn = sized.where(F.col("class").isNotNull() & F.col("features").isNotNull()).select("class", "features", "times", held.alias("held")).limit(2 * sample).collect()
    weights = _fit_softmax([r for r in drawn if not r["held"]], k)
    accuracy = documents.sparkSession.createDataFrame(_accuracy([r for r in drawn if r["held"]], weights, [r.source for r in wanted]), "source string, held_out bigint, right bigint, confidence double")
    soft = materialize(sized.where(F.col("class").isNull()).mapInArrow(_posteriors(weights), _with_id(named, "n_tokens bigint, posterior array<double>")), "soft")
    soft_size = _sums(soft, F.lit(1.0), k)
    scale = size + soft_size
    errors: list[list[float]] = []
    rate = own.copy()
    for _ in range(iterations if soft_size.sum() > 0 else 0):
        got = size * rate + _sums(soft, _soft_rate(own, caps, errors), k)
        error = np.divide(got - goal, scale, out=np.zeros(k), where=scale > 0)
        if np.abs(got - goal)[~short].max(initial=0) <= 1e-4 * max(total, 1):
            break
        errors.append(error.tolist())
        rate = np.clip(rate - error, 0, caps)
    expected = size * rate + (_sums(soft, _soft_rate(own, caps, errors), k) if k else 0)

    u = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("repeat")), F.lit(1_000_000)) / 1_000_000
    hard_rate = F.element_at(F.array(*[F.lit(float(r)) for r in rate]), F.col("class") + 1) if k else F.lit(0.0)
    rows = sized.where(F.col("class").isNotNull()).select("id", "source", "n_tokens", hard_rate.alias("rate"))
    rows = rows.unionByName(soft.select("id", F.lit(None).cast("string").alias("source"), "n_tokens", _soft_rate(own, caps, errors).alias("rate")))
    rates = rows.select(F.col("id").alias(id), "source", "n_tokens", "rate", F.floor(F.col("rate") + u).alias("repeats"))
    taken = {r.source: r.t or 0 for r in rates.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect()}  # one row per wanted source
    all_taken = max(1, sum(taken.values()))
    soft_taken = _sums(soft, F.floor(_soft_rate(own, caps, errors) + u), k)
    soft_taken *= taken.get(None, 0) / (soft_taken.sum() or 1.0)  # posteriors are of single precision
    report = documents.sparkSession.createDataFrame(
        [
            (r.source, r.share, int(r.cap), int(by_class.get(i, (0, 0))[1]), int(size[i]), int(size[i] * r.cap), float(goal[i]), float(expected[i]), int(taken.get(r.key, 0)), float(soft_taken[i]), float(taken.get(r.key, 0) + soft_taken[i]) / all_taken, float((taken.get(r.key, 0) + soft_taken[i]) / max(1.0, total)), bool(short[i]))
            for i, r in enumerate(wanted)
        ],
        "source string, target_share double, max_repeats int, n_documents bigint, size bigint, capacity bigint, wanted double, expected double, drawn bigint, drawn_soft double, actual_share double, met_share double, short boolean",
    )
    return Mix(rates, report, accuracy)


def _step(rate: np.ndarray, gradient: np.ndarray, scale: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """A gradient step in units of each source's size, projected onto [0, cap]."""
    return np.clip(rate - np.divide(gradient, scale, out=np.full(len(rate), -np.inf), where=scale > 0), 0, caps)


def _with_id(named: DataFrame, more: str):
    from pyspark.sql import types as T

    own = [named.schema["id"], named.schema["source"]] if more.startswith("class") else [named.schema["id"]]
    return T.StructType([*own, *T.StructType.fromDDL(more).fields])


def _sizes(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            sizes, features, times = [], [], []
            for x, need in zip(b.column("text"), b.column("need").to_pylist()):
                ids = encode(x.as_py()) if x.is_valid else []
                sizes.append(len(ids))
                at, n = np.unique(np.asarray(ids, np.int64) * 2654435761 % 4294967296 % WIDTH, return_counts=True) if need else (None, None)
                features.append(at if at is None else at.astype(np.int32))
                times.append(n if n is None else n.astype(np.int32))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (features, times)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), b.column("class"), pa.array(sizes, pa.int64()), *lists], names=["id", "source", "class", "n_tokens", "features", "times"])

    return run


def _bags(features: list, times: list) -> np.ndarray:
    """Square roots of the shares of the hashed tokens, and a 1; at most WIDTH numbers stand for a text of any length."""
    x = np.zeros((len(features), WIDTH + 1), np.float32)
    for i, (f, n) in enumerate(zip(features, times)):
        if f is not None and len(f):
            x[i, np.asarray(f)] = np.sqrt(np.asarray(n) / np.sum(n))
    x[:, WIDTH] = 1
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit_softmax(rows: list, k: int, *, epochs: int = 12, batch: int = 128, rate: float = 0.3, decay: float = 1e-5, seed: int = 1) -> np.ndarray:
    """Weights of a softmax classifier, by adaptive gradient steps over small batches of the sample."""
    w = np.zeros((WIDTH + 1, max(k, 1)), np.float32)
    if not rows or not k:
        return w
    x, y = _bags([r["features"] for r in rows], [r["times"] for r in rows]), np.zeros((len(rows), k), np.float32)
    y[np.arange(len(rows)), [r["class"] for r in rows]] = 1
    rng, squares = np.random.default_rng(seed), np.full_like(w, 1e-6)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(rows)), -(-len(rows) // batch)):
            g = x[at].T @ (_softmax(x[at] @ w) - y[at]) / len(at) + decay * w
            squares += g * g
            w -= rate * g / np.sqrt(squares)
    return w


def _accuracy(rows: list, weights: np.ndarray, sources: list[str]) -> list[tuple]:
    """(source, documents, those given to it, mean posterior of it) per source."""
    if not rows:
        return [(s, 0, 0, None) for s in sources]
    p, y = _softmax(_bags([r["features"] for r in rows], [r["times"] for r in rows]) @ weights), np.array([r["class"] for r in rows])
    own = [(y == i, s) for i, s in enumerate(sources)]
    return [(s, int(at.sum()), int((p[at].argmax(axis=1) == i).sum()), float(p[at, i].mean()) if at.any() else None) for i, (at, s) in enumerate(own)]


def _posteriors(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            features, times = b.column("features").to_pylist(), b.column("times").to_pylist()
            for lo in range(0, b.num_rows, 1024):
                out += list(_softmax(_bags(features[lo : lo + 1024], times[lo : lo + 1024]) @ weights).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_tokens"), pa.array(out, pa.list_(pa.float64()))], names=["id", "n_tokens", "posterior"])

    return run


def _soft_rate(own: np.ndarray, caps: np.ndarray, errors: list[list[float]]) -> Column:
    """Rate of a soft member after the steps so far: from the posterior mean of the sources' rates, projected each time."""
    dot = lambda v: " + ".join(f"posterior[{i}] * {float(x)!r}D" for i, x in enumerate(v)) or "0D"
    steps = ", ".join(map(dot, errors))
    return F.expr(f"aggregate(CAST(array({steps}) AS ARRAY<DOUBLE>), {dot(own)}, (r, e) -> greatest(0D, least({dot(caps)}, r - e)))")


def _sums(soft: DataFrame, rate: Column, k: int) -> np.ndarray:
    """Expected tokens of each source that the soft members give at ``rate``."""
    if not k:
        return np.zeros(0)
    mass = soft.select((F.col("n_tokens") * rate).alias("m"), "posterior")
    return np.array([x or 0.0 for x in mass.agg(*[F.expr(f"sum(m * posterior[{i}])") for i in range(k)]).first()])
