"""Toxicity severity by cumulative-link (proportional odds) ordinal regression over sparse text features.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector serves all ordered thresholds. x holds hashed binary
features: each distinct word (white-space word in lower case without marks at its ends) and its prefixes, so that
inflected forms share evidence. Weights carry an L1 penalty, so only features with real evidence keep a weight.

Grades: the labels give toxic 0 or 1. Grade 0 is "not toxic"; toxic documents get grade 1 to 3 by the terciles of how
many different words with strong evidence they hold.

The model is fitted on the driver on a bounded sample of labelled documents (``most_rows``, chosen by hash of the id);
every document is scored whole. The table that goes to the workers holds at most ``most_features`` weights.

Defined results: null and empty texts have no features; long texts are read whole; rows repeated keep one result each;
labels that are null are left out and a document with several labels has the largest; without labelled rows, or without
toxic ones, every severity is 0 and nothing is toxic; empty tables give no rows; other columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import slices

BITS = 20
PREFIXES = (5, 6, 7)
MOST_ROWS = 8_000
MOST_FEATURES = 4_096
LEAST_DOCS = 4
STRONG = 2.5
GRADES = 4
MARKS = ".,;:!?\"'()[]{}<>*%&$#|-_~`^=+/\\"


def features_of_word(word: bytes) -> tuple[int, ...]:
    w = word.decode("utf-8", "replace").lower().strip(MARKS)
    if not w:
        return ()
    keys = ["w" + w, *(f"{n}{w[:n]}" for n in PREFIXES if len(w) >= n)]
    return tuple(xxhash.xxh32_intdigest(k) & ((1 << BITS) - 1) for k in keys)


def _features(words: set[bytes], cache: common.Cache) -> set[int]:
    return set().union(*map(cache.__getitem__, words)) if words else set()


@dataclass(frozen=True)
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def above(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1 ...; zeros without a model."""
        if not self.thresholds:
            return np.zeros(GRADES - 1)
        return 1.0 / (1.0 + np.exp(np.clip(np.asarray(self.thresholds) - score, -700, 700)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, grades: int = GRADES, l1: float = 2e-5, steps: int = 400, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of binary sparse x (row, column of each 1) by proximal Adam on the mean log likelihood."""
    n = len(y)
    w, start = np.zeros(width), np.log((np.arange(1, grades)[:, None] > y[None, :]).mean(axis=1).clip(1e-4, 1 - 1e-4))
    share = np.exp(start)
    first = np.log(share[0] / (1 - share[0]))
    logit = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(logit), 1e-2))
    p = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(n)
    for step in range(1, steps + 1):
        w = p[:width]
        theta = np.concatenate([[-np.inf], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))]), [np.inf]])
        s = np.bincount(rows, weights=w[cols], minlength=n)
        z = np.clip(theta[None, :] - s[:, None], -40, 40)
        c = 1 / (1 + np.exp(-z))
        c[:, 0], c[:, -1] = 0.0, 1.0
        d = c * (1 - c)
        prob = np.maximum(c[at, y + 1] - c[at, y], 1e-12)
        ds = (d[at, y + 1] - d[at, y]) / prob / n  # derivative of -log prob by s
        dtheta = np.zeros(grades + 1)
        np.add.at(dtheta, y + 1, -d[at, y + 1] / prob / n)
        np.add.at(dtheta, y, d[at, y] / prob / n)
        inner = dtheta[1:-1]
        tail = np.cumsum(inner[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, weights=ds[rows], minlength=width), [tail[0]], tail[1:] * np.exp(p[width + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        scale = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p = p - scale * m / (1 - 0.9**step)
        p[:width] = np.sign(p[:width]) * np.maximum(np.abs(p[:width]) - np.minimum(scale[:width] * l1, rate), 0)
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])


def fit_features(lists: list[np.ndarray], toxic: np.ndarray, most_features: int = MOST_FEATURES) -> Model:
    """Model of documents given as arrays of distinct features."""
    if not len(lists) or not toxic.any() or toxic.all():
        return Model()
    size = 1 << BITS
    bad, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for x, t in zip(lists, toxic.tolist(), strict=True):
        (bad if t else good)[x] += 1  # the features of a document are distinct
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    seen = bad + good
    expected = seen * n_bad / (n_bad + n_good)
    chi = np.where(seen >= LEAST_DOCS, (bad - expected) ** 2 / np.maximum(expected, 1e-9), 0)
    # Kept: clear evidence for toxicity. What speaks against it is the threshold, so no document is cleared by length.
    candidates = np.flatnonzero((chi > 10.83) & (odds > 1.0))
    chosen = candidates[np.argsort(-chi[candidates], kind="stable")[:most_features]]
    if not len(chosen):
        return Model()
    index = np.full(size, -1)
    index[chosen] = np.arange(len(chosen))
    strong = odds > STRONG
    count = np.asarray([int((strong[x] & (index[x] >= 0)).sum()) for x in lists])
    cuts = np.quantile(count[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    y = np.where(toxic, 1 + (count[:, None] > cuts[None, :]).sum(axis=1), 0)
    kept = [i[i >= 0] for i in (index[x] for x in lists)]
    rows, cols = np.repeat(np.arange(len(lists)), [len(i) for i in kept]), np.concatenate(kept)
    w, theta = fit_ordinal(rows, cols, y, len(chosen))
    return Model({int(f): float(x) for f, x in zip(chosen, w, strict=True) if x}, tuple(map(float, theta)))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES) -> Model:
    """Model from at most about ``most_rows`` labelled documents."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    count = known.count()
    if count > most_rows:
        limit = int(most_rows / count * (1 << 30))
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < limit)

    def run(batches):
        common.kept("nothing", dict)
        cache = common.Cache(features_of_word, 200_000)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                cache.trim()
                out = [np.fromiter(_features(set(common.words_of(t)), cache), np.uint32).tobytes() for t in batch.column(0).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(out, pa.binary())], names=["toxic", "features"])

    # The sample is bounded, so it may be broadcast to the scan.
    sample = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), "id").select("text", "toxic")
    got = common.arrow(sample, run, "toxic boolean, features binary").toArrow()
    lists = [np.frombuffer(x.as_buffer(), np.uint32) for x in got.column("features")]
    model = fit_features(lists, np.asarray(got.column("toxic").to_pylist(), bool), most_features)
    del got, lists
    common.settle()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """(id, expected_severity, grade, toxic): grade is the most probable one, toxic is P(grade >= 1) >= ``reject``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        common.kept("nothing", dict)
        weights = model.weights

        def heavy(word):
            return tuple(f for f in features_of_word(word) if f in weights)

        cache = common.Cache(heavy)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                cache.trim()
                above = []
                for t in batch.column(1).slice(a, b - a).to_pylist():
                    found = _features(set(common.words_of(t)), cache)
                    above.append(model.above(sum(weights[f] for f in sorted(found))))
                above = np.asarray(above).reshape(-1, GRADES - 1)
                each = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(above.sum(axis=1).round(9)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= reject)],
                    names=[id_col, "expected_severity", "grade", "toxic"],
                )

    return common.arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, expected_severity double, grade int, toxic boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that are not toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        common.kept("nothing", dict)
        weights = model.weights
        cache = common.Cache(lambda word: tuple(f for f in features_of_word(word) if f in weights))
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part, keep = batch.slice(a, b - a), []
                for t in part.column(at).to_pylist():
                    found = _features(set(common.words_of(t)), cache)
                    keep.append(bool(model.above(sum(weights[f] for f in sorted(found)))[0] < reject))
                cache.trim()
                yield part.filter(pa.array(keep, pa.bool_()))

    return common.arrow(docs, run, docs.schema)
