"""Ordinal regression on graded ratings: a cumulative-link (proportional odds) model over hashed text features.

P(grade >= j) = sigmoid(w . x - t_j) with one weight vector for all grades and thresholds t_1 < t_2. The features are the
presence of hashed words and word prefixes, and of bins of a few shape ratios (upper case, symbols, digits, what is no
word, words that repeat the one before). Only features that tell the grades apart beyond chance in the training sample get
weights; by default (one_sided) of words only those that speak for a lower grade, which does better on held-out documents than free signs do,
as long texts gather credit word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import fresh_name
from ._words import Words, sliced

BITS = 20
PREFIXES = (4, 5, 6)
SHAPES = 6
EDGES = np.array([0.0, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])
SIZE = (1 << BITS) + SHAPES * (len(EDGES) + 1)
_CLASS = np.zeros((256, 4), np.int64)
_CLASS[65:91, 0] = 1
_CLASS[[ord(c) for c in "#$%&*+<=>@^_`~"], 1] = 1
_CLASS[[ord(c) for c in "!?|\\{}[]"], 2] = 1
_CLASS[48:58, 3] = 1


@dataclass
class Model:
    weights: np.ndarray  # float32[SIZE]
    thresholds: np.ndarray  # ascending

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... by column."""
        return 1 / (1 + np.exp(-(score[:, None] - self.thresholds[None, :])))


def _present(w: Words, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs without repeats, only of features that `useful` marks."""
    shift = np.uint64(64 - BITS)
    n = len(w.bounds) - 1
    rows, features = [w.row], [w.word_hash() >> shift]
    for k in PREFIXES:
        at = np.flatnonzero(w.end - w.start > k)
        rows.append(w.row[at])
        features.append((w.hash(w.start[at], w.start[at] + k) ^ np.uint64(0x9E37 * k << 40)) >> shift)
    row, feature = np.concatenate(rows), np.concatenate(features).astype(np.int64)
    if useful is not None:
        at = np.flatnonzero(useful[feature])
        row, feature = row[at], feature[at]
    pair = np.unique(row * (1 << BITS) + feature)
    row, feature = pair >> BITS, pair & ((1 << BITS) - 1)
    ratios = np.zeros((n, SHAPES))
    size = np.maximum(np.diff(w.bounds), 1)
    for c in range(4):
        total = np.concatenate([[0], np.cumsum(_CLASS[w.raw, c])])
        ratios[:, c] = (total[w.bounds[1:]] - total[w.bounds[:-1]]) / size
    letters = np.bincount(w.row, weights=w.end - w.start, minlength=n)
    ratios[:, 4] = 1 - letters / size
    h = features[0]
    same = np.flatnonzero((h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1]))
    ratios[:, 5] = np.bincount(w.row[same], minlength=n) / np.maximum(np.bincount(w.row, minlength=n), 1)
    bins = np.searchsorted(EDGES, ratios, "right") + np.arange(SHAPES) * (len(EDGES) + 1) + (1 << BITS)
    shape_row, bins = np.repeat(np.arange(n), SHAPES), bins.ravel()
    if useful is not None:
        at = np.flatnonzero(useful[bins])
        shape_row, bins = shape_row[at], bins[at]
    return np.concatenate([row, shape_row]), np.concatenate([feature, bins])


def fit_rows(texts: list[str | None] | pa.Array, grades: np.ndarray, grade_count: int, weight_of: np.ndarray | None = None, features: int = 4000, steps: int = 200, rate: float = 0.05, l2: float = 1.0, least_z: float = 4.0, one_sided: bool = True) -> Model:
    """The model from rated texts. Features are chosen by the z-score of their presence between neighbouring grade
    splits; the weights minimise the penalised negative log-likelihood by Adam steps over the whole sample. Of features with equal scores
    the lower number is chosen; texts that repeat count as often as they stand there; null and empty texts have shape features only;
    no texts give a model without weights."""
    grades = np.asarray(grades, np.int64)
    each = (np.ones(grade_count) if weight_of is None else np.asarray(weight_of, float))[grades]
    each = each / max(each.sum(), 1e-9)
    n, texts = len(texts), texts if isinstance(texts, pa.Array | pa.ChunkedArray) else pa.array(texts, pa.large_string())
    have = np.zeros((grade_count, SIZE), np.float32)  # first pass: in how many texts of each grade a feature is
    for first, last, w in sliced(texts):
        r, f = _present(w)
        for j in range(grade_count):
            have[j] += np.bincount(f[grades[first:last][r] == j], minlength=SIZE).astype(np.float32)
    z = np.zeros(SIZE, np.float32)
    for j in range(1, grade_count):
        n1, n0 = max((grades >= j).sum(), 1), max((grades < j).sum(), 1)
        c1, c0 = have[j:].sum(0), have[:j].sum(0)
        p = (c1 + c0 + 1) / (n1 + n0 + 2)
        here = (c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        bigger = np.abs(here) > np.abs(z)
        if one_sided:
            bigger[: 1 << BITS] = here[: 1 << BITS] < z[: 1 << BITS]
        z = np.where(bigger, here, z)
    z[have.sum(0) < 4] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:features]
    chosen = chosen[np.abs(z[chosen]) >= least_z]
    index = np.full(SIZE, -1, np.int64)
    index[chosen] = np.arange(len(chosen))
    row, col = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, _, w in sliced(texts):  # second pass: which chosen features each text has
        r, f = _present(w, index >= 0)
        row.append(r + first)
        col.append(index[f])
    row, col = np.concatenate(row), np.concatenate(col)
    theta = np.concatenate([np.zeros(len(chosen)), np.linspace(-1, 1, grade_count - 1) if grade_count > 2 else np.zeros(1)])
    m1, m2, k, i = np.zeros_like(theta), np.zeros_like(theta), len(chosen), np.arange(n)
    for step in range(1, steps + 1):
        weight, cut = theta[:k], theta[k:]
        s = np.bincount(row, weights=weight[col], minlength=n)
        up = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(s[:, None] - cut[None, :]))), np.zeros((n, 1))], axis=1)
        hi, lo = up[i, grades], up[i, grades + 1]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dhi, dlo = dhi * each, dlo * each
        g = -(dhi - dlo)
        gradient = np.concatenate([np.bincount(col, weights=g[row], minlength=k) + l2 / n * weight, [dhi[grades == j].sum() - dlo[grades == j - 1].sum() for j in range(1, grade_count)]])
        m1 = 0.9 * m1 + 0.1 * gradient
        m2 = 0.99 * m2 + 0.01 * gradient**2
        theta = theta - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        theta[k:] = np.sort(theta[k:])
    weight, cut = theta[:k], theta[k:]
    weights = np.zeros(SIZE, np.float32)
    weights[chosen] = weight
    return Model(weights, cut)


def fit(docs: DataFrame, ratings: DataFrame, grade_count: int, doc_id: str = "doc_id", text: str = "text", per_grade: int = 1500, longest: int = 50_000, **options) -> Model:
    """Fits on a bounded sample: about `per_grade` rated documents of each grade, drawn by a hash of their id among those of
    at most `longest` bytes; equal texts count once. The sample is fitted in one task, the driver gets the weights only. `ratings`: doc_id, grade (0 .. grade_count - 1; other and null
    grades are left out)."""
    rated = ratings.select(F.col("doc_id").alias("_id"), F.col("grade").cast("int").alias("_grade")).where(F.col("_grade").between(0, grade_count - 1))
    counts = {r["_grade"]: r["n"] for r in rated.groupBy("_grade").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return _weightless(grade_count)
    share = F.lit(0.0)
    for grade, n in counts.items():
        share = F.when(F.col("_grade") == grade, min(1.0, per_grade / n)).otherwise(share)
    unit = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / float(1 << 40)
    picked = rated.where(unit < share)  # about per_grade * grade_count rows
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).where(F.octet_length("_text") <= longest)
    rows = own.join(F.broadcast(picked), "_id").select("_id", "_grade", "_text")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (parts := [b for b in batches if b.num_rows]):
            return
        rows = pa.Table.from_batches(parts).sort_by([("_id", "ascending"), ("_grade", "ascending")])
        first = {t.as_py(): i for i, t in reversed(list(enumerate(rows["_text"])))}  # equal texts: the first
        rows = rows.take(pa.array(sorted(first.values()), pa.int64()))
        del first
        of = rows["_grade"].to_numpy().astype(np.int64)
        # a grade that was thinned out counts for all its documents
        weight_of = [counts.get(j, 0) / max((of == j).sum(), 1) for j in range(grade_count)]
        model = fit_rows(rows["_text"], of, grade_count, weight_of, **options)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([model.weights[at].tolist()], pa.list_(pa.float32())), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))], names=["at", "weights", "thresholds"])

    found = rows.repartition(1).mapInArrow(fitted, "at array<long>, weights array<float>, thresholds array<double>").collect()
    return _restored(found[0]) if found else _weightless(grade_count)


def _weightless(grade_count: int) -> Model:
    return Model(np.zeros(SIZE, np.float32), np.linspace(-1, 1, grade_count - 1) if grade_count > 2 else np.zeros(1))


def _restored(row: Row) -> Model:
    weights = np.zeros(SIZE, np.float32)
    weights[np.array(row["at"], np.int64)] = np.array(row["weights"], np.float32)
    return Model(weights, np.array(row["thresholds"]))


def scores(column: pa.Array, model: Model, useful: np.ndarray) -> np.ndarray:
    out = np.zeros(len(column))
    for first, last, w in sliced(column):
        row, feature = _present(w, useful)
        out[first:last] = np.bincount(row, weights=model.weights[feature], minlength=last - first)
    return out


def rated(docs: DataFrame, model: Model, text: str = "text", least_tail: float = 0.5, select_only: bool = False) -> DataFrame:
    """`docs` with expected_grade, tail (the probability of the highest grade) and selected (tail >= least_tail); with
    select_only the columns stay as they are and only selected rows remain. Whole texts are read; a null or empty text is
    scored by its shape features. Repeated rows get equal scores; an empty table gives an empty one. New columns
    replace columns of the same name."""
    sc = docs.sparkSession.sparkContext
    given = sc.broadcast((model, model.weights != 0))  # fixed size: SIZE weights
    own = docs if select_only else docs.drop("expected_grade", "tail", "selected")
    key = fresh_name("_text", own.columns)
    more = [] if select_only else [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("selected", T.BooleanType())]
    schema = T.StructType([*own.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, useful = given.value
        for b in batches:
            tails = fitted.tails(scores(b.column(b.num_columns - 1), fitted, useful))
            chosen = tails[:, -1] >= least_tail
            kept = b.select(range(b.num_columns - 1))
            if select_only:
                yield kept.filter(pa.array(chosen))
            else:
                columns = [*kept.columns, pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(chosen)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.withColumn(key, docs[text].cast("string")).mapInArrow(run, schema)


def grades(labels: DataFrame) -> DataFrame:
    """The graded rating behind the two labels: 0 toxic, 1 poor, 2 clean and well written; null if a label that decides is."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2).alias("grade"))
