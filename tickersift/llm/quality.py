"""Quality of texts by a generalised additive model with pairwise interactions.

Every text becomes a row of ``FEATURES``, all of them counts and shares over the whole text.
Features are cut into bins at quantiles of the sample, and each has a lookup table with one
value a bin. The tables grow by boosting in turn: for one feature after the other a tree of
up to four leaves is fitted to the gradient, shrunk and added to the feature's table, round
by round, until the rows kept aside do not gain. The residuals then choose the pairs of
features whose best cut into four parts explains most, and tables over both features' bins
are boosted in the same way. A text's log-odds are the intercept plus one value of each table.

The model learns on the driver from features, not texts, of a bounded sample
(``rows_per_class`` rows for each label, a parameter); rows of a class that the sample thins
out are weighed up again, so scores keep the labels' share.

Defined results: NULL and empty texts are scored as a text without words; a document that is
labelled more than once has its largest label; NULL labels and ids are not learned from, and
a NULL id is not held out; a label above 0 counts as 1; without a labelled row every score is 0.5; repeated rows get
equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 32
PAIR_BINS = 12
PAIRS = 10
LEAST_ROWS = 20  # weight of rows that a leaf needs at least
SMOOTHING = 5.0  # added to a leaf's curvature, so small leaves move little

FEATURES = (
    "log_bytes", "log_words", "log_lines", "mean_word", "longest_word", "mean_line", "distinct_words", "top_word", "repeated_next",
    "distinct_pairs", "distinct_lines", "long_words", "short_words", "upper", "digits", "spaces", "breaks", "foreign", "stops",
    "cries", "symbols", "bars", "brackets", "control", "symbol_ends", "byte_entropy",
)

_BYTES = np.arange(256)
_among = lambda chars: np.isin(_BYTES, np.frombuffer(chars, np.uint8))
CLASSES = np.stack(
    [
        (_BYTES >= 65) & (_BYTES <= 90),  # upper
        (_BYTES >= 48) & (_BYTES <= 57),  # digits
        _among(b" \t"),  # spaces
        _among(b"\n\r"),  # breaks
        _BYTES >= 128,  # foreign
        _among(b".,;:"),  # stops
        _among(b"!?"),  # cries
        _among(b"#$%&*+=<>@\\^_`~/"),  # symbols
        _among(b"|"),  # bars
        _among(b"()[]{}\"'"),  # brackets
        (_BYTES < 32) & ~_among(b"\t\n\r"),  # control
    ]
).astype(np.float64)
LETTERS = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
SYMBOL_ENDS = frozenset("#$%&*+=<>@\\^_`~/|")


def features(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    size, letters = max(1, len(raw)), max(1.0, float(histogram[LETTERS].sum()))
    shares = (CLASSES @ histogram) / size
    shares[0] *= size / letters
    present = histogram[histogram > 0] / size
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, kinds = max(1, len(words)), Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    following = list(zip(words, words[1:], strict=False))
    pairs = max(1, len(following))
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        float(lengths.sum()) / n,
        math.log1p(int(lengths.max(initial=0))),
        math.log1p(len(raw) / max(1, len(lines))),
        len(kinds) / n,
        max(kinds.values(), default=0) / n,
        sum(a == b for a, b in following) / pairs,
        len(set(following)) / pairs,
        len(set(lines)) / max(1, len(lines)),
        int((lengths >= 12).sum()) / n,
        int((lengths <= 2).sum()) / n,
        *shares.tolist(),
        sum(w[-1] in SYMBOL_ENDS for w in words) / n,
        float(-(present * np.log2(present)).sum()),
    ]


def binned(rows: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, rows[:, f], side="right") for f, e in enumerate(edges)]) if edges else np.zeros((len(rows), 0), np.int64)


@dataclass(frozen=True)
class Model:
    """Lookup tables: one row of bins for each feature, one grid for each chosen pair of features, over coarser bins."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    single: np.ndarray
    pair_edges: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    grids: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        fine = binned(rows, self.edges)
        for f in range(fine.shape[1]):
            total += self.single[f, fine[:, f]]
        if self.pairs:
            coarse = binned(rows, self.pair_edges)
            for (a, b), grid in zip(self.pairs, self.grids, strict=True):
                total += grid[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def quantile_edges(rows: np.ndarray, bins: int) -> tuple[np.ndarray, ...]:
    """Bounds between bins, at most ``bins - 1`` for each feature, between distinct values."""
    found = []
    for column in rows.T:
        values = np.unique(column)
        if len(values) <= bins:
            found.append((values[1:] + values[:-1]) / 2)
        else:
            found.append(np.unique(np.quantile(column, np.arange(1, bins) / bins)))
    return tuple(found)


def best_cut(gradient: np.ndarray, curvature: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two; place 0 for none."""
    g, h, w = (np.cumsum(x) for x in (gradient, curvature, weight))
    gain = g[:-1] ** 2 / (h[:-1] + SMOOTHING) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + SMOOTHING) - g[-1] ** 2 / (h[-1] + SMOOTHING)
    gain = np.where((w[:-1] >= LEAST_ROWS) & (w[-1] - w[:-1] >= LEAST_ROWS), gain, 0)
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 0 else (0.0, 0)


def shallow_tree(gradient: np.ndarray, curvature: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A step for each bin from a tree of depth two."""
    bounds = {0, len(gradient)}
    _, first = best_cut(gradient, curvature, weight)
    if first:
        bounds.add(first)
        for a, b in ((0, first), (first, len(gradient))):
            _, second = best_cut(gradient[a:b], curvature[a:b], weight[a:b])
            if second:
                bounds.add(a + second)
    starts = np.array(sorted(bounds))[:-1]
    steps = np.add.reduceat(gradient, starts) / (np.add.reduceat(curvature, starts) + SMOOTHING)
    return np.repeat(steps, np.diff([*starts, len(gradient)]))


def best_quarters(gradient: np.ndarray, curvature: np.ndarray, weight: np.ndarray) -> tuple[float, int, int]:
    """Gain and cuts of the best division of a grid into four quarters; cuts 0 for none."""
    total, quarters = 0.0, []
    cumulated = [np.cumsum(np.cumsum(x, 0), 1) for x in (gradient, curvature, weight)]
    for pick in range(4):
        parts = []
        for c in cumulated:
            top, left = c[:-1, -1:], c[-1:, :-1]
            parts.append((c[:-1, :-1], top - c[:-1, :-1], left - c[:-1, :-1], c[-1, -1] - top - left + c[:-1, :-1])[pick])
        quarters.append(parts)
        total = total + parts[0] ** 2 / (parts[1] + SMOOTHING)
    allowed = np.min([q[2] for q in quarters], axis=0) >= LEAST_ROWS
    gain = np.where(allowed, total, 0)
    if not gain.size or gain.max() <= 0:
        return 0.0, 0, 0
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    return float(gain[a, b]), int(a) + 1, int(b) + 1


def quarter_steps(gradient: np.ndarray, curvature: np.ndarray, weight: np.ndarray) -> np.ndarray:
    gain, a, b = best_quarters(gradient, curvature, weight)
    steps = np.zeros_like(gradient)
    if gain:
        for part in ((slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))):
            steps[part] = gradient[part].sum() / (curvature[part].sum() + SMOOTHING)
    return steps


def train(
    rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 300, rate: float = 0.1, patience: int = 20, bags: int = 2, seed: int = 11
) -> Model:
    """The mean of the tables of several bags, each of which keeps another sixth of the rows aside to end its boosting."""
    if not len(rows):
        return Model(0.0, (), np.zeros((0, 1)), (), (), np.zeros((0, 1, 1)))
    total = float(weights @ labels)
    prior = (total + 1) / (float(weights.sum()) + 2)
    edges, pair_edges = quantile_edges(rows, BINS), quantile_edges(rows, PAIR_BINS)
    fine, coarse = binned(rows, edges), binned(rows, pair_edges)
    part = np.random.default_rng(seed).integers(0, 6, len(rows)) if len(rows) >= 120 else np.full(len(rows), -1)
    intercept = math.log(prior / (1 - prior))
    width = max(len(e) + 1 for e in edges)
    single = np.zeros((bags, rows.shape[1], width))
    logits = np.full((bags, len(rows)), intercept)
    boost = {"labels": labels, "weights": weights, "rounds": rounds, "rate": rate, "patience": patience}
    for bag in range(bags):
        _boosted([fine[:, f] for f in range(rows.shape[1])], single[bag], logits[bag], part != bag, shallow_tree, **boost)
    pairs = _strongest_pairs(coarse, labels - _odds(logits.mean(0)), logits.mean(0), weights)
    wide = max(len(e) + 1 for e in pair_edges)
    grids = np.zeros((bags, len(pairs), wide * wide))
    for bag in range(bags):
        fit = lambda *x: quarter_steps(*(y.reshape(wide, wide) for y in x)).ravel()
        _boosted([coarse[:, a] * wide + coarse[:, b] for a, b in pairs], grids[bag], logits[bag], part != bag, fit, **boost)
    return Model(intercept, edges, single.mean(0), pair_edges, tuple(pairs), grids.mean(0).reshape(len(pairs), wide, wide))


def _odds(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def _boosted(cells, tables, logits, learn, fit, labels, weights, rounds, rate, patience) -> None:
    """Grow ``tables`` and ``logits`` in place, a small step for each in turn; back to the best round in the end."""
    kept = ~learn if not learn.all() else learn
    loss = lambda: float(weights[kept] @ (np.logaddexp(0, logits[kept]) - labels[kept] * logits[kept]))
    best, since, saved = loss(), 0, (tables.copy(), logits.copy())
    own = weights * learn
    for _ in range(rounds if len(cells) else 0):
        for cell, table in zip(cells, tables, strict=True):
            p = _odds(logits)
            sums = [np.bincount(cell, x, len(table)) for x in (own * (labels - p), own * p * (1 - p), own)]
            step = rate * fit(*sums)
            table += step
            logits += step[cell]
        now = loss()
        if now < best - 1e-4 * abs(best):
            best, since, saved = now, 0, (tables.copy(), logits.copy())
        else:
            since += 1
            if since >= patience:
                break
    tables[:], logits[:] = saved


def _strongest_pairs(coarse: np.ndarray, residual: np.ndarray, logits: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
    p = _odds(logits)
    wide = int(coarse.max()) + 1
    sums = (weights * residual, weights * p * (1 - p), weights)
    gains = []
    for a, b in combinations(range(coarse.shape[1]), 2):
        cell = coarse[:, a] * wide + coarse[:, b]
        gain, _, _ = best_quarters(*(np.bincount(cell, x, wide * wide).reshape(wide, wide) for x in sums))
        gains.append((-gain, a, b))
    return [(a, b) for gain, a, b in sorted(gains)[:PAIRS] if gain < 0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, rows_per_class: int = 10_000, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learn from ``labels`` (id and a label of 0 or 1) of documents that are not held out; only features reach the driver."""
    doc_id = F.col(id_column)
    known = labels.where(doc_id.isNotNull() & F.col(label_column).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(doc_id.alias("id")).agg(F.max((F.col(label_column) > 0).cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # one row a label
    if not counts:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0))
    share = {c: min(1.0, rows_per_class / n) for c, n in counts.items()}
    # The same hash thins labels and documents.
    place = lambda c: F.pmod(F.xxhash64(F.lit(23), F.col(c).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    pairs = [F.lit(x) for c, s in share.items() for x in (c, s)]
    chosen = known.where(place("id") < F.create_map(*pairs)[F.col("label")])
    texts = docs.where(place(id_column) < max(share.values())).select(doc_id.alias("id"), F.col(text_column).alias("text"))
    # Distinct ids, about rows_per_class for each of two labels at any size of the tables: below 1 MB.
    joined = texts.join(F.broadcast(chosen), "id").select("label", "text")
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["label", "features"])

    # An id may be that of many documents; then a bounded part of them will do.
    rows = joined.mapInArrow(describe, schema).limit(4 * rows_per_class * len(share)).collect()
    rows.sort(key=lambda r: (r["label"], r["features"]))
    label = np.array([r["label"] for r in rows], np.float64)
    x = np.array([r["features"] for r in rows], np.float64).reshape(-1, len(FEATURES))
    return train(x, label, np.array([1 / share[int(c)] for c in label]))


def score_quality(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with a last column, the probability of label 1, named as ``score_column`` says."""
    parts = tuple(getattr(model, f) for f in Model.__dataclass_fields__)
    sent = docs.sparkSession.sparkContext.broadcast(parts)  # tables of fixed size, below 100 KB
    name, at = score_column(docs), docs.columns.index(text_column)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            rows = np.array([features(t.as_py()) for t in batch.column(at)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(rows))], [*batch.schema.names, name])

    return docs.mapInArrow(score, schema)


def score_column(docs: DataFrame) -> str:
    """A name that no column of ``docs`` has."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return name
