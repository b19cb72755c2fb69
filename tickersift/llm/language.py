"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes a word boundary, and the character
n-grams of its words are hashed into buckets. The mean of the buckets' embeddings goes
through a linear softmax. Embeddings and weights are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled rows (``rows_per_language``
for each of the ``max_languages`` most frequent labels; both are parameters). A part of
the sample is kept from training: it sets the temperature, which makes the score a
probability, and the share of known subwords below which a prediction is rejected, as is
one hardly better than a guess. Whether a subword is known is kept in a space much larger
than the buckets, where unseen ones seldom meet a seen one. The least share lies between
those of the sample's own texts and those that each language's texts have without their
language, so a text in an unlearned language fails, while one in two known languages passes.

Defined results: a text that is NULL or has no letter is ``und`` with score 0, rejected;
without any labelled row all are; a NULL id is not learned from and not held out;
repeated rows get equal predictions; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickersift.functions.scratch import staged

UNKNOWN = "und"
BUCKET_BITS = 15
KNOWN_BITS = 24
# Known subwords that every text is given, since a few unknown ones prove little.
GIVEN = 10
DIMENSIONS = 16
BOUNDARY = 32
# How far from a guess to certainty an accepted score lies at least.
GUESS_MARGIN = 0.05
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    return _letters


def subwords(text: str | None) -> np.ndarray | None:
    """Hashes of KNOWN_BITS bits of all 1- to 4-grams within words, boundaries included; None without a letter. The leading bits are the bucket."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return None
    wide = np.full(len(points) + 2, BOUNDARY, np.uint32)
    wide[1:-1] = np.where(letter, points, BOUNDARY)
    inside = wide != BOUNDARY
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[0] = True
    points, inside = wide[keep], inside[keep]
    found = []
    gram = points.copy()
    valid = inside.copy()  # a gram has a letter, and no boundary but at its ends
    for n in range(1, 5):
        if n > 1:
            gram = gram[:-1] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1)
            valid = inside[: len(gram)] | inside[n - 1 :] if n == 2 else valid[:-1]
            for middle in range(1, n - 1):
                valid = valid & inside[middle : middle + len(gram)]
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
        found.append((mixed[valid] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - KNOWN_BITS))
    return np.concatenate(found)


def bucket_of(grams: np.ndarray) -> np.ndarray:
    return grams >> np.uint32(KNOWN_BITS - BUCKET_BITS)


def known_share(known: np.ndarray, counts: np.ndarray) -> float:
    return float((known @ counts + GIVEN) / (counts.sum() + GIVEN))


@dataclass(frozen=True)
class Model:
    """Logits of each bucket (the product of embeddings and weights); the calibration; a bit for each known subword."""

    languages: tuple[str, ...]
    table: np.ndarray
    temperature: float
    least_known: float
    known: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        logits = counts @ self.table / counts.sum() / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        grams = subwords(text)
        if grams is None or not len(grams) or not self.languages:
            return UNKNOWN, 0.0, True
        p = self.scores(np.bincount(bucket_of(grams), minlength=1 << BUCKET_BITS).astype(np.float32))
        known = known_share(self.known[grams >> np.uint32(3)] >> (grams & np.uint32(7)).astype(np.uint8) & 1, np.ones(len(grams)))
        best, guess = int(p.argmax()), 1 / len(p)
        hardly = len(p) > 1 and p[best] < guess + GUESS_MARGIN * (1 - guess)
        return self.languages[best], min(1.0, float(p[best])), bool(hardly or known < self.least_known)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(
    docs: DataFrame, rows_per_language: int, max_languages: int, id_column: str, text_column: str, label_column: str
) -> tuple[list[str], DataFrame | None]:
    """Languages, and the subwords of a bounded sample as a stored table: (i, row, learns, calibrates, grams, counts, buckets, times).

    A language's share of rows is set from its count, by a hash of the id, so the sample is
    the same whenever it is drawn. Texts and subwords stay with the executors.
    """
    label, doc_id, text = F.col(label_column), F.col(id_column), F.col(text_column)
    usable = docs.where(label.isNotNull() & doc_id.isNotNull() & text.isNotNull() & ~held_out(doc_id))
    most = usable.groupBy(label.alias("label")).count().orderBy(F.desc("count"), "label").limit(max_languages).collect()
    languages = sorted(r["label"] for r in most)
    if not languages:
        return [], None
    share = {r["label"]: min(1.0, rows_per_language / r["count"]) for r in most}
    pairs = [x for lang in languages for x in (F.lit(lang), F.struct(F.lit(languages.index(lang)).alias("i"), F.lit(share[lang]).alias("share")))]
    place = F.pmod(F.xxhash64(F.lit(17), doc_id), F.lit(1 << 20)) / float(1 << 20)
    chosen = usable.select(F.create_map(*pairs)[label].alias("l"), text.alias("text"), place.alias("place"), F.xxhash64(F.lit(29), doc_id).alias("hash"))
    chosen = chosen.where(F.col("place") < F.col("l.share")).select(F.col("l.i").alias("i"), F.col("hash"), F.monotonically_increasing_id().alias("row"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["i", "hash", "row", "grams", "counts", "buckets", "times"]
        for batch in batches:
            kept, columns = [], [[], [], [], []]
            for at, text in enumerate(batch.column(3)):
                grams = subwords(text.as_py())
                if grams is not None and len(grams):
                    value, n = np.unique(grams, return_counts=True)
                    buckets, begins = np.unique(bucket_of(value), return_index=True)
                    kept.append(at)
                    for column, found in zip(columns, (value.astype(np.int32), n.astype(np.int32), buckets.astype("<u2").tobytes(), np.add.reduceat(n, begins).astype("<u4").tobytes()), strict=True):
                        column.append(found)
            which = pa.array(kept, pa.int64())
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            arrays = [batch.column(c).take(which) for c in range(3)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    sample = staged(chosen.mapInArrow(count, "i int, hash long, row long, grams array<int>, counts array<int>, buckets binary, times binary"), "language-sample")
    sizes = {r["i"]: r["count"] for r in sample.groupBy("i").count().collect()}  # one row a language
    if any(n > 2 * rows_per_language for n in sizes.values()):
        # The shares bound the sample unless an id has very many rows; then rows are thinned.
        limits = F.create_map(*[x for i, n in sizes.items() for x in (F.lit(i), F.lit(rows_per_language / n))])
        sample = sample.where(F.pmod(F.xxhash64(F.lit(31), "row"), F.lit(1 << 20)) / float(1 << 20) < limits[F.col("i")])
    fifth = F.pmod("hash", F.lit(5)) == 0
    few = F.lit(sum(sizes.values()) < 50)
    return languages, sample.select("i", "row", (few | ~fifth).alias("learns"), (few | fifth).alias("calibrates"), "grams", "counts", "buckets", "times")


def known_subwords(sample: DataFrame, languages: int, wrong_rejects: float) -> tuple[np.ndarray, float]:
    """Bits of the known subwords, and the least share: each language's kept texts without their language should fail, with it pass.

    Subwords are joined and summed in the executors; the bits, 2 MB, and two shares for
    each kept text of the sample reach the driver.
    """
    held = sample.where("learns").select("i", F.explode("grams").alias("gram")).distinct()
    holders = staged(held.groupBy("gram").agg(F.count("*").alias("n"), F.min("i").alias("owner")), "known-subwords")
    words = holders.groupBy(F.shiftright("gram", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("gram").bitwiseAND(63))).alias("bits"))
    words = words.toArrow()
    bits = np.zeros(1 << (KNOWN_BITS - 6), np.int64)
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    kept = sample.where("calibrates").select("i", "row", F.explode(F.arrays_zip("grams", "counts")).alias("g"))
    met = kept.select("i", "row", F.col("g.grams").alias("gram"), F.col("g.counts").alias("count")).join(holders, "gram", "left")
    known, others = F.col("n").isNotNull(), (F.col("n") > 1) | (F.col("owner") != F.col("i"))
    share = lambda c: ((F.sum(F.when(c, F.col("count")).otherwise(0)) + GIVEN) / (F.sum("count") + GIVEN)).cast("double")
    rows = met.groupBy("i", "row").agg(share(known).alias("own"), share(others).alias("foreign")).toArrow().to_pydict()
    own, foreign, label = (np.array(rows[c]) for c in ("own", "foreign", "i"))
    # Well below what the sample's own texts reach, if there is nothing to compare them with.
    least = float(np.quantile(own, wrong_rejects, method="lower"))
    # The median, since a text may be mostly in another language than its label says.
    typical = max(float(np.median(foreign[label == i])) for i in np.unique(label)) if languages > 1 else least / 2
    return bits.view(np.uint8), (least + min(least, typical)) / 2


def train(languages: list[str], sample: DataFrame | None, epochs: int = 6, rate: float = 1.0, wrong_rejects: float = 0.001, seed: int = 1) -> Model:
    """Stochastic gradient descent, one text a step; a fifth of the sample calibrates. Only bucket counts are collected."""
    size, n = 1 << BUCKET_BITS, len(languages)
    table = sample.select("i", "learns", "calibrates", "buckets", "times").toArrow() if languages else None
    if not table or not table.num_rows:
        return Model((), np.zeros((size, 1), np.float32), 1.0, 1.0, np.zeros(1 << (KNOWN_BITS - 3), np.uint8))
    columns = [table.column(c).to_pylist() for c in ("i", "learns", "calibrates")]
    buckets, times = (table.column(c).to_pylist() for c in ("buckets", "times"))
    # In an order that does not depend on how the sample was read.
    order = sorted(range(len(buckets)), key=lambda j: (columns[0][j], zlib.crc32(buckets[j]), zlib.crc32(times[j])))
    rows = [(columns[0][j], np.frombuffer(buckets[j], "<u2"), np.frombuffer(times[j], "<u4")) for j in order]
    learn = [r for j, r in zip(order, rows, strict=True) if columns[1][j]] or rows
    kept = [r for j, r in zip(order, rows, strict=True) if columns[2][j]] or rows
    random = np.random.default_rng(seed)
    embed = np.zeros((size, DIMENSIONS), np.float32)
    met = np.zeros(size, bool)
    for _, b, _ in learn:
        met[b] = True
    embed[met] = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (int(met.sum()), DIMENSIONS))
    weight, steps, step = np.zeros((DIMENSIONS, n), np.float32), epochs * len(learn), 0
    for _ in range(epochs):
        for i in random.permutation(len(learn)):
            label, own, counts = learn[i]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ embed[own]
            logits = mean @ weight
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            now = rate * (1 - step / steps)
            back = weight @ error
            weight -= now * np.outer(mean, error)
            embed[own] -= now * len(own) ** 0.5 * share[:, None] * back
            step += 1
    table = embed @ weight
    logits = np.stack([(c / c.sum()).astype(np.float32) @ table[b] for _, b, c in kept])
    truth = np.array([label for label, _, _ in kept])
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: _loss(logits / t, truth))
    bits, least = known_subwords(sample, n, wrong_rejects)
    return Model(tuple(languages), table, float(temperature), least, bits)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    """Cross entropy against smoothed targets, (n + 1) / (n + 2) for n rows: without errors in the sample, odds stay finite."""
    n, k = logits.shape
    miss = 1 / (n + 2)
    logs = np.log(_softmax(logits) + 1e-12)
    own = logs[np.arange(n), truth]
    return float(-((1 - miss) * own + miss * (logs.sum(1) - own) / max(1, k - 1)).mean())


def fit_languages(
    docs: DataFrame, rows_per_language: int = 1000, max_languages: int = 200, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang"
) -> Model:
    return train(*labelled_sample(docs, rows_per_language, max_languages, id_column, text_column, label_column))


def predict_languages(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with a last column, a struct of lang_pred, score and rejected, named as ``prediction_column`` says."""
    parts = (model.languages, model.table, model.temperature, model.least_known, model.known)
    sent = docs.sparkSession.sparkContext.broadcast(parts)  # 2 MB, and 128 KB per language, at most max_languages of them
    name = prediction_column(docs)
    at = docs.columns.index(text_column)
    result = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, result)])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            struct = pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    return docs.mapInArrow(predict, schema)


def prediction_column(docs: DataFrame) -> str:
    """A name that no column of ``docs`` has."""
    name = "prediction"
    while name in docs.columns:
        name += "_"
    return name
