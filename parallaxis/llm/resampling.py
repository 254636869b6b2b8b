"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, of the target (documents labelled
good) and of all raw text, give each document an importance weight: the ratio
of its likelihoods. Documents are sampled without replacement by the Gumbel
top-k rule on the log of that weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallaxis.llm import _text, _work

#: Byte n-grams counted, and buckets that each length is hashed to. To them comes a third kind: n-grams of word repetition.
ORDERS = (2, 4)
BUCKETS = 1 << 16
KINDS = len(ORDERS) + 1
#: Words that the repetition n-gram of a word compares it with.
BACK = 3
#: N-grams of evidence that a text can give: the log ratio of a text of n of them counts LENGTH / (n + LENGTH), so that short texts count in full and long ones by their mean.
LENGTH = 400
#: Parts of the labelled documents; those of a part are weighed by the others for the calibration.
FOLDS = 4
#: Labelled documents that the target model and the calibration are fitted on, at most; chosen by a hash of doc_id.
MOST_LABELLED = 20_000
#: Added to every count.
SMOOTHING = 0.5
SEED = 7


def gram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte."""
    n = max(0, len(data) - order + 1)
    code = np.zeros(n, np.uint64)
    for k in range(order):
        code = (code << np.uint64(8)) | data[k : k + n]
    return (_text.mix(code + np.uint64(order)) % np.uint64(BUCKETS)).astype(np.int32)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind: buckets of all n-grams, the first of each text, and how many each text has. Those that cross texts belong to none."""
    for i, order in enumerate(ORDERS):
        yield gram_buckets(data, order) + np.int32(i * BUCKETS), offsets[:-1], np.maximum(np.diff(offsets) - order + 1, 0)
    w = _text.spans(data, offsets)
    hashes, first = w.hashes(), w.firsts()
    code = np.zeros(len(hashes), np.int32)
    for k in range(1, BACK + 1):
        code[k:] |= ((hashes[k:] == hashes[:-k]) & (w.row[k:] == w.row[:-k])).astype(np.int32) << (k - 1)
    yield code + np.int32(len(ORDERS) * BUCKETS), first[:-1], np.diff(first)


def gram_counts(documents: DataFrame, fold: str) -> DataFrame:
    """bucket, raw, target: counts of n-gram buckets in all texts, and in those of each fold (0 to FOLDS - 1; null: in none). Buckets of the i-th kind are i * BUCKETS on."""

    def within(first: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
        mark = np.zeros(total + 1, np.int32)
        some = n > 0
        np.add.at(mark, first[some], 1)
        np.add.at(mark, (first + n)[some], -1)
        return np.cumsum(mark[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 + FOLDS, KINDS * BUCKETS), np.int64)
        for batch in batches:
            folds = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in _text.chunks(batch.column(0)):
                for code, first, n in grams(data, offsets):
                    counts[0] += np.bincount(code[within(first, n, len(code))], minlength=KINDS * BUCKETS)
                    for f in np.unique(folds[a:b]):
                        if f >= 0:
                            counts[1 + f] += np.bincount(code[within(first, n * (folds[a:b] == f), len(code))], minlength=KINDS * BUCKETS)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c[some]) for c in counts)], names=["bucket", "raw", *(f"target{f}" for f in range(FOLDS))])

    names = [f"target{f}" for f in range(FOLDS)]
    parts = documents.select("text", fold).mapInArrow(run, ", ".join(["bucket int, raw long", *(f"{x} long" for x in names)]))
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.array(*(F.sum(x) for x in names)).alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log of target over raw probability for each bucket: a row with all folds, and one for each fold without it. The table has KINDS * BUCKETS rows at most."""
    raw, target = np.full(KINDS * BUCKETS, SMOOTHING), np.zeros((FOLDS, KINDS * BUCKETS))
    for row in counts.toLocalIterator():
        raw[row.bucket] += row.raw
        target[:, row.bucket] += row.target
    whole = target.sum(0)
    models = np.stack([whole, *(whole - target)]) + SMOOTHING
    out = np.empty_like(models)
    for i in range(KINDS):
        s = slice(i * BUCKETS, (i + 1) * BUCKETS)
        out[:, s] = np.log(models[:, s] / models[:, s].sum(1, keepdims=True)) - np.log(raw[s] / raw[s].sum())
    return out


def log_weights(documents: DataFrame, ratios: np.ndarray, model: str | None = None) -> DataFrame:
    """documents with log_weight: the log likelihood ratio of a whole text's n-grams, by its length; 0 for a text without any.

    The first row of ratios weighs all texts, or where model names a column,
    the row that it tells.
    """
    own = documents.drop("log_weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(model).to_numpy(zero_copy_only=False) if model else np.zeros(batch.num_rows, np.int64)
            for a, b, data, offsets in _text.chunks(batch.column("text")):
                total, number = np.zeros(b - a), np.zeros(b - a)
                for code, first, n in grams(data, offsets):
                    for k in np.unique(which[a:b]):
                        at = np.flatnonzero((which[a:b] == k) & (n > 0))
                        if len(at):  # each text is summed by itself, so that equal texts have equal weights
                            total[at] += np.add.reduceat(np.append(ratios[k][code], 0.0), np.column_stack([first[at], first[at] + n[at]]).ravel())[::2]
                    number += n
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(total * LENGTH / (number + LENGTH))], names=[*batch.schema.names, "log_weight"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("log_weight", T.DoubleType())]))


def calibrate(weight: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of labels on log weights, on the scale of asinh. Without both labels, everything counts as good, or as bad."""
    if len(weight) == 0 or y.all() or not y.any():
        return 0.0, 40.0 if len(weight) == 0 or y.all() else -40.0
    z = np.column_stack([np.arcsinh(weight), np.ones(len(weight))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (p - y) + 1e-2 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def kth_largest(keys: DataFrame, key: str, k: int, few: int = 5000) -> float | None:
    """The k-th largest value of a column, by histograms over ever narrower ranges; None where k is beyond the rows."""
    low, high, rows = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if k < 1 or k > rows:
        return None
    inside = F.lit(True)
    while rows > few and low < high:
        width = (high - low) / 512
        bucket = F.least(F.floor((F.col(key) - low) / width), F.lit(511))
        found = keys.filter(inside).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.b):
            if r.n >= k:
                low, high, rows = r.low, r.high, r.n
                break
            k -= r.n
        inside = F.col(key).between(low, high)
    if low == high:
        return low
    values = sorted((r[0] for r in keys.filter(inside).select(key).collect()), reverse=True)
    return values[k - 1]


@dataclass
class Model:
    """Log ratios of the buckets, and the calibration of a text's log weight."""

    ratios: np.ndarray
    slope: float
    intercept: float

    def keyed(self, documents: DataFrame, seed: int = SEED, evidence: float = LENGTH) -> DataFrame:
        """documents with log_weight, score and key, by their text and doc_id alone; the noise in key is another for each seed, and a long text's weight in it that of evidence n-grams."""
        own = documents.drop("log_weight", "score", "key")
        uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        logit = self.slope * F.asinh("log_weight") + self.intercept
        return log_weights(own, self.ratios[:1]).select(*own.columns, "log_weight", (1 / (1 + F.exp(-logit))).alias("score"), (F.col("log_weight") * (evidence / LENGTH) - F.log(-F.log(uniform))).alias("key"))


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """The raw model of all documents, the target model of those labelled 1, and the calibration by the labels, each document weighed without its own fold."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.min(target).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(SEED))).limit(MOST_LABELLED).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int"))
    known = _work.stored(known, "labels")  # at most MOST_LABELLED rows of three numbers
    labelled = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left")
    ratios = log_ratios(gram_counts(labelled.select("text", F.when(F.col("label") == 1, F.col("fold")).alias("good")), "good"))
    own = labelled.filter("label is not null").select("doc_id", "text", "label", (F.col("fold") + 1).alias("model"))
    fitted = log_weights(own, ratios, "model").groupBy("doc_id").agg(F.min(F.struct("log_weight", "label")).alias("x")).select("x.*").collect()  # at most MOST_LABELLED rows
    return Model(ratios, *calibrate(np.array([r.log_weight for r in fitted], float), np.array([r.label == 1 for r in fitted], float)))


def resample(documents: DataFrame, labels: DataFrame, target: str = "quality", keep: float | None = None, seed: int = SEED, evidence: float = LENGTH) -> DataFrame:
    """doc_id, log_weight, score, key, kept of every row of documents.

    The target model counts documents whose label is 1, the raw model all.
    log_weight is the log importance weight of the whole text (see LENGTH); key
    adds Gumbel noise drawn from doc_id, so that reruns agree, to evidence /
    LENGTH of it: the less evidence, the more even the draw. The rows of the
    k largest keys are kept, and of rows that tie for the last place, all: k is
    `keep` of the rows, or where that is None the expected number of target
    documents, the sum of score, which is the weight's chance (0 to 1), by the
    labels, to be of the target. With a k below the number of good documents
    and little evidence the draw is a sample of them, the likelier the larger
    their weights; by default it takes the good ones nearly as they are. Null texts are empty; without n-grams a text's
    weight is one. Rows of one doc_id draw the same noise. Several labels of a
    doc_id count by the smallest, null ones not. Other columns are ignored; an
    empty table gives no rows.
    """
    keyed = _work.stored(fit(documents, labels, target).keyed(documents.select("doc_id", "text"), seed, evidence).drop("text"), "keys")
    k, last = _last(keyed, keep)
    return keyed.withColumn("kept", F.lit(k > 0) if last is None else F.col("key") >= last)


def _last(keyed: DataFrame, keep: float | None) -> tuple[int, float | None]:
    """How many rows are kept, and the key of the last of them (None where all or none are)."""
    rows, expected = keyed.agg(F.count("*"), F.sum(F.round("score", 6).cast("decimal(20,6)"))).first()
    k = int(round(float(expected or 0) if keep is None else keep * rows))
    return k, None if k in (0, rows) else kth_largest(keyed, "key", k)


def keep_target(documents: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """The rows of documents that resample keeps (of rows that tie for the last place, all), unchanged; the texts are not shuffled."""
    model = fit(documents, labels, target)
    keyed = _work.stored(model.keyed(documents.select("doc_id", "text")).select("score", "key"), "keys")
    k, last = _last(keyed, None)
    if last is None:
        return documents if k else documents.limit(0)
    own = {c: c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(documents.columns)}
    kept = model.keyed(documents.select(*(F.col(c).alias(k) for c, k in own.items())))
    return kept.filter(F.col("key") >= last).select(*(F.col(k).alias(c) for c, k in own.items()))
