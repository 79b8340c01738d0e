"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import text_slices
from .langid import grams, letters

ORDERS = (4, 5, 6)
BUCKET_BITS = 20
#: Labelled documents of each label that the classifier is fitted on, taken in hash order of the id.
SAMPLE = {1: 4_000, 0: 8_000}
#: Buckets with the clearest ratios that become features.
FEATURES = 4_096
SMOOTHING = 1.0
#: Ridges to choose from, on a part of the training rows, and steps of the descent in that choice and at the end.
RIDGES = (30.0, 10.0, 3.0)
CHOICE_STEPS, STEPS = 60, 200
THRESHOLD = 0.7


class Model:
    """Bias and one weight per bucket (ratio times coefficient; 0 for buckets that are no features)."""

    def __init__(self, bias: float, weights: np.ndarray, orders=ORDERS, bits: int = BUCKET_BITS):
        self.bias, self.weights, self.orders, self.bits = bias, weights, orders, bits

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        owner, bucket = present(texts, self.orders, self.bits, self.weights != 0)
        if len(owner):
            out += np.bincount(owner, self.weights[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def present(texts: list[str], orders, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every bucket that a text holds, once; only ``wanted`` buckets when given."""
    codes, lengths = letters(texts)
    pairs = []
    for order in orders:
        bucket, owner = grams(codes, lengths, order, bits)
        if wanted is not None:
            some = wanted[bucket]
            bucket, owner = bucket[some], owner[some]
        pairs.append((owner << bits) | bucket)
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both >> bits, both & ((1 << bits) - 1)


def log_ratios(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket, from the documents of either label that hold it."""
    p, q = (positive + smoothing) / (n_positive + 2 * smoothing), (negative + smoothing) / (n_negative + 2 * smoothing)
    return np.log(p / q)


class Bits:
    """Presence of features as packed bits, multiplied block by block; ``scale`` is the value of each feature where it is present."""

    def __init__(self, packed: np.ndarray, scale: np.ndarray, block: int = 1_000):
        self.packed, self.scale, self.block = packed, scale.astype(np.float32), block
        self.shape = (len(packed), len(scale))

    def pick(self, rows: np.ndarray) -> Bits:
        return Bits(self.packed[rows], self.scale, self.block)

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for first in range(0, len(self.packed), self.block):
            part = slice(first, first + self.block)
            yield part, np.unpackbits(self.packed[part], axis=1, count=self.shape[1]).astype(np.float32)

    def times(self, w: np.ndarray) -> np.ndarray:
        out, v = np.zeros(self.shape[0]), (w * self.scale).astype(np.float32)
        for part, x in self.blocks():
            out[part] = x @ v
        return out

    def descend(self, w: np.ndarray, bias: float, y: np.ndarray, share: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Log loss with rows weighed by ``share``, and its gradient by bias and coefficients, in one pass."""
        loss, by_bias, by_w, v = 0.0, 0.0, np.zeros(self.shape[1]), (w * self.scale).astype(np.float32)
        for part, x in self.blocks():
            z = x @ v + bias
            loss += float((np.logaddexp(0, np.where(y[part] == 1, -z, z)) * share[part]).sum())
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[part]) * share[part]
            by_bias += float(error.sum())
            by_w += x.T @ error.astype(np.float32)
        return loss, by_bias, by_w * self.scale


def shares(y: np.ndarray) -> np.ndarray:
    """Weight of each row, so that both labels count alike and all rows together count as many as they are."""
    n1 = max(float(y.sum()), 1.0)
    n0 = max(len(y) - float(y.sum()), 1.0)
    return np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))


def logistic(x: Bits, y: np.ndarray, ridge: float, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Bias and coefficients of a ridge logistic regression in which both labels count alike.

    Limited-memory quasi-Newton steps, ``steps`` passes over the rows at most.
    The bias is measured in the mean length of a row, as the features are.
    """
    share = shares(y)
    unit = 1.0 + float(np.abs(x.times(x.scale)).mean()) ** 0.5 if len(y) else 1.0

    def at(p: np.ndarray) -> tuple[float, np.ndarray]:
        loss, by_bias, by_w = x.descend(p[1:], p[0] * unit, y, share)
        return loss + ridge / 2 * float(p[1:] @ p[1:]), np.r_[by_bias * unit, by_w + ridge * p[1:]]

    p = np.zeros(x.shape[1] + 1)
    value, grad = at(p)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    start, used, rate = float(np.linalg.norm(grad)), 1, 1 / max(float(np.linalg.norm(grad)), 1.0)
    while used < steps and np.linalg.norm(grad) > 1e-6 * start:
        step, kept = grad.copy(), []
        for s, g, r in reversed(moves):
            kept.append(r * float(s @ step))
            step -= kept[-1] * g
        step *= float(moves[-1][0] @ moves[-1][1]) / float(moves[-1][1] @ moves[-1][1]) if moves else rate
        for (s, g, r), k in zip(moves, reversed(kept)):
            step += (k - r * float(g @ step)) * s
        length, slope = 1.0, float(grad @ step)
        while used < steps:
            used += 1
            there, turned = at(p - length * step)
            if there <= value - 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, g = -length * step, turned - grad
        if float(s @ g) > 1e-12 * float(g @ g):
            moves = [*moves[-9:], (s, g, 1 / float(s @ g))]
        p, value, grad = p + s, there, turned
    return float(p[0]) * unit, p[1:]


def balanced_loss(x: Bits, y: np.ndarray, bias: float, w: np.ndarray) -> float:
    """Mean log loss with both labels counting alike."""
    z = np.where(y == 1, 1, -1) * (x.times(w) + bias)
    return float((np.logaddexp(0, -z) * shares(y)).mean())


def choose_ridge(x: Bits, y: np.ndarray, ridges: tuple[float, ...] = RIDGES) -> float:
    """The ridge with the least balanced loss on every fourth row, fitted on the others."""
    test = np.arange(len(y)) % 4 == 0
    if len(set(y[test].tolist())) < 2 or len(set(y[~test].tolist())) < 2:
        return ridges[0]
    losses = [balanced_loss(x.pick(test), y[test], *logistic(x.pick(~test), y[~test], r, CHOICE_STEPS)) for r in ridges]
    return ridges[int(np.argmin(losses))]


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, features: int = FEATURES, orders=ORDERS,
        bits: int = BUCKET_BITS) -> Model:
    """Fits on a bounded sample of labelled rows: at most ``sample[label]`` of each label.

    ``labels`` needs doc_id and toxic; null ids or labels are left out, and an id
    labelled twice counts with its larger label. Bucket counts and the feature
    rows are made in the tasks that read the texts. The driver gets at most
    2^bits counts per label, then one bit set of ``features`` bits per sampled row.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for label, n in (sample or SAMPLE).items()]
    chosen = parts[0].union(parts[1])
    # at most sum(sample) ids, so the broadcast is bounded
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * size, dtype=np.int64)
        n = np.zeros(2, dtype=np.int64)
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in text_slices(batch):
                own = toxic[first:first + len(texts)].astype(np.int64)
                owner, bucket = present(texts, orders, bits)
                sums += np.bincount(own[owner] * size + bucket, minlength=2 * size)
                n += np.bincount(own, minlength=2)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-2, -1]])), pa.array(np.concatenate([sums[at], n]))], names=["bucket", "n"])

    found = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = (found[c].to_numpy() for c in ("bucket", "n"))
    n0, n1 = (int(n[bucket == k].sum()) for k in (-2, -1))
    if not n0 or not n1:
        return Model(-20.0 if n0 or not n1 else 20.0, np.zeros(size), orders, bits)
    counts = np.zeros(2 * size)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    ratio = log_ratios(counts[size:], counts[:size], n1, n0)
    # clearness: the ratio weighed by how far the count lies from what the label shares predict
    both = counts[size:] + counts[:size]
    expected = both * n1 / (n0 + n1)
    clear = np.abs(counts[size:] - expected) / np.sqrt(expected * n0 / (n0 + n1) + 1)
    kept = np.sort(np.argsort(-clear, kind="stable")[:features])
    kept = kept[both[kept] > 0]
    place = np.full(size, -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    sent = spark.sparkContext.broadcast(place)

    def bitsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        for batch in batches:
            for first, texts in text_slices(batch):
                owner, bucket = present(texts, orders, bits, place >= 0)
                grid = np.zeros((len(texts), len(kept)), dtype=bool)
                grid[owner, place[bucket]] = True
                packed = np.packbits(grid, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([r.tobytes() for r in packed], pa.binary())], names=["toxic", "bits"])

    table = rows.mapInArrow(bitsets, "toxic int, bits binary").toArrow()
    # in the order of the rows' content, whatever task they came from
    ordered = sorted(zip(table["toxic"].to_pylist(), table["bits"].to_pylist(), strict=True))
    del table
    y = np.array([t for t, _ in ordered], dtype=np.float64)
    x = Bits(np.frombuffer(b"".join(b for _, b in ordered), np.uint8).reshape(len(ordered), -1), ratio[kept])
    del ordered
    bias, w = logistic(x, y, choose_ridge(x, y))
    weights = np.zeros(size)
    weights[kept] = w * ratio[kept]
    return Model(bias, weights, orders, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) for every row of ``docs``; only doc_id and text are read.

    Null and empty texts get the score of a text without features. Where one
    label was never seen, every text gets the other label's extreme score; with
    no labels at all the score is close to 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sent.value.score(texts))], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, with a score below ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch):
                yield batch.slice(first, len(texts)).filter(pa.array(sent.value.score(texts) < threshold))

    return docs.mapInArrow(apply, docs.schema)
