"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import ODD, segment_index, text_slices

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
SMOOTHING = 0.1
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Code point -> itself where it is a letter, 0 elsewhere."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], dtype=np.uint32)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with every other run as one 0, and their number per text.

    Every text starts with a 0, so that its first letters are known as such.
    """
    lowered = ["\n" + t.lower() + "\n" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = segment_index(np.fromiter(map(len, lowered), np.int64, len(lowered)))
    codes = _letter_table()[codes]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
    return codes[keep], np.bincount(owner[keep], minlength=len(texts))


def grams(codes: np.ndarray, lengths: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram of one order; none spans two texts, and single non-letters are left out."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, order, dtype=np.uint64)
    for i in range(order):
        h = (h * ODD) ^ codes[i:i + n]
        h ^= h >> np.uint64(29)
    owner = segment_index(lengths)
    inside = owner[:n] == owner[order - 1:]
    if order == 1:
        inside &= codes != 0
    return ((h * ODD) >> np.uint64(64 - bits)).astype(np.int64)[inside], owner[:n][inside]


class Model:
    """Languages, log priors and the log-probability matrix [bucket, language]."""

    def __init__(self, langs: list[str], prior: np.ndarray, matrix: np.ndarray, orders=ORDERS, bits: int = BUCKET_BITS):
        self.langs, self.prior, self.matrix, self.orders, self.bits = langs, prior, matrix, orders, bits

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, posterior) per text: sparse rows of n-gram counts times the matrix."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        codes, lengths = letters(texts)
        total = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), dtype=np.int64)
        for order in self.orders:
            bucket, owner = grams(codes, lengths, order, self.bits)
            n = np.bincount(owner, minlength=len(texts))
            if order == 1:
                seen = n
            some = np.flatnonzero(n)
            if len(some):
                total[some] += np.add.reduceat(self.matrix[bucket], (np.cumsum(n) - n)[some], axis=0)
        total += self.prior
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, seen)], np.where(seen > 0, share, 0.0)


def fit(labelled: DataFrame, orders=ORDERS, bits: int = BUCKET_BITS, smoothing: float = SMOOTHING) -> Model:
    """Learns from all rows of ``labelled`` (lang, text); rows without lang or text are left out.

    Tasks count buckets in numpy and Spark adds the counts up. The driver gets
    one number per language and bucket; its size grows with the languages only.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in text_slices(batch):
                part = langs[first:first + len(texts)]
                names = sorted(set(part))
                number = np.array([names.index(x) for x in part])
                codes, lengths = letters(texts)
                found = np.zeros(len(names) * size, dtype=np.int64)
                for order in orders:
                    bucket, owner = grams(codes, lengths, order, bits)
                    found += np.bincount(number[owner] * size + bucket, minlength=len(found))
                for i, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + found[i * size:(i + 1) * size]
                    docs[name] = docs.get(name, 0) + part.count(name)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(n[at], docs[name]))],
                                             names=["lang", "bucket", "n"])

    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    found = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((size, len(langs)))
    docs = np.zeros(len(langs))
    for i, name in enumerate(langs):
        own = found[found["lang"] == name]
        docs[i] = own.loc[own["bucket"] < 0, "n"].sum()
        own = own[own["bucket"] >= 0]
        counts[own["bucket"].to_numpy(), i] = own["n"]
    matrix = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * size) if langs else counts
    return Model(langs, np.log(docs / docs.sum()) if langs else docs, matrix.astype(np.float32), orders, bits)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (posterior of that language) for every row of ``docs``.

    Only doc_id and text are read; a ``lang`` column or any other is ignored.
    Texts that are null or hold no letter get ``und`` and score 0, as does every
    text when nothing was learned. Ties go to the first language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch):
                langs, score = sent.value.score(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(langs, pa.string()), pa.array(score)],
                                                 names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {kind}, lang_pred string, score double")
