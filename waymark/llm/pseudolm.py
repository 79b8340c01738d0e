"""Document scores by masked pseudo-likelihood.

A network sees the tokens on both sides of a masked one and predicts it. Tokens
are lower-cased characters; every character of the corpus has its own. All
windows of the corpus are counted into a Spark table, tasks train the network on
partitions of its rows, and a document's score is the sum of the
log-probabilities of its tokens, each given its true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..cluster import scratch_path
from .batches import ODD, mix64, segment_index, text_slices

EDGE, OTHER = 0, 1  # beyond a text; a character that the fitted corpus lacks
SIDE = 2  # tokens on each side
HIDDEN = 48
PARTS, ROUNDS, STEPS, BATCH = 16, 5, 100, 2048
RATE = 0.02
#: Windows that one task trains on, and that a counting task holds at once.
PART_ROWS, HELD = 1 << 20, 1 << 23
#: Cells of the largest softmax made at once, weights that are averaged as one row, log-probabilities that a scoring task remembers.
CELLS, BLOCK, CACHE_BITS = 1 << 22, 1 << 16, 22


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, characters per text), lower-cased."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.fromiter(map(len, lowered), np.int64, len(lowered))


def layout(tokens: int, side: int) -> tuple[int, list[range]]:
    """(bits a token, positions per 64-bit key): how a window of 2 side + 1 tokens is packed."""
    bits = max(tokens - 1, 1).bit_length()
    n, per = 2 * side + 1, 63 // bits
    return bits, [range(at, min(at + per, n)) for at in range(0, n, per)]


def windows(texts: list[str], table: np.ndarray, side: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys, characters per text): the window around each token, packed into one or more columns."""
    codes, lengths = characters(texts)
    bits, columns = layout(int(table.max()) + 1, side)
    at = np.arange(len(codes)) + side * (segment_index(lengths) + 1)
    padded = np.full(len(codes) + side * (len(texts) + 1), EDGE, dtype=np.int64)
    padded[at] = table[np.minimum(codes, len(table) - 1)]
    first, keys = at - side, []
    n = max(len(padded) - 2 * side, 0)
    for positions in columns:
        key = np.zeros(n, dtype=np.int64)
        for k in positions:
            key <<= bits
            key |= padded[k:k + n]
        keys.append(key[first])
    return keys, lengths


def unpack(keys: list[np.ndarray], tokens: int, side: int) -> np.ndarray:
    """One row of 2 side + 1 tokens per window; the masked one is column ``side``."""
    bits, columns = layout(tokens, side)
    return np.stack([key >> bits * (len(p) - 1 - i) & (1 << bits) - 1 for key, p in zip(keys, columns, strict=True) for i in range(len(p))], axis=1)


def distinct(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct windows in order, count of each)."""
    if len(keys) == 1:
        one, n = np.unique(keys[0], return_counts=True)
        return [one], n
    order = np.lexsort(keys[::-1])
    ordered = [k[order] for k in keys]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in ordered], axis=0)
    at = np.flatnonzero(fresh)
    return [k[at] for k in ordered], np.diff(np.append(at, len(order)))


class Network:
    """Position-wise rows for the context tokens, one tanh layer, a softmax over all tokens."""

    def __init__(self, inner: np.ndarray, inner_bias: np.ndarray, outer: np.ndarray, outer_bias: np.ndarray):
        self.parts = [inner, inner_bias, outer, outer_bias]

    @property
    def side(self) -> int:
        return len(self.parts[0]) // 2

    @property
    def tokens(self) -> int:
        return self.parts[0].shape[1]

    @classmethod
    def start(cls, tokens: int, side: int = SIDE, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.1, (2 * side, tokens, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
                   r.normal(0, 0.1, (HIDDEN, tokens)).astype(np.float32), np.zeros(tokens, np.float32))

    def forward(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden, log-probabilities) of contexts: one row of neighbours each."""
        inner, inner_bias, outer, outer_bias = self.parts
        hidden = np.tanh(sum(inner[k][near[:, k]] for k in range(near.shape[1])) + inner_bias)
        z = hidden @ outer + outer_bias
        z[:, EDGE] = -1e9  # a token of a text is never the edge
        z -= z.max(axis=1, keepdims=True)
        return hidden, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def log_probs(self, keys: list[np.ndarray]) -> np.ndarray:
        """Log-probability of the masked token of each window."""
        out, rows = np.zeros(len(keys[0]), dtype=np.float32), max(1, CELLS // self.tokens)
        for at in range(0, len(out), rows):
            all_ = unpack([k[at:at + rows] for k in keys], self.tokens, self.side)
            logs = self.forward(np.delete(all_, self.side, axis=1))[1]
            out[at:at + rows] = logs[np.arange(len(all_)), all_[:, self.side]]
        return out

    def gradients(self, near: np.ndarray, target: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-probability of the targets, each counted ``n`` times."""
        inner, _, outer, _ = self.parts
        hidden, logs = self.forward(near)
        error = np.exp(logs)
        error[np.arange(len(near)), target] -= 1
        error *= (n / n.sum())[:, None]
        back = (error @ outer.T) * (1 - hidden * hidden)
        rows = np.zeros_like(inner)
        for k in range(near.shape[1]):
            some, where = np.unique(near[:, k], return_inverse=True)
            hot = np.zeros((len(near), len(some)), dtype=np.float32)
            hot[np.arange(len(near)), where] = 1
            rows[k][some] = hot.T @ back
        return [rows, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]

    def train(self, keys: list[np.ndarray], counts: np.ndarray, steps: int, rate: float, seed: int) -> None:
        """Adam over batches of windows in random order, pass after pass: ``steps`` at least, and every window once at least."""
        order, r = np.arange(len(counts)), np.random.default_rng(seed)
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        batch = max(1, min(BATCH, CELLS // self.tokens))
        per_pass = -(-len(order) // batch)
        for step in range(1, max(steps, per_pass) + 1):
            at = (step - 1) % per_pass * batch
            if at == 0:
                r.shuffle(order)
            pick = order[at:at + batch]
            all_ = unpack([k[pick] for k in keys], self.tokens, self.side)
            found = self.gradients(np.delete(all_, self.side, axis=1), all_[:, self.side], counts[pick])
            for p, g, a, b in zip(self.parts, found, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def pack(self) -> bytes:
        return b"".join(p.astype("<f4").tobytes() for p in self.parts)

    @classmethod
    def from_bytes(cls, data: bytes, tokens: int, side: int) -> Network:
        flat, out, at = np.frombuffer(data, "<f4"), [], 0
        for shape in ((2 * side, tokens, HIDDEN), (HIDDEN,), (HIDDEN, tokens), (tokens,)):
            n = int(np.prod(shape))
            out.append(flat[at:at + n].reshape(shape).copy())
            at += n
        return cls(*out)


def vocabulary(docs: DataFrame) -> np.ndarray:
    """Code point -> token for every character of all texts, the most frequent first; ties go to the smaller code point."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for _, texts in text_slices(batch):
                n = np.bincount(characters(texts)[0], minlength=len(sums))
                n[:len(sums)] += sums
                sums = n
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["code", "n"])

    counts = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # one row per code point, so Unicode bounds what comes to the driver
    found = counts.toPandas().sort_values(["n", "code"], ascending=[False, True])["code"].to_numpy()
    table = np.full(int(found.max(initial=0)) + 2, OTHER, dtype=np.int64)
    table[found] = np.arange(2, 2 + len(found))
    return table


def window_counts(docs: DataFrame, table: np.ndarray, side: int = SIDE) -> DataFrame:
    """k0, k1, ... (the packed window), n: how often each window occurs in all texts."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    names = [f"k{i}" for i in range(len(layout(int(table.max()) + 1, side)[1]))]

    def rows(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, n = distinct([np.concatenate(column) for column in zip(*held, strict=True)])
        for at in range(0, len(n), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 18)]) for c in (*keys, n)], names=[*names, "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, texts in text_slices(batch):
                held.append(windows(texts, sent.value, side)[0])
                size += len(held[-1][0])
                if size >= HELD:
                    yield from rows(held)
                    held, size = [], 0
        if size:
            yield from rows(held)

    found = docs.select("text").mapInArrow(count, ", ".join(f"{k} long" for k in (*names, "n")))
    return found.groupBy(*names).agg(F.sum("n").alias("n"))


def _learner(sent, tokens: int, side: int, number: int, steps: int, rate: float):
    """Trains a copy of the network on one share of the windows; gives its weights in blocks."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c for c in pdf.columns if c not in ("part", "n")]
        pdf = pdf.sort_values(names)
        own = Network.from_bytes(sent.value, tokens, side)
        own.train([pdf[c].to_numpy() for c in names], pdf["n"].to_numpy(dtype=np.float32), steps, rate / (1 + number), number)
        data = own.pack()
        blocks = [data[at:at + 4 * BLOCK] for at in range(0, len(data), 4 * BLOCK)]
        return pd.DataFrame({"block": range(len(blocks)), "part": pdf["part"].iloc[0], "seen": float(pdf["n"].sum()), "weights": blocks})

    return learn


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of weights, averaged over the copies by the tokens that they saw."""
    pdf = pdf.sort_values("part")
    share = pdf["seen"].to_numpy() / pdf["seen"].sum()
    mean = sum(np.frombuffer(w, "<f4").astype(np.float64) * x for w, x in zip(pdf["weights"], share, strict=True))
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "weights": [mean.astype("<f4").tobytes()]})


def fit(docs: DataFrame, rounds: int = ROUNDS, steps: int = STEPS, parts: int = PARTS, rate: float = RATE, side: int = SIDE) -> tuple[np.ndarray, Network]:
    """(token table, network) learned from every window of every text.

    Windows are dealt to ``parts`` tasks, or more where a task would get above
    PART_ROWS. In every round each task trains a copy of the network on all rows
    of its share, and the copies are averaged by the tokens they saw.
    """
    spark = docs.sparkSession
    table = vocabulary(docs)
    path = scratch_path(spark, "windows")
    window_counts(docs, table, side).write.parquet(path)
    counted = spark.read.parquet(path)
    parts = max(parts, -(-counted.count() // PART_ROWS))
    dealt = counted.withColumn("part", F.pmod(F.xxhash64(*[c for c in counted.columns if c != "n"]), F.lit(parts)).cast("int"))
    network = Network.start(int(table.max()) + 1, side)
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(network.pack())
        learn = _learner(sent, network.tokens, side, number, steps, rate)
        copies = dealt.groupBy("part").applyInPandas(learn, "block int, part int, seen double, weights binary")
        blocks = copies.groupBy("block").applyInPandas(_mean, "block int, weights binary").collect()
        if not blocks:
            break
        data = b"".join(bytes(r["weights"]) for r in sorted(blocks, key=lambda r: r["block"]))
        network = Network.from_bytes(data, network.tokens, side)
    return table, network


class Scorer:
    """Log-probabilities of windows, with a table of fixed size of those met before."""

    def __init__(self, table: np.ndarray, network: Network):
        self.table, self.network = table, network
        columns = layout(network.tokens, network.side)[1]
        self.keys = [np.full(1 << CACHE_BITS, -1, dtype=np.int64) for _ in columns]
        self.logs = np.zeros(1 << CACHE_BITS, dtype=np.float32)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, summed log-probability) per text."""
        keys, lengths = windows(texts, self.table, self.network.side)
        code = keys[0].astype(np.uint64)
        for key in keys[1:]:
            code = mix64(code) ^ key.astype(np.uint64)
        slot = (code * ODD >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        known = np.ones(len(slot), dtype=bool)
        for key, kept in zip(keys, self.keys, strict=True):
            known &= kept[slot] == key
        logs, new = self.logs[slot], np.flatnonzero(~known)
        if len(new):
            # windows of one slot come together; equal ones are computed once
            new = new[np.lexsort([*[k[new] for k in keys], slot[new]])]
            fresh = np.ones(len(new), dtype=bool)
            fresh[1:] = np.any([k[new[1:]] != k[new[:-1]] for k in keys], axis=0)
            once = new[fresh]
            found = self.network.log_probs([k[once] for k in keys])
            logs[new] = found[np.cumsum(fresh) - 1]
            last = np.append(slot[once[1:]] != slot[once[:-1]], True)
            for key, kept in zip(keys, self.keys, strict=True):
                kept[slot[once[last]]] = key[once[last]]
            self.logs[slot[once[last]]] = found[last]
        return lengths, np.bincount(segment_index(lengths), logs, minlength=len(texts)).astype(np.float64)


def score(docs: DataFrame, table: np.ndarray, network: Network) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum), mean_log_prob for every row of ``docs``.

    Only doc_id and text are read. Null and empty texts have no tokens, log_prob
    0 and mean_log_prob null. Repeated rows are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast((table, network))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            for first, texts in text_slices(batch):
                n, total = scorer.score(texts)
                mean = [t / k if k else None for t, k in zip(total.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n), pa.array(total), pa.array(mean, pa.float64())],
                                                 names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {kind}, n_tokens long, log_prob double, mean_log_prob double")
