"""Line dedup against a sharded minimal perfect hash.

Distinct line hashes that enough documents hold are dealt to shards. A shard is
a minimal perfect hash (bit levels with ranks) over its keys and three arrays
in rank order: fingerprint, document count and the id that keeps the line.
Documents probe the arrays where their text is; lines are never joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..cluster import scratch_path
from .batches import ODD, mix64, text_slices

MIN_CHARS, MIN_DOCS = 40, 5
#: White space that a key loses at both ends: ASCII 32 and 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 1 << 18
#: Bytes of index that one pass over the documents loads.
PASS_BYTES = 64 << 20
NO_OWNER = -(1 << 63)  # all holders have a null id

INDEX = "shard int, n long, levels array<long>, bits binary, ranks binary, fingerprints binary, counts binary, owners binary, bytes long"


def line_keys(text: str, min_chars: int = MIN_CHARS) -> tuple[list[str], list[int], bytes]:
    """Lines of a text, which of them have a key long enough, and the 16-byte hashes of those keys."""
    lines = text.split("\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(SPACE)
            if len(key) >= min_chars:
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(key.encode().lower()))  # bytes.lower() changes A-Z only
    return lines, at, b"".join(digests)


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Slot of two-word keys at one level of a shard."""
    one, two = (np.uint64(int(ODD) * (2 * level + k) % (1 << 64)) for k in (1, 2))
    x = mix64(keys[:, 0] + one) ^ mix64(keys[:, 1] + two)
    return (mix64(x) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(slots per level, bit words, set bits before each word) of distinct two-word keys."""
    sizes, words, left = [], [], keys
    while len(left):
        size = 64 * math.ceil(2 * len(left) / 64)
        slot = _level(left, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = left[~alone[slot]]
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]]) if len(bits) else np.zeros(0)
    return sizes, bits, ranks.astype(np.uint32)


def rank_of(keys: np.ndarray, sizes, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Index of each key, -1 for some of those that are not in the hash."""
    out = np.full(len(keys), -1, dtype=np.int64)
    open_, first = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(open_):
            break
        slot = _level(keys[open_], level, size) + first * 64
        word, bit = slot >> 6, (slot & 63).astype(np.uint64)
        hit = (bits[word] >> bit) & np.uint64(1) == 1
        below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        out[open_[hit]] = ranks[word[hit]].astype(np.int64) + np.bitwise_count(below)
        open_, first = open_[~hit], first + size // 64
    return out


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, n_docs, owner for every distinct key: a document counts once, owner is the largest id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_slices(batch):
                rows, keys = [], []
                for i, text in enumerate(texts):
                    digest = np.frombuffer(line_keys(text, min_chars)[2], np.int64).reshape(-1, 2)
                    if len(digest):
                        digest = np.unique(digest, axis=0) if len(digest) > 1 else digest
                        keys.append(digest)
                        rows.append((first + i, len(digest)))
                if rows:
                    at, n = np.array(rows).T
                    both = np.concatenate(keys)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(at, n))), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "h1", "h2"])

    held = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, "doc_id long, h1 long, h2 long")
    return held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("owner"))


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """The stored index: one row per shard, in the shared folder.

    Distinct keys below ``min_docs`` documents can never lose a line and take no
    room; the 64-bit fingerprints keep their probes from matching another key.
    """
    spark = docs.sparkSession
    kept = scratch_path(spark, "line-counts")
    line_counts(docs, min_chars).where(F.col("n_docs") >= min_docs).write.parquet(kept)
    frequent = spark.read.parquet(kept)
    bits = max(0, math.ceil(math.log2(max(frequent.count() / keys_per_shard, 1))))
    shard = F.shiftrightunsigned("h1", 64 - bits).cast("int") if bits else F.lit(0)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[["h1", "h2"]].to_numpy().astype(np.int64).view(np.uint64)
        sizes, words, ranks = build_hash(keys)
        order = np.empty(len(keys), dtype=np.int64)
        order[rank_of(keys, sizes, words, ranks)] = np.arange(len(keys))
        owner = pdf["owner"].fillna(NO_OWNER).to_numpy().astype(np.int64)
        row = [words.tobytes(), ranks.tobytes(), keys[order, 1].tobytes(), pdf["n_docs"].to_numpy().astype(np.int64)[order].tobytes(), owner[order].tobytes()]
        return pd.DataFrame([[pdf["shard"].iloc[0], len(keys), sizes, *row, sum(map(len, row))]],
                            columns=["shard", "n", "levels", "bits", "ranks", "fingerprints", "counts", "owners", "bytes"])

    path = scratch_path(spark, "line-index")
    # a null owner would turn ids into floats in pandas, so it travels as a marked value
    keyed = frequent.select(shard.alias("shard"), "h1", "h2", "n_docs", F.coalesce("owner", F.lit(NO_OWNER)).alias("owner"))
    keyed.groupBy("shard").applyInPandas(build, INDEX).write.parquet(path)
    return spark.read.parquet(path)


def _probe(keys: np.ndarray, shards: dict[int, tuple], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(is indexed, owner) of two-word keys against the loaded shards."""
    found, owner = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    home = (keys[:, 0] >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), dtype=np.int64)
    for number in np.unique(home).tolist():
        if number in shards:
            at = np.flatnonzero(home == number)
            sizes, bits, ranks, prints, owners = shards[number]
            slot = rank_of(keys[at], sizes, bits, ranks)
            hit = slot >= 0
            hit[hit] = prints[slot[hit]] == keys[at[hit], 1]
            found[at[hit]], owner[at[hit]] = True, owners[slot[hit]]
    return found, owner


def _load(rows) -> dict[int, tuple]:
    return {r["shard"]: (list(r["levels"]), np.frombuffer(r["bits"], np.uint64), np.frombuffer(r["ranks"], np.uint32),
                         np.frombuffer(r["fingerprints"], np.uint64), np.frombuffer(r["owners"], np.int64)) for r in rows}


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                        keys_per_shard: int = KEYS_PER_SHARD, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, text (what stays), n_lines (before), n_dropped for every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. A line's key is
    the line without ASCII white space at its ends, A-Z lower-cased. A key of at
    least ``min_chars`` code points in at least ``min_docs`` documents loses its
    lines everywhere but in the largest doc_id that holds it.

    - Null and empty texts are one empty line.
    - Every row counts as a document; rows that share the largest id all keep
      their lines. A null id never wins over another; where all holders have
      null ids they keep their lines.
    - An empty table gives an empty result.

    The index is read in groups of shards of at most ``pass_bytes``, the size
    checked before each group is sent to the tasks. With one group the texts are
    cut in that pass; with more, each pass emits the few hits it finds and the
    texts are cut once, by id and row, at the end.
    """
    spark = docs.sparkSession
    index = build_index(docs, min_chars, min_docs, keys_per_shard)
    weights = sorted((r["shard"], r["bytes"], r["n"]) for r in index.select("shard", "bytes", "n").collect())
    bits = max(0, math.ceil(math.log2(max(sum(w[2] for w in weights) / keys_per_shard, 1))))
    groups: list[list[int]] = [[]]
    room = pass_bytes
    for number, size, _ in weights:
        if groups[-1] and size > room:
            groups.append([])
            room = pass_bytes
        groups[-1].append(number)
        room -= size

    def doomed(shards: dict, texts: list[str], ids: list):
        """Per text: its lines, and which of them go."""
        parts = [line_keys(t, min_chars) for t in texts]
        keys = np.frombuffer(b"".join(p[2] for p in parts), np.uint64).reshape(-1, 2)
        found, owner = _probe(keys, shards, 64 - bits)
        start = 0
        for (lines, at, _), own in zip(parts, ids, strict=True):
            gone = found[start:start + len(at)] & (owner[start:start + len(at)] != (NO_OWNER if own is None else own))
            yield lines, [at[j] for j in np.flatnonzero(gone).tolist()]
            start += len(at)

    def send(numbers: list[int]):
        rows = index.where(F.col("shard").isin(numbers)).collect() if numbers else []
        return spark.sparkContext.broadcast([r.asDict() for r in rows])

    source = docs.select(F.col("doc_id").cast("long"), "text")
    if len(groups) == 1:
        sent = send(groups[0])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = _load(sent.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, texts in text_slices(batch):
                    kept, n_lines, n_dropped = [], [], []
                    for lines, gone in doomed(shards, texts, ids[first:first + len(texts)]):
                        out = set(gone)
                        kept.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else "\n".join(lines))
                        n_lines.append(len(lines))
                        n_dropped.append(len(out))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(kept, pa.string()),
                                                      pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                                     names=["doc_id", "text", "n_lines", "n_dropped"])

        return source.mapInArrow(cut, "doc_id long, text string, n_lines long, n_dropped long")

    hits = None
    for numbers in groups:
        sent = send(numbers)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shards = _load(sent.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, texts in text_slices(batch):
                    rows = [(i, g, hash_) for i, ((_, gone), hash_) in enumerate(zip(doomed(shards, texts, ids[first:first + len(texts)]),
                                                                                    (xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts))) for g in gone]
                    if rows:
                        at, line, hash_ = zip(*rows)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)).take(pa.array(at)), pa.array(hash_, pa.int64()),
                                                          pa.array(line, pa.int64())], names=["doc_id", "_text", "line"])

        path = scratch_path(spark, "line-hits")
        source.mapInArrow(find, "doc_id long, _text long, line long").write.parquet(path)
        part = spark.read.parquet(path)
        hits = part if hits is None else hits.union(part)
    # equal rows (same id and text) lose the same lines, so a set of line numbers per id and text is enough
    gone = hits.groupBy("doc_id", "_text").agg(F.collect_set("line").alias("_gone"))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts.to_pylist()], pa.int64())],
                                             names=["doc_id", "text", "_text"])

    tagged = source.mapInArrow(tag, "doc_id long, text string, _text long")
    joined = tagged.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d._text") == F.col("g._text")), "left")
    lines = F.split("d.text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("_gone", i.cast("long")), x)), lambda x: x.isNotNull())
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), F.when(F.col("_gone").isNull(), F.col("d.text")).otherwise(F.concat_ws("\n", kept)).alias("text"),
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
