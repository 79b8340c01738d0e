"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank of frequency in the corpus, so that common ids
take one byte. Two-bit lengths stand apart in control bytes, four ids to one,
and the low bytes of the ranks follow in a data column; both are decoded in
numpy by table lookup, without a loop over ids.

A file set is three Parquet folders: ``ids`` (part, at, before, doc_id, control,
data, n_tokens: one row per document; part after part, and row after row by
``at``, holds the next document; ``before`` counts the ids before it in its
part), ``parts`` (part, base: ids before the part) and ``ranks`` (rank, id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..cluster import scratch_path
from .batches import text_slices, within
from .vocabulary import chunk_ids, chunks, vocabulary_size

END_ID = 2

#: For each control byte: the lengths of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)

#: Ids that a task turns into numpy arrays at once.
SLICE_IDS = 500_000


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(controls, data) of documents whose ranks (unsigned, below 2^32) stand one after another."""
    size = (1 + (ranks >= 1 << 8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)).astype(np.uint8)
    quads = -(-counts // 4)
    slots = np.zeros(4 * int(quads.sum()), dtype=np.uint8)
    slots[np.repeat(4 * (np.cumsum(quads) - quads), counts) + within(counts)] = size - 1
    control = np.bitwise_or.reduce(slots.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8), axis=1).tobytes()
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
    return _cut(control, quads), _cut(data, np.diff(_ends(size)[_ends(counts)]))


def decode_ranks(controls: list[bytes], data: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Ranks of documents, one after another: lengths by table lookup, then one gather of bytes."""
    quads = np.fromiter(map(len, controls), np.int64, len(controls))
    lengths = LENGTHS[np.frombuffer(b"".join(controls), np.uint8)].reshape(-1)
    size = lengths[np.repeat(4 * (np.cumsum(quads) - quads), counts) + within(counts)]
    octets = np.zeros((len(size), 4), dtype=np.uint8)
    octets[np.arange(4) < size[:, None]] = np.frombuffer(b"".join(data), np.uint8)
    return octets.view("<u4").reshape(-1)


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _cut(data: bytes, counts: np.ndarray) -> list[bytes]:
    """Consecutive parts of the given lengths."""
    at = _ends(counts).tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


def _spans(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most SLICE_IDS ids; a longer document is a range of its own."""
    first, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if i > first and held + n > SLICE_IDS:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(counts):
        yield first, len(counts)


def id_width(vocabulary: str, end_id: int) -> int:
    return 4 if max(vocabulary_size(vocabulary), end_id + 1) > 1 << 16 else 2


#: In place of n_tokens in the row in which a task counts its ids.
COUNTS = -1


def encode(docs: DataFrame, vocabulary: str, end_id: int = END_ID, counted: bool = False) -> DataFrame:
    """doc_id, ids (two bytes each, or four for a vocabulary above 65,536), n_tokens with the end id.

    With ``counted``, every task adds one row with n_tokens = COUNTS, whose
    ``ids`` are the counts of its ids as 64-bit numbers.
    """
    width = id_width(vocabulary, end_id)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = chunk_ids(vocabulary, width), end_id.to_bytes(width, "little")
        sums, kind = np.zeros(max(vocabulary_size(vocabulary), end_id + 1), dtype=np.int64), None
        for batch in batches:
            for first, texts in text_slices(batch):
                ids = [b"".join(map(known.__getitem__, chunks(t))) + end for t in texts]
                kind = batch.column(0).type
                if counted:
                    sums += np.bincount(np.frombuffer(b"".join(ids), f"<u{width}"), minlength=len(sums))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(ids, pa.binary()),
                                                  pa.array([len(b) // width for b in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])
        if counted and kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([sums.astype("<i8").tobytes()], pa.binary()), pa.array([COUNTS], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tokens, f"doc_id {kind}, ids binary, n_tokens long")


def rank_ids(counts: DataFrame) -> DataFrame:
    """rank, id: ids by falling count, then by id, from the counts of all tasks. At most one row per id of the vocabulary."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0).to_pylist():
                n = np.frombuffer(row, "<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    found = counts.select("ids").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    found = found.sort_values(["n", "id"], ascending=[False, True])
    return counts.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(found["id"])], "rank long, id long")


def write_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encodes every row of ``docs`` (doc_id, text; other columns are ignored) into the folder ``path``.

    Rows go in ascending doc_id order, null ids first, rows with one id in order
    of their ids' bytes; null text counts as empty and gives the end id alone. An
    empty table gives an empty file set. The order comes from a range-partitioned
    sort, so no task holds more than its range; one row per range is added up.
    """
    spark = docs.sparkSession
    width = id_width(vocabulary, end_id)
    raw = scratch_path(spark, "token-ids")
    encode(docs, vocabulary, end_id, counted=True).write.option("compression", "zstd").parquet(raw)
    encoded = spark.read.parquet(raw)
    ranked = rank_ids(encoded.where(F.col("n_tokens") == COUNTS))
    encoded = encoded.where(F.col("n_tokens") != COUNTS)
    ranked.coalesce(1).write.parquet(f"{path}/ranks")
    ids = [r["id"] for r in ranked.collect()]
    table = np.zeros(max(ids, default=0) + 1, dtype=np.uint32)
    table[ids] = np.arange(len(ids), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(table)

    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "ids"]
    laid = encoded.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes the sorted rows of a range and gives each its place and the ids before it."""
        part, at, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            counts = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in _spans(counts):
                n = counts[a:b]
                ids = np.frombuffer(b"".join(batch.column(1).slice(a, b - a).to_pylist()), f"<u{width}")
                controls, data = encode_ranks(sent.value[ids], n)
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part)), pa.array(np.arange(at, at + len(n))), pa.array(ends - n), batch.column(0).slice(a, b - a),
                     pa.array(controls, pa.binary()), pa.array(data, pa.binary()), pa.array(n)], names=["part", "at", "before", "doc_id", "control", "data", "n_tokens"])
                at, before = at + len(n), int(ends[-1])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"part long, at long, before long, doc_id {kind}, control binary, data binary, n_tokens long"
    laid.mapInArrow(code, schema).write.option("compression", "zstd").parquet(f"{path}/ids")
    stored = spark.read.parquet(f"{path}/ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/parts")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (four bytes each, little-endian) of a file set, in no particular row order.

    ``start`` is the number of ids before the document. The tables that are sent
    to all tasks hold one row per id of the vocabulary and one per file.
    """
    stored = spark.read.parquet(f"{path}/ids")
    rank = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    sent = spark.sparkContext.broadcast(np.array(rank, dtype="<u4"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(4).to_numpy(zero_copy_only=False)
            for a, b in _spans(counts):
                part = batch.slice(a, b - a)
                ids = sent.value[decode_ranks(part.column(2).to_pylist(), part.column(3).to_pylist(), counts[a:b])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(4), pa.array(_cut(ids.tobytes(), 4 * counts[a:b]), pa.binary())],
                                                 names=["doc_id", "start", "n_tokens", "ids"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    placed = stored.join(F.broadcast(spark.read.parquet(f"{path}/parts")), "part")
    rows = placed.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "control", "data", "n_tokens")
    return rows.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids binary")
