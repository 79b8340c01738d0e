"""Mixing sources to target weights with a low-discrepancy schedule.

Every slot of the mix takes one block of equal token count. Slot ``n`` belongs
to the source whose share of the unit interval holds the golden-ratio point
``frac((n + 1) / phi)``, computed in 64-bit integers so that it is exact at any
length. Slots are ranked per source, and rank ``k`` takes block ``k`` of that
source's shuffled stream; a stream holds every document once per epoch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..cluster import cut_lineage
from .batches import ODD

#: Weights by rank of the source name, repeated in this order.
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 256
#: Documents of a source that one window orders at once, and slots that one row of the schedule makes.
CHUNK_ROWS = 256
CHUNK_SLOTS = 65_536


def text_size(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_level(sizes: list[int], weights: list[float], total: float, max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Targets that share ``total`` by weight, none above ``max_epochs`` times its size."""
    caps = [float(max_epochs * s) for s in sizes]
    if total >= sum(caps):
        return caps
    free = set(range(len(sizes)))
    while free:
        level = (total - sum(caps[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i] for i in free)
        above = {i for i in free if weights[i] * level > caps[i]}
        if not above:
            return [weights[i] * level if i in free else caps[i] for i in range(len(sizes))]
        free -= above
    return caps


def targets(sized: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: _s, source, source_size, target, words (the target as a whole number).

    Only one row per source comes to the driver.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in rows]
    weight = [float(weights[i % len(weights)]) for i in range(len(rows))]
    goal = water_level(sizes, weight, share * sum(sizes), max_epochs)
    out = [(i, r["source"], sizes[i], goal[i], min(max_epochs * sizes[i], math.floor(goal[i] + 0.5))) for i, r in enumerate(rows)]
    return sized.sparkSession.createDataFrame(out, "_s int, source string, source_size long, target double, words long")


def schedule(spark, blocks: list[int]) -> DataFrame:
    """slot, _s, block: every block 0 .. blocks[s]-1 of every source, once.

    ``blocks`` are the blocks that each source gives. A source that the points
    reach too often skips the surplus slots; one they reach too seldom (by a few
    slots, the discrepancy of the sequence) gets its last blocks at the end.
    """
    total = sum(blocks)
    cumulative = np.cumsum(np.asarray(blocks, dtype=np.float64)) / max(total, 1)

    def drawn(first: int) -> np.ndarray:
        n = np.arange(first + 1, min(first + CHUNK_SLOTS, total) + 1, dtype=np.uint64)
        u = (n * ODD >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        return np.minimum(np.searchsorted(cumulative, u, side="right"), len(blocks) - 1)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                n = np.bincount(drawn(chunk * CHUNK_SLOTS), minlength=len(blocks))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk)), pa.array(some.astype(np.int32)), pa.array(n[some])],
                                                 names=["_chunk", "_s", "n"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                s = drawn(chunk * CHUNK_SLOTS)
                order = np.argsort(s, kind="stable")
                n = np.bincount(s, minlength=len(blocks))
                rank = np.empty(len(s), dtype=np.int64)
                rank[order] = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), chunk)), pa.array(chunk * CHUNK_SLOTS + np.arange(len(s))),
                                                  pa.array(s.astype(np.int32)), pa.array(rank)], names=["_chunk", "slot", "_s", "_rank"])

    chunks = spark.range(math.ceil(total / CHUNK_SLOTS)).select(F.col("id").alias("_chunk"))
    found = chunks.mapInArrow(counts, "_chunk long, _s int, n long")
    before = Window.partitionBy("_s").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = found.select("_chunk", "_s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = chunks.mapInArrow(slots, "_chunk long, slot long, _s int, _rank long").join(base, ["_chunk", "_s"])
    have = {r["_s"]: r["n"] for r in found.groupBy("_s").agg(F.sum("n").alias("n")).collect()}
    late = [(s, k) for s, n in enumerate(blocks) for k in range(have.get(s, 0), n)]
    tail = spark.createDataFrame([(total + i, s, k) for i, (s, k) in enumerate(late)], "slot long, _s int, block long")
    limit = F.element_at(F.lit([int(b) for b in blocks]) if blocks else F.array(F.lit(0)), F.col("_s") + 1)
    return ranked.select("slot", "_s", (F.col("_base") + F.col("_rank")).alias("block")).where(F.col("block") < limit).unionByName(tail)


def keyed(docs: DataFrame) -> DataFrame:
    """_row, which tells rows apart by id, text and source, then by count; _all holds the whole row."""
    twin = Window.partitionBy("doc_id", "_text").orderBy("source")
    text = F.col("text") if docs.schema["text"].dataType == T.LongType() else F.xxhash64("text")
    rows = docs.select(F.struct(*docs.columns).alias("_all"), "doc_id", "source", text.alias("_text"))
    return rows.select("_all", F.struct("doc_id", "_text", F.row_number().over(twin).alias("_n")).alias("_row"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS,
        block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix of all ``docs``.

    ``docs`` needs doc_id, text, source; other columns are ignored. Sources by
    code point, null last, weigh ``weights`` in turn and share ``share`` times
    all words, none above ``max_epochs`` times its own.

    - documents, one per row: _row (key of the row), doc_id, size, source,
      source_size, target.
    - pieces: slot, _row, epoch, first_word, n_words: the words that each
      slot takes, in the order of the mix.

    Null or empty texts have size 0 and no pieces; null ids and repeated rows are
    told apart by text, then by count. Reruns agree: the shuffle is a hash of
    epoch and id. Streams are ordered by windows over hash chunks of about
    CHUNK_ROWS documents, so a source that holds most rows has many tasks; one
    row per chunk goes through the window that adds the chunks up.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.xxhash64("text").alias("text")))
    sized = cut_lineage(rows.select("_row", "_all.doc_id", "_all.source", "_all.size"))
    goals = targets(sized, weights, share, max_epochs)
    documents = sized.join(F.broadcast(goals), sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])

    digits = max(0, math.ceil(math.log(max(sized.count() / CHUNK_ROWS, 1), 16)))
    stream = documents.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    stream = stream.withColumn("_key", F.md5(F.concat_ws("-", "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    stream = stream.withColumn("_chunk", F.substring("_key", 1, digits) if digits else F.lit(""))
    before = Window.partitionBy("_s").orderBy("epoch", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = stream.groupBy("_s", "epoch", "_chunk").agg(F.sum("size").alias("_n"))
    chunks = chunks.select("_s", "epoch", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_s", "epoch", "_chunk").orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stream.withColumn("_end", F.sum("size").over(inside)).join(chunks, ["_s", "epoch", "_chunk"])
    placed = placed.withColumn("_to", F.least(F.col("_base") + F.col("_end"), "words")).withColumn("_from", F.col("_base") + F.col("_end") - F.col("size"))
    placed = placed.where("_to > _from")
    block = F.explode(F.sequence(F.floor(F.col("_from") / block_words), F.floor((F.col("_to") - 1) / block_words)))
    pieces = placed.withColumn("block", block)
    start, stop = F.greatest("_from", F.col("block") * block_words), F.least("_to", (F.col("block") + 1) * block_words)
    pieces = pieces.select("_s", "block", "_row", "epoch", (start - F.col("_from")).alias("first_word"), (stop - start).alias("n_words"))
    blocks = [math.ceil(r["words"] / block_words) for r in goals.orderBy("_s").collect()]
    slots = schedule(spark, blocks)
    return documents.drop("_s", "words"), pieces.join(slots, ["_s", "block"]).drop("_s", "block")


def taken_words(docs: DataFrame, **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (repeats counted)."""
    documents, pieces = mix(docs, **kw)
    took = pieces.groupBy("_row").agg(F.sum("n_words").alias("taken"))
    return documents.join(took, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame, whole: bool = False, **kw) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one row per document and epoch that it enters.

    A document that the mix takes twice comes twice; one without words never.
    Where the target of a source ends inside a document, that row holds the text
    as it stands up to the last word taken; with ``whole`` it holds all of it, so
    that the source passes its target by less than one document. A column
    ``n_chars`` follows the text.
    """
    _, pieces = mix(docs, **kw)
    took = pieces.groupBy("_row", "epoch").agg(F.sum("n_words").alias("_n"))
    text = F.col("_all.text")
    # each word with the white space before it
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(parts, F.lit(1), F.col("_n").cast("int")), "")
    final = text if whole else F.when(F.col("_n") < text_size(text), cut).otherwise(text)
    rows = keyed(docs).join(took, "_row").withColumn("_text", final)
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col(f"_all.`{c}`")).alias(c) for c in docs.columns])
