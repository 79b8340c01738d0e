"""Exact dedup by content sort, in DataFrame functions only.

Normalised texts are dealt to range partitions at sampled splitters, sorted
externally, and compared in full with their neighbours: a window over the
sorted text ends a group exactly where two neighbours differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import cut_lineage

#: The splitters hold this many leading characters, then a hash, so that what
#: Spark samples stays small however long the texts are.
HEAD_CHARS = 16
#: A group above both of these is dealt out in pieces.
PIECE_ROWS = 100
PIECE_SHARE = 1e-4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def content_sort(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and whether it stays.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Columns
    of the result: doc_id, keep_id, group_size, kept, text_sha256.

    - Null text counts as empty; empty texts form one group.
    - The largest doc_id of a group stays. Null ids come last; a group of null
      ids only has keep_id null. Of rows that share the largest id, one stays.
    - An empty table gives an empty result.

    A group may be a third of all rows. Its rows are counted by hash first
    (slim, combined before the shuffle) and groups above the limit are dealt out
    in pieces by id; pieces are joined again over their digests. At most
    1 / PIECE_SHARE groups can be that large, which bounds the broadcast tables.
    """
    slim = docs.select("doc_id", normalised(F.col("text")).alias("_norm")).withColumn("_hash", F.xxhash64("_norm"))
    piece_rows = max(PIECE_ROWS, int(docs.count() * PIECE_SHARE))
    hot = (
        slim.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > piece_rows)
        .select("_hash", F.ceil(F.col("_n") / piece_rows).cast("long").alias("_pieces"))
    )
    dealt = slim.join(F.broadcast(hot), "_hash", "left").select(
        "doc_id", "_norm", "_hash", F.substring("_norm", 1, HEAD_CHARS).alias("_head"), F.col("_pieces").isNotNull().alias("_hot"),
        F.pmod(F.xxhash64("doc_id"), F.coalesce("_pieces", F.lit(1))).alias("_piece"),
    )
    sorted_text = dealt.repartitionByRange("_head", "_hash", "_piece")
    equal = Window.partitionBy("_head", "_hash", "_piece", "_norm").orderBy(F.col("doc_id").desc_nulls_last())
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = cut_lineage(sorted_text.select(
        "doc_id", "_hot", "_norm", F.row_number().over(equal).alias("_rank"), F.first("doc_id").over(whole).alias("_keep"),
        F.count(F.lit(1)).over(whole).alias("_size"),
    ).select("doc_id", "_hot", "_rank", "_keep", "_size", F.sha2("_norm", 256).alias("text_sha256")))
    joined = (
        runs.where(F.col("_hot") & (F.col("_rank") == 1)).groupBy("text_sha256")
        .agg(F.max("_keep").alias("_all_keep"), F.sum("_size").alias("_all_size"))
    )
    keep = F.when(F.col("_all_size").isNull(), F.col("_keep")).otherwise(F.col("_all_keep"))
    return runs.join(F.broadcast(joined), "text_sha256", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_all_size", "_size").alias("group_size"),
        ((F.col("_rank") == 1) & F.col("_keep").eqNullSafe(keep)).alias("kept"), "text_sha256",
    )
