"""Order-dependent operators without one-task windows.

A window over (crawl) would put a hot crawl into a single task. Instead rows
get an exact position per key from a range-partitioned sort, and windows run
over fixed-size blocks of positions. Each block carries the few rows before it
that its frame needs; running values cross blocks through one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import cut_lineage

BLOCK_ROWS = 65_536


def with_position(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``pos``: 1-based arrival position within ``keys``.

    Order columns must be unique within a key. The sorted rows are checkpointed
    once, because partition numbers must not change between the two reads.
    """
    sort = [*keys, *order]
    laid = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    laid = cut_lineage(laid.withColumn("_gid", F.monotonically_increasing_id()))
    part = F.shiftright("_gid", 33)
    runs = laid.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_gid").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first", "_before")
    match = part == F.col("_p")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = laid.join(runs, match)
    pos = F.col("_gid") - F.col("_first") + 1 + F.col("_before")
    return joined.withColumn("pos", pos).select(*rows.columns, "pos")


def _blocks(rows: DataFrame, overlap: int, size: int) -> DataFrame:
    """Adds ``_block``; the last ``overlap`` rows of a block also enter the next."""
    if overlap >= size:
        raise ValueError("a block must be longer than the frame")
    own = F.floor((F.col("pos") - 1) / size)
    inside = (F.col("pos") - 1) % size
    both = F.when(inside >= size - overlap, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_own", own).withColumn("_block", F.explode(both))


def sliding(rows: DataFrame, keys: Sequence[str], frame: int, block_rows: int = BLOCK_ROWS, **values) -> DataFrame:
    """Aggregates over the current row and the ``frame - 1`` rows before it.

    Each value is a callable from a window to a column.
    """
    block_rows = max(block_rows, frame)
    w = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(-(frame - 1), 0)
    out = _blocks(rows, frame - 1, block_rows).withColumns({n: f(w) for n, f in values.items()})
    return out.where("_own = _block").drop("_own", "_block")


def previous(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``prev_<column>`` from the row before, null on the first."""
    w = Window.partitionBy(*keys, "_block").orderBy("pos")
    out = _blocks(rows, 1, block_rows).withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})
    return out.where("_own = _block").drop("_own", "_block")


def run_start(rows: DataFrame, keys: Sequence[str], starts: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``run``: position of the latest row at or before where ``starts`` holds."""
    marked = rows.withColumns({"_block": F.floor((F.col("pos") - 1) / block_rows), "_mark": F.when(starts, F.col("pos"))})
    last = marked.groupBy(*keys, "_block").agg(F.max("_mark").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_carried", F.max("_last").over(earlier)).drop("_last")
    w = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    within = marked.withColumn("_seen", F.max("_mark").over(w))
    joined = within.join(last, [*keys, "_block"], "left")
    return joined.withColumn("run", F.coalesce("_seen", "_carried", F.lit(1))).drop("_block", "_mark", "_seen", "_carried")


def streaks(rows: DataFrame, keys: Sequence[str], value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs of equal ``value``: keys, value, first and last position, length."""
    seen = previous(rows, keys, [value], block_rows)
    changed = F.col(f"prev_{value}").isNull() | (F.col(f"prev_{value}") != F.col(value))
    runs = run_start(seen, keys, changed, block_rows)
    return runs.groupBy(*keys, "run", value).agg(F.count("*").alias("length"), F.max("pos").alias("last_pos"))
