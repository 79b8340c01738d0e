"""A stored table with one row per key, brought up to date batch by batch.

Every batch writes its new rows under its own number, dealt to buckets by key
hash, and one small table that lists the files which are live from then on. A
replayed batch starts from the list before it and overwrites what it wrote, so
it changes nothing. Beside each file lie the range of its leading key and a
Bloom filter of its keys: a batch opens only files that may hold one of its
keys. A bucket with many live files is merged into one by the next batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bits and probes per key: a foreign key is taken for a stored one 4 times in 100,000.
BLOOM_BITS, BLOOM_PROBES = 24, 8
LIVE = "batch int, bucket int, name string, n long, low string, high string"
#: Rows per file, which bounds the keys that one Bloom filter is made of.
FILE_ROWS = 250_000
#: Hashes whose bit numbers are in memory at once.
AT_ONCE = 65_536


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Bit numbers of each key hash: ``BLOOM_PROBES`` columns."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(BLOOM_PROBES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, len(hashes) * BLOOM_BITS), dtype=bool)
    for start in range(0, len(hashes), AT_ONCE):
        bits[_places(hashes[start:start + AT_ONCE], len(bits)).ravel()] = True
    return len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    size = int.from_bytes(filter_[:8], "little")
    packed = np.frombuffer(filter_, np.uint8, offset=8)
    found = np.ones(len(hashes), dtype=bool)
    for start in range(0, len(hashes), AT_ONCE):
        places = _places(hashes[start:start + AT_ONCE], size)
        found[start:start + AT_ONCE] = ((packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1)
    return found


def exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no such folder."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(hpath)] if fs.exists(hpath) else []


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished ``batch=`` folders below ``path``, rising."""
    names = children(spark, path)
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition over columns of equal names; null equals null."""
    match = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        match = match & left[k].eqNullSafe(right[k])
    return match


class KeyedTable:
    """``schema`` holds ``keys`` and the values; without one, that of the stored rows counts.

    ``buckets`` stays as it was at the first batch. A bucket of a batch is
    written by one task, so choose it for the size of a large batch. A bucket
    with live files of ``most`` batches is merged.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType | None = None, buckets: int = 8, most: int = 8):
        self.spark, self.path, self.keys, self.buckets, self.most = spark, path, keys, buckets, most
        if schema is None:
            stored = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data").drop("_kh", "_batch", "batch", "bucket")
            schema = stored.schema
        self.columns = schema.names
        self.stored = T.StructType([*schema.fields, T.StructField("_kh", T.LongType()), T.StructField("_batch", T.IntegerType())])
        self.opened: list[str] = []  # files that the last lookup read

    def _live(self, before: int | None = None) -> list:
        """Live files as of the last finished batch (before ``before``); as many rows as buckets x ``most`` at the utmost, plus one batch."""
        done = [b for b in batches(self.spark, f"{self.path}/live") if before is None or b < before]
        return self.spark.read.schema(LIVE).parquet(f"{self.path}/live/batch={done[-1]}").collect() if done else []

    def _file(self, r) -> str:
        return f"{self.path}/data/batch={r['batch']}/bucket={r['bucket']}/{r['name']}"

    def _rows(self, files: list) -> DataFrame:
        """Rows of some live files with the batch they were written in."""
        if not files:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[self._file(r) for r in files])

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in self.columns if c not in self.keys]
        if not values:
            return rows.select(*self.columns, "_kh").distinct()
        newest = rows.groupBy("_kh", *self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"_v.{c}").alias(c) for c in self.columns], "_kh")

    def _hashed(self, rows: DataFrame) -> DataFrame:
        kh = F.xxhash64(*self.keys)
        return rows.withColumns({"_kh": kh, "_bucket": F.pmod(kh, F.lit(self.buckets)).cast("int"), "_lead": F.coalesce(F.col(self.keys[0]).cast("string"), F.lit(""))})

    def read(self) -> DataFrame:
        """Every stored row, the newest of each key."""
        return self._newest(self._rows(self._live())).drop("_kh")

    def lookup(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Stored rows whose keys occur in ``rows``, as of the batch before ``before``."""
        wanted = self._hashed(rows.select(*self.keys)).distinct()
        live = self._live(before)
        ranges = {r["_bucket"]: r for r in wanted.groupBy("_bucket").agg(F.min("_lead").alias("low"), F.max("_lead").alias("high")).collect()} if live else {}
        near = [r for r in live if r["bucket"] in ranges and r["low"] <= ranges[r["bucket"]]["high"] and ranges[r["bucket"]]["low"] <= r["high"]]
        self.opened = []
        if near:
            names = {(r["batch"], r["name"]) for r in near}
            index = self.spark.read.schema("name string, bucket int, bits binary").parquet(*sorted({f"{self.path}/files/batch={b}" for b, _ in names}))
            index = index.where(F.col("name").isin(sorted({n for _, n in names}))).select("bucket", "name", "bits")

            def probe(key, keys: pa.Table, files: pa.Table) -> pa.Table:
                hashes = keys["_kh"].to_numpy()
                hit = [n for n, bits in zip(files["name"].to_pylist(), files["bits"].to_pylist()) if len(hashes) and may_hold(bits, hashes).any()]
                return pa.table({"name": pa.array(hit, pa.string())})

            found = wanted.select("_bucket", "_kh").groupBy("_bucket").cogroup(index.groupBy("bucket")).applyInArrow(probe, "name string")
            hit = {r["name"] for r in found.collect()}
            near = [r for r in near if r["name"] in hit]
            self.opened = [self._file(r) for r in near]
        stored = self._newest(self._rows(near))
        keys = wanted.select("_kh", *self.keys)
        return stored.join(keys, (stored["_kh"] == keys["_kh"]) & same_keys(stored, keys, self.keys), "left_semi").select(*self.columns)

    def put(self, rows: DataFrame, batch: int) -> None:
        """Store ``rows`` (one per key) as of ``batch``; they replace stored rows with their keys."""
        if any(b > batch for b in batches(self.spark, f"{self.path}/live")):
            raise ValueError(f"batch {batch} has a later one; only the last can be run again")
        live = self._live(batch)
        count: dict[int, set] = {}
        for r in live:
            count.setdefault(r["bucket"], set()).add(r["batch"])
        full = {b for b, of in count.items() if len(of) >= self.most}
        new = self._hashed(rows.select(*self.columns)).withColumn("_batch", F.lit(batch))
        if full:
            old = self._rows([r for r in live if r["bucket"] in full])
            old = self._newest(old.unionByName(new.where(F.col("_bucket").isin(sorted(full))).select(*self.columns, "_kh", "_batch")))
            new = new.where(~F.col("_bucket").isin(sorted(full))).unionByName(self._hashed(old).withColumn("_batch", F.lit(batch)))
        data = f"{self.path}/data/batch={batch}"
        dealt = new.repartition(self.buckets, "_bucket").withColumn("bucket", F.col("_bucket")).select(*self.columns, "_kh", "_batch", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").option("maxRecordsPerFile", FILE_ROWS).parquet(data)

        def describe(part: pd.DataFrame) -> pd.DataFrame:
            lead = part["lead"]
            return pd.DataFrame({"name": part["name"].iloc[:1], "bucket": part["bucket"].iloc[:1], "n": len(part), "low": lead.min(), "high": lead.max(),
                                 "bits": [bloom(part["kh"].to_numpy())]})

        if any(n.startswith("bucket=") for n in children(self.spark, data)):
            back = self.spark.read.schema(T.StructType([*self.stored.fields, T.StructField("bucket", T.IntegerType())])).parquet(data)
            slim = back.select(F.col("_metadata.file_name").alias("name"), "bucket", F.col("_kh").alias("kh"), F.coalesce(F.col(self.keys[0]).cast("string"), F.lit("")).alias("lead"))
            # a group is one file, of FILE_ROWS rows at most
            made = slim.groupBy("name", "bucket").applyInPandas(describe, "name string, bucket int, n long, low string, high string, bits binary")
        else:
            made = self.spark.createDataFrame([], "name string, bucket int, n long, low string, high string, bits binary")
        made.write.mode("overwrite").parquet(f"{self.path}/files/batch={batch}")
        mine = self.spark.read.parquet(f"{self.path}/files/batch={batch}").select(F.lit(batch).alias("batch"), "bucket", "name", "n", "low", "high")
        kept = self.spark.createDataFrame([r for r in live if r["bucket"] not in full], LIVE)
        kept.unionByName(mine).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live/batch={batch}")

