"""Sources: transactions, saved URL feeds, telemetry, reports, wordlists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schema
from ..cluster import cut_lineage


def text_of(body: Column) -> Column:
    """UTF-8 text of a binary body, bad bytes replaced."""
    return F.make_valid_utf8(body.cast("string"))


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Stored request/response rows with bodies as text; unordered.

    Partition pruning on host and column pruning of the bodies come from the
    Parquet layout; sort at the sink if arrival order is wanted.
    """
    rows = spark.read.schema(T.StructType([*schema.TRANSACTIONS.fields, T.StructField("host", T.StringType())])).parquet(path)
    return rows.withColumns({
        "ts": F.col("timestamp"),
        "response_body": text_of(F.col("response_body")),
        "request_body": F.coalesce(text_of(F.col("request_body")), F.lit("")),
    })


def js_responses(txn: DataFrame) -> DataFrame:
    return txn.where(F.col("response_content_type").contains("javascript"))


def html_responses(txn: DataFrame) -> DataFrame:
    return txn.where(F.col("response_content_type").contains("html") & (F.col("page_type") == "real_content"))


def read_text_index(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated ``url status mime`` lines; ``-`` means missing."""
    parts = F.split(F.trim("value"), " ", 3)

    def field(i: int) -> Column:
        return F.coalesce(F.nullif(F.get(parts, F.lit(i)), F.lit("-")), F.lit(""))

    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.get(parts, F.lit(0)).alias("url"), field(1).alias("status"), field(2).alias("mime"))


def read_crawl_index(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; unreadable lines and rows without URL dropped."""
    rows = spark.read.schema(schema.CRAWL_INDEX).option("mode", "DROPMALFORMED").json(path)
    rows = rows.where(F.coalesce("url", F.lit("")) != "")
    return rows.select("url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("status", "mime")])


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a ``url_list`` of url and httpcode."""
    docs = spark.read.schema(schema.URL_LIST).option("multiLine", True).json(path)
    rows = docs.select(F.explode("url_list").alias("e")).where(F.coalesce("e.url", F.lit("")) != "")
    return rows.select(
        F.col("e.url").alias("url"), F.coalesce("e.httpcode", F.lit("")).alias("status"), F.lit("").alias("mime")
    )


def union_feeds(**feeds: DataFrame) -> DataFrame:
    """URL feeds stacked, each row tagged with its feed name."""
    out = None
    for tag, feed in feeds.items():
        tagged = feed.withColumn("tag", F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def parse_telemetry(rows: DataFrame, column: str = "metrics_json") -> DataFrame:
    """Typed per-page telemetry from stored JSON text."""
    keep = [c for c in rows.columns if c != column and c not in schema.TELEMETRY.names]
    return rows.select(*keep, F.from_json(column, schema.TELEMETRY).alias("m")).select(*keep, "m.*")


def checked_manifest(spark: SparkSession, path: str) -> DataFrame:
    """entity, schema, n, checksum of a report's parts; an error when a part has other rows than were written."""
    manifest = spark.read.schema("entity string, schema string, n long, checksum string").json(f"{path}/manifest")
    found = None
    for r in manifest.collect():
        part = spark.read.text(f"{path}/{r['entity']}").agg(F.count("*").alias("n"), schema.row_checksum("value").alias("checksum"))
        part = part.select(F.lit(r["entity"]).alias("entity"), "n", "checksum")
        found = part if found is None else found.unionByName(part)
    wrong = [] if found is None else manifest.select("entity", "n", "checksum").exceptAll(found).collect()
    if wrong:
        raise ValueError(f"parts of the report at {path} differ from its manifest: {sorted(r['entity'] for r in wrong)}")
    return manifest


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a report, each with the schema and the rows that its manifest names."""
    parts = checked_manifest(spark, path).select("entity", "schema").collect()
    return {r["entity"]: spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).json(f"{path}/{r['entity']}") for r in parts}


def read_report_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Entity tables of reports saved as JSON documents: each file holds one report or a list of them.

    The documents are opened once for all tables: many small files cost more
    to open than to read.
    """
    names = ["endpoints", "input_vectors", "auth_boundaries", "tech_stack", "api_schemas", "secrets"]
    doc = cut_lineage(spark.read.schema(schema.REPORT).option("multiLine", True).json(path))
    tables = {n: doc.select(F.inline(n)) for n in names}
    tables["risk_summary"] = doc.select("target", "risk_summary.*")
    return tables


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line; blank and comment lines dropped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return lines.select(F.trim("value").alias("word")).where("word <> ''")
