"""Sinks: transaction append, entity files, report, API documents, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import schema
from ..functions import urls
from ..operators.filters import by_host
from .keyed import KeyedTable, batches

# Type and status names of the API document.
OPENAPI_TYPES = {
    "string": "string", "integer": "integer", "int": "integer", "number": "number",
    "float": "number", "boolean": "boolean", "bool": "boolean", "file": "string",
    "json": "object", "xml": "string",
}
OPENAPI_LOCATIONS = ["query", "header", "cookie", "path"]
WITH_BODY = ["POST", "PUT", "PATCH"]
FILES_PER_HOST = 8
#: Rows of a host beyond which it gets more files; each is written by one task.
HOST_FILE_ROWS = 50_000


# ---- Transactions and entities -----------------------------------------


def append_transactions(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Insert rows whose id is not stored yet, the first by time of each id, partitioned by batch and host.

    The ids of a store lie beside it in a keyed table (``_ids``): only its files
    whose id range and Bloom filter may hold an arriving id are opened, and no
    stored transaction is read. Without a number the append is the next batch;
    a batch that is repeated under its number overwrites what it wrote.
    """
    spark = rows.sparkSession
    kind = T.StructType([rows.schema["id"], T.StructField("day", T.DateType())])
    ids = KeyedTable(spark, f"{path}/_ids", ["id"], kind)
    batch = max(batches(spark, f"{path}/_ids/live"), default=-1) + 1 if batch is None else batch
    first = Window.partitionBy("id").orderBy("timestamp")
    fresh = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    stored = ids.lookup(fresh, batch)
    fresh = by_host(fresh.join(stored.select("id"), "id", "left_anti").select(*rows.columns), "request_url")
    # the rows of a host meet in few files; a hot host is dealt out by id, the more the larger it is
    sizes = by_host(rows.select("request_url"), "request_url").groupBy("host").agg(F.ceil(F.count("*") / HOST_FILE_ROWS).alias("files"))
    hot = sizes.where(F.col("files") > FILES_PER_HOST).collect()  # one row per FILES_PER_HOST x HOST_FILE_ROWS rows of the batch at most
    files = F.lit(FILES_PER_HOST).cast("long")
    if hot:
        files = F.coalesce(F.create_map(*[F.lit(x) for r in hot for x in (r["host"], r["files"])])[F.col("host")], files)
    dealt = fresh.repartition("host", F.pmod(F.xxhash64("id"), files))
    target = f"{path}/batch={batch}"
    dealt.write.mode("overwrite").partitionBy("host").parquet(target)
    written = spark.read.schema(rows.select("id", "timestamp").schema).parquet(target)
    ids.put(written.select("id", F.to_date("timestamp").alias("day")), batch)


def write_entities(rows: DataFrame, path: str) -> None:
    """JSON lines, replacing the previous run."""
    rows.write.mode("overwrite").json(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per table and a manifest with their schemas, row counts and checksums.

    A single document would pull every entity through one task, so the report
    is a directory whose members read back as the same tables. The manifest is
    written last; without it there is no report.
    """
    spark, manifest = None, []
    for name, rows in tables.items():
        spark = rows.sparkSession
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
        done = spark.read.text(f"{path}/{name}").agg(F.count("*").alias("n"), schema.row_checksum("value").alias("c")).first()
        manifest.append((name, rows.schema.json(), done["n"], done["c"]))
    if manifest:
        spark.createDataFrame(manifest, "entity string, schema string, n long, checksum string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


# ---- API document ------------------------------------------------------


def openapi_operations(endpoints: DataFrame, params: DataFrame, template: str | None = "path_template") -> DataFrame:
    """One row per (path, method) with the parts of its operation object.

    ``endpoints``: url, method, status_code, content_type, requires_auth, seq
    and the template column; ``params``: url, method, name, location,
    param_type, required, example, seq.
    """
    def keyed(df: DataFrame) -> DataFrame:
        raw = urls.path(F.col("url"))
        path = F.when(raw == "", "/").otherwise(raw)
        if template and template in df.columns:
            path = F.coalesce(F.nullif(F.col(template), F.lit("")), path)
        return df.withColumn("path", path).withColumn("method", F.lower("method"))

    eps = keyed(endpoints)
    head = eps.groupBy("path", "method").agg(
        F.min_by("requires_auth", "seq").alias("secured"), F.min_by("content_type", "seq").alias("body_type")
    )
    code = F.coalesce(F.nullif(F.col("status_code"), F.lit(0)), F.lit(200))
    responses = eps.groupBy("path", "method", code.alias("code")).agg(F.min_by("content_type", "seq").alias("media"))
    responses = responses.groupBy("path", "method").agg(
        F.sort_array(F.collect_list(F.struct("code", "media"))).alias("responses")
    )
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in OPENAPI_TYPES.items() for x in kv]), F.col("param_type"))
    merged = keyed(params).groupBy("path", "method", "name", "location").agg(
        F.min(F.struct("seq", "param_type", "required", "example")).alias("p")
    )
    merged = merged.select("path", "method", "name", "location", "p.*").withColumn("type", F.coalesce(kind, F.lit("string")))
    fields = F.struct("name", "location", "type", "required", "example")
    lists = merged.groupBy("path", "method").agg(F.sort_array(F.collect_list(fields)).alias("all_params"))
    out = head.join(responses, ["path", "method"]).join(lists, ["path", "method"], "left")
    everything = F.coalesce("all_params", F.array().cast(lists.schema["all_params"].dataType))
    out = out.withColumn("all_params", everything)
    named = F.filter(F.split("path", "/"), lambda s: (s != "") & ~s.startswith("{"))
    return out.select(
        "path", "method", "secured", "body_type", "responses",
        F.concat_ws(" ", F.upper("method"), "path").alias("summary"),
        F.get(named, F.lit(0)).alias("tag"),
        F.filter("all_params", lambda p: p["location"] != "body").alias("parameters"),
        F.when(
            F.upper("method").isin(WITH_BODY), F.filter("all_params", lambda p: p["location"] == "body")
        ).alias("body_params"),
    )


# ---- Collection and proxy exports --------------------------------------


def _first(samples: str) -> Column:
    return F.coalesce(F.get(samples, F.lit(0)), F.lit(""))


def _at(params: str, location: str) -> Column:
    return F.filter(params, lambda p: p["location"] == location)


def _sample(p: Column) -> Column:
    return F.coalesce(F.get(p["sample_values"], F.lit(0)), F.lit(""))


def postman_items(endpoints: DataFrame) -> DataFrame:
    """(folder, item JSON) per endpoint with nested ``parameters``."""
    url = F.col("url")
    segs = urls.segments(url)
    kv = lambda p: F.struct(p["name"].alias("key"), _sample(p).alias("value"))
    own = F.transform(urls.query_pairs(url, keep_blank=True), lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value")))
    own_names = F.transform(own, lambda p: p["key"])
    extra = F.filter(_at("parameters", "query"), lambda p: ~F.array_contains(own_names, p["name"]))
    cookies = F.array_join(F.transform(_at("parameters", "cookie"), lambda p: F.concat(p["name"], F.lit("="), _sample(p))), "; ")
    has_body = F.upper("method").isin(WITH_BODY)

    def fixed(key: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))

    none = F.array().cast("array<struct<key:string,value:string>>")
    headers = F.transform(_at("parameters", "header"), kv)
    typed = F.exists(headers, lambda h: F.lower(h["key"]) == "content-type")
    content = F.when(has_body & (F.coalesce("content_type", F.lit("")) != "") & ~typed, fixed("Content-Type", F.col("content_type"))).otherwise(none)
    headers = F.concat(headers, content, F.when(cookies != "", fixed("Cookie", cookies)).otherwise(none))
    fields = F.transform(_at("parameters", "body"), kv)
    is_json = F.lower(F.coalesce("content_type", F.lit(""))).contains("json")
    raw = F.to_json(F.map_from_entries(F.transform(_at("parameters", "body"), lambda p: F.struct(p["name"], _sample(p)))))
    body = F.when(
        has_body & (F.size(fields) > 0),
        F.struct(
            F.when(is_json, "raw").otherwise("formdata").alias("mode"),
            F.when(is_json, raw).alias("raw"),
            F.when(~is_json, F.transform(fields, lambda f: F.struct(f["key"], f["value"], F.lit("text").alias("type")))).alias("formdata"),
        ),
    )
    request = F.struct(
        F.upper("method").alias("method"), headers.alias("header"),
        F.struct(
            url.alias("raw"), urls.scheme(url).alias("protocol"), F.split(urls.host(url), r"\.").alias("host"),
            segs.alias("path"), F.nullif(urls.port(url), F.lit("")).alias("port"),
            F.concat(own, F.transform(extra, kv)).alias("query"),
        ).alias("url"),
        body.alias("body"),
    )
    name = F.concat_ws(" ", F.upper("method"), F.coalesce(F.nullif(urls.path(url), F.lit("")), F.lit("/")))
    folder = F.concat(F.lit("/"), F.coalesce(F.get(segs, F.lit(0)), F.lit("")))
    return endpoints.select(folder.alias("folder"), F.to_json(F.struct(name.alias("name"), request.alias("request"))).alias("item"))


def write_postman(endpoints: DataFrame, path: str) -> None:
    """Items as text lines below one folder each."""
    postman_items(endpoints).write.mode("overwrite").partitionBy("folder").text(path)


def proxy_items(endpoints: DataFrame, comment: str = "recorded by") -> DataFrame:
    """One row per endpoint with the raw request in base64."""
    url = F.col("url")
    method = F.upper("method")
    path = F.coalesce(F.nullif(urls.path(url), F.lit("")), F.lit("/"))
    full = F.concat(path, F.when(urls.query(url) != "", F.concat(F.lit("?"), urls.query(url))).otherwise(""))
    fields = _at("parameters", "body")
    has_body = method.isin(WITH_BODY) & (F.size(fields) > 0)
    is_json = F.lower(F.coalesce("content_type", F.lit(""))).contains("json")
    body = F.when(has_body & is_json, F.to_json(F.map_from_entries(F.transform(fields, lambda p: F.struct(p["name"], _sample(p)))))).when(
        has_body, F.array_join(F.transform(fields, lambda p: F.concat(p["name"], F.lit("="), _sample(p))), "&")
    ).otherwise("")
    cookies = F.array_join(F.transform(_at("parameters", "cookie"), lambda p: F.concat(p["name"], F.lit("="), _sample(p))), "; ")
    media = F.when(is_json, "application/json").otherwise("application/x-www-form-urlencoded")
    lines = F.array_compact(
        F.concat(
            F.array(
                F.concat(method, F.lit(" "), full, F.lit(" HTTP/1.1")),
                F.concat(F.lit("Host: "), urls.host(url)),
                F.when(has_body, F.concat(F.lit("Content-Type: "), media)),
                F.when(has_body, F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))),
            ),
            F.transform(_at("parameters", "header"), lambda p: F.concat(p["name"], F.lit(": "), _sample(p))),
            F.array(F.when(cookies != "", F.concat(F.lit("Cookie: "), cookies))),
        )
    )
    raw = F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n\r\n"), body)
    default = F.when(urls.scheme(url) == "https", 443).otherwise(80)
    return endpoints.select(
        "url", urls.host(url).alias("host"),
        F.coalesce(F.nullif(urls.port(url), F.lit("")).cast("int"), default).alias("port"),
        F.coalesce(F.nullif(urls.scheme(url), F.lit("")), F.lit("https")).alias("protocol"),
        method.alias("method"), full.alias("path"), F.base64(F.encode(raw, "utf-8")).alias("request"),
        F.coalesce("status_code", F.lit(0)).alias("status"), F.coalesce("content_type", F.lit("")).alias("mimetype"),
        F.concat_ws(" ", F.lit(comment), "source_module").alias("comment"),
    )


def write_proxy_xml(endpoints: DataFrame, path: str) -> None:
    rows = proxy_items(endpoints)
    rows.write.mode("overwrite").format("xml").option("rootTag", "items").option("rowTag", "item").save(path)


def write_telemetry(pages: DataFrame, summary: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(f"{path}/pages")
    summary.write.mode("overwrite").json(f"{path}/summary")
