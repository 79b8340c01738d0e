"""The endpoint registry: what every producer saw, merged per method and URL.

A sighting is a row of ``COLUMNS``. Producers are ranked by ``stage``; inside a
stage ``at`` gives the order. Merged rows carry where their values came from,
so that merging merged rows again, in any grouping, gives the same result: a
stored registry can be brought up to date with the rows of a batch alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import urls
from ..sinks.keyed import KeyedTable
from . import apispec

PARAMETER = "struct<name:string,location:string,param_type:string,required:boolean>"
NO_PARAMETERS = f"array<{PARAMETER}>"
COLUMNS = ["seq", "method", "url", "status_code", "content_type", "source_module", "depth", "page_type", "tags", "requires_auth", "parameters"]
KEYS = ["method", "url"]


def sightings(rows: DataFrame, stage: int, module: Column | str, **given: Column) -> DataFrame:
    """Rows with ``url`` in the shape of the registry; ``given`` names the columns a producer knows more about."""
    none = F.array().cast("array<string>")
    known = {
        "at": F.lit(0), "method": F.lit("GET"), "status_code": F.lit(0), "content_type": F.lit(""), "depth": F.lit(0), "page_type": F.lit(""),
        "tags": none, "requires_auth": F.lit(False), "parameters": F.array().cast(NO_PARAMETERS), **given,
    }
    seq = F.struct(F.lit(stage).alias("stage"), known.pop("at").cast("long").alias("at"))
    module = F.lit(module) if isinstance(module, str) else module
    casts = {"status_code": "int", "depth": "int", "tags": "array<string>", "parameters": NO_PARAMETERS}
    columns = {"seq": seq, "url": urls.normalize(F.col("url")), "source_module": module, **known, "method": F.upper(known["method"])}
    return rows.select(*[columns[c].cast(casts[c]).alias(c) if c in casts else columns[c].alias(c) for c in COLUMNS])


def recorded(observed: DataFrame) -> DataFrame:
    c = F.col
    return sightings(observed, 0, c("source_module"), at=c("seq"), method=c("method"), status_code=c("status_code"), content_type=c("content_type"),
                     depth=c("depth"), page_type=c("page_type"), tags=c("tags"))


def linked(links: DataFrame) -> DataFrame:
    return sightings(links, 1, "s_links", tags=F.array(F.lit("link")))


def called(calls: DataFrame) -> DataFrame:
    """Script analysis rows: full_url, method, tag, parameters."""
    named = F.transform("parameters", lambda p: F.struct(p["name"], p["location"], F.lit("string").alias("param_type"), F.lit(False).alias("required")))
    return sightings(calls.withColumn("url", F.col("full_url")), 2, "s_js", method=F.col("method"), tags=F.array("tag"), parameters=named)


def documented(docs: DataFrame, base_url: Column | None = None, key: list[str] | None = None) -> DataFrame:
    """Operations of API documents under ``base_url`` (the document's own origin when not given)."""
    parsed = apispec.parse(docs, key=key)
    ops, params = apispec.flatten_openapi(docs, key)
    item = F.struct("name", "location", "param_type", "required")
    nested = params.groupBy("did", "path", "method").agg(F.sort_array(F.collect_list(item)).alias("parameters"))
    media = apispec.media_types(parsed).groupBy("did", "path", "method").agg(F.collect_set(
        F.when(F.col("media").contains("json"), "json_body").when(F.col("media").contains("xml"), "xml_body")
        .when(F.col("media").contains("form") | F.col("media").contains("multipart"), "form_body")).alias("body_tags"))
    rows = ops.join(nested, ["did", "path", "method"], "left").join(media, ["did", "path", "method"], "left")
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1) if base_url is None else F.regexp_replace(base_url, "/+$", "")
    auth = F.when(F.size("auth_schemes") > 0, F.concat(F.lit("auth:"), F.array_join("auth_schemes", ",")))
    tags = F.array_compact(F.concat(F.array(F.lit("openapi"), auth), F.coalesce("body_tags", F.array().cast("array<string>"))))
    return sightings(rows.withColumn("url", F.concat(origin, "path")), 3, "s_api", method=F.col("method"), tags=tags, requires_auth=F.col("requires_auth"),
                     parameters=F.coalesce("parameters", F.array().cast(NO_PARAMETERS)))


def listed(feeds: DataFrame) -> DataFrame:
    """URL feeds: url, tag, status."""
    return sightings(feeds, 4, "s_feeds", status_code=F.coalesce(F.expr("try_cast(status AS int)"), F.lit(0)), tags=F.array("tag"))


def profiled(telemetry: DataFrame) -> DataFrame:
    """API calls that pages made in a browser."""
    # an inner explode would add a filter on the list, for which the whole document is parsed twice more
    calls = telemetry.select(F.posexplode_outer("api_calls").alias("at", "c")).where("at IS NOT NULL").select("c.*")
    return sightings(calls, 5, "s_browser", method=F.coalesce("method", F.lit("GET")), status_code=F.coalesce("status_code", F.lit(0)),
                     content_type=F.coalesce("mime_type", F.lit("")), tags=F.array(F.lit("browser")))


def merged(rows: DataFrame) -> DataFrame:
    """One row per method and URL from sightings or rows merged before.

    Tags are united; page type and status come from the first sighting that has
    one; of the parameters of a name the first stands; the rest, also whether
    the endpoint asks for a login, comes from the first sighting. Columns that
    end in ``_seq`` say where a value came from.
    """
    # asked before anything is made of the list: a producer that never has parameters then drops out of their pass when it is planned
    holding = rows.where(F.size("parameters") > 0)
    if "page_seq" not in rows.columns:
        rows = rows.withColumns({"page_seq": F.when(F.col("page_type") != "", F.col("seq")), "status_seq": F.when(F.col("status_code") != 0, F.col("seq"))})
        holding = holding.withColumn("parameters", F.transform("parameters", lambda p: F.struct(
            p["name"].alias("name"), F.col("seq").alias("seq"), p["location"].alias("location"), p["param_type"].alias("param_type"), p["required"].alias("required"))))
    first = F.min_by(F.struct("source_module", "content_type", "depth", "requires_auth"), "seq").alias("f")
    one = rows.groupBy(*KEYS).agg(
        F.min("seq").alias("seq"), first, F.coalesce(F.min_by("page_type", "page_seq"), F.lit("")).alias("page_type"), F.min("page_seq").alias("page_seq"),
        F.coalesce(F.min_by("status_code", "status_seq"), F.lit(0)).alias("status_code"), F.min("status_seq").alias("status_seq"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
    )
    # parameters as rows, so that a URL seen very often gathers no long list
    named = holding.select(*KEYS, F.explode("parameters").alias("p")).groupBy(*KEYS, F.col("p.name").alias("name")).agg(F.min(F.struct("p.seq", "p.location", "p.param_type", "p.required")).alias("v"))
    lists = named.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("name", "v.*"))).alias("parameters"))
    empty = F.array().cast(lists.schema["parameters"].dataType)
    out = one.join(lists, KEYS, "left").withColumn("parameters", F.coalesce("parameters", empty))
    return out.select("method", "url", "seq", "f.*", "page_type", "page_seq", "status_code", "status_seq", "tags", "parameters")


def update(spark: SparkSession, path: str, rows: DataFrame, batch: int) -> KeyedTable:
    """Takes the sightings of a batch into the registry stored at ``path``; only entries that they touch are read.

    The merged batch is written once, so that the producers run once.
    """
    staged = f"{path}/staged/batch={batch}"
    merged(rows).write.mode("overwrite").parquet(staged)
    new = spark.read.parquet(staged)
    table = KeyedTable(spark, path, KEYS, new.schema)
    table.put(merged(new.unionByName(table.lookup(new, batch))), batch)
    return table


def first_boundaries(rows: DataFrame) -> DataFrame:
    """One row per URL and method from boundary rows of all kinds (stage, ts, id give the order).

    ``rows``: url, method, boundary_type, unauth_status, auth_status, role,
    status, seq. A row without a role adds nothing to the access matrix; per
    role the last status stands.
    """
    latest = rows.where("role IS NOT NULL").groupBy("url", "method", "role").agg(F.max_by("status", "seq").alias("status"))
    matrix = latest.groupBy("url", "method").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "status")))).alias("access_matrix"))
    first = rows.groupBy("url", "method").agg(F.min_by(F.struct("boundary_type", "unauth_status", "auth_status"), "seq").alias("f"), F.min("seq").alias("seq"))
    empty = F.create_map().cast("map<string,int>")
    return first.join(matrix, ["url", "method"], "left").select("url", "method", "f.*", F.coalesce("access_matrix", empty).alias("access_matrix"), "seq")


def boundary_rows(sighted: DataFrame, mixed: DataFrame, roles: DataFrame) -> DataFrame:
    """Boundary sightings, mixed-status paths and role differences as one table, in this order."""
    def placed(rows: DataFrame, stage: int, role: Column, status: Column, at: Column) -> DataFrame:
        seq = F.struct(F.lit(stage).alias("stage"), at.alias("at"))
        return rows.select("url", "method", "boundary_type", F.col("unauth_status").cast("int").alias("unauth_status"), F.col("auth_status").cast("int").alias("auth_status"),
                           role.cast("string").alias("role"), status.cast("int").alias("status"), seq.alias("seq"))

    nowhere = F.lit(None).cast(sighted.schema["seq"].dataType)
    per_role = roles.select("url", "method", "boundary_type", "unauth_status", "auth_status", F.explode("access_matrix").alias("role", "status"))
    return placed(sighted, 0, F.col("role"), F.col("status"), F.col("seq")).unionByName(
        placed(mixed, 1, F.lit(None), F.lit(None), nowhere)).unionByName(placed(per_role, 2, F.col("role"), F.col("status"), nowhere))
