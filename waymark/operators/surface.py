"""Entity merges: endpoints, parameters, vectors, boundaries, tech, secrets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..cluster import written
from ..functions import classify, urls


def query_parameters(rows: DataFrame, url: str = "url") -> DataFrame:
    """One row per query name of each URL with all its values, in order."""
    named = rows.where(F.col(url).contains("?")).withColumn("_pairs", urls.query_pairs(F.col(url)))
    # an inner explode would add a filter on the list, for which the URL is taken apart once more
    named = named.withColumn("name", F.explode_outer(F.array_distinct(F.transform("_pairs", lambda p: p["name"])))).where("name IS NOT NULL")
    values = F.transform(
        F.filter("_pairs", lambda p: p["name"] == F.col("name")), lambda p: p["value"]
    )
    return named.withColumn("sample_values", values).drop("_pairs")


# ---- Technologies ------------------------------------------------------


def merge_tech(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row per name. Later sightings add 0.3 of their confidence, capped at 1."""
    named = rows.withColumn("name", F.lower("name"))
    first = F.min_by("confidence", order)
    return named.groupBy("name").agg(
        F.min_by("category", order).alias("category"),
        F.coalesce(F.min_by("version", F.when(F.col("version") != "", F.col(order))), F.lit("")).alias("version"),
        F.least(F.lit(1.0), first + 0.3 * (F.sum("confidence") - first)).alias("confidence"),
        F.sum("evidence_count").alias("evidence_count"),
    )


def implied_paths(tech: DataFrame) -> DataFrame:
    return tech.select(F.explode("implied_paths").alias("path")).distinct()


def tech_by_category(tech: DataFrame) -> DataFrame:
    """Technologies of each category, most certain first."""
    item = F.struct((-F.col("confidence")).alias("order"), "name", "version", "confidence")
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit("other"))
    return tech.groupBy(category.alias("category")).agg(F.sort_array(F.collect_list(item)).alias("items"))


# ---- Endpoints ---------------------------------------------------------


def merge_endpoints(observed: DataFrame, order: str = "seq") -> DataFrame:
    """One row per METHOD and normalised URL.

    Tags are united; page type and status come from the first sighting that
    has one, everything else from the first sighting. ``tags`` holds the few
    stage labels, so the set stays small however often a URL is seen.
    """
    rows = observed.withColumns({"method": F.upper("method"), "url": urls.normalize(F.col("url"))})
    seq = F.col(order)
    merged = rows.groupBy("method", "url").agg(
        F.min(seq).alias("seq"),
        F.min_by(F.struct("source_module", "content_type", "depth"), seq).alias("f"),
        F.coalesce(F.min_by("page_type", F.when(F.col("page_type") != "", seq)), F.lit("")).alias("page_type"),
        F.min_by("status_code", F.when(F.col("status_code") != 0, seq)).alias("status_code"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
    )
    return merged.select("method", "url", "seq", "f.*", "page_type", "status_code", "tags")


def endpoint_parameters(observed: DataFrame, order: str = "seq", body: str | None = None) -> DataFrame:
    """Long table of endpoint parameters: query names, and form-encoded body names.

    Names and values depend on the URL or the body alone, so a request that
    comes again is taken apart once, at its first ``order``.
    """
    def first(rows: DataFrame, *keys: str) -> DataFrame:
        rows = rows.groupBy(*keys).agg(F.min(order).alias(order))
        return rows.withColumns({"method": F.upper("method"), "url": urls.normalize(F.col("url"))})

    found = query_parameters(first(observed.where(F.col("url").contains("?")), "method", "url")).withColumn("location", F.lit("query"))
    keep = ["method", "url", "name", "location", "sample_values", order]
    found = found.select(*keep)
    if body is not None:
        posted = first(observed.where(F.col(body) != ""), "method", "url", body).withColumn("_form", F.concat(F.lit("?"), F.col(body)))
        posted = query_parameters(posted, "_form").withColumn("location", F.lit("body"))
        found = found.unionByName(posted.select(*keep))
    return found.groupBy("method", "url", "name", "location").agg(
        F.min_by("sample_values", order).alias("sample_values"), F.min(order).alias("seq")
    )


def with_param_count(endpoints: DataFrame, params: DataFrame) -> DataFrame:
    """Adds the number of distinct parameter names."""
    counts = params.groupBy("method", "url").agg(F.countDistinct("name").alias("param_count"))
    return endpoints.join(counts, ["method", "url"], "left").withColumn(
        "param_count", F.coalesce("param_count", F.lit(0).cast("long"))
    )


def attach_parameters(endpoints: DataFrame, params: DataFrame) -> DataFrame:
    """Nested ``parameters`` for the exports that need whole endpoints."""
    item = F.struct("seq", "name", "location", "sample_values")
    nested = params.groupBy("method", "url").agg(F.sort_array(F.collect_list(item)).alias("parameters"))
    empty = F.array().cast(nested.schema["parameters"].dataType)
    return endpoints.join(nested, ["method", "url"], "left").withColumn("parameters", F.coalesce("parameters", empty))


def known_parameters(txn: DataFrame, registered: DataFrame) -> DataFrame:
    """Distinct parameter names per base URL from traffic and registry."""
    seen = txn.select(F.explode(urls.query_names(F.col("request_url"))).alias("name"), F.col("request_url"))
    seen = seen.select(urls.base_url(F.col("request_url")).alias("base_url"), "name")
    return seen.union(registered.select("url", "name")).distinct()


def unspidered(endpoints: DataFrame, expanded: DataFrame) -> DataFrame:
    """Known endpoints never expanded, one per normalised URL."""
    norm = urls.normalize(F.col("url"))
    done = expanded.select(norm.alias("norm")).distinct()
    left = endpoints.withColumn("norm", norm).join(done, "norm", "left_anti")
    return left.groupBy("norm").agg(F.min_by(F.struct(*endpoints.columns), "seq").alias("e")).select("e.*")


# ---- Input vectors -----------------------------------------------------


def merge_vectors(vectors: DataFrame, order: str = "seq") -> DataFrame:
    """One row per URL, name and location. Risks are united, reflection sticks."""
    risks = F.array_distinct(F.concat("risk_indicators", classify.name_risks(F.col("name"))))
    return vectors.withColumn("risk_indicators", risks).groupBy("endpoint_url", "name", "location").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("risk_indicators")))).alias("risk_indicators"),
        F.bool_or("is_reflected").alias("is_reflected"),
        F.min_by("input_type", order).alias("input_type"),
        F.min_by("sample_values", order).alias("sample_values"),
        F.min_by("source_module", order).alias("source_module"),
        F.min(order).alias("seq"),
    )


#: Bytes of URLs and sample values up to which they are sent to the bodies.
ASKED_BYTES = 32_000_000
#: Values of one URL that are searched one by one, and that one automaton is made of.
ONE_BY_ONE, TOGETHER = 16, 1_000
HIT = "url string, name string, location string"


def reflected_parameters(params: DataFrame, txn: DataFrame, block_bytes: int = ASKED_BYTES) -> DataFrame:
    """(url, name, location) whose sample value shows up in a response body of its URL.

    ``params``: url, name, location, sample_values. Short values and short
    numbers are no evidence. Up to ``block_bytes`` of asked values go to the
    bodies, which stay where they are read, and only hits move. Beyond that the
    two meet by URL in one join, so that every body is read once however many
    values are asked.
    """
    usable = F.filter(
        "sample_values", lambda v: (F.length(v) >= 4) & ~(v.rlike("^[0-9]+$") & (F.length(v) < 6))
    )
    asked = params.select("url", "name", "location", F.explode_outer(F.array_distinct(usable)).alias("value")).where("value IS NOT NULL")
    asked = written(asked.distinct(), "asked")
    total = asked.agg(F.sum(F.octet_length("url") + F.octet_length("value") + F.octet_length("name") + 32)).first()[0] or 0
    # no filter on empty bodies, for which every body would be made twice where the log is a view: they hold no value anyway
    bodies = txn.select(F.col("request_url").alias("url"), "response_body")
    if total > block_bytes:
        return _reflected_by_url(asked, bodies).distinct()
    sent = txn.sparkSession.sparkContext.broadcast(asked.toArrow())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = ValueFinder(sent.value)
        for batch in batches:
            hits = tools.hits(batch)
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*hits)], names=["url", "name", "location"])

    return bodies.mapInArrow(find, HIT).distinct()


def _reflected_by_url(asked: DataFrame, bodies: DataFrame) -> DataFrame:
    """The join of asked values and bodies; the values of a URL come in lists of bounded length."""
    counts = asked.groupBy("url").agg(F.count("*").alias("_n"))
    part = F.when(F.col("_n") > ONE_BY_ONE, F.pmod(F.xxhash64("value"), F.ceil(F.col("_n") / TOGETHER)) + 1).otherwise(0)
    lists = asked.join(counts, "url").groupBy("url", part.alias("part")).agg(F.collect_list(F.struct("value", "name", "location")).alias("asked"))
    few, many = lists.where("part = 0"), lists.where("part > 0")
    # outer, since an inner explode would search every body once more for a filter on its list
    found = bodies.join(few, "url").select("url", F.explode_outer(F.filter("asked", lambda a: F.contains("response_body", a["value"]))).alias("a"))
    found = found.where("a IS NOT NULL")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine = values = None
        for batch in batches:
            hits = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key != own:  # rows come in the order of the join: one list is in memory
                    own, values = key, {}
                    for a in batch.column(3)[i].as_py():
                        values.setdefault(a["value"], []).append((a["name"], a["location"]))
                    machine = Automaton(list(values))
                hits += [(key[0], *at) for v in machine.find(batch.column(2)[i].as_py() or "") for at in values.pop(v, [])]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*hits)], names=["url", "name", "location"])

    together = bodies.join(many, "url").select("url", "part", "response_body", "asked").mapInArrow(find, HIT)
    return found.select("url", "a.name", "a.location").unionByName(together)


class ValueFinder:
    """Looks for the asked values of a URL in its bodies; every (url, name, location) is reported once per task."""

    #: Values of one URL from which an automaton is made of them.
    MANY = 8

    def __init__(self, asked: pa.Table):
        self.asked: dict[str, dict[str, list[tuple[str, str]]]] = {}
        for url, name, location, value in zip(*(asked[c].to_pylist() for c in ("url", "name", "location", "value"))):
            self.asked.setdefault(url, {}).setdefault(value, []).append((name, location))
        self.machines: dict[str, Automaton] = {}

    def hits(self, batch: pa.RecordBatch) -> list[tuple[str, str, str]]:
        out = []
        for i, url in enumerate(batch.column(0).to_pylist()):
            values = self.asked.get(url)
            if values:
                body = batch.column(1)[i].as_py() or ""
                for value in self.present(url, values, body):
                    out += [(url, name, location) for name, location in values.pop(value)]
        return out

    def present(self, url: str, values: dict, body: str) -> list[str]:
        if len(values) < self.MANY:
            return [v for v in values if v in body]
        machine = self.machines.get(url)
        if machine is None:
            machine = self.machines[url] = Automaton(list(values))
        return [v for v in machine.find(body) if v in values]


class Automaton:
    """Which of many texts occur in a text, in one pass: a trie with failure links."""

    def __init__(self, texts: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        for text in texts:
            at = 0
            for c in text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][c]
            self.ends[at].append(text)
        self.back = [0] * len(self.next)
        queue = list(self.next[0].values())
        for at in queue:
            for c, to in self.next[at].items():
                back = self.back[at]
                while back and c not in self.next[back]:
                    back = self.back[back]
                self.back[to] = self.next[back].get(c, 0) if self.next[back].get(c, 0) != to else 0
                self.ends[to] = self.ends[to] + self.ends[self.back[to]]
                queue.append(to)

    def find(self, text: str) -> set[str]:
        at, found = 0, set()
        for c in text:
            while at and c not in self.next[at]:
                at = self.back[at]
            at = self.next[at].get(c, 0)
            if self.ends[at]:
                found.update(self.ends[at])
        return found


# Fixed values: (technology, parameter name pattern, risk tag)
TECH_RISKS = [
    ("php", "(?i)file|path|include|require|page|dir", "lfi_elevated_php"),
    ("php", "(?i)cmd|exec|system|shell", "cmdi_elevated_php"),
    ("java", "(?i)class|bean|type|object", "deserialization_risk_java"),
    ("aspnet", "(?i)__VIEWSTATE|__EVENTVALIDATION", "viewstate_deserialization"),
    ("rails", "(?i)template|render|partial", "ssti_elevated_rails"),
    ("django", "(?i)template|render", "ssti_elevated_django"),
    ("wordpress", "(?i)action|plugin|theme", "wp_plugin_abuse"),
]


def tech_risks(params: DataFrame, tech: DataFrame, rules=TECH_RISKS) -> DataFrame:
    """Risk tags that a detected technology adds to parameter names.

    Names repeat, so the patterns run once per distinct name; the technology
    side has one row per rule at most.
    """
    names = params.select("name").distinct()
    hits = [
        F.when(F.col("name").rlike(p), F.struct(F.lit(t).alias("tech"), F.lit(tag).alias("risk"))) for t, p, tag in rules
    ]
    tagged = names.select("name", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("name", "h.*")
    known = sorted({t for t, _, _ in rules})
    present = tech.select(F.lower("name").alias("tech")).where(F.col("tech").isin(known)).distinct()
    return tagged.join(present, "tech", "left_semi").select("name", "risk")


def classify_vectors(params: DataFrame, txn: DataFrame, tech: DataFrame) -> DataFrame:
    """Typed, risk-tagged input vectors from endpoint parameters."""
    typed = params.withColumn("input_type", classify.infer_type(F.col("name"), F.col("sample_values")))
    echoed = reflected_parameters(params, txn).withColumn("is_reflected", F.lit(True))
    rows = typed.join(echoed, ["url", "name", "location"], "left").withColumn(
        "is_reflected", F.coalesce("is_reflected", F.lit(False))
    )
    elevated = tech_risks(params, tech).groupBy("name").agg(F.collect_set("risk").alias("tech_risks"))
    rows = rows.join(elevated, "name", "left")
    by_type = (
        F.when(F.col("input_type") == "url", "ssrf_candidate").when(F.col("input_type") == "path", "lfi_candidate")
        .when(F.col("input_type") == "json", "injection_candidate")
    )
    extra = F.array_compact(F.array(
        F.when(F.col("is_reflected"), "reflected_xss_candidate"), by_type,
        F.when(F.upper("method").isin("PUT", "DELETE", "PATCH"), "state_changing_method"),
    ))
    risks = F.array_distinct(F.concat(
        classify.endpoint_risks(F.col("url")), extra, F.coalesce("tech_risks", F.array().cast("array<string>"))
    ))
    return rows.select(
        F.col("url").alias("endpoint_url"), "name", "location", "input_type", "is_reflected", "sample_values",
        risks.alias("risk_indicators"), F.lit("classifier").alias("source_module"), "seq",
    )


# ---- Boundaries, secrets, schemas --------------------------------------


def merge_boundaries(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row per URL and method; per role the last status stands.

    ``rows``: url, method, boundary_type, unauth_status, auth_status, role, status.
    """
    first = F.min_by(F.struct("boundary_type", "unauth_status", "auth_status"), order)
    per_role = rows.groupBy("url", "method", "role").agg(F.max_by("status", order).alias("status"), first.alias("f"), F.min(order).alias("seq"))
    merged = per_role.where("url IS NOT NULL AND method IS NOT NULL").groupBy("url", "method").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "status")))).alias("access_matrix"),
        F.min_by("f", "seq").alias("f"), F.min("seq").alias("seq"),
    )
    return merged.select("url", "method", "f.*", "access_matrix", "seq")


def distinct_secrets(secrets: DataFrame, order: str = "seq") -> DataFrame:
    """First sighting of each value."""
    return secrets.groupBy("value").agg(F.min_by(F.struct("kind", "source_url"), order).alias("f")).select("value", "f.*")


def distinct_schemas(schemas: DataFrame, order: str = "seq") -> DataFrame:
    return schemas.groupBy("url", "schema_type").agg(F.min(order).alias("seq"))


def require_auth(endpoints: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Sets requires_auth where the URL has a boundary, or its path where a boundary names a path.

    A flag that is set stays set.
    """
    known = F.coalesce("requires_auth", F.lit(False)) if "requires_auth" in endpoints.columns else F.lit(False)
    names = boundaries.select(F.col("url").alias("_bound")).distinct()
    rows = endpoints.withColumns({"_path": urls.path(F.col("url")), "requires_auth": known})
    by_url = names.withColumn("_by_url", F.lit(True))
    by_path = names.where(F.col("_bound").startswith("/")).select(F.col("_bound").alias("_path"), F.lit(True).alias("_by_path"))
    rows = rows.join(by_url, rows["url"] == by_url["_bound"], "left").join(by_path, "_path", "left")
    bounded = F.coalesce("_by_url", "_by_path", F.lit(False))
    return rows.withColumn("requires_auth", F.col("requires_auth") | bounded).drop("_bound", "_path", "_by_url", "_by_path")


def unbounded_auth_endpoints(endpoints: DataFrame, boundaries: DataFrame) -> DataFrame:
    return endpoints.where("requires_auth").join(boundaries.select("url"), "url", "left_anti")


# ---- Report ------------------------------------------------------------

DEBUG_TAGS = ["debug", "actuator", "phpinfo"]


def is_open_admin() -> Column:
    return (F.col("page_type") == "admin") & ~F.col("requires_auth")


def is_exposed_debug() -> Column:
    return F.arrays_overlap("tags", F.array(*[F.lit(t) for t in DEBUG_TAGS]))


def open_admin(endpoints: DataFrame) -> DataFrame:
    return endpoints.where(is_open_admin())


def exposed_debug(endpoints: DataFrame) -> DataFrame:
    return endpoints.where(is_exposed_debug())


def entity_counts(**tables: DataFrame) -> DataFrame:
    """(entity, n) rows, one per table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def risk_summary(endpoints: DataFrame, vectors: DataFrame, boundaries: DataFrame, secrets: DataFrame) -> DataFrame:
    """Counts and the 0 to 100 score as one row."""
    def counted(rows: DataFrame, **conditions: Column | None) -> DataFrame:
        """(entity, n) rows: all counts of one table in one aggregate."""
        one = rows.agg(*[(F.count("*") if c is None else F.count_if(c)).alias(n) for n, c in conditions.items()])
        return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("entity"), F.col(n).alias("n")) for n in conditions]))).select("col.*")

    bounded = boundaries.select("url").distinct().withColumn("_bounded", F.lit(True))
    counts = counted(
        endpoints.join(bounded, "url", "left"), total_endpoints=None, unprotected_admin_paths=is_open_admin(),
        exposed_debug_endpoints=is_exposed_debug(), unbounded=F.col("requires_auth") & F.col("_bounded").isNull(),
    )
    counts = counts.unionByName(counted(vectors, total_input_vectors=None, high_risk_vectors=F.size("risk_indicators") > 0))
    counts = counts.unionByName(counted(boundaries, auth_boundaries_found=None)).unionByName(counted(secrets, secrets_found=None))
    names = ["total_endpoints", "total_input_vectors", "high_risk_vectors", "auth_boundaries_found",
             "unprotected_admin_paths", "exposed_debug_endpoints", "secrets_found", "unbounded"]
    row = counts.agg(*[F.max(F.when(F.col("entity") == n, F.col("n"))).alias(n) for n in names])

    def points(name: str, each: float, most: float) -> Column:
        return F.least(F.lit(most), F.col(name) * each)

    score = F.least(
        F.lit(100.0),
        points("high_risk_vectors", 2.0, 40.0) + points("secrets_found", 5.0, 20.0)
        + points("unprotected_admin_paths", 5.0, 15.0) + points("exposed_debug_endpoints", 5.0, 15.0)
        + points("unbounded", 2.0, 10.0),
    )
    return row.withColumns({"score": score, "unbounded_points": points("unbounded", 2.0, 10.0)}).drop("unbounded")


def high_risk_findings(endpoints: DataFrame, vectors: DataFrame, secrets: DataFrame) -> DataFrame:
    """Risky vectors, open admin, exposed debug and secrets in one table."""
    def kind(rows: DataFrame, name: str, url: str, detail: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("kind"), F.col(url).alias("url"), detail.alias("detail"))

    risky = vectors.where(F.size("risk_indicators") > 0)
    out = kind(risky, "input_vector", "endpoint_url", F.concat("name", F.lit(" @ "), "location"))
    out = out.unionByName(kind(open_admin(endpoints), "open_admin", "url", F.col("method")))
    out = out.unionByName(kind(exposed_debug(endpoints), "exposed_debug", "url", F.col("method")))
    return out.unionByName(kind(secrets, "secret", "source_url", F.col("kind")))


PASSIVE_TAGS = ["wayback", "commoncrawl", "otx"]


def report_tables(endpoints: DataFrame, vectors: DataFrame, crawled: int | None = None, passive: int | None = None, risky: int | None = None) -> DataFrame:
    """The report's rows: crawled and passive endpoints, risky vectors; only the first of each when a number is given."""
    def first(rows: DataFrame, most: int | None, *order: str) -> DataFrame:
        return rows if most is None else rows.orderBy(*order).limit(most)

    is_passive = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in PASSIVE_TAGS]))
    key = F.concat_ws(" ", "method", "url").alias("key")
    out = first(endpoints.where(~is_passive), crawled, "seq").select(F.lit("crawled").alias("section"), key)
    out = out.union(first(endpoints.where(is_passive), passive, "seq").select(F.lit("passive"), key))
    top = first(vectors.where(F.size("risk_indicators") > 0), risky, "endpoint_url", "name", "location")
    return out.union(top.select(F.lit("risky"), F.concat_ws(" ", "endpoint_url", "name", "location")))


def path_search(endpoints: DataFrame, text: str) -> DataFrame:
    """Per path the endpoint with most parameters, first found on a tie."""
    path = F.coalesce(F.nullif(urls.path(F.col("url")), F.lit("")), F.lit("/"))
    rows = endpoints.withColumn("path", path).where(F.lower("path").contains(text.lower()))
    best = rows.groupBy("path").agg(F.min_by(F.struct("method", "url", "param_count"), F.struct(-F.col("param_count"), "seq")).alias("b"))
    return best.select("path", "b.*").orderBy("path")
