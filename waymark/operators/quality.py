"""Data-quality plays: tables in, finding rows out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import any_of

# Fixed values: (group, module, names, categories, reason)
MODULE_RULES = [
    ("PHP", "s6_passive", ["php", "wordpress", "drupal", "joomla", "laravel"], [],
     "PHP detected; passive collection can find PHP-specific paths"),
    ("REST API", "s5_api", ["rest", "api", "swagger", "openapi"], ["api"],
     "API patterns detected; API discovery module recommended"),
    ("JavaScript SPA", "s4_js", ["react", "vue", "angular", "next.js", "nuxt"], [],
     "SPA framework detected; JS analysis essential for route discovery"),
]


def recommended_modules(tech: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Modules that the detected technologies call for and nobody selected.

    An empty selection means every module runs, so nothing is recommended.
    """
    hits = [
        F.when(
            F.lower("name").isin(names) | (F.lower("category").isin(cats) if cats else F.lit(False)),
            F.struct(F.lit(group).alias("detected_tech"), F.lit(module).alias("module"), F.lit(reason).alias("reason")),
        )
        for group, module, names, cats, reason in MODULE_RULES
        if selected and module not in selected
    ]
    hits = hits or [F.lit(None).cast("struct<detected_tech:string,module:string,reason:string>")]
    found = tech.select(F.explode(F.array_compact(F.array(*hits))).alias("r"))
    return found.select("r.*").distinct()

# Text of failed logins and of error pages, placeholder words.
LOGIN_FAILURE = [
    r"(?i)login\s+fail|invalid\s+(credentials?|username|password)|"
    r"incorrect\s+(password|username|credentials?)|"
    r"authentication\s+fail|access\s+denied|wrong\s+password",
]
ERROR_TEXT = [
    r"(?i)not\s+found|page\s+not\s+found|does\s+not\s+exist|"
    r"error\s+404|no\s+such|cannot\s+find|"
    r"access\s+denied|forbidden|unauthorized",
]
PLACEHOLDERS = ["test", "example", "placeholder", "xxx", "dummy", "sample", "demo", "todo"]

FINDING = "struct<play:string,severity:string,title:string,detail:string,evidence:map<string,string>,auto_action:string>"


def _text(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def finding(play: str, severity: str, title, detail="", auto_action: str = "", **evidence) -> Column:
    """Finding struct; titles and details may be columns."""
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), _text(v))]
    facts = F.create_map(*pairs) if pairs else F.create_map()
    return F.struct(
        F.lit(play).alias("play"), F.lit(severity).alias("severity"), _text(title).alias("title"), _text(detail).alias("detail"),
        facts.cast("map<string,string>").alias("evidence"), F.lit(auto_action).alias("auto_action"),
    ).cast(FINDING)


def _emit(stats: DataFrame, found: Sequence[Column], otherwise: Column | None = None, when: Column | None = None) -> DataFrame:
    """Rows for the findings that apply, or the one for when none does."""
    hits = F.array_compact(F.array(*found))
    if otherwise is not None:
        hits = F.when(F.size(hits) == 0, F.array(otherwise)).otherwise(hits)
    rows = stats if when is None else stats.where(when)
    return rows.select(F.explode(hits).alias("f")).select("f.*")


def _wide(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(measure, n) rows as one row of columns."""
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)).alias(m) for m in names])


def _measure(name: str, rows: DataFrame, value: Column | None = None) -> DataFrame:
    total = F.count("*") if value is None else value
    return rows.agg(total.cast("double").alias("n")).select(F.lit(name).alias("measure"), "n")


def completeness(tables: dict[str, DataFrame]) -> DataFrame:
    """Enough endpoints, not too many failures or server errors."""
    txn = tables["transactions"]
    play = "P1_completeness"
    status = F.col("response_status")
    names = ["endpoints", "total", "failed", "server_errors"]
    counts = _measure("endpoints", tables["endpoints"]).union(_measure("total", txn)).union(
        _measure("failed", txn, F.count_if(status == 0))).union(_measure("server_errors", txn, F.count_if(status.between(500, 599))))
    s = _wide(counts, names)
    eps, total, failed, errors = (F.col(n).cast("long") for n in names)
    return _emit(
        s,
        [
            F.when((eps < 5) & (total > 20), finding(play, "fail", "Very few endpoints discovered",
                   F.format_string("Only %d endpoints found after %d requests.", eps, total), endpoints_found=eps, requests_total=total)),
            F.when((total > 0) & (failed / total > 0.5), finding(play, "warn", "High error rate",
                   F.format_string("%d/%d requests failed.", failed, total), failed=failed, total=total, rate=F.round(failed / total, 3))),
            F.when((total > 0) & (errors / total > 0.2), finding(play, "warn", "High server error rate",
                   F.format_string("%d/%d responses are 5xx.", errors, total), count_5xx=errors, total=total, rate=F.round(errors / total, 3))),
        ],
        finding(play, "info", "Completeness check passed", F.format_string("%d endpoints discovered from %d requests.", eps, total), endpoints_found=eps, requests_total=total),
    )


def login_verification(tables: dict[str, DataFrame], url_contains: str = "login") -> DataFrame:
    """Did posted logins work? Stops at the first clear verdict in arrival order."""
    from ..functions.classify import REDIRECTS
    from ..functions.structure import header

    play = "P2_auth"
    status, body = F.col("response_status"), F.col("response_body")
    posts = tables["transactions"].where(F.col("request_url").contains(url_contains) & (F.col("request_method") == "POST"))
    location = header(F.col("response_headers"), "location")
    cookie = header(F.col("response_headers"), "set-cookie") != ""
    where = F.concat(F.lit("POST "), "request_url", F.lit(" returned "), status.cast("string"))
    facts = {"url": F.col("request_url"), "status": status}
    verdict = (
        F.when(any_of(body, LOGIN_FAILURE), finding(play, "fail", "Login response contains failure keywords", where, "Sessions invalidated due to likely authentication failure.", **facts))
        .when(status.isin(REDIRECTS) & F.lower(location).contains("login"), finding(play, "fail", "Login redirect loop detected", where, "Sessions invalidated due to redirect loop.", **facts))
        .when(~cookie & (status == 200), finding(play, "warn", "Login returned 200 but no Set-Cookie", where, **facts))
        .when(cookie, finding(play, "info", "Login appears successful", where, **facts))
    )
    order = F.struct("ts", "id").alias("seq")
    rows = posts.select(order, verdict.alias("f"))
    final = F.col("f.title") != "Login returned 200 but no Set-Cookie"
    stop = rows.agg(F.min(F.when(final, F.col("seq"))).alias("seq")).scalar()
    shown = rows.where("f IS NOT NULL").where(stop.isNull() | (F.col("seq") <= stop)).select("f.*")
    none = _emit(
        posts.agg(F.count("*").alias("n")), [finding(play, "warn", "No login POST requests found", "The request log holds no POST to a login URL.")], when=F.col("n") == 0
    )
    return shown.unionByName(none)


def response_semantics(tables: dict[str, DataFrame]) -> DataFrame:
    """Soft 404s, error text behind 200, near-empty pages, JSON error payloads."""
    play = "P3_semantics"
    txn = tables["transactions"]
    body = F.col("response_body")
    ok = txn.where(F.col("response_status") == 200)
    html = ok.where(F.col("response_content_type").contains("html"))
    json = ok.where(F.col("response_content_type").contains("json"))
    groups = html.groupBy("content_hash").agg(F.count("*").alias("n")).where("n >= 5")
    keys = F.json_object_keys(body)
    counts = _measure("pages", html).union(_measure("groups", groups)).union(_measure("affected", groups, F.sum("n"))).union(
        _measure("errors", html, F.count_if(any_of(body, ERROR_TEXT)))).union(_measure("tiny", html, F.count_if(F.octet_length(body) < 100))).union(
        _measure("json_errors", json, F.count_if(F.arrays_overlap(keys, F.array(F.lit("error"), F.lit("errors"))))))
    names = ["pages", "groups", "affected", "errors", "tiny", "json_errors"]
    s = _wide(counts, names)
    pages, found, affected, errors, tiny, bad = (F.col(n).cast("long") for n in names)
    return _emit(
        s,
        [
            F.when(found > 0, finding(play, "warn", F.format_string("Soft-404 detected: %d duplicate response patterns", found),
                   F.format_string("%d URLs returned identical content.", affected), "Registered content hashes for dedup filtering.",
                   duplicate_groups=found, total_affected_urls=affected)),
            F.when(errors > 3, finding(play, "warn", F.format_string("%d potential false positive endpoints", errors), "200 OK with error-like content.", count=errors)),
            F.when(tiny > 5, finding(play, "info", F.format_string("%d responses with near-empty bodies", tiny), "200 OK responses with less than 100 bytes.", count=tiny)),
            F.when(bad > 2, finding(play, "warn", F.format_string("%d JSON error responses with 200 OK", bad), "API responses returning 200 OK with error payloads.", count=bad)),
        ],
        finding(play, "info", "Response semantics check passed", F.format_string("Analyzed %d responses.", pages)),
        when=pages >= 5,
    )


def vector_quality(tables: dict[str, DataFrame]) -> DataFrame:
    """Parameter coverage and the distribution of risk tags."""
    play = "P4_input_vectors"
    eps, vectors = tables["endpoints"], tables["vectors"]
    risks = vectors.select(F.explode("risk_indicators").alias("risk")).groupBy("risk").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("risk", "n"))), lambda r: F.concat_ws("=", r["risk"], r["n"].cast("string"))), ",")
    names = ["endpoints", "with_params", "vectors", "risky", "reflected"]
    counts = _measure("endpoints", eps).union(_measure("with_params", eps, F.count_if(F.col("param_count") > 0))).union(_measure("vectors", vectors)).union(
        _measure("risky", vectors, F.count_if(F.size("risk_indicators") > 0))).union(_measure("reflected", vectors, F.count_if("is_reflected")))
    s = _wide(counts, names).withColumn("risks", F.coalesce(risks.agg(text.alias("t")).scalar(), F.lit("")))
    n, filled, total, risky, reflected = (F.col(c).cast("long") for c in names)
    bare = 1 - filled / n
    return _emit(
        s,
        [
            F.when((bare > 0.7) & (n > 10), finding(play, "warn", "Low parameter coverage", F.format_string("%d/%d endpoints have no parameters.", n - filled, n),
                   endpoints_total=n, endpoints_with_params=filled, paramless_ratio=F.round(bare, 3))),
            finding(play, "info", "Input vector summary", F.format_string("%d input vectors across %d endpoints. %d high-risk, %d reflected.", total, n, risky, reflected),
                    total_vectors=total, high_risk=risky, reflected=reflected, risk_distribution=F.col("risks")),
        ],
        when=n > 0,
    )


def tech_coverage(tables: dict[str, DataFrame], selected: Sequence[str] = ()) -> DataFrame:
    """Are the right modules on for the technologies found?"""
    play = "P5_tech_coverage"
    tech = tables["tech"]
    advice = recommended_modules(tech, selected)
    warn = advice.select(finding(
        play, "warn", F.concat(F.lit("Module "), "module", F.lit(" recommended for "), "detected_tech"), F.col("reason"),
        detected_tech=F.col("detected_tech"), recommended_module=F.col("module"),
    ).alias("f")).select("f.*")
    s = _wide(_measure("tech", tech).union(_measure("advice", advice)), ["tech", "advice"])
    n = F.col("tech").cast("long")
    rest = _emit(s, [
        F.when(n == 0, finding(play, "info", "No technologies detected", "Fingerprinting found no technologies.")),
        F.when((n > 0) & (F.col("advice") == 0), finding(play, "info", "Tech coverage adequate", "Module selection matches detected technologies.", tech_count=n)),
    ])
    return warn.unionByName(rest)


def scope_efficiency(tables: dict[str, DataFrame], least: int = 20) -> DataFrame:
    """Endpoints per request, and URL templates asked for too often."""
    play = "P6_scope"
    txn = tables["transactions"]
    template = F.regexp_replace(F.substring_index("request_url", "?", 1), "/[0-9]+", "/{id}")
    busiest = txn.groupBy(template.alias("template")).agg(F.count("*").alias("n")).where(F.col("n") > least)
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "template", "n"))), lambda r: F.concat_ws("=", r["template"], r["n"].cast("string")))
    over = busiest.agg(F.count("*").alias("oversampled"), F.array_join(listed, ",").alias("templates"))
    counts = _measure("endpoints", tables["endpoints"]).union(_measure("total", txn))
    s = _wide(counts, ["endpoints", "total"])
    over_n = over.select("oversampled").scalar()
    s = s.withColumn("oversampled", over_n).withColumn("templates", over.select("templates").scalar())
    eps, total, n = F.col("endpoints").cast("long"), F.col("total").cast("long"), F.col("oversampled")
    share = eps / total
    return _emit(
        s,
        [
            F.when(n > 0, finding(play, "warn", F.format_string("%d over-sampled URL templates", n), "Some URL templates received significantly more requests than necessary.", oversampled=F.col("templates"))),
            finding(play, "info", F.format_string("Scope efficiency: %.1f%%", share * 100), F.format_string("%d unique endpoints from %d requests.", eps, total),
                    unique_endpoints=eps, total_requests=total, efficiency=F.round(share, 4)),
        ],
        when=total >= 10,
    )


def secret_plausibility(tables: dict[str, DataFrame]) -> DataFrame:
    """Placeholder values, short tokens, and what is left."""
    play = "P7_secrets"
    low = F.lower("value")
    fake = F.lit(False)
    for w in PLACEHOLDERS:
        fake = fake | low.contains(w)
    short = (F.length("value") < 10) & F.col("kind").isin("api_key", "token")
    s = tables["secrets"].agg(F.count("*").alias("total"), F.count_if(fake).alias("fake"), F.count_if(short).alias("short"))
    total, fakes, shorts = F.col("total"), F.col("fake"), F.col("short")
    left = total - fakes - shorts
    return _emit(s, [
        F.when(total == 0, finding(play, "info", "No secrets discovered", "No secrets or credentials found in responses.")),
        F.when(fakes > 0, finding(play, "warn", F.format_string("%d likely false positive secrets", fakes), "Values with placeholder words are probably not real credentials.", count=fakes)),
        F.when(shorts > 0, finding(play, "warn", F.format_string("%d suspiciously short tokens", shorts), "Keys or tokens shorter than 10 characters.", count=shorts)),
        F.when((total > 0) & (left > 0), finding(play, "info", F.format_string("%d potentially valid secrets found", left), F.format_string("Total secrets: %d", total), total=total, filtered_valid=left)),
    ])


def discovery_momentum(tables: dict[str, DataFrame]) -> DataFrame:
    """Per phase: saturated, stuck, or still finding. ``phases`` and ``coverage`` rows."""
    play = "P8_momentum"
    overall = tables["coverage"].agg(
        F.bool_and("saturated").alias("saturated"), F.sum("unique_coverage").alias("unique_coverage"), F.sum("total_checked").alias("total_checked")
    )
    rows = tables["phases"].withColumn("saturated", overall.select("saturated").scalar())
    new, asked = F.col("new_coverage"), F.col("requests")
    rate = F.when(asked > 0, new / asked).otherwise(0.0)
    verdict = (
        F.when(F.col("saturated"), finding(play, "info", "Coverage saturated", "Further crawling has diminishing returns.", phase=F.col("phase")))
        .when((asked > 50) & (new == 0), finding(play, "warn", "No new coverage from this phase", F.format_string("Phase made %d requests but discovered 0 new coverage.", asked), phase=F.col("phase"), phase_requests=asked))
        .otherwise(finding(play, "info", F.format_string("Discovery momentum: %.1f%%", rate * 100), F.format_string("Phase produced %d new coverage from %d requests.", new, asked),
                           phase=F.col("phase"), new_coverage=new, phase_requests=asked, phase_discovery_rate=F.round(rate, 4)))
    )
    return rows.select(verdict.alias("f")).select("f.*")


def hints(findings: DataFrame) -> DataFrame:
    """Configuration hints for the next run."""
    p, s, t = F.col("play"), F.col("severity"), F.col("title")
    hint = lambda action, text: F.struct(F.lit(action).alias("action"), _text(text).alias("description"))
    chosen = (
        F.when((p == "P2_auth") & (s == "fail"), hint("fix_auth", "Authentication failed. Verify credentials and login URL."))
        .when((p == "P5_tech_coverage") & (s == "warn"), hint("enable_module", F.concat(F.lit("Enable "), F.col("evidence")["recommended_module"], F.lit(" for better coverage of detected technology."))))
        .when((p == "P1_completeness") & (s == "fail"), hint("increase_depth", "Very few endpoints found. Consider increasing depth or checking target."))
        .when((p == "P6_scope") & t.contains("over-sampled"), hint("focus_area", "Over-sampled templates. Consider excluding or rate-limiting these paths."))
    )
    return findings.select("play", chosen.alias("h")).where("h IS NOT NULL").select("play", "h.*")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


Play = Callable[[dict[str, DataFrame]], DataFrame]

# phase -> plays; callers add their own functions to a copy
PLAYS: dict[str, list[Play]] = {
    "active_crawl": [completeness, response_semantics, scope_efficiency, discovery_momentum],
    "fingerprinting": [tech_coverage],
    "auth_crawl": [login_verification],
    "deep_crawl": [response_semantics, scope_efficiency, discovery_momentum],
    "param_discovery": [vector_quality],
    "classification": [secret_plausibility],
}


def run_plays(tables: dict[str, DataFrame], phase: str, plays: dict[str, list[Play]] = PLAYS) -> DataFrame:
    """Findings of every play registered for a phase."""
    out = None
    for play in plays.get(phase, []):
        rows = play(tables)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise KeyError(f"no play registered for phase {phase!r}")
    return out.withColumn("phase", F.lit(phase))
