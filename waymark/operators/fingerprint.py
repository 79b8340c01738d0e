"""Technology detection from headers, cookies, error pages and markup.

Every detector yields evidence rows
``component, category, source, detail, confidence, version, hits, first_seen``.
A detector is one SQL array of ``CASE`` arms over literal regexes, so a
signature list compiles into the scan; only the small evidence rows are
shuffled, never a body. Bodies that must count once are keyed by their hash.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..cluster import cut_lineage, written
from ..functions import classify, html, urls
from ..functions.structure import header
from ..functions.text import sql_text
from ..signatures import infra, tech

SOFT_404_COUNT = 5
MIN_BODY_BYTES = 32
KEEP_CONFIDENCE = 0.30
EVIDENCE = ["component", "category", "source", "detail", "confidence", "version", "hits", "first_seen"]
HIT = "array<struct<component:string,category:string,source:string,detail:string,confidence:double,version:string>>"


def _hit(component: str, category: str, source: str, detail: str, confidence: float, version: str = "''") -> str:
    """SQL struct; ``detail`` and ``version`` are SQL expressions."""
    return (
        f"named_struct('component', {sql_text(component)}, 'category', {sql_text(category)}, 'source', {sql_text(source)}, "
        f"'detail', {detail}, 'confidence', {float(confidence)!r}D, 'version', {version})"
    )


def _arms(arms: Sequence[tuple[str, str]]) -> str:
    """SQL array of the hits whose condition holds."""
    if not arms:
        return f"CAST(array() AS {HIT})"
    return "array_compact(array(" + ", ".join(f"CASE WHEN {when} THEN {hit} END" for when, hit in arms) + "))"


def _version(value: str, pattern: str, group: int) -> str:
    return f"regexp_extract({value}, {sql_text(pattern)}, {group})" if group else "''"


def _opened(rows: DataFrame, hits: str, *keep: str) -> DataFrame:
    """One row per hit.

    The arms are evaluated inside a lambda: dozens of regex arms generate a
    method too large for the JVM to compile, and the lambda is not generated.
    """
    inside = f"flatten(transform(array(0), one_ -> {hits}))"
    return rows.select(*keep, F.explode(F.expr(inside)).alias("hit")).select(*keep, "hit.*")


def _sum_up(rows: DataFrame) -> DataFrame:
    """Evidence rows summed per detail; the earliest version is kept."""
    return rows.groupBy("component", "category", "source", "detail", "confidence").agg(
        F.min_by(F.nullif("version", F.lit("")), F.when(F.col("version") != "", F.col("first_seen"))).alias("version"),
        F.sum("hits").alias("hits"),
        F.min("first_seen").alias("first_seen"),
    ).withColumn("version", F.coalesce("version", F.lit(""))).select(*EVIDENCE)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"hits": F.lit(1), "first_seen": F.struct("ts", "id")})


# ---- Header values -----------------------------------------------------


def header_values(txn: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct (name, value) of the headers of interest: count, first arrival.

    Most header values repeat, so they are combined before any regex runs.
    """
    rows = txn.select("ts", "id", F.explode("response_headers").alias("_name", "value"))
    rows = rows.select("ts", "id", F.lower("_name").alias("name"), "value").where(F.col("name").isin(list(names)) & (F.col("value") != ""))
    return rows.groupBy("name", "value").agg(F.count("*").alias("hits"), F.min(F.struct("ts", "id")).alias("first_seen"))


def header_lists(txn: DataFrame, names: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Distinct header lists of responses with count and first arrival.

    Values of headers that neither bear one of ``names`` nor start with one of
    ``prefixes`` are left out: dates and lengths would tell all lists apart.
    """
    def entry(e: Column) -> Column:
        name = F.lower(e["key"])
        read = name.isin(list(names))
        for p in prefixes:
            read = read | name.startswith(p)
        return F.struct(name.alias("name"), F.when(read, e["value"]).alias("value"))

    entries = F.transform(F.map_entries("response_headers"), entry)
    rows = txn.select("ts", "id", entries.alias("entries"))
    # sorted by the hash first: lists mostly begin alike
    rows = rows.groupBy(F.xxhash64("entries").alias("_h"), "entries").agg(F.count("*").alias("hits"), F.min(F.struct("ts", "id")).alias("first_seen"))
    return rows.drop("_h")


def _header_sql(signatures) -> str:
    """Arms grouped by header name, so a value meets only its own patterns."""
    detail = "concat(name, ': ', value)"
    by_name: dict[str, list] = {}
    for comp, cat, h, p, conf, g in signatures:
        by_name.setdefault(h, []).append((f"value RLIKE {sql_text(p)}", _hit(comp, cat, "header", detail, conf, _version("value", p, g))))
    cases = " ".join(f"WHEN {sql_text(h)} THEN {_arms(arms)}" for h, arms in by_name.items())
    return f"CASE name {cases} ELSE CAST(array() AS {HIT}) END"


def _cookie_sql(signatures) -> str:
    arms = [
        (f"startswith(c.name, {sql_text(mark)})" if prefix else f"c.name = {sql_text(mark)}",
         _hit(comp, cat, "cookie", "concat('Set-Cookie: ', c.name)", conf))
        for comp, cat, mark, prefix, conf in signatures
    ]
    return f"flatten(transform(cookies, c -> {_arms(arms)}))"


def _via_sql(proxies) -> str:
    arms = [(f"contains(lower(hop), {sql_text(p)})", _hit(p, "proxy", "via_header", "concat('Via: ', hop)", 0.80)) for p in proxies]
    return f"flatten(transform(transform(split(value, ','), h -> trim(h)), hop -> {_arms(arms)}))"


KEPT = ["hits", "first_seen"]


def _from_headers(values: DataFrame, signatures) -> DataFrame:
    return _opened(values, _header_sql(signatures), *KEPT)


def _from_cookies(values: DataFrame, signatures) -> DataFrame:
    rows = values.where("name = 'set-cookie'").withColumn("cookies", classify.cookie_pairs(F.col("value")))
    return _opened(rows, _cookie_sql(signatures), *KEPT)


def _from_via(values: DataFrame, proxies) -> DataFrame:
    return _opened(values.where("name = 'via'"), _via_sql(proxies), *KEPT)


def header_matches(txn: DataFrame, signatures=infra.HEADERS) -> DataFrame:
    return _sum_up(_from_headers(header_values(txn, sorted({s[2] for s in signatures})), signatures))


def cookie_matches(txn: DataFrame, signatures=infra.COOKIES) -> DataFrame:
    return _sum_up(_from_cookies(header_values(txn, ["set-cookie"]), signatures))


def via_matches(txn: DataFrame, proxies=infra.VIA_PROXIES) -> DataFrame:
    return _sum_up(_from_via(header_values(txn, ["via"]), proxies))


# ---- Whole responses ---------------------------------------------------


def _named(txn: DataFrame) -> DataFrame:
    """Adds the header entries in order, names in lower case."""
    entries = F.transform(
        F.map_entries("response_headers"), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value"))
    )
    return txn.withColumn("entries", entries)


def _prefix_sql(signatures) -> str:
    """First header that starts with the prefix, once per response."""
    arms = []
    for comp, cat, prefix, conf in signatures:
        first = f"get(filter(entries, e -> startswith(e.name, {sql_text(prefix)})), 0)"
        arms.append((f"{first} IS NOT NULL", _hit(comp, cat, "header_prefix", f"concat({first}.name, ': ', {first}.value)", conf)))
    return _arms(arms)


def _presence_sql(signatures) -> str:
    """All present headers there, none of the absent ones."""
    arms = []
    for comp, cat, present, absent, conf in signatures:
        text = f"has [{', '.join(present)}]" + (f" & missing [{', '.join(absent)}]" if absent else "")
        tests = [f"array_contains(names, {sql_text(h)})" for h in present] + [f"NOT array_contains(names, {sql_text(h)})" for h in absent]
        arms.append((" AND ".join(tests), _hit(comp, cat, "header_presence", sql_text(text), conf)))
    return _arms(arms)


def _error_sql(signatures) -> str:
    return _arms([
        (f"response_status BETWEEN {max(low, 400)} AND {high} AND response_body RLIKE {sql_text(p)}",
         _hit(comp, cat, "error_page", f"concat('HTTP ', response_status, {sql_text(' body matches ' + comp)})", conf))
        for comp, cat, p, conf, (low, high) in signatures
    ])


def header_prefix_matches(txn: DataFrame, signatures=infra.HEADER_PREFIXES) -> DataFrame:
    return _sum_up(_counted(_opened(_named(txn), _prefix_sql(signatures), "ts", "id")))


def name_sequences(txn: DataFrame) -> DataFrame:
    """Distinct sequences of header names with count and first arrival."""
    joined = F.array_join(F.transform(F.map_keys("response_headers"), F.lower), ",")
    rows = txn.groupBy(joined.alias("joined")).agg(F.count("*").alias("hits"), F.min(F.struct("ts", "id")).alias("first_seen"))
    return rows.withColumn("names", F.split("joined", ","))


def header_presence_matches(txn: DataFrame, signatures=infra.HEADER_PRESENCE) -> DataFrame:
    return _sum_up(_opened(name_sequences(txn), _presence_sql(signatures), *KEPT))


def error_page_matches(txn: DataFrame, signatures=infra.ERROR_PAGES) -> DataFrame:
    rows = txn.where(F.col("response_status") >= 400)
    return _sum_up(_counted(_opened(rows, _error_sql(signatures), "ts", "id")))


# ---- Header order ------------------------------------------------------


def header_orders(txn: DataFrame) -> DataFrame:
    """Distinct sequences of standard headers (two or more) with counts."""
    return _orders(name_sequences(txn))


def _orders(sequences: DataFrame) -> DataFrame:
    seq = F.filter("names", lambda h: h.isin(infra.STANDARD_HEADERS))
    rows = sequences.withColumn("seq", seq).where(F.size("seq") >= 2)
    return rows.groupBy(F.array_join("seq", ",").alias("sequence")).agg(F.sum("hits").alias("n"), F.min("first_seen").alias("first_seen"))


def _votes(orders: DataFrame, signatures) -> DataFrame:
    arms = [
        (f"concat(',', sequence, ',') RLIKE {sql_text(',' + ',(?:.*,)?'.join(order) + ',')}",
         f"named_struct('component', {sql_text(comp)}, 'category', {sql_text(cat)}, 'confidence', {float(conf)!r}D, 'rank', {rank})")
        for rank, (comp, cat, order, conf) in enumerate(signatures)
    ]
    rows = orders.select("n", "first_seen", F.explode(F.expr(_arms(arms))).alias("s"))
    return rows.groupBy("s.component", "s.category", "s.confidence", "s.rank").agg(
        F.sum("n").alias("votes"), F.min("first_seen").alias("first_seen")
    )


def header_order_matches(txn: DataFrame, signatures=infra.HEADER_ORDERS) -> DataFrame:
    """Votes per component: responses whose headers contain its order."""
    return _votes(header_orders(txn), signatures)


def header_order_winner(txn: DataFrame, signatures=infra.HEADER_ORDERS) -> DataFrame:
    """Evidence for the order most responses share, when at least half do."""
    return _winner(header_orders(txn), signatures)


def _winner(orders: DataFrame, signatures) -> DataFrame:
    best = _votes(orders, signatures).orderBy(F.col("votes").desc(), "rank").limit(1)
    best = best.withColumn("total", orders.agg(F.sum("n").alias("n")).scalar())
    text = F.format_string("Header ordering matched %s in %d/%d responses", "component", "votes", "total")
    return best.where((F.col("total") >= 3) & (F.col("votes") / F.col("total") >= 0.5)).select(
        "component", "category", F.lit("header_order").alias("source"), text.alias("detail"), "confidence",
        F.lit("").alias("version"), F.lit(1).cast("long").alias("hits"), "first_seen",
    )


# ---- DNS, bodies and URLs ----------------------------------------------


def cname_matches(dns: DataFrame, signatures=infra.CNAMES) -> DataFrame:
    """``dns``: host, cname. The first pattern that fits names the component."""
    arms = [(f"cname RLIKE {sql_text(p)}", _hit(comp, cat, "dns_cname", "concat(host, ' → ', cname)", 0.85)) for comp, cat, p in signatures]
    rows = dns.where(F.col("host") != F.col("cname")).select("host", F.get(F.expr(_arms(arms)), F.lit(0)).alias("hit"))
    return rows.where("hit IS NOT NULL").select("host", "hit.*")


def body_key(body: Column) -> Column:
    """Hash that identifies a body; empty for trivially short ones."""
    return F.when(F.octet_length(body) >= MIN_BODY_BYTES, F.md5(body)).otherwise("")


def soft_404_bodies(txn: DataFrame, least: int = SOFT_404_COUNT) -> DataFrame:
    """Hashes of HTML bodies served at least ``least`` times."""
    rows = txn.where(F.lower("response_content_type").contains("html"))
    rows = rows.select(body_key(F.col("response_body")).alias("body_hash")).where("body_hash <> ''")
    return rows.groupBy("body_hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def needed_literals(pattern: str, least: int = 3) -> list[str]:
    """Lower-cased texts of which every match of a regex holds one; none when the pattern does not tell.

    One text per top-level alternative: its longest run of plain characters.
    """
    texts, best, run, depth, i = [], "", "", 0, 0
    pattern = pattern.removeprefix("(?i)")
    while pattern.startswith("(?:") and pattern.endswith(")") and "(" not in pattern[3:]:
        pattern = pattern[3:-1]
    while i <= len(pattern):
        c = pattern[i:i + 1]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            plain, c = not pattern[i].isalnum(), pattern[i]
        elif c == "[":
            i, plain = pattern.index("]", i + 2), False
        else:
            plain = c not in ("", "(", ")", "|", ".", "^", "$", "*", "+", "?", "{", "}")
            depth += (c == "(") - (c == ")")
            if c == "{":
                i = pattern.index("}", i)
        if plain and not depth:
            run += c
        else:
            if c in ("*", "?", "{") and not plain:
                run = run[:-1]  # the last character may be missing
            best, run = max(best, run, key=len), ""
            if (c == "|" and not plain and not depth) or i >= len(pattern):
                texts.append(best.lower())
                best = ""
        i += 1
    return texts if all(len(t) >= least for t in texts) else []


def guarded(low: str, text: str, pattern: str) -> str:
    """SQL condition that ``text`` matches; the regex runs only where ``low`` (its lower case) holds a needed literal."""
    found = " OR ".join(f"contains({low}, {sql_text(t)})" for t in needed_literals(pattern))
    return f"({found}) AND {text} RLIKE {sql_text(pattern)}" if found else f"{text} RLIKE {sql_text(pattern)}"


def _page_sql(meta, scripts, bodies) -> str:
    """Meta, script, link and markup hits of one HTML body."""
    tags = _arms([
        (f"t.name = {sql_text(name)} AND t.content RLIKE {sql_text(p)}",
         _hit(comp, cat, "meta_tag", "concat(t.name, '=\"', t.content, '\"')", conf, _version("t.content", p, g)))
        for comp, cat, name, p, conf, g in meta
    ])

    def refs(column: str, source: str) -> str:
        arms = _arms([
            (f"r RLIKE {sql_text(p)}", _hit(comp, cat, source, "r", conf, _version("r", p, g)))
            for comp, cat, p, conf, g in scripts
        ])
        return f"flatten(transform({column}, r -> {arms}))"

    markup = _arms([
        (guarded("low_", "response_body", p), _hit(comp, cat, "body", f"regexp_extract(response_body, {sql_text(p)}, 0)", conf))
        for comp, cat, p, conf in bodies
    ])
    markup = f"flatten(transform(array(lower(response_body)), low_ -> {markup}))"
    return f"concat(flatten(transform(meta, t -> {tags})), {refs('srcs', 'script_src')}, {refs('hrefs', 'link_href')}, {markup})"


def _url_sql(signatures) -> str:
    return _arms([
        (f"request_url RLIKE {sql_text(p)}", _hit(comp, cat, "url_path", "request_url", conf))
        for comp, cat, p, conf in signatures
    ])


def _body_groups(txn: DataFrame) -> DataFrame:
    """HTML bodies by hash: how often each was served, and its first good response. Only hashes leave the scan."""
    rows = txn.where(F.lower("response_content_type").contains("html"))
    rows = rows.select(body_key(F.col("response_body")).alias("body_hash"), F.when(F.col("response_status") < 400, F.struct("ts", "id")).alias("at"))
    # short bodies are one group, left out by the readers: left out here, every hash would be made once more for the filter
    return written(rows.groupBy("body_hash").agg(F.count("*").alias("n"), F.min("at").alias("first")), "bodies")


def _soft_404(groups: DataFrame) -> DataFrame:
    return groups.where((F.col("body_hash") != "") & (F.col("n") >= SOFT_404_COUNT)).select("body_hash")


def _pages(txn: DataFrame, groups: DataFrame) -> DataFrame:
    """The first good response of every HTML body that is no soft 404, with the tags the signatures read."""
    page = F.col("response_body")
    first = groups.where((F.col("body_hash") != "") & (F.col("n") < SOFT_404_COUNT) & F.col("first").isNotNull()).select(F.col("first.id").alias("_id"), "body_hash")
    rows = txn.where((F.col("response_status") < 400) & F.lower("response_content_type").contains("html"))
    rows = rows.join(first, rows["id"].eqNullSafe(first["_id"])).drop("_id")
    # no equality, which would become a key of the join and be computed for every row
    rows = rows.where(body_key(page).between(F.col("body_hash"), F.col("body_hash")))
    return rows.withColumns({
        "meta": html.meta_tags(page), "srcs": html.all_matches(page, html.SCRIPT_SRC), "hrefs": html.all_matches(page, html.LINK_HREF),
    })


def _may_match(text: str, patterns: Sequence[str]) -> Column:
    """False where no pattern can match: the texts they need are looked for one by one, and the patterns that need none as they are."""
    needed = {p: needed_literals(p) for p in patterns}
    # plain searches over bytes: one regex of all texts would try each of them at every character
    def holds(low: Column) -> Column:
        found = F.lit(False)
        for t in sorted({t for texts in needed.values() for t in texts}):
            found = found | low.contains(t)
        return found

    found = F.exists(F.array(F.lower(text)), holds)
    for p in (p for p, texts in needed.items() if not texts):
        found = found | F.col(text).rlike(p)
    return found


def _url_hits(txn: DataFrame, signatures) -> DataFrame:
    """Hits of successful responses; bodies are hashed for rows that may hit only."""
    rows = txn.where(F.col("response_status").between(200, 399) & _may_match("request_url", [s[2] for s in signatures]))
    rows = rows.select("ts", "id", "request_url", body_key(F.col("response_body")).alias("body_hash"))
    return _opened(rows, _url_sql(signatures), "ts", "id", "body_hash")


def _evidence(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Evidence without the bodies of soft-404 groups.

    Rows are summed per (hit, body) first. A page hit counts a body once, a
    URL hit counts every response.
    """
    keys = ["component", "category", "source", "detail", "confidence", "version", "body_hash"]
    summed = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("first_seen"))
    real = summed.join(_soft_404(groups), "body_hash", "left_anti")
    return _sum_up(real.withColumn("hits", F.when(F.col("source") == "url_path", F.col("n")).otherwise(1)))


def _page_hits(txn: DataFrame, groups: DataFrame, meta, scripts, bodies) -> DataFrame:
    return _opened(_pages(txn, groups), _page_sql(meta, scripts, bodies), "ts", "id", "body_hash")


def page_matches(txn: DataFrame, meta=tech.META_TAGS, scripts=tech.SCRIPT_SOURCES, bodies=tech.BODIES) -> DataFrame:
    """Meta, script, link and markup hits of HTML pages, each body once."""
    groups = _body_groups(txn)
    return _evidence(_page_hits(txn, groups, meta, scripts, bodies), groups)


def url_path_matches(txn: DataFrame, signatures=tech.URL_PATHS) -> DataFrame:
    """URL hits on successful responses that are no soft 404."""
    return _evidence(_url_hits(txn, signatures), _body_groups(txn))


def favicon_matches(txn: DataFrame, icons=tech.FAVICONS) -> DataFrame:
    """MD5 of icon bodies looked up in the icon table."""
    rows = txn.where((F.col("response_status") == 200) & F.lower("request_url").contains("favicon") & F.col("request_url").rlike(tech.FAVICON_URL))
    rows = rows.where(F.octet_length("response_body") >= 16).select("ts", "id", F.md5("response_body").alias("md5"))
    arms = [(f"md5 = {sql_text(d)}", _hit(comp, cat, "favicon_hash", sql_text(f"md5={d} ({comp})"), conf)) for d, comp, cat, conf in icons]
    return _sum_up(_counted(_opened(rows, _arms(arms), "ts", "id")))


# ---- Cross-row inference -----------------------------------------------


def load_balancer(txn: DataFrame) -> DataFrame:
    """Evidence row when more than one Server value answers, most frequent first."""
    return _balancer(header_values(txn, ["server"]))


def _balancer(values: DataFrame) -> DataFrame:
    """``values``: value, hits, first_seen."""
    values = values.withColumnRenamed("hits", "n")
    total = values.agg(F.count("*").alias("variants")).scalar()
    top = values.withColumn("variants", total)
    shown = F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "value", F.format_string("%s (%dx)", "value", "n").alias("t")))), lambda s: s["t"]
    )
    one = top.groupBy("variants").agg(F.array_join(shown, ", ").alias("shown"), F.min("first_seen").alias("first_seen")).where("variants > 1")
    return one.select(
        F.lit("inferred_lb").alias("component"), F.lit("load_balancer").alias("category"), F.lit("server_diversity").alias("source"),
        F.concat(F.lit("Multiple Server headers detected: "), "shown").alias("detail"), F.lit(0.70).alias("confidence"),
        F.lit("").alias("version"), F.lit(1).cast("long").alias("hits"), "first_seen",
    )


def cache_topology(txn: DataFrame) -> DataFrame:
    """Hit and miss counts of X-Cache and whether Age was ever seen."""
    x = F.upper(header(F.col("response_headers"), "x-cache"))
    return txn.agg(
        F.count_if(x.contains("HIT")).alias("cache_hits"),
        F.count_if(~x.contains("HIT") & x.contains("MISS")).alias("cache_misses"),
        F.bool_or(header(F.col("response_headers"), "age") != "").alias("age_seen"),
        F.min(F.struct("ts", "id")).alias("first_seen"),
    ).withColumn("hit_ratio", F.try_divide("cache_hits", F.col("cache_hits") + F.col("cache_misses")))


def _cache_evidence(c: DataFrame) -> DataFrame:
    """``c``: cache_hits, cache_misses, age_seen, first_seen."""
    text = "concat('X-Cache: ', cache_hits, ' HITs / ', cache_hits + cache_misses, ' total')"
    arms = [
        ("cache_hits + cache_misses > 0", _hit("cache_layer", "cdn", "cache", text, 0.60)),
        ("age_seen", _hit("cache_layer", "cdn", "cache", "'Age header present'", 0.50)),
    ]
    return _opened(c, _arms(arms), "first_seen").withColumn("hits", F.lit(1).cast("long")).select(*EVIDENCE)


def cache_evidence(txn: DataFrame) -> DataFrame:
    return _cache_evidence(cache_topology(txn))


# ---- Fusion ------------------------------------------------------------


def fuse(evidence: DataFrame) -> DataFrame:
    """One row per component: probabilistic OR over the best hit per source."""
    by_source = evidence.groupBy("component", "category", "source").agg(
        F.max("confidence").alias("c"), F.sum("hits").alias("hits"), F.countDistinct("detail").alias("details"),
        F.min_by(F.nullif("version", F.lit("")), F.when(F.col("version") != "", F.col("first_seen"))).alias("version"),
        F.min(F.when(F.col("version") != "", F.col("first_seen"))).alias("version_seen"),
        F.min("first_seen").alias("first_seen"),
    )
    return by_source.groupBy("component", "category").agg(
        (1 - F.product(1 - F.col("c"))).alias("confidence"),
        F.sum("hits").alias("hit_count"),
        F.sum("details").alias("evidence_count"),
        F.coalesce(F.min_by("version", "version_seen"), F.lit("")).alias("version"),
        F.min("first_seen").alias("first_seen"),
    )


def infra_evidence(txn: DataFrame) -> DataFrame:
    """Header-stage evidence of every kind.

    The distinct header lists are written once; distinct header values, name
    sequences and prefixes are made of them and feed all header detectors and
    inferences. Error pages have a scan of their own.
    """
    names = sorted({s[2] for s in infra.HEADERS} | {"set-cookie", "via", "server", "x-cache", "age"})
    lists = written(header_lists(txn, names, [s[2] for s in infra.HEADER_PREFIXES]), "headers")
    each = lists.select("hits", "first_seen", F.explode("entries").alias("e")).select("hits", "first_seen", "e.*")
    each = each.where(F.col("name").isin(names) & (F.col("value") != ""))
    # a list can name a header twice, in another case; each counts
    values = cut_lineage(each.groupBy("name", "value").agg(F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen")))
    joined = F.array_join(F.transform("entries", lambda e: e["name"]), ",")
    sequences = lists.groupBy(joined.alias("joined")).agg(F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen"))
    sequences = cut_lineage(sequences.withColumn("names", F.split("joined", ",")))
    x = F.upper("value")
    hit = (F.col("name") == "x-cache") & x.contains("HIT")
    miss = (F.col("name") == "x-cache") & ~x.contains("HIT") & x.contains("MISS")

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("hits"))), F.lit(0))

    cache = values.where(F.col("name").isin("x-cache", "age")).agg(
        total(hit).alias("cache_hits"), total(miss).alias("cache_misses"), (total(F.col("name") == "age") > 0).alias("age_seen"),
        F.min("first_seen").alias("first_seen"),
    )
    direct = _from_headers(values, infra.HEADERS).unionByName(_from_cookies(values, infra.COOKIES)).unionByName(_from_via(values, infra.VIA_PROXIES))
    direct = direct.unionByName(_opened(sequences, _presence_sql(infra.HEADER_PRESENCE), *KEPT))
    direct = direct.unionByName(_opened(lists, _prefix_sql(infra.HEADER_PREFIXES), *KEPT))
    errors = _opened(txn.where(F.col("response_status") >= 400), _error_sql(infra.ERROR_PAGES), "ts", "id")
    summed = _sum_up(direct.unionByName(_counted(errors).drop("ts", "id")))
    return _stack([
        summed, _balancer(values.where("name = 'server'")), _winner(_orders(sequences), infra.HEADER_ORDERS), _cache_evidence(cache),
    ])


def tech_evidence(txn: DataFrame) -> DataFrame:
    """Page, URL and icon evidence; bodies are grouped once."""
    groups = _body_groups(txn)
    pages = _page_hits(txn, groups, tech.META_TAGS, tech.SCRIPT_SOURCES, tech.BODIES)
    return _stack([_evidence(pages.unionByName(_url_hits(txn, tech.URL_PATHS)), groups), favicon_matches(txn)])


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*EVIDENCE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*EVIDENCE))
    return out


def topology(detections: DataFrame) -> DataFrame:
    """Components from client to origin."""
    layers = F.create_map(*[F.lit(x) for kv in infra.LAYERS.items() for x in kv])
    return detections.withColumn("layer", F.coalesce(F.try_element_at(layers, F.col("category")), F.lit(99))).orderBy(
        "layer", "component"
    )


def category_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("category").agg(
        F.count_if(F.col("confidence") >= KEEP_CONFIDENCE).alias("detected"),
        F.count_if(F.col("confidence") >= 0.80).alias("high_confidence"),
    )


def detections_to_tech(detections: DataFrame, stage: int) -> DataFrame:
    """Kept detections in merge order: stage, then component, then category."""
    return detections.where(F.col("confidence") >= KEEP_CONFIDENCE).select(
        F.col("component").alias("name"), "category", "version", "confidence", "evidence_count",
        F.struct(F.lit(stage).alias("stage"), "component", "category").alias("seq"),
    )
