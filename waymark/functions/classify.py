"""Row classifiers as one ``when`` chain each."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import urls
from .structure import header
from .text import any_of, contains_any, every_label, first_label, string_array

REDIRECTS = [301, 302, 303, 307, 308]
BLOCKING = [403, 406, 429, 503]
EMPTY_BODY_BYTES = 64

# ---- Fixed values: patterns and word lists that decide the results ----

WAF_HEADERS = [
    ("cf-ray", r"."),
    ("server", r"(?i)cloudflare"),
    ("x-amzn-requestid", r"."),
    ("x-akamai-transformed", r"."),
    ("x-sucuri-id", r"."),
    ("x-cdn", r"(?i)imperva|incapsula"),
]
WAF_BODY = [
    r"(?is)Attention\s+Required[^<]*Cloudflare",
    r"(?is)Access\s+Denied[^<]*AWS",
    r"(?i)Request\s+blocked",
    r"(?i)ModSecurity",
    r"(?i)Not\s+Acceptable!?\s*</",
    r"(?i)Web\s+Application\s+Firewall",
    r"(?i)This\s+request\s+has\s+been\s+blocked",
    r"(?i)<title>\s*403\s+Forbidden\s*</title>",
    r"(?is)Access\s+Denied.*?Incapsula|Powered\s+By\s+Incapsula",
    r"(?is)AkamaiGHost|Request\s+ID.*?akamai",
    r"(?i)Fastly\s+error:\s+unknown\s+domain|Varnish\s+cache\s+server",
]
ERROR_BODY = [
    r"Traceback \(most recent call last\)",
    r"(?:File|Module)\s+\"[^\"]+\",\s+line\s+[0-9]+",
    r"\bat\s+[A-Za-z0-9_$.]+\([A-Za-z0-9_]+\.java:[0-9]+\)",
    r"\bat\s+(?:com|org|net|io)\.[A-Za-z0-9_]+",
    r"java\.lang\.[A-Za-z0-9_]+Exception",
    r"System\.[A-Za-z0-9_]+Exception",
    r"(?i)Stack\s*Trace:",
    r"(?i)Server\s+Error\s+in\s+'/",
    r"(?i)(?:Fatal|Parse)\s+error:.*on\s+line\s+[0-9]+",
    r"(?i)<b>(?:Warning|Notice)</b>:.*in\s+<b>/",
    r"(?i)Whitelabel\s+Error\s+Page",
    r"(?i)Django\s+Debug",
    r"(?i)<title>Error</title>",
    r"(?i)Internal\s+Server\s+Error",
]
AUTH_REDIRECT = [r"(?i)login", r"(?i)signin", r"(?i)sign-in", r"(?i)auth", r"(?i)sso", r"(?i)cas/", r"(?i)oauth"]
AUTH_BODY = [
    r"(?is)<form[^>]*>.*?(?:type=[\"']password[\"']|name=[\"']password[\"'])",
    r"(?i)Please\s+(?:log\s*in|sign\s*in)",
    r"(?i)Authentication\s+required",
]
ADMIN_MARKERS = [r"(?i)admin\s*(panel|dashboard|console)", r"(?i)role[\"'\s:=]+[\"']?admin"]
USER_MARKERS = [r"(?i)logged\s+in\s+as", r"(?i)welcome\s+back", r"(?i)my\s+account", r"(?i)sign\s+out|log\s*out"]
FORM_TYPES = [
    ("login", ["username", "email", "password", "login", "signin"]),
    ("register", ["username", "email", "password", "confirm", "register", "signup"]),
    ("password_reset", ["email", "token", "new_password", "reset"]),
    ("search", ["q", "query", "search", "keyword"]),
    ("checkout", ["card", "payment", "cvv", "expiry", "billing"]),
]
UNSAFE_FIELDS = [
    "password", "passwd", "pass", "pwd", "secret",
    "card", "credit_card", "cc_number", "cvv", "cvc", "expiry",
    "ssn", "social_security",
    "token", "csrf", "csrf_token", "_token",
]
SEARCH_FIELDS = [
    "q", "query", "search", "keyword", "s", "term", "find",
    "sort", "order", "orderby", "page", "p", "offset",
    "limit", "per_page", "filter", "type", "category",
    "lang", "locale", "format", "output", "min", "max",
    "from", "to", "start", "end", "date",
]
SEARCH_NAMES = ["q", "query", "search", "keyword", "s", "term"]
VALUE_TYPES = [
    ("^-?[0-9]+$", "integer"),
    (r"^-?[0-9]+\.[0-9]+$", "float"),
    ("(?i)^(?:true|false|0|1|yes|no)$", "boolean"),
    (r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "email"),
    ("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "uuid"),
    ("^https?://", "url"),
    ("^[0-9]{4}-[0-9]{2}-[0-9]{2}", "date"),
    (r"^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+", "jwt"),
    (r"^\s*[\[{]", "json"),
    ("^[A-Za-z0-9+/]{16,}={0,2}$", "base64"),
    ("^[0-9a-fA-F]{8,}$", "hex"),
    (r"^(?:[/\\]|\.\./)", "path"),
]
NAME_TYPES = {
    "id": "integer", "user_id": "integer", "page": "integer", "limit": "integer",
    "offset": "integer", "count": "integer", "size": "integer", "num": "integer",
    "email": "email", "mail": "email",
    "url": "url", "uri": "url", "link": "url", "redirect": "url",
    "callback": "url", "next": "url", "return": "url", "goto": "url",
    "file": "path", "path": "path", "dir": "path", "filename": "path",
    "token": "string", "key": "string", "api_key": "string",
    "password": "string", "secret": "string",
    "enabled": "boolean", "active": "boolean", "debug": "boolean",
    "date": "date", "start_date": "date", "end_date": "date",
    "json": "json", "data": "json", "body": "json", "payload": "json",
}
ENDPOINT_RISKS = [
    ("admin_context", "(?i)/admin|/manage|/dashboard|/internal"),
    ("api_context", "(?i)/api/|/v[0-9]+/|/graphql"),
    ("upload_context", "(?i)/upload|/import|/attach|/file"),
    ("auth_context", "(?i)/login|/auth|/token|/session|/oauth"),
    ("search_context", "(?i)/search|/query|/find|/lookup"),
    ("debug_context", "(?i)/debug|/test|/dev|/actuator|/phpinfo"),
]
RISK_NAMES = {
    "ssrf_candidate": ["url", "uri", "host", "target", "proxy", "redirect", "next", "return", "callback", "fetch", "load"],
    "lfi_candidate": ["file", "path", "dir", "include", "require", "read", "template", "view", "source"],
    "sqli_candidate": ["id", "user", "username", "email", "name", "query", "search", "filter", "sort", "order"],
    "cmdi_candidate": ["cmd", "command", "exec", "action", "run"],
    "ssti_candidate": ["template", "view", "render", "lang", "language"],
    "redirect_candidate": ["redirect", "url", "next", "return", "callback", "goto", "to"],
}
SECURITY_WEIGHTS = [
    ("(?i)/admin", 5.0), ("(?i)/api/internal", 5.0), ("(?i)/debug", 4.0), ("(?i)/graphql", 3.0),
    ("(?i)/upload", 3.0), ("(?i)/auth|/login|/oauth", 3.0), ("(?i)/api/", 2.0),
    ("(?i)/config|/settings", 2.0), ("(?i)/actuator|/health|/metrics", 2.0),
]
LOGIN_WORDS = ["login", "signin", "auth", "sso"]
API_TYPES = ["XHR", "Fetch"]
API_MIME = [
    "application/json", "application/graphql+json", "application/graphql-response+json",
    "application/x-ndjson", "text/event-stream",
]
SPA_MARKERS = [
    'id="__next"', 'id="app"', 'id="root"', "ng-app=", "data-reactroot",
    "window.__NUXT__", "window.__NEXT_DATA__",
]
SAFE_METHODS = ["GET", "HEAD", "OPTIONS"]


def _head(body: Column, chars: int | None) -> Column:
    """Whole text, or its first ``chars`` when a limit is asked for."""
    return body if chars is None else F.substring(body, 1, chars)


# ---- Pages -------------------------------------------------------------


def auth_level(body: Column, chars: int | None = None) -> Column:
    text = _head(body, chars)
    return (
        F.when(any_of(text, ADMIN_MARKERS), "admin")
        .when(any_of(text, USER_MARKERS), "authenticated")
        .otherwise("anonymous")
    )


def waf_block(status: Column, body: Column, headers: Column) -> Column:
    marked = F.lit(False)
    for name, pattern in WAF_HEADERS:
        marked = marked | header(headers, name).rlike(pattern)
    branded = (status == 403) & (F.length(body) > 1000) & F.lower(body).contains("<html")
    return (status.isin(BLOCKING) & (marked | any_of(body, WAF_BODY))) | branded


def page_type(
    status: Column, body: Column, headers: Column, custom_404: Column, chars: int | None = None
) -> Column:
    """Ordered page classes; ``custom_404`` is the flag from the baseline match."""
    text = _head(body, chars)
    waf = waf_block(status, text, headers)
    return (
        F.when((F.octet_length(body) < EMPTY_BODY_BYTES) & ~status.isin(REDIRECTS), "empty")
        .when(status.between(300, 399) & any_of(header(headers, "location"), AUTH_REDIRECT), "auth_required")
        .when(status.between(300, 399), "redirect")
        .when(status.isin(401, 403) & waf, "waf_block")
        .when(status.isin(401, 403), "auth_required")
        .when(any_of(text, AUTH_BODY), "auth_required")
        .when(waf, "waf_block")
        .when(status >= 500, "error")
        .when(any_of(text, ERROR_BODY), "error")
        .when(custom_404 | (status == 404), "custom_404")
        .otherwise("real_content")
    )


def insight(status: Column, headers: Column) -> Column:
    """Struct (insight_type, detail), null when the response says nothing."""
    allow = header(headers, "allow")
    location = header(headers, "location")

    def row(kind: str, detail) -> Column:
        text = detail if isinstance(detail, Column) else F.lit(detail)
        return F.struct(F.lit(kind).alias("insight_type"), text.alias("detail"))

    return (
        F.when(status == 403, row("auth_boundary", "Path exists but requires authorization"))
        .when(status == 401, row("auth_boundary", "Explicit authentication required"))
        .when(
            status == 405,
            row(
                "method_hint",
                F.when(allow != "", F.concat(F.lit("Method not allowed. Accepted: "), allow)).otherwise(
                    "Method not allowed"
                ),
            ),
        )
        .when(status == 500, row("server_processing", "Input reached server-side processing (internal error)"))
        .when(
            status.isin(REDIRECTS) & contains_any(F.lower(location), LOGIN_WORDS),
            row("redirect_boundary", F.concat(F.lit("Redirects to auth: "), location)),
        )
    )


def needs_rendering(status: Column, content_type: Column, body: Column) -> Column:
    text = F.lower(body)
    thin = content_type.contains("html") & (F.length(F.trim(text)) < 200)
    shell = (
        contains_any(text, SPA_MARKERS)
        & (F.regexp_count(text, F.lit("<a ")) < 3)
        & (F.regexp_count(text, F.lit("href=")) < 5)
    )
    return status.between(200, 399) & (thin | shell)


def is_api_call(resource_type: Column, mime: Column) -> Column:
    api = resource_type.isin(API_TYPES)
    for prefix in API_MIME:
        api = api | mime.startswith(prefix)
    return F.coalesce(api, F.lit(False))


def is_third_party(url: Column, target: str) -> Column:
    host = urls.authority(url)
    return (url != "") & (host != target) & ~host.endswith("." + target)


def unsafe_request(method: Column, source: Column) -> Column:
    """auth / unsafe_method for requests that need a person's consent, else null."""
    return F.when(
        ~F.upper(method).isin(SAFE_METHODS),
        F.when(source.startswith("s7_auth"), "auth").otherwise("unsafe_method"),
    )


# ---- Forms -------------------------------------------------------------


def form_type(field_names: Column) -> Column:
    """Best keyword overlap of at least two; the first listed type wins a tie."""
    names = F.array_distinct(F.transform(field_names, lambda n: F.replace(F.lower(n), F.lit("-"), F.lit("_"))))
    scored = F.array(
        *[
            F.struct(
                F.size(F.array_intersect(names, string_array(words))).alias("score"),
                F.lit(-rank).alias("rank"),
                F.lit(kind).alias("kind"),
            )
            for rank, (kind, words) in enumerate(FORM_TYPES)
        ]
    )
    best = F.array_max(scored)
    return F.when(best["score"] >= 2, best["kind"])


def form_safety(field_names: Column, method: Column) -> Column:
    names = F.transform(field_names, F.lower)

    def has(words) -> Column:
        return F.arrays_overlap(names, string_array(words))

    return (
        F.when(has(UNSAFE_FIELDS) & has(["password", "passwd"]), "login")
        .when(has(UNSAFE_FIELDS), "unsafe")
        .when(has(SEARCH_NAMES), "search")
        .when(has(SEARCH_FIELDS), "filter")
        .when(F.upper(method) == "GET", "filter")
        .otherwise("generic")
    )


# ---- Parameters --------------------------------------------------------


def value_type(value: Column) -> Column:
    """First of the ordered value patterns that matches."""
    return first_label(value, VALUE_TYPES)


def name_type(name: Column) -> Column:
    """Type hinted by the parameter name, else null."""
    table = F.create_map(*[F.lit(x) for kv in NAME_TYPES.items() for x in kv])
    return F.try_element_at(table, F.replace(F.lower(name), F.lit("-"), F.lit("_")))


def infer_type(name: Column, samples: Column) -> Column:
    """Name hint, else majority of the sample types, ties to the type seen first."""
    def winner(votes: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(votes),
            lambda t: F.struct(
                F.size(F.filter(votes, lambda v: v == t)).alias("n"),
                (-F.array_position(votes, t)).alias("first"),
                t.alias("kind"),
            ),
        )
        return F.array_max(ranked)["kind"]

    # the votes are the value of a lambda: as an expression they would be made again at each of their uses
    votes = F.array(F.array_compact(F.transform(samples, value_type)))
    return F.coalesce(name_type(name), F.get(F.transform(votes, winner), F.lit(0)), F.lit("string"))


def endpoint_risks(url: Column) -> Column:
    return every_label(url, ENDPOINT_RISKS)


def name_risks(name: Column) -> Column:
    low = F.lower(name)
    return F.array_compact(F.array(*[F.when(low.isin(words), F.lit(tag)) for tag, words in RISK_NAMES.items()]))


def security_weight(url: Column) -> Column:
    return F.coalesce(first_label(url, SECURITY_WEIGHTS), F.lit(0.0))


# ---- Cookies and flows -------------------------------------------------


def cookie_pairs(set_cookie: Column) -> Column:
    """(name, value) of each cookie in a comma-joined header.

    Commas also occur in expiry dates, so only the part before the first
    semicolon counts and a name must start with a letter.
    """
    parts = F.transform(F.split(set_cookie, ","), lambda p: F.trim(F.regexp_extract(p, "(?s)^([^;]*)", 1)))
    pairs = F.transform(
        F.filter(parts, lambda p: p.contains("=")),
        lambda p: F.struct(
            F.trim(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("name"),
            F.trim(F.regexp_extract(p, "(?s)^[^=]*=(.*)", 1)).alias("value"),
        ),
    )
    return F.filter(pairs, lambda c: c["name"].rlike("^[A-Za-z]"))


# Flow names in test order.
FLOW_NAMES = [
    ("login_flow", ["login", "signin"]),
    ("registration_flow", ["register", "signup"]),
    ("checkout_flow", ["checkout", "payment"]),
    ("cart_flow", ["cart"]),
    ("password_reset_flow", ["password", "reset"]),
    ("oauth_flow", ["oauth", "authorize"]),
]
SIDE_EFFECT_WORDS = ["register", "signup", "create", "delete", "payment", "checkout"]


def flow_name(url_has, steps: Column) -> Column:
    """Name from a callable giving, per word list, whether any URL has a word."""
    case = None
    for name, words in FLOW_NAMES:
        hit = url_has(words)
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise(F.concat(F.lit("flow_"), steps.cast("string"), F.lit("_steps")))
