"""Infrastructure signatures: headers, cookies, error pages, DNS names."""

# Fixed values: (component, category, header, pattern, confidence, version group)
HEADERS = [
    ("cloudflare", "cdn", "cf-ray", "(?i).+", 0.95, 0),
    ("cloudflare", "cdn", "cf-cache-status", "(?i)(?:HIT|MISS|BYPASS|DYNAMIC|EXPIRED|STALE|UPDATING|REVALIDATED)", 0.9, 0),
    ("cloudflare", "cdn", "cdn-loop", "(?i)cloudflare", 0.9, 0),
    ("akamai", "cdn", "x-akamai-transformed", "(?i).+", 0.9, 0),
    ("akamai", "cdn", "akamai-grn", "(?i).+", 0.95, 0),
    ("akamai", "cdn", "x-akamai-edgescape", "(?i).+", 0.85, 0),
    ("fastly", "cdn", "x-served-by", "(?i)cache-", 0.9, 0),
    ("fastly", "cdn", "fastly-ff", "(?i).+", 0.95, 0),
    ("fastly", "cdn", "x-fastly-request-id", "(?i).+", 0.9, 0),
    ("cloudfront", "cdn", "x-amz-cf-id", "(?i).+", 0.95, 0),
    ("cloudfront", "cdn", "x-amz-cf-pop", r"(?i)[A-Z]{3}[0-9]+", 0.95, 0),
    ("azure_cdn", "cdn", "x-azure-ref", "(?i).+", 0.85, 0),
    ("google_cdn", "cdn", "x-goog-hash", "(?i).+", 0.8, 0),
    ("cloudflare_waf", "waf", "server", "(?i)cloudflare", 0.8, 0),
    ("aws_waf", "waf", "x-amzn-waf-action", "(?i).+", 0.9, 0),
    ("aws_waf", "waf", "x-amzn-waf-rule", "(?i).+", 0.85, 0),
    ("aws", "server", "x-amzn-requestid", "(?i).+", 0.5, 0),
    ("imperva", "waf", "x-cdn", "(?i)(?:imperva|incapsula)", 0.9, 0),
    ("sucuri", "waf", "x-sucuri-id", "(?i).+", 0.9, 0),
    ("sucuri", "waf", "x-sucuri-cache", "(?i).+", 0.85, 0),
    ("modsecurity", "waf", "server", "(?i)mod_security", 0.85, 0),
    ("f5_bigip", "waf", "server", "(?i)BigIP|BIG-IP", 0.85, 0),
    ("barracuda", "waf", "server", "(?i)Barracuda", 0.85, 0),
    ("nginx", "proxy", "server", r"(?i)nginx(?:/([0-9.]+))?", 0.85, 1),
    ("apache", "proxy", "server", r"(?i)Apache(?:/([0-9.]+))?", 0.85, 1),
    ("varnish", "proxy", "via", "(?i)varnish", 0.85, 0),
    ("varnish", "proxy", "x-varnish", r"(?i)[0-9]+", 0.9, 0),
    ("envoy", "proxy", "server", "(?i)envoy", 0.9, 0),
    ("envoy", "proxy", "x-envoy-upstream-service-time", r"(?i)[0-9]+", 0.85, 0),
    ("traefik", "proxy", "server", "(?i)Traefik", 0.85, 0),
    ("caddy", "proxy", "server", "(?i)Caddy", 0.85, 0),
    ("haproxy", "proxy", "via", "(?i)haproxy", 0.8, 0),
    ("openresty", "proxy", "server", r"(?i)openresty(?:/([0-9.]+))?", 0.85, 1),
    ("litespeed", "proxy", "server", r"(?i)LiteSpeed(?:/([0-9.]+))?", 0.85, 1),
    ("aws_alb", "load_balancer", "x-amzn-trace-id", "(?i)Root=", 0.8, 0),
    ("aws_elb", "load_balancer", "server", "(?i)awselb", 0.9, 0),
    ("iis", "server", "server", r"(?i)Microsoft-IIS(?:/([0-9.]+))?", 0.9, 1),
    ("tomcat", "server", "server", r"(?i)Apache-Coyote(?:/([0-9.]+))?", 0.85, 1),
    ("gunicorn", "server", "server", r"(?i)gunicorn(?:/([0-9.]+))?", 0.85, 1),
    ("waitress", "server", "server", "(?i)waitress", 0.85, 0),
    ("uvicorn", "server", "server", "(?i)uvicorn", 0.85, 0),
    ("express", "server", "x-powered-by", "(?i)Express", 0.85, 0),
    ("php", "server", "x-powered-by", r"(?i)PHP(?:/([0-9.]+))?", 0.9, 1),
    ("aspnet", "server", "x-powered-by", r"(?i)ASP\\.NET", 0.9, 0),
    ("aspnet", "server", "x-aspnet-version", r"(?i)([0-9.]+)", 0.9, 1),
    ("rails", "server", "x-runtime", r"(?i)[0-9.]+", 0.75, 0),
    ("django", "server", "x-frame-options", "(?i)SAMEORIGIN", 0.15, 0),
    ("kestrel", "server", "server", "(?i)Kestrel", 0.85, 0),
    ("jetty", "server", "server", r"(?i)Jetty(?:\(([0-9.]+)\))?", 0.85, 1),
    ("werkzeug", "server", "server", r"(?i)Werkzeug(?:/([0-9.]+))?", 0.85, 1),
    ("tornado", "server", "server", r"(?i)TornadoServer(?:/([0-9.]+))?", 0.85, 1),
    ("aiohttp", "server", "server", "(?i)Python/aiohttp", 0.85, 0),
    ("python_http", "server", "server", r"(?i)(?:BaseHTTP|CPython|Python)(?:/([0-9.]+))?", 0.8, 1),
    ("flask", "server", "x-powered-by", "(?i)Flask", 0.85, 0),
    ("django", "server", "x-powered-by", "(?i)Django", 0.85, 0),
    ("laravel", "server", "x-powered-by", "(?i)Laravel", 0.85, 0),
    ("spring_boot", "server", "x-powered-by", "(?i)Spring", 0.8, 0),
    ("next_js", "server", "x-powered-by", r"(?i)Next\\.js", 0.85, 0),
    ("passenger", "server", "x-powered-by", r"(?i)Phusion\s+Passenger", 0.85, 0),
    ("puma", "server", "x-powered-by", "(?i)Puma", 0.85, 0),
    ("fastapi", "server", "server", "(?i)uvicorn|starlette", 0.8, 0),
    ("vercel", "cdn", "x-vercel-id", "(?i).+", 0.95, 0),
    ("vercel", "cdn", "server", "(?i)Vercel", 0.9, 0),
    ("vercel", "cdn", "x-vercel-cache", "(?i)(?:HIT|MISS|STALE|PRERENDER)", 0.9, 0),
    ("netlify", "cdn", "x-nf-request-id", "(?i).+", 0.95, 0),
    ("netlify", "cdn", "server", "(?i)Netlify", 0.9, 0),
    ("fly_io", "server", "fly-request-id", "(?i).+", 0.9, 0),
    ("fly_io", "server", "server", "(?i)Fly/", 0.85, 0),
    ("render", "server", "server", "(?i)Render", 0.85, 0),
    ("railway", "server", "server", "(?i)Railway", 0.85, 0),
    ("heroku", "server", "via", "(?i)vegur", 0.85, 0),
    ("github_pages", "cdn", "server", r"(?i)GitHub\.com", 0.9, 0),
    ("cloudflare_pages", "cdn", "cf-ray", "(?i).+", 0.5, 0),
    ("firebase", "cdn", "x-firebase-hosting-version", "(?i).+", 0.95, 0),
    ("aws_amplify", "cdn", "x-amz-apigw-id", "(?i).+", 0.7, 0),
    ("deno_deploy", "server", "server", "(?i)deno/", 0.9, 0),
    ("fortiweb", "waf", "server", "(?i)FortiWeb", 0.9, 0),
    ("netscaler", "waf", "via", "(?i)NS-CACHE", 0.8, 0),
    ("netscaler", "waf", "cneonction", "(?i).+", 0.85, 0),
    ("datadome", "waf", "x-datadome", "(?i).+", 0.9, 0),
    ("datadome", "waf", "server", "(?i)DataDome", 0.9, 0),
]

# Fixed values: (component, category, header prefix, confidence)
HEADER_PREFIXES = [
    ("perimeterx", "waf", "x-px-", 0.85),
    ("aws", "server", "x-amz-", 0.4),
]

# Fixed values: (component, category, header order, confidence)
HEADER_ORDERS = [
    ("nginx", "proxy", ('server', 'date', 'content-type'), 0.45),
    ("apache", "proxy", ('date', 'server', 'content-type'), 0.45),
    ("iis", "server", ('content-type', 'server', 'x-powered-by'), 0.4),
    ("gunicorn", "server", ('server', 'date', 'content-type', 'content-length'), 0.35),
    ("caddy", "proxy", ('server', 'alt-svc', 'content-type'), 0.4),
    ("express", "server", ('x-powered-by', 'content-type'), 0.35),
]

# Fixed values: (component, category, present, absent, confidence)
HEADER_PRESENCE = [
    ("go_http", "server", ('content-type', 'date'), ('server', 'x-powered-by'), 0.3),
    ("deno", "server", ('content-type',), ('server', 'x-powered-by'), 0.25),
    ("express", "server", ('x-powered-by',), ('server',), 0.3),
    ("litespeed", "proxy", ('x-litespeed-cache',), (), 0.85),
    ("litespeed", "proxy", ('x-turbo-charged-by',), (), 0.8),
    ("drupal", "cms", ('x-drupal-cache',), (), 0.9),
    ("fastapi", "server", ('x-process-time',), (), 0.75),
]

# Fixed values: (component, category, cookie name, is prefix, confidence)
COOKIES = [
    ("aws_alb", "load_balancer", "AWSALB", False, 0.9),
    ("aws_alb", "load_balancer", "AWSALBCORS", False, 0.85),
    ("haproxy", "load_balancer", "SERVERID", False, 0.7),
    ("cloudflare", "cdn", "cf_clearance", False, 0.85),
    ("cloudflare", "cdn", "__cfduid", False, 0.8),
    ("cloudflare_bot", "waf", "__cf_bm", False, 0.85),
    ("imperva", "waf", "incap_ses_", True, 0.9),
    ("imperva", "waf", "visid_incap_", True, 0.9),
    ("shape_security", "waf", "reese84", False, 0.8),
    ("datadome", "waf", "datadome", False, 0.85),
    ("fortiweb", "waf", "FORTIWAFSID", False, 0.9),
    ("perimeterx", "waf", "_px", True, 0.8),
    ("java", "server", "JSESSIONID", False, 0.7),
    ("php", "server", "PHPSESSID", False, 0.8),
    ("aspnet", "server", "ASP.NET_SessionId", False, 0.85),
    ("ruby_rack", "server", "rack.session", False, 0.8),
    ("rails", "server", "_rails_session", True, 0.85),
    ("express", "server", "connect.sid", False, 0.75),
    ("laravel", "server", "laravel_session", False, 0.85),
    ("wordpress", "cms", "wp-settings-", True, 0.85),
    ("wordpress", "cms", "wordpress_logged_in_", True, 0.9),
    ("drupal", "cms", "Drupal.visitor.", True, 0.85),
    ("concrete5", "cms", "CONCRETE5", False, 0.85),
    ("vercel", "cdn", "__vercel_live_token", False, 0.9),
    ("netlify", "cdn", "nf_jwt", False, 0.8),
]

# Fixed values: (component, category, pattern, confidence, (lowest, highest status))
ERROR_PAGES = [
    ("nginx", "proxy", r"(?i)<center>\s*nginx(?:/([0-9.]+))?\s*</center>", 0.85, (400, 599)),
    ("apache", "proxy", r"(?i)Apache(?:/([0-9.]+))?\s+Server\s+at\s+\S+\s+Port\s+[0-9]+", 0.85, (400, 599)),
    ("iis", "server", r"(?i)Internet\s+Information\s+Services", 0.85, (400, 599)),
    ("cloudflare", "cdn", r"(?i)Cloudflare\s+Ray\s+ID|Error\s+10[0-2][0-9]", 0.8, (400, 599)),
    ("varnish", "proxy", r"(?i)Guru\s+Meditation|Varnish\s+cache\s+server", 0.85, (500, 599)),
    ("tomcat", "server", r"(?i)Apache\s+Tomcat(?:/([0-9.]+))?", 0.85, (400, 599)),
    ("spring_boot", "server", r"(?i)Whitelabel\s+Error\s+Page", 0.8, (400, 599)),
    ("django", "server", r"(?i)Django\s+Debug|You\'re\s+seeing\s+this\s+error\s+because", 0.85, (400, 599)),
    ("flask", "server", r"(?i)Werkzeug\s+Debugger|Traceback\s+\(most\s+recent\s+call\s+last\)", 0.7, (400, 599)),
    ("aspnet", "server", r"(?i)Server\s+Error\s+in\s+'/|ASP\.NET\s+is\s+configured", 0.85, (400, 599)),
]

# Fixed values: (component, category, pattern)
CNAMES = [
    ("cloudflare", "cdn", r"(?i)\.cloudflare\.net$"),
    ("cloudfront", "cdn", r"(?i)\.cloudfront\.net$"),
    ("akamai", "cdn", r"(?i)\.akamai(?:edge|tech|ized)?\.net$"),
    ("fastly", "cdn", r"(?i)\.fastly\.net$"),
    ("azure_cdn", "cdn", r"(?i)\.azureedge\.net$"),
    ("incapsula", "waf", r"(?i)\.incapdns\.net$"),
    ("sucuri", "waf", r"(?i)\.sucuri\.net$"),
    ("stackpath", "cdn", r"(?i)\.stackpathdns\.com$"),
    ("edgecast", "cdn", r"(?i)\.edgecastcdn\.net$"),
    ("vercel", "cdn", r"(?i)\.vercel-dns\.com$"),
    ("netlify", "cdn", r"(?i)\.netlify\.app$|\.netlify\.com$"),
    ("fly_io", "cdn", r"(?i)\.fly\.dev$|\.fly\.io$"),
    ("heroku", "server", r"(?i)\.herokuapp\.com$|\.herokussl\.com$"),
    ("render", "server", r"(?i)\.onrender\.com$"),
]

# Proxies named in a Via hop
VIA_PROXIES = ["varnish", "cloudflare", "akamai", "haproxy", "envoy", "nginx", "apache", "squid", "traefik"]

# Headers whose order is compared
STANDARD_HEADERS = [
    "date", "server", "content-type", "content-length",
    "connection", "keep-alive", "transfer-encoding",
    "cache-control", "pragma", "expires", "etag",
    "last-modified", "vary", "x-powered-by", "alt-svc",
    "strict-transport-security", "content-encoding",
    "x-content-type-options", "x-frame-options",
]

# Network layer per category, client side first
LAYERS = {"cdn": 0, "waf": 1, "load_balancer": 2, "proxy": 3, "server": 4, "cms": 5}
