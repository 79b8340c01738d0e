"""Page signatures: meta tags, script sources, markup, URL paths, icons."""

# Fixed values: (component, category, meta name, pattern, confidence, version group)
META_TAGS = [
    ("wordpress", "cms", "generator", r"(?i)WordPress\s*([0-9.]+)?", 0.95, 1),
    ("drupal", "cms", "generator", r"(?i)Drupal\s*([0-9.]+)?", 0.95, 1),
    ("joomla", "cms", "generator", "(?i)Joomla", 0.95, 0),
    ("hugo", "cms", "generator", r"(?i)Hugo\s*([0-9.]+)?", 0.9, 1),
    ("ghost", "cms", "generator", r"(?i)Ghost\s*([0-9.]+)?", 0.9, 1),
    ("shopify", "cms", "generator", "(?i)Shopify", 0.95, 0),
    ("wix", "cms", "generator", r"(?i)Wix\.com", 0.95, 0),
    ("squarespace", "cms", "generator", "(?i)Squarespace", 0.95, 0),
    ("gatsby", "framework", "generator", r"(?i)Gatsby\s*([0-9.]+)?", 0.9, 1),
    ("next_js", "framework", "generator", r"(?i)Next\.js", 0.9, 0),
    ("nuxt", "framework", "generator", "(?i)Nuxt", 0.9, 0),
    ("astro", "framework", "generator", r"(?i)Astro\s*([0-9.]+)?", 0.9, 1),
    ("docusaurus", "framework", "generator", r"(?i)Docusaurus\s*([0-9.]+)?", 0.9, 1),
]

# Fixed values: (component, category, pattern, confidence, version group)
SCRIPT_SOURCES = [
    ("jquery", "js_library", r"(?i)jquery[.-]?([0-9.]+)?(?:\.min)?\.js", 0.9, 1),
    ("react", "js_library", r"(?i)react(?:\.production|\.development)?[.-]?([0-9.]+)?(?:\.min)?\.js", 0.85, 1),
    ("vue", "js_library", r"(?i)vue(?:\.global|\.runtime)?[.-]?([0-9.]+)?(?:\.min)?\.js", 0.85, 1),
    ("angular", "js_library", r"(?i)angular(?:\.min)?\.js", 0.85, 0),
    ("angular", "js_library", r"(?i)(?:polyfills|runtime)\.[a-f0-9]+\.js", 0.1, 0),
    ("bootstrap", "js_library", r"(?i)bootstrap[.-]?([0-9.]+)?(?:\.bundle)?(?:\.min)?\.js", 0.85, 1),
    ("lodash", "js_library", r"(?i)lodash(?:\.min)?\.js", 0.85, 0),
    ("moment", "js_library", r"(?i)moment(?:\.min)?\.js", 0.8, 0),
    ("axios", "js_library", r"(?i)axios(?:\.min)?\.js", 0.8, 0),
    ("underscore", "js_library", r"(?i)underscore(?:\.min)?\.js", 0.8, 0),
    ("backbone", "js_library", r"(?i)backbone(?:\.min)?\.js", 0.8, 0),
    ("ember", "js_library", r"(?i)ember(?:\.min)?\.js", 0.85, 0),
    ("svelte", "js_library", "(?i)svelte", 0.7, 0),
    ("htmx", "js_library", r"(?i)htmx(?:\.min)?\.js", 0.85, 0),
    ("alpine", "js_library", r"(?i)alpine(?:\.min)?\.js|cdn\.jsdelivr\.net/npm/alpinejs", 0.85, 0),
    ("google_analytics", "analytics", r"(?i)google-analytics\.com/(?:analytics|ga)\.js|googletagmanager\.com/gtag", 0.9, 0),
    ("google_tag_manager", "analytics", r"(?i)googletagmanager\.com/gtm\.js", 0.9, 0),
    ("hotjar", "analytics", r"(?i)static\.hotjar\.com", 0.9, 0),
    ("segment", "analytics", r"(?i)cdn\.segment\.com/analytics\.js", 0.9, 0),
    ("facebook_pixel", "analytics", r"(?i)connect\.facebook\.net/.*/fbevents\.js", 0.9, 0),
    ("wordpress", "cms", "(?i)/wp-(?:includes|content)/", 0.9, 0),
    ("drupal", "cms", r"(?i)/(?:modules|sites/all)/.*\.js|drupal\.js", 0.8, 0),
    ("shopify", "cms", r"(?i)cdn\.shopify\.com", 0.9, 0),
    ("astro", "framework", "(?i)/_astro/", 0.85, 0),
    ("qwik", "framework", r"(?i)qwik(?:loader|city)?(?:\.min)?\.js|/q-[a-z0-9]+\.js", 0.85, 0),
    ("clarity", "analytics", r"(?i)clarity\.ms/tag/", 0.9, 0),
    ("plausible", "analytics", r"(?i)plausible\.io/js/", 0.9, 0),
]

# Fixed values: (component, category, pattern, confidence)
BODIES = [
    ("wordpress", "cms", "(?i)/wp-content/|/wp-includes/|wp-json", 0.85),
    ("drupal", "cms", r"(?i)jQuery\.extend\(Drupal\.settings|drupal\.org", 0.85),
    ("joomla", "cms", "(?i)/media/jui/|/components/com_", 0.8),
    ("magento", "cms", r"(?i)(?:Mage\.Cookies|/skin/frontend/|mage/cookies)", 0.8),
    ("shopify", "cms", r"(?i)Shopify\.theme|cdn\.shopify\.com", 0.85),
    ("wix", "cms", "(?i)_wixCIDX|wix-code-sdk|X-Wix-", 0.85),
    ("webflow", "cms", r"(?i)webflow\.com|Webflow|w-json|wf-page", 0.85),
    ("craft_cms", "cms", "(?i)craftcms|CRAFT_CSRF_TOKEN", 0.85),
    ("typo3", "cms", "(?i)typo3temp/|TYPO3|typo3conf/", 0.85),
    ("umbraco", "cms", "(?i)/umbraco/|umbracoArea", 0.8),
    ("django", "framework", "(?i)csrfmiddlewaretoken|__admin_media_prefix__", 0.8),
    ("rails", "framework", '(?i)name="authenticity_token"|data-turbo-|turbolinks', 0.8),
    ("laravel", "framework", '(?i)name="_token"|laravel_session', 0.75),
    ("spring", "framework", r"(?i)org\.springframework|spring-boot|Whitelabel Error Page", 0.75),
    ("aspnet_webforms", "framework", "(?i)__VIEWSTATE|__EVENTVALIDATION|aspnetForm", 0.9),
    ("aspnet_blazor", "framework", r"(?i)_blazor|blazor\.webassembly\.js|blazor\.server\.js", 0.9),
    ("next_js", "framework", "(?i)__NEXT_DATA__|/_next/static/", 0.9),
    ("nuxt", "framework", "(?i)__NUXT__|/_nuxt/", 0.9),
    ("gatsby", "framework", "(?i)___gatsby|gatsby-", 0.85),
    ("remix", "framework", "(?i)__remixContext|__remix", 0.85),
    ("svelte_kit", "framework", "(?i)__sveltekit", 0.85),
    ("astro", "framework", "(?i)astro-island|astro-slot|/_astro/", 0.9),
    ("qwik", "framework", "(?i)q:container|qwik/|q:manifest", 0.9),
    ("solidjs", "framework", r"(?i)_\$HY|_\$createComponent|solid-js", 0.8),
    ("docusaurus", "framework", "(?i)docusaurus|docsVersionDropdown", 0.85),
    ("preact", "js_library", "(?i)__PREACT_DEVTOOLS__|preact/compat", 0.8),
    ("lit", "js_library", "(?i)lit-html|lit-element|@lit/", 0.8),
    ("stimulus", "js_library", "(?i)data-controller=|stimulus", 0.7),
    ("turbo", "js_library", r"(?i)data-turbo-frame=|turbo-frame|Turbo\.session", 0.8),
    ("strapi", "cms", r"(?i)/uploads/.*strapi|strapi\.io", 0.75),
    ("payload_cms", "cms", "(?i)payloadcms|payload-admin", 0.8),
    ("react", "js_library", "(?i)data-reactroot|_reactRootContainer|__REACT_DEVTOOLS", 0.8),
    ("angular", "js_library", r"(?i)ng-version=|ng-app=|ng-controller=|\[ngClass\]", 0.85),
    ("vue", "js_library", r"(?i)data-v-[a-f0-9]|v-cloak|v-bind:|Vue\.component", 0.8),
    ("svelte", "js_library", "(?i)svelte-[a-z0-9]|__svelte", 0.8),
    ("ember", "js_library", "(?i)data-ember-|ember-view|EmberENV", 0.85),
    ("backbone", "js_library", r"(?i)Backbone\.Model|Backbone\.View", 0.8),
    ("htmx", "js_library", "(?i)hx-get=|hx-post=|hx-trigger=|hx-swap=", 0.85),
    ("alpine", "js_library", '(?i)x-data=\\s*["\\\'{]|x-bind:|x-on:', 0.7),
    ("bootstrap", "css_framework", '(?i)class="[^"]*\\b(?:col-(?:xs|sm|md|lg|xl)-[0-9]+|navbar-toggler|navbar-collapse)\\b', 0.7),
    ("tailwind", "css_framework", '(?i)class=["\\\'][^"\\\']*\\b(?:bg-(?:blue|red|green|gray|slate|zinc|neutral|stone|orange|amber|yellow|lime|emerald|teal|cyan|sky|indigo|violet|purple|fuchsia|pink|rose)-[0-9]{2,3})\\b', 0.5),
    ("materialize", "css_framework", '(?i)materialize(?:\\.min)?\\.css|class="[^"]*materialize', 0.8),
    ("bulma", "css_framework", r"(?i)bulma(?:\.min)?\.css", 0.85),
    ("foundation", "css_framework", r"(?i)foundation(?:\.min)?\.css", 0.85),
    ("google_fonts", "font", r"(?i)fonts\.googleapis\.com", 0.9),
    ("font_awesome", "font", "(?i)font-awesome|fontawesome", 0.85),
    ("recaptcha", "security", r"(?i)google\.com/recaptcha|g-recaptcha|grecaptcha", 0.9),
    ("hcaptcha", "security", r"(?i)hcaptcha\.com|h-captcha", 0.9),
    ("turnstile", "security", r"(?i)challenges\.cloudflare\.com/turnstile", 0.9),
]

# Fixed values: (component, category, pattern, confidence)
URL_PATHS = [
    ("wordpress", "cms", "(?i)/wp-(?:admin|login|content|includes|json)/", 0.9),
    ("drupal", "cms", r"(?i)/(?:node/[0-9]+|admin/structure|sites/default/files)", 0.8),
    ("joomla", "cms", "(?i)/administrator/|/components/com_", 0.8),
    ("magento", "cms", "(?i)/(?:checkout/cart|customer/account|catalog/product)", 0.35),
    ("spring_actuator", "framework", "(?i)/actuator(?:/health|/info|/env|/beans)?$", 0.85),
    ("laravel", "framework", "(?i)/telescope|/horizon|/_debugbar", 0.8),
    ("rails", "framework", "(?i)/rails/info/routes|/rails/mailers", 0.85),
    ("django", "framework", "(?i)/__debug__/|/admin/login/", 0.7),
    ("graphql", "api", "(?i)/graphql(?:[/?#]|$)|/graphiql(?:[/?#]|$)", 0.7),
    ("swagger", "api", r"(?i)/swagger-ui(?:[/?#.]|$)|/api-docs(?:[/?#]|$)|/openapi\.json(?:[?#]|$)", 0.75),
    ("elmah", "framework", r"(?i)/elmah\.axd", 0.9),
    ("phpmyadmin", "tool", "(?i)/phpmyadmin|/pma", 0.9),
    ("strapi", "cms", r"(?i)/api/.*\?populate=|/admin/content-manager", 0.7),
    ("directus", "cms", "(?i)/admin/content/|/_/items/", 0.7),
    ("supabase", "api", "(?i)/rest/v1/|/auth/v1/", 0.6),
    ("astro", "framework", "(?i)/_astro/", 0.8),
]

# Fixed values: (md5 of the icon, component, category, confidence)
FAVICONS = [
    ("d41d8cd98f00b204e9800998ecf8427e", "spring_boot", "framework", 0.50),
    ("0488faca4c19046b94d07c3ee83cf9d6", "tomcat", "server", 0.85),
    ("15f45e137e36488380ed76a2523849b7", "jenkins", "tool", 0.90),
    ("c77816a4f26e549b02c06540a0dc9cb5", "grafana", "tool", 0.90),
    ("8bac70891a8a4a23a1cbab1a8e6c3452", "kibana", "tool", 0.85),
    ("72a2671afb69c91a80c1b60445e73dfc", "gitlab", "tool", 0.90),
    ("8b3f7f6a38d3fe65a5f05c870e9af0e2", "jira", "tool", 0.90),
    ("a28b06e1c01b7c97b2a4eb33d0c3b6e2", "wordpress", "cms", 0.70),
    ("2cc3e05076b16bf76ea3277b0b4a8438", "phpmyadmin", "tool", 0.90),
]
FAVICON_URL = r"(?i)favicon\.ico|/favicon[^/]*\.(?:ico|png|svg)"
