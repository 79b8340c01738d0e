"""Call sites, constants and literals of scripts, one row per case."""

import time

import pytest
from pyspark.sql import functions as F

from waymark.operators import jslex, scripts

CALLS = [
    # fetch with options
    ("fetch('/a/b')", [("/a/b", "GET", "fetch", 1, [])]),
    ("x\n\n  fetch(\"https://h.io/orgs\", { method: 'post', headers: { 'User-agent': 'M/4', Accept: a }, body: { k: [1, {z: 2}], 'l-m': 3 } })",
     [("https://h.io/orgs", "POST", "fetch", 3, [("User-agent", "header"), ("Accept", "header"), ("k", "body"), ("l-m", "body")])]),
    ("function p(url, d) { return fetch(url, {method: 'POST', body: JSON.stringify(d)}) }", []),
    ("fetch(`https://h.io/auth/${user}/${pass}`, {headers: {Authorization: 'Basic x'}})", [("https://h.io/auth/{user}/{pass}", "GET", "fetch", 1, [("Authorization", "header")])]),
    ("const mainEndpoint = 'https://g.io/v1';\nawait fetch(mainEndpoint, {method: 'POST', body: JSON.stringify({query: 'm { f(id: \"1\") }'})})", [("https://g.io/v1", "POST", "fetch", 2, [])]),
    ("window.fetch('/no'); refetch('/no'); this.axios.get('/no')", []),
    ("fetch('/m', {method: verb})", [("/m", "VERB", "fetch", 1, [])]),
    ("fetch('/deep', {a: {b: {c: {d: 1}}}, method: \"PUT\", ...rest, [h]: 1, fn() { return 2 }})", [("/deep", "PUT", "fetch", 1, [])]),
    # operands
    ("let apiBase = '/api/'; fetch(apiBase + '/users'); fetch('/items/' + id); fetch(apiBase || '/x')",
     [("/api/users", "GET", "fetch", 1, []), ("/items/", "GET", "fetch", 1, []), ("/api/x", "GET", "fetch", 1, [])]),
    ("fetch(ok ? '/a' : '/b'); fetch(make('/c')); fetch(o.url); fetch()", []),
    # clients
    ("axios.get('/u'); axios.post('/u', {name: 'J', email: e, role}); axios.delete('/u/1'); axios.patch('/u/1', {s: 1}); axios.create('/c')",
     [("/u", "GET", "axios", 1, []), ("/u", "POST", "axios", 1, [("name", "body"), ("email", "body")]), ("/u/1", "DELETE", "axios", 1, []), ("/u/1", "PATCH", "axios", 1, [("s", "body")]),
      ("/c", "GET", "axios", 1, [])]),
    ("$http.put('/p', {a: 1}); http.get('/t', {params: q}); client\n .head('/h')", [("/p", "PUT", "axios", 1, [("a", "body")]), ("/t", "GET", "axios", 1, []), ("/h", "HEAD", "axios", 1, [])]),
    # jquery
    ("$.ajax({type: 'post', url: '/e', data: {someData: true, n: 't'}}); $.ajax({method: \"PUT\", url: base})", [("/e", "POST", "jquery", 1, [("someData", "body"), ("n", "body")])]),
    ("$.get('/s', function(d) { $.post('/in', {q: 1}) }); $.getJSON('/j')",
     [("/s", "GET", "jquery", 1, []), ("/in", "POST", "jquery", 1, [("q", "body")]), ("/j", "GET", "jquery", 1, [])]),
    # XMLHttpRequest
    ("x.open('delete', '/x/1', true); new XMLHttpRequest().open('GET', `/y`); w.open('/one')", [("/x/1", "DELETE", "xhr", 1, []), ("/y", "GET", "xhr", 1, [])]),
    # what surrounds a call
    ("// fetch('/no')\n/* fetch('/no') */ s = \"fetch('/no')\"; fetch('/yes')", [("/yes", "GET", "fetch", 2, [])]),
    ("r = /fetch\\('\\/no[\"'/]/g; d = a / b; fetch('/yes')", [("/yes", "GET", "fetch", 1, [])]),
    ("t = `a ${ fetch('/in/' + `${x}`) } b`; fetch('/out')", [("/in/{x}", "GET", "fetch", 1, []), ("/out", "GET", "fetch", 1, [])]),
    ("fetch('it\\'s \\x2fok')", [("it\\'s /ok", "GET", "fetch", 1, [])]),
    ("fetch('\\u002fapi\\x2fv1')", [("/api/v1", "GET", "fetch", 1, [])]),
    ("{ 1:function(e){ e.exports={ f:function(){return fetch('/a/users')}, d:function(e){return fetch('/a/items/'+e,{method:'DELETE'})} } } }",
     [("/a/users", "GET", "fetch", 1, []), ("/a/items/", "DELETE", "fetch", 1, [])]),
    # broken sources
    ("fetch('/open", []), ("fetch('/a', {method: 'POST'", []), (")]}`${`", []), ("", []), ("fetch('/a'); 'unclosed\nfetch('/b')", [("/a", "GET", "fetch", 1, []), ("/b", "GET", "fetch", 2, [])]),
]


@pytest.mark.parametrize("source, calls", CALLS)
def test_calls(source, calls):
    assert jslex.Scan(source).calls == calls


def test_constants_and_literals():
    source = r"""const API_URL = "https://a.io/v2", n = '/x', hostName = `//h/${p}`; var baseUrl = '/one'; baseUrl = '/two'; let endpoint = "/e" + q; let serverUrl = 'ftp://x'
    const origin = '\x2fo'
    const list = ['/api/v1/users', 'POST', "/graphql", '/other', "https://z.io/a b", `/auth/${id}/me`, '/admin'];"""
    found = jslex.Scan(source)
    assert found.constants == {"API_URL": "https://a.io/v2", "hostName": "//h/{p}", "baseUrl": "/one", "origin": "/o"}
    assert found.literals() == [("https://a.io/v2", 1), ("/api/v1/users", 3), ("/graphql", 3), ("/auth/{id}/me", 3), ("/admin", 3)]


def test_time_grows_with_the_length():
    for unit in ("fetch('/api/a' + ", "`${", "((", "a / b; ", "'x", "var url = '/a', ", "{a:[", "$.ajax({url: '/b', data: {c: 1}}); "):
        start = time.time()
        jslex.Scan(unit * (200_000 // len(unit)))
        assert time.time() - start < 20, unit


def test_rows_per_script_and_url(spark):
    rows = [("s1", 0, "axios.post('/u', {a: 1});\naxios.put('/u', {b: 2}); fetch('/api/q'); z = '/api/q'"), ("s1", 1, None), ("s2", 0, "const apiUrl = '/r'; fetch(apiUrl + 's')")]
    table = spark.createDataFrame(rows, "source_url string, script_no int, source string")
    calls = {(r["source_url"], r["url"]): (r["method"], r["line"], [tuple(p) for p in r["parameters"]]) for r in scripts.call_sites(table).collect()}
    assert calls == {("s1", "/u"): ("POST", 1, [("a", "body"), ("b", "body")]), ("s1", "/api/q"): ("GET", 2, []), ("s2", "/r/s"): ("GET", 1, [])}
    assert {(r["name"], r["value"]) for r in scripts.base_constants(table).collect()} == {("apiUrl", "/r")}
    merged = {r["url"]: (r["tag"], r["line"], len(r["parameters"])) for r in scripts.analyse(table, "https://h.io/", "h.io").collect()}
    assert merged == {"/u": ("axios", 1, 2), "/api/q": ("fetch", 2, 0), "/r/s": ("fetch", 1, 0)}
    assert scripts.mine(table.limit(0)).count() == 0 and scripts.mine(table).where(F.col("kind") == "literal").count() == 1


def test_scripts_that_share_their_url_keep_their_calls(spark):
    rows = [("s", 0, "axios.post('/u', {b: 1}); axios.put('/u', {a: 2})"), ("s", 0, "fetch('/u')"), ("s", 0, "fetch('/u')")]
    table = spark.createDataFrame(rows, "source_url string, script_no int, source string")
    got = sorted((r["url"], r["client"], [tuple(p) for p in r["parameters"]]) for r in scripts.call_sites(table).collect())
    assert got == [("/u", "axios", [("a", "body"), ("b", "body")]), ("/u", "fetch", []), ("/u", "fetch", [])]
