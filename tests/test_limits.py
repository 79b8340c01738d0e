"""Inputs beyond limits that a single-process crawler would set: nothing is cut."""

import json

from pyspark.sql import functions as F
from waymark.functions import html, structure
from waymark.operators import apispec, extract, frontier, graph, scripts, surface


def test_long_scripts_and_short_inline_scripts_are_mined(spark):
    big = "/*" + "x" * 6_000_000 + "*/ fetch('/api/late')"
    rows = [(1, "http://a/x.js", "application/javascript", "", big, "2024-01-01"), (2, "http://a/x.js", "application/javascript", "", "fetch('/api/later')", "2024-01-02"),
            (3, "http://a/p", "text/html", "real_content", "<script>fetch('/q')</script>", "2024-01-01")]
    txn = spark.createDataFrame(rows, "id long, request_url string, response_content_type string, page_type string, response_body string, ts string")
    found = {r["url"] for r in scripts.call_sites(scripts.script_table(txn)).collect()}
    assert found == {"/api/late", "/q"}


def test_secrets_with_one_long_prefix_stay_two(spark):
    one, two = "s" * 300 + "1", "s" * 300 + "2"
    rows = spark.createDataFrame([("u", f"token = '{one}'; password = '{two}';")], "source_url string, source string")
    assert {r["value"] for r in scripts.secrets(rows).collect()} == {one, two}


def test_deep_and_cyclic_schemas(spark):
    schemas = {f"L{i}": {"type": "object", "properties": {f"f{i}": {"type": "string"}, "n": {"$ref": f"#/components/schemas/L{i + 1}"}}} for i in range(9)}
    schemas["L9"] = {"type": "object", "properties": {"last": {"type": "integer"}, "back": {"$ref": "#/components/schemas/L0"}}}
    doc = {"paths": {"/x": {"post": {"requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/L0"}}}}}}}, "components": {"schemas": schemas}}
    docs = spark.createDataFrame([("u", json.dumps(doc))], "url string, body string")
    names = {r["name"] for r in apispec.flatten_openapi(docs)[1].collect()}
    assert names == {"n." * i + f"f{i}" for i in range(9)} | {"n." * 9 + "last"}


def test_graphql_types_of_any_depth(spark):
    ref = {"kind": "SCALAR", "name": "T", "ofType": None}
    for kind in ("NON_NULL", "LIST", "NON_NULL", "LIST", "NON_NULL"):
        ref = {"kind": kind, "name": None, "ofType": ref}
    schema = {"queryType": {"name": "Query"}, "types": [{"name": "Query", "kind": "OBJECT", "fields": [{"name": "f", "args": [{"name": "a", "type": ref}]}]}]}
    docs = spark.createDataFrame([("u", json.dumps({"data": {"__schema": schema}}))], "url string, body string")
    row = apispec.flatten_graphql(docs).first()
    assert (row["param_type"], row["required"]) == ("[[T!]!]!", True)


def test_long_chains_are_walked_to_the_end(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i) for i in range(60)], "src string, dst string, seq int")
    assert graph.reachable(edges, "n0").count() == 60
    assert graph.shortest_path(edges, "n0", "n55").count() == 55


def test_structure_sees_the_whole_body(spark):
    page = "<p>" * 250
    rows = spark.createDataFrame([(page + "<a>",), (page + "<b>",)], "body string")
    assert rows.select(structure.html_hash(F.col("body"))).distinct().count() == 2
    broken = spark.createDataFrame([("{" + "x" * 3000 + "1",), ("{" + "x" * 3000 + "2",)], "body string")
    assert broken.select(structure.json_hash(F.col("body"))).distinct().count() == 2


def test_link_text_and_parameter_values_are_whole(spark):
    page = spark.createDataFrame([("http://a/", "<a href='/x'>" + "t" * 150 + "</a>")], "url string, html string")
    assert len(page.select(F.explode(html.links(F.col("html"), F.col("url"))).alias("l")).first()["l"]["text"]) == 150
    urls = spark.createDataFrame([("http://a/?p=1&p=2&p=3&p=4",)], "url string")
    assert surface.query_parameters(urls).first()["sample_values"] == ["1", "2", "3", "4"]


def test_high_api_versions_have_siblings(spark):
    slots = spark.createDataFrame([("/v12/{id}", {"id": "integer"}, "http://a/v12/5")], "template string, slots map<string,string>, first_url string")
    energy, seen = spark.createDataFrame([("/v12/{id}", 100)], "template string, energy int"), spark.createDataFrame([], "url string")
    urls = {r["url"] for r in extract.candidate_urls(slots, energy, seen).collect()}
    assert {"http://a/v1/5", "http://a/v11/5", "http://a/v14/5"} <= urls and "http://a/v12/5" not in urls


def test_a_set_auth_flag_stays_and_paths_count(spark):
    endpoints = spark.createDataFrame([("http://a/x", True), ("http://a/y", False), ("http://a/z?q=1", None)], "url string, requires_auth boolean")
    boundaries = spark.createDataFrame([("/z",), ("http://b/",)], "url string")
    out = {r["url"]: r["requires_auth"] for r in surface.require_auth(endpoints, boundaries).collect()}
    assert out == {"http://a/x": True, "http://a/y": False, "http://a/z?q=1": True}


def test_beta_draws_have_the_right_quantiles(spark):
    import numpy as np

    for a, b in ((1, 1), (2, 5), (40, 3), (3000, 7000)):
        rows = spark.range(1999).select(frontier.beta_quantile(F.lit(float(a)), F.lit(float(b)), (F.col("id") + 1) / 2000.0).alias("q"))
        got = np.array([r["q"] for r in rows.collect()])
        want = np.quantile(np.random.default_rng(1).beta(a, b, 200_000), np.arange(1, 2000) / 2000)
        assert np.abs(got - want).max() < 0.02 and abs(got.mean() - a / (a + b)) < 0.004


def test_saved_reports_are_read_alone_and_in_lists_and_opened_once(spark, tmp_path):
    from waymark import sources

    def report(i):
        return {"target": f"t{i}", "endpoints": [{"url": f"u{i}", "method": "GET"}], "secrets": [{"kind": "token", "value": f"v{i}", "source_url": "s"}], "risk_summary": {"score": 5.0}}

    (tmp_path / "one.json").write_text(json.dumps(report(0), indent=2))
    (tmp_path / "list.json").write_text(json.dumps([report(i) for i in range(1, 150)]))
    tables = sources.read_report_documents(spark, str(tmp_path))
    (tmp_path / "one.json").unlink(), (tmp_path / "list.json").unlink()
    assert {r["url"] for r in tables["endpoints"].collect()} == {f"u{i}" for i in range(150)}
    assert tables["secrets"].count() == tables["risk_summary"].count() == 150
