"""Registered queries against their SQL at the smallest scale.

One query per operator group keeps the run short; WAYMARK_ALL=1 runs all.
"""

import os

import pytest

import oracle
from waymark.plans import ORACLES, QUERIES

SF = os.environ.get("WAYMARK_SF", "/root/testdata/sf0.001")
QUICK = [
    "scl_02_url_template", "scl_20_page_type", "flt_01_transaction_filter", "src_07_feed_union", "snk_01_append_transactions",
    "ext_02_forms", "ext_11_script_analysis", "jn_02_header_signatures", "jn_13_reflection", "agg_01_endpoint_merge",
    "agg_30_path_collapse", "win_02_saturation", "win_06_flows", "top_01_priority_score", "set_02_queue_merge",
    "grf_01_reachable_states", "dq_03_response_semantics", "str_03_coverage", "udf_03_sql_functions",
]
#: Queries whose start or goal lies beyond the smallest tables.
EMPTY_AT_SMALLEST = {"grf_02_shortest_path"}
NAMES = sorted(ORACLES) if os.environ.get("WAYMARK_ALL") else QUICK


@pytest.fixture(scope="session")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    empty = {"EMPTY"} if name in EMPTY_AT_SMALLEST and SF.endswith("sf0.001") else set()
    assert oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], SF) in {None, *empty}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
