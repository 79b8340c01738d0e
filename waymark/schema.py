"""Declared schemas. Nothing is inferred on read."""

from pyspark.sql import Column, functions as F, types as T

STRING, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


TRANSACTIONS = struct(
    id=STRING, timestamp=T.TimestampType(), request_method=STRING, request_url=STRING,
    request_headers=T.MapType(STRING, STRING), request_body=T.BinaryType(),
    request_content_type=STRING, response_status=INT,
    response_headers=T.MapType(STRING, STRING), response_body=T.BinaryType(),
    response_content_type=STRING, response_url_final=STRING, source_module=STRING,
    depth=INT, page_type=STRING, content_hash=STRING,
)

PARAMETER = struct(
    name=STRING, location=STRING, sample_values=STRINGS, param_type=STRING,
    required=T.BooleanType(), source_module=STRING,
)
ENDPOINTS = struct(
    url=STRING, method=STRING, status_code=INT, content_type=STRING, source_module=STRING,
    depth=INT, tags=STRINGS, page_type=STRING, requires_auth=T.BooleanType(),
    path_template=STRING, parameters=T.ArrayType(PARAMETER),
)
INPUT_VECTORS = struct(
    endpoint_url=STRING, name=STRING, location=STRING, input_type=STRING,
    is_reflected=T.BooleanType(), sample_values=STRINGS, risk_indicators=STRINGS,
    source_module=STRING,
)
AUTH_BOUNDARIES = struct(
    url=STRING, method=STRING, unauth_status=INT, auth_status=INT, boundary_type=STRING,
    access_matrix=T.MapType(STRING, INT),
)
TECH = struct(
    name=STRING, version=STRING, category=STRING, confidence=T.DoubleType(),
    evidence=STRINGS, implied_paths=STRINGS,
)
SECRETS = struct(
    kind=STRING, value=STRING, source_url=STRING, line=INT, entropy=T.DoubleType(),
    risk_indicators=STRINGS,
)
API_SCHEMAS = struct(
    schema_type=STRING, url=STRING, raw_content=STRING, auth_schemes=STRINGS,
)
RISK_SUMMARY = struct(
    total_endpoints=INT, total_input_vectors=INT, high_risk_vectors=INT,
    auth_boundaries_found=INT, unprotected_admin_paths=INT, exposed_debug_endpoints=INT,
    secrets_found=INT, score=T.DoubleType(),
)
REPORT = struct(
    target=STRING, scan_duration=T.DoubleType(), endpoints=T.ArrayType(ENDPOINTS),
    input_vectors=T.ArrayType(INPUT_VECTORS), auth_boundaries=T.ArrayType(AUTH_BOUNDARIES),
    tech_stack=T.ArrayType(TECH), api_schemas=T.ArrayType(API_SCHEMAS),
    secrets=T.ArrayType(SECRETS), risk_summary=RISK_SUMMARY,
)

SUB_REQUEST = struct(
    url=STRING, method=STRING, resource_type=STRING, initiator_url=STRING, status_code=INT,
    mime_type=STRING, is_api_call=T.BooleanType(), is_third_party=T.BooleanType(),
)
CONSOLE = struct(level=STRING, text=STRING, url=STRING, line=INT)
SECURITY_HEADERS = struct(
    csp=STRING, csp_report_only=STRING, cors_allow_origin=STRING, cors_allow_credentials=STRING,
    x_frame_options=STRING, strict_transport_security=STRING, x_content_type_options=STRING,
    referrer_policy=STRING, permissions_policy=STRING,
)
TELEMETRY = struct(
    request_url=STRING, final_url=STRING, timestamp=T.DoubleType(),
    discovered_requests=T.ArrayType(SUB_REQUEST), api_calls=T.ArrayType(SUB_REQUEST),
    websocket_sessions=T.ArrayType(struct(url=STRING, frames_sent=INT, frames_received=INT)),
    console_messages=T.ArrayType(CONSOLE), js_errors=T.ArrayType(CONSOLE),
    security_headers=SECURITY_HEADERS, redirect_chain=STRINGS, total_requests=INT,
)

CRAWL_INDEX = struct(url=STRING, status=STRING, mime=STRING)
URL_LIST = struct(url_list=T.ArrayType(struct(url=STRING, httpcode=STRING)))


def row_checksum(text: str) -> Column:
    """Aggregate over rows of text that does not depend on their order."""
    return F.coalesce(F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.lit(0)).cast("string")
