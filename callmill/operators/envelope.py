"""Exchanges to versioned records, and back.

A record is one line of JSON with fixed order.  Bodies are spliced in as they
were observed, so numbers and key order survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_text, policy
from . import assembly

# ---- fixed values
SCHEMA_VERSION, SOURCE = "1", "proxy"
RECORD = (
    "schema_version string, source string, provider string, endpoint string, request_id string, "
    "capture struct<http_status: int, client_version: string, timestamp: string, project_id_hash: string, upstream_origin: string, "
    "sse_assembly: struct<`by`: string, client_version: string, rules_version: string>, garbled: boolean>, "
    "format_hints struct<`anthropic-version`: string, `anthropic-beta`: array<string>>"
)
# ---- end of the fixed values


@F.pandas_udf(T.BooleanType())
def is_valid_json(text):
    return text.map(json_text.is_valid).astype(bool)


@F.pandas_udf(T.StringType())
def json_quoted(text):
    """A text as one JSON string."""
    return text.map(json_text.quote, na_action="ignore")


def as_text(body: Column) -> Column:
    """UTF-8, with a replacement for what isn't; a missing body is empty."""
    return F.coalesce(F.decode(body, "UTF-8"), F.lit(""))


def compact(body: Column) -> Column:
    return F.regexp_replace(body, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")


def classified(exchanges: DataFrame, assembler: str = "messages") -> DataFrame:
    """Adds request_json, response_json, structured, assembled_by and garbled.

    A stream is assembled if it is whole and unencoded; bodies that aren't
    whole valid JSON are kept as one JSON string and mark the record.
    """
    encoded = F.coalesce(F.col("content_encoding"), F.lit("")) != ""
    stream = F.lower(F.coalesce(F.col("content_type"), F.lit(""))).startswith("text/event-stream")
    wants = ~encoded & stream & F.col("response_complete")
    texts = exchanges.withColumns({"_req": as_text(F.col("request")), "_res": as_text(F.col("response")), "_wants": wants})
    texts = texts.withColumn("_built", assembly.assembled(F.when(F.col("_wants"), F.col("_res")), assembler))
    built = F.when(F.col("_wants"), F.col("_built.message"))
    direct = ~encoded & ~stream & F.col("response_complete") & is_valid_json(F.col("_res"))
    request_ok = F.col("request_complete") & is_valid_json(F.col("_req"))
    out = texts.withColumns({"_direct": direct, "_request_ok": request_ok, "_message": built})
    structured = F.col("_direct") | F.col("_message").isNotNull()
    out = out.withColumns({
        "response_json": F.when(F.col("_direct"), compact(F.col("_res"))).when(F.col("_message").isNotNull(), F.col("_message")).otherwise(json_quoted(F.col("_res"))),
        "request_json": F.when(F.col("_request_ok"), compact(F.col("_req"))).otherwise(json_quoted(F.col("_req"))),
        "structured": structured,
        "assembled_by": F.when(F.col("_message").isNotNull(), "client").otherwise("none"),
        "garbled": ~structured | ~F.col("_request_ok"),
    })
    return out.drop("_req", "_res", "_wants", "_built", "_direct", "_request_ok", "_message")


def records(exchanges: DataFrame, client_version: str, assembler: str = "messages", now: str | None = None) -> DataFrame:
    """request_id, session_key, timestamp, project_id_hash, garbled and data (the record's text) of each exchange."""
    rules = assembly.ASSEMBLERS[assembler][1]
    c = classified(exchanges, assembler)
    at = F.coalesce(F.nullif(F.col("at"), F.lit("")), F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    key = F.concat_ws("|", F.col("project_id_hash"), at, F.md5(F.col("request_json")), F.md5(F.col("response_json")))
    c = c.withColumns({"request_id": policy.request_id(F.col("structured"), F.col("response_json"), F.col("upstream_request_id"), key), "timestamp": at})
    by_client = F.col("assembled_by") == "client"
    s = lambda x: json_quoted(F.coalesce(x, F.lit("")))
    assembly_json = F.concat(F.lit('{"by":"'), F.col("assembled_by"), F.when(by_client, F.concat(F.lit('","client_version":'), s(F.lit(client_version)), F.lit(f',"rules_version":"{rules}"}}'))).otherwise('"}'))
    betas = F.when(F.size(F.coalesce(F.col("anthropic_beta"), F.array())) > 0, F.concat(F.lit(',"anthropic-beta":'), F.to_json("anthropic_beta"))).otherwise("")
    data = F.concat(
        F.lit(f'{{"schema_version":"{SCHEMA_VERSION}","source":"{SOURCE}","provider":'), s(F.col("provider")), F.lit(',"endpoint":'), s(F.col("endpoint")),
        F.lit(',"request_id":'), s(F.col("request_id")), F.lit(',"capture":{"http_status":'), F.col("http_status").cast("string"), F.lit(',"client_version":'), s(F.col("client_version")),
        F.lit(',"timestamp":'), s(F.col("timestamp")), F.lit(',"project_id_hash":'), s(F.col("project_id_hash")), F.lit(',"upstream_origin":"'), policy.upstream_origin(F.col("upstream"), F.col("official_upstream")),
        F.lit('","sse_assembly":'), assembly_json, F.lit(',"garbled":'), F.col("garbled").cast("string"), F.lit('},"format_hints":{"anthropic-version":'), s(F.col("anthropic_version")), betas,
        F.lit('},"request":'), F.col("request_json"), F.lit(',"response":'), F.col("response_json"), F.lit("}"),
    )
    return c.select("request_id", session_key(F.col("request_json")).alias("session_key"), "timestamp", "project_id_hash", "garbled", data.alias("data"))


def session_key(request: Column) -> Column:
    return F.coalesce(F.get_json_object(request, "$.metadata.user_id"), F.lit(""))


def parsed(rows: DataFrame, data: str = "data") -> DataFrame:
    """Adds record (a struct, bodies left out) and parse_error, null where the record can be read."""
    record = F.from_json(F.col(data), RECORD)
    ok = is_valid_json(F.col(data))
    version = F.col("record.schema_version")
    error = F.when(~F.col("_ok"), "invalid JSON").when(~version.eqNullSafe(F.lit(SCHEMA_VERSION)), F.concat(F.lit("unknown schema version "), F.coalesce(version, F.lit(""))))
    return rows.withColumns({"record": record, "_ok": ok}).withColumn("parse_error", error).drop("_ok")


def lenient_project_hash(data: Column) -> Column:
    """The project of a record whatever its version; null if the text is invalid or names none."""
    return F.when(is_valid_json(data), F.nullif(F.get_json_object(data, "$.capture.project_id_hash"), F.lit("")))
