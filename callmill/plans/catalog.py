"""Queries over the driver's tables, each with SQL that has the same result.

The tables hold no exchanges or records, so queries derive them from columns,
by the same arithmetic on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy, redaction
from ..operators import assembly, batching, envelope, folds, reports, store, verdict

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core among which rows are dealt.
DEALT = 4


def dealt(spark: SparkSession, sf_dir: str, name: str, *key: str) -> DataFrame:
    """A table for work that costs far more a row than reading it: files of few bytes or row groups come in one task, whatever is made of their rows."""
    tasks = max(DEALT * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, sf_dir, name).repartition(tasks, *key)


_S = r"[\t\n\f\r ]"
_RE2_EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
_RE2_PHONE = redaction.PHONE_PATTERN


# ---- masking

#: The secrets that the tables' texts hold: forty hexadecimal digits that are assigned to a token.
_TEXT_SQL = r"""regexp_replace(text, '((?i:token)[\t ]{0,3}=[\t ]{0,3}")[0-9A-Fa-f]{40}', '\1REDACTED', 'g')"""


@query(rf"SELECT doc_id, regexp_replace(regexp_replace({_TEXT_SQL}, '{_RE2_EMAIL}', '[REDACTED_EMAIL]', 'g'), '{_RE2_PHONE}', '[REDACTED_PHONE]', 'g') AS masked FROM documents")
def pii_mask_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redaction.mask_records(F.col("text")).alias("masked"))


@query(rf"SELECT page_id, len(regexp_extract_all(html, '{_RE2_EMAIL}'))::BIGINT AS emails, len(regexp_extract_all(html, '{_RE2_PHONE}'))::BIGINT AS phones FROM pages")
def pii_spans_pages(spark, sf_dir):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n(redaction.EMAIL_PATTERN).alias("emails"), n(redaction.PHONE_PATTERN).alias("phones"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'write noreply@' || lower(c_mktsegment) || '.example.com now' WHEN 1 THEN 'write u' || c_custkey || '@users.noreply.github.com now'
  ELSE 'write [REDACTED_EMAIL] now' END AS masked FROM customer""")
def pii_allowlist(spark, sf_dir):
    c = dealt(spark, sf_dir, "customer", "c_custkey")
    domain = F.concat(F.lower("c_mktsegment"), F.lit(".example.com"))
    k = F.col("c_custkey") % 4
    mail = F.when(k == 0, F.concat(F.lit("noreply@"), domain)).when(k == 1, F.concat(F.lit("u"), F.col("c_custkey"), F.lit("@users.noreply.github.com"))).otherwise(F.concat(F.lit("c."), F.col("c_custkey"), F.lit("@"), domain))
    return c.select("c_custkey", redaction.mask_records(F.concat(F.lit("write "), mail, F.lit(" now"))).alias("masked"))


@query("""WITH tokens AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9+_=-]{10,}')) AS token FROM documents),
chars AS (SELECT token, unnest(string_split(token, '')) AS c FROM tokens), counts AS (SELECT token, c, count(*) AS n FROM chars GROUP BY ALL)
SELECT token, round(-sum(n / length(token)::DOUBLE * log2(n / length(token)::DOUBLE)), 6) AS entropy, round(-sum(n / length(token)::DOUBLE * log2(n / length(token)::DOUBLE)), 6) > 4.5 AS secret FROM counts GROUP BY token""")
def token_entropy(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(redaction.RUN_PATTERN), F.lit(0))).alias("token")).distinct()
    bits = tokens.withColumn("entropy", F.round(redaction.native_entropy(F.col("token")), 6))
    return bits.withColumn("secret", F.col("entropy") > redaction.ENTROPY_ABOVE)


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'key REDACTED end' WHEN 1 THEN 'key REDACTED end' ELSE 'key sb_publishable_' || repeat('ab', 12) || ' end' END AS masked FROM orders""")
def provider_token_mask(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    key = F.when(k == 0, F.concat(F.lit(redaction.PROVIDER_MARKS[0]), F.repeat(F.lit("ab"), 12))).when(k == 1, F.concat(F.lit(redaction.PROVIDER_MARKS[1]), F.repeat(F.lit("ab"), 12))).otherwise(F.concat(F.lit("sb_publishable_"), F.repeat(F.lit("ab"), 12)))
    return dealt(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", redaction.mask_records(F.concat(F.lit("key "), key, F.lit(" end"))).alias("masked"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'see REDACTED now' WHEN 1 THEN 'see https://host/path' || s_suppkey || ' now' WHEN 2 THEN 'PG_PASSWORD=REDACTED now' ELSE 'PG_PASSWORD=changeme now' END AS masked FROM supplier""")
def credential_mask(spark, sf_dir):
    k, n = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("see postgres://u:"), F.lit("pa"), n, F.lit("@db/x now"))).when(k == 1, F.concat(F.lit("see https://host/path"), n, F.lit(" now")))
        .when(k == 2, F.concat(F.lit("PG_PASSWORD=pa"), n, F.lit(" now"))).otherwise(F.lit("PG_PASSWORD=changeme now"))
    )
    return dealt(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", redaction.mask_records(text).alias("masked"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'REDACTED' WHEN 1 THEN 'host=h user=u' WHEN 2 THEN 'REDACTED' ELSE 'Server=a;User Id=b;Password=changeme' END AS masked FROM nation""")
def connection_string_mask(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    text = F.when(k == 0, F.concat(F.lit("host=h user=u password=p"), F.col("n_nationkey"))).when(k == 1, "host=h user=u").when(k == 2, F.concat(F.lit("Server=a;User Id=b;Password=p"), F.col("n_nationkey"))).otherwise("Server=a;User Id=b;Password=changeme")
    return table(spark, sf_dir, "nation").select("n_nationkey", redaction.mask_records(text).alias("masked"))


_PLACEHOLDER_VALUES = ["changeme", "<db-password>", "${PW}", "****", "xx", "hunter2", "", "[REDACTED]", "'example'", "<A>", "---"]


@query("""SELECT r_regionkey, v AS value, v IN ('changeme', '<db-password>', '${PW}', '****', '', '[REDACTED]', '''example''', '---') AS placeholder
  FROM region, (SELECT unnest(['changeme', '<db-password>', '${PW}', '****', 'xx', 'hunter2', '', '[REDACTED]', '''example''', '<A>', '---']) AS v)""")
def placeholder_class(spark, sf_dir):
    values = F.explode(F.array(*map(F.lit, _PLACEHOLDER_VALUES))).alias("value")
    return table(spark, sf_dir, "region").select("r_regionkey", values).withColumn("placeholder", redaction.native_is_placeholder(F.col("value")))


@query("""SELECT event_id, '{"user_id":"u' || user_id || '@mail.example.com","note":"[REDACTED_EMAIL]","n": 1.10,"items":["x","' || event_type || '"],"host":"h","user":"u","password":"REDACTED"}' AS masked FROM events""")
def json_field_mask(spark, sf_dir):
    mail = F.concat(F.lit("u"), F.col("user_id"), F.lit("@mail.example.com"))
    text = F.concat(F.lit('{"user_id":"'), mail, F.lit('","note":"'), mail, F.lit('","n": 1.10,"items":["x","'), F.col("event_type"), F.lit('"],"host":"h","user":"u","password":"p'), F.col("event_id"), F.lit('"}'))
    return dealt(spark, sf_dir, "events", "event_id").select("event_id", redaction.mask_records(text).alias("masked"))


# ---- reassembly

def _stream(text, change):
    """A message's event stream with its text in two parts, broken as ``change`` says."""
    event = lambda name, data: F.concat(F.lit(f"event: {name}\ndata: "), data, F.lit("\n\n"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("t"))), r'(?s)\A\{"t":(.*)\}\z', 1)
    half = F.floor(F.char_length(text) / 2).cast("int")
    delta = lambda c: event("content_block_delta", F.concat(F.lit('{"index":0,"delta":{"type":"text_delta","text":'), quoted(c), F.lit("}}")))
    head = event("message_start", F.lit('{"message":{"id":"m","content":[],"usage":{"input_tokens":3}}}'))
    block = event("content_block_start", F.lit('{"index":0,"content_block":{"type":"text","text":""}}'))
    end = event("message_stop", F.lit("{}"))
    return F.concat(
        F.when(change == 1, "").otherwise(head), event("ping", F.lit("{}")), F.when(change == 2, "").otherwise(block),
        delta(F.substring(text, F.lit(1), half)), delta(F.substr(text, half + 1)), event("content_block_stop", F.lit('{"index":0}')),
        event("message_delta", F.lit('{"delta":{"stop_reason":"end"},"usage":{"output_tokens":9007199254740993}}')),
        F.when(change == 3, "").otherwise(end), F.when(change == 4, end).otherwise(F.lit("")),
    )


@query("SELECT conv_id, turn, text AS assembled, '9007199254740993' AS output_tokens FROM conversations")
def sse_roundtrip(spark, sf_dir):
    rows = dealt(spark, sf_dir, "conversations", "conv_id", "turn").withColumn("m", assembly.assembled(_stream(F.col("text"), F.lit(0))))
    return rows.select("conv_id", "turn", F.get_json_object("m.message", "$.content[0].text").alias("assembled"), F.regexp_extract("m.message", r'"output_tokens":(\d+)', 1).alias("output_tokens"))


@query("""SELECT conv_id, turn, CASE conv_id % 5 WHEN 1 THEN 'event before start' WHEN 2 THEN 'unstarted block' WHEN 3 THEN 'no stop' WHEN 4 THEN 'event after stop' END AS reason FROM conversations""")
def sse_degrade_reasons(spark, sf_dir):
    rows = dealt(spark, sf_dir, "conversations", "conv_id", "turn")
    return rows.select("conv_id", "turn", assembly.assembled(_stream(F.col("text"), F.col("conv_id") % 5))["error"].alias("reason"))


# ---- exchanges to records

def _exchanges(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.when(k % 5 == 0, F.concat(F.lit('{"id":"msg_'), k, F.lit('"}'))).when(k % 5 == 1, F.concat(F.lit('{"id":"../'), k, F.lit('"}'))).when(k % 5 == 2, "{}").when(k % 5 == 3, "not json").otherwise('{"id":"a1"}')
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", body.cast("binary").alias("response"), F.lit("{}").cast("binary").alias("request"), (k % 7 != 0).alias("request_complete"), F.lit(True).alias("response_complete"),
        F.lit("application/json").alias("content_type"), F.when(k % 11 == 0, "br").otherwise("").alias("content_encoding"),
        F.when(k % 2 == 0, F.concat(F.lit("req_"), k)).otherwise("").alias("upstream_request_id"),
    )


@query("""SELECT o_orderkey, (o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 3) AS structured, NOT (o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 3) OR o_orderkey % 7 = 0 AS garbled, 'none' AS assembled_by FROM orders""")
def classify_response(spark, sf_dir):
    return envelope.classified(_exchanges(spark, sf_dir)).select("o_orderkey", "structured", "garbled", "assembled_by")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 THEN 'msg_' || o_orderkey WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 1 THEN 'local-' || md5(o_orderkey::VARCHAR)
  WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 4 THEN 'a1' WHEN o_orderkey % 2 = 0 THEN 'req_' || o_orderkey ELSE 'local-' || md5(o_orderkey::VARCHAR) END AS request_id FROM orders""")
def request_id_policy(spark, sf_dir):
    c = envelope.classified(_exchanges(spark, sf_dir))
    return c.select("o_orderkey", policy.request_id(F.col("structured"), F.col("response_json"), F.col("upstream_request_id"), F.col("o_orderkey").cast("string")).alias("request_id"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN 'official' ELSE 'third_party' END AS origin FROM nation""")
def origin_class(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    upstream = F.when(k == 0, "https://api.example.com").when(k == 1, "https://api.example.com//").otherwise(F.concat(F.lit("https://relay.example/"), F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", policy.upstream_origin(upstream, F.lit("https://api.example.com/")).alias("origin"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 't' || event_id END AS token, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN '/' ELSE '/v1/messages' END AS rest,
  CASE WHEN event_id % 4 = 0 THEN 'a|b' ELSE 'a' END AS betas FROM events""")
def path_and_header_split(spark, sf_dir):
    k = F.col("event_id") % 4
    path = F.concat(F.when(k == 3, "/t//").otherwise(F.concat(F.lit("/t/t"), F.col("event_id"))), F.when(k == 2, "").otherwise("/v1/messages"))
    split = policy.split_token(path)
    betas = policy.split_beta(F.when(k == 0, F.array(F.lit(" a ,"), F.lit("b,, "))).otherwise(F.array(F.lit("a"))))
    return table(spark, sf_dir, "events").select("event_id", split["token"].alias("token"), split["rest"].alias("rest"), F.array_join(betas, "|").alias("betas"))


# ---- routing and consent

def _routes(spark, sf_dir):
    """A grant for every customer but each fifth; each seventh is revoked."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where(k % 5 != 0)
    return rows.select(
        F.concat(F.lit("t"), k).alias("token"), policy.project_hash(F.col("c_name")).alias("project_id_hash"), F.col("c_name").alias("root_path"),
        F.lit("https://api.example.com").alias("upstream"), F.lit("2024-01-01T00:00:00Z").alias("granted_at"), F.when(k % 7 == 0, "2024-02-01T00:00:00Z").otherwise("").alias("revoked_at"),
    )


_ROUTES_SQL = "routes AS (SELECT 't' || c_custkey AS token, sha256(c_name) AS project_id_hash, c_custkey % 7 = 0 AS revoked FROM customer WHERE c_custkey % 5 <> 0)"


def _arrivals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("t"), F.col("user_id")).alias("token"), F.when(F.col("event_id") % 3 == 0, "GET").otherwise("POST").alias("method"), F.lit("/v1/messages").alias("path"), F.when(F.col("event_id") % 10 == 0, 500).otherwise(200).alias("http_status"), F.lit("{}").cast("binary").alias("request"), F.lit("{}").cast("binary").alias("response"))


@query(f"""WITH {_ROUTES_SQL} SELECT event_id, CASE WHEN r.token IS NULL THEN 'unknown' WHEN revoked THEN 'revoked' ELSE 'record' END AS verdict, project_id_hash FROM events e LEFT JOIN routes r ON r.token = 't' || e.user_id""")
def route_verdict(spark, sf_dir):
    return verdict.with_verdict(_arrivals(spark, sf_dir), _routes(spark, sf_dir)).select("event_id", "verdict", "project_id_hash")


@query(f"""WITH {_ROUTES_SQL} SELECT CASE WHEN r.token IS NULL THEN 'unknown' WHEN revoked THEN 'revoked' ELSE 'paused' END AS verdict, count(*)::BIGINT AS n FROM events e LEFT JOIN routes r ON r.token = 't' || e.user_id GROUP BY 1""")
def verdict_counts_paused(spark, sf_dir):
    return verdict.with_verdict(_arrivals(spark, sf_dir), _routes(spark, sf_dir), "signed_out").groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {_ROUTES_SQL} SELECT event_id, project_id_hash FROM events e JOIN routes r ON r.token = 't' || e.user_id WHERE NOT revoked AND event_id % 3 <> 0 AND event_id % 10 <> 0""")
def consent_recheck(spark, sf_dir):
    return verdict.recordable(_arrivals(spark, sf_dir), _routes(spark, sf_dir)).select("event_id", "project_id_hash")


@query("SELECT page_id, sha256(url) AS project_id_hash FROM pages")
def project_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", policy.project_hash(F.col("url")).alias("project_id_hash"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 3) THEN 'none' WHEN c_custkey % 4 = 1 THEN 'refused' ELSE 'moved' END AS move FROM customer""")
def upstream_reconcile(spark, sf_dir):
    k, no = F.col("c_custkey") % 4, F.lit(False)
    wanted = F.when(k == 0, "https://api.example.com").when(k == 1, "http://relay.example").when(k == 2, "http://127.0.0.1:8080").otherwise("https://other.example")
    return table(spark, sf_dir, "customer").select("c_custkey", policy.upstream_move(no, k == 3, no, wanted, F.lit("https://api.example.com")).alias("move"))


@query("""SELECT o_orderkey, 'b-' || md5(o_orderkey::VARCHAR) AS batch_id, CASE WHEN o_orderkey % 4 = 0 THEN 'recording stays off until this device has signed in again' WHEN o_orderkey % 4 = 1 THEN '' ELSE 'other' END AS pause,
  o_orderkey % 3 = 0 AS enabled, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 2147483648 END AS quota FROM orders WHERE o_custkey > 0""")
def small_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    reason = F.when(k % 4 == 0, "signed_out").when(k % 4 == 1, "").otherwise("other")
    quota = policy.new_quota(F.lit(policy.QUOTA_BYTES).cast("long"), F.when(k % 2 == 0, F.col("o_custkey")).otherwise(0))
    setting = F.when(k % 3 == 0, " True ").when(k % 3 == 1, "no").otherwise("")
    return table(spark, sf_dir, "orders").where("o_custkey > 0").select("o_orderkey", policy.new_batch_id(k.cast("string")).alias("batch_id"), policy.explain_pause(reason).alias("pause"), policy.is_truthy(setting).alias("enabled"), quota.alias("quota"))


# ---- the store

_SPOOL_SQL = "spool AS (SELECT strftime(ts, '%Y%m%d') AS day, 'r' || event_id AS request_id, (20 + event_id % 97)::BIGINT AS size, ts AS timestamp, CASE WHEN event_id % 50 = 0 THEN 'index.jsonl' ELSE 'r' || event_id || '.json' END AS name, user_id, event_id FROM events)"


def _spool(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    request = F.concat(F.lit("r"), F.col("event_id"))
    return e.select(policy.day_key(F.col("ts")).alias("day"), request.alias("request_id"), (20 + F.col("event_id") % 97).cast("long").alias("size"), F.col("ts").alias("timestamp"), F.when(F.col("event_id") % 50 == 0, "index.jsonl").otherwise(F.concat(request, F.lit(".json"))).alias("name"), "user_id", "event_id")


@query(f"WITH {_SPOOL_SQL} SELECT day, count(*) FILTER (WHERE name LIKE '%.json')::BIGINT AS records, sum(size)::BIGINT AS bytes FROM spool GROUP BY day")
def day_summary(spark, sf_dir):
    return store.day_summary(_spool(spark, sf_dir))


@query(f"WITH {_SPOOL_SQL} SELECT sum(size)::BIGINT AS bytes FROM spool")
def store_usage(spark, sf_dir):
    return store.usage(_spool(spark, sf_dir))


@query(f"WITH {_SPOOL_SQL} SELECT day, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS oldest FROM spool WHERE day = (SELECT min(day) FROM spool) GROUP BY day")
def oldest_in_first_day(spark, sf_dir):
    return store.oldest(_spool(spark, sf_dir)).select("day", F.date_format("oldest", "yyyy-MM-dd HH:mm:ss").alias("oldest"))


@query("""SELECT strftime(ts, '%Y%m%d') AS day, 'r' || (event_id % 500) AS request_id, max(event_id)::BIGINT AS last FROM events GROUP BY 1, 2""")
def store_dedup_last_write(spark, sf_dir):
    rows = _spool(spark, sf_dir).withColumn("request_id", F.concat(F.lit("r"), F.col("event_id") % 500))
    return store.last_write(rows, "event_id").select("day", "request_id", F.col("event_id").alias("last"))


@query("""SELECT 'o' || o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN 's' || o_custkey ELSE '' END AS session_key,
  CASE WHEN o_orderkey % 6 = 0 THEN '2024-05-06 07:08:09' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at FROM orders""")
def index_left_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    files = o.select(F.lit("20240506").alias("day"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    lines = o.where("o_orderkey % 3 = 0").select(F.lit("20240506").alias("day"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("line_no"), F.lit(True).alias("parse_ok"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("request_id"), "o_custkey", "o_orderkey")
    index = lines.select("day", "line_no", "parse_ok", "request_id", F.when(F.col("line_no") == 1, F.concat(F.lit("s"), F.col("o_custkey"))).otherwise("stale").alias("session_key"), F.when(F.col("o_orderkey") % 6 == 0, "2024-05-06T07:08:09Z").otherwise("soon").alias("timestamp"), F.lit("").alias("project_id_hash"))
    return store.with_index(files, index).select("request_id", "session_key", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT day, request_id FROM (SELECT strftime(ts, '%Y%m%d') AS day, 'r' || event_id AS request_id, event_id, user_id FROM events) WHERE NOT (user_id % 10 = 3 AND event_id % 3 <> 2)""")
def purge_project(spark, sf_dir):
    rows = _spool(spark, sf_dir)
    owner = F.concat(F.lit("p"), F.col("user_id") % 10)
    body = F.concat(F.lit('{"capture":{"project_id_hash":"'), owner, F.when(F.col("event_id") % 3 == 2, '"').otherwise('"}}'))
    spool = rows.select("day", "request_id", body.alias("data"))
    index = rows.where("event_id % 3 = 0").select("day", F.lit(0).cast("long").alias("line_no"), F.lit(True).alias("parse_ok"), "request_id", F.lit("").alias("session_key"), F.lit("").alias("timestamp"), owner.alias("project_id_hash"))
    return store.purge_project(spool, index, "p3").select("day", "request_id")


@query("SELECT strftime(ts, '%Y%m%d') AS day, 'r' || event_id AS request_id FROM events WHERE event_id % 4 <> 1")
def delete_acknowledged(spark, sf_dir):
    rows = _spool(spark, sf_dir).select("day", "request_id", "event_id")
    return store.delete_acknowledged(rows, rows.where("event_id % 4 = 1")).select("day", "request_id")


# ---- batches

_CALLS_SQL = "calls AS (SELECT conv_id, turn, CASE WHEN conv_id % 6 = 0 THEN '' ELSE 's' || (conv_id % 5) END AS session_key, 'c' || conv_id || '.' || turn AS request_id, octet_length(encode(text))::BIGINT AS size, conv_id % 3 AS batch FROM conversations)"


def _calls(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    request = F.concat(F.lit("c"), F.col("conv_id"), F.lit("."), F.col("turn"))
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 6 == 0, "").otherwise(F.concat(F.lit("s"), F.col("conv_id") % 5)).alias("session_key"), request.alias("request_id"), F.octet_length("text").cast("long").alias("size"), F.concat(F.lit("b"), F.col("conv_id") % 3).alias("batch_id"), F.col("turn").alias("timestamp"), F.concat(F.lit('{"n":'), F.col("turn"), F.lit("}")).alias("data"))


@query(f"""WITH {_CALLS_SQL} SELECT request_id, (row_number() OVER w - 1)::BIGINT AS position, (coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
FROM calls WINDOW w AS (PARTITION BY batch ORDER BY session_key = '', session_key, turn, request_id)""")
def session_order_offsets(spark, sf_dir):
    rows = batching.record_offsets(batching.batch_order(_calls(spark, sf_dir)))
    return rows.select("request_id", F.col("position").cast("long").alias("position"), F.col("offset").cast("long").alias("offset"))


_FOLD_SQL = """WITH RECURSIVE {calls}, rows AS (SELECT batch, request_id, size, row_number() OVER (PARTITION BY batch ORDER BY conv_id, turn) AS n FROM calls),
fold(batch, request_id, n, total, out) AS (
  SELECT batch, request_id, n, {first} FROM rows WHERE n = 1
  UNION ALL SELECT r.batch, r.request_id, r.n, {next} FROM fold f JOIN rows r ON r.batch = f.batch AND r.n = f.n + 1)
SELECT request_id, {result} FROM fold"""


@query(_FOLD_SQL.format(calls=_CALLS_SQL, first="size, 0::BIGINT", next="CASE WHEN f.total >= 5000 THEN r.size ELSE f.total + r.size END, CASE WHEN f.total >= 5000 THEN f.out + 1 ELSE f.out END", result="out AS bin"))
def greedy_batches(spark, sf_dir):
    rows = _calls(spark, sf_dir).select(F.col("batch_id").alias("writer"), F.struct("conv_id", "turn").alias("seq"), "request_id", "size")
    return folds.greedy_bins(rows, 5000).select("request_id", "bin")


@query(_FOLD_SQL.format(calls=_CALLS_SQL, first="CASE WHEN size <= 20000 THEN size ELSE 0 END, size <= 20000", next="CASE WHEN f.total + r.size <= 20000 THEN f.total + r.size ELSE f.total END, f.total + r.size <= 20000", result="out AS admitted"))
def quota_admission(spark, sf_dir):
    rows = _calls(spark, sf_dir).select(F.col("batch_id").alias("writer"), F.struct("conv_id", "turn").alias("seq"), "request_id", "size")
    return folds.admitted(rows, 20_000).select("request_id", "admitted")


@query(f"""WITH {_CALLS_SQL} SELECT 'b' || batch AS batch_id, request_id, '{{"schema_version":"1","endpoint":"e","capture":{{"project_id_hash":"p"}},"request":' || turn || '}}' AS data FROM calls""")
def batch_pack_roundtrip(spark, sf_dir):
    data = F.concat(F.lit('{"schema_version":"1","endpoint":"e","capture":{"project_id_hash":"p"},"request":'), F.col("turn"), F.lit("}"))
    rows = _calls(spark, sf_dir).withColumn("data", data).withColumn("project_id_hash", F.lit("p"))
    return batching.unpack_batches(batching.pack_batches(batching.masked_batches(rows), "1.0.0", "2024-01-01T00:00:00Z"))


# ---- delivery

@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'empty' WHEN o_totalprice * 100 < 10485760 AND o_orderkey % 100000 < 86400 THEN 'below_threshold' ELSE 'due' END AS outcome FROM orders""")
def flush_outcome(spark, sf_dir):
    usage = F.when(F.col("o_orderkey") % 4 == 0, 0.0).otherwise(F.col("o_totalprice") * 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.flush_due(usage, F.col("o_orderkey") % 100_000).alias("outcome"))


@query("""SELECT o_orderkey, (400 + o_orderkey % 130)::BIGINT AS status, CASE 400 + o_orderkey % 130 WHEN 426 THEN 'upgrade' WHEN 429 THEN 'limited' WHEN 408 THEN 'timeout' WHEN 401 THEN 'transient' ELSE CASE WHEN o_orderkey % 130 < 100 THEN 'rejected' ELSE 'transient' END END AS kind FROM orders""")
def failure_class(spark, sf_dir):
    status = (400 + F.col("o_orderkey") % 130).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), policy.failure_class(status).alias("kind"))


@query("""SELECT o_orderkey, least((60 + floor(o_totalprice * 50 / 65536)) * pow(2, o_orderkey % 6), 1800)::BIGINT AS budget, least(60 * pow(2, greatest(o_orderkey % 9 - 1, 0)), 900)::BIGINT AS pause,
  CASE o_orderkey % 3 WHEN 0 THEN least(o_orderkey, 3600) ELSE 0 END::BIGINT AS retry FROM orders""")
def upload_timing(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "soon").otherwise("Mon, 01 Jan 2024 00:00:00 GMT")
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.upload_budget(F.col("o_totalprice") * 50, k % 6).alias("budget"), policy.timeout_backoff(k % 9).alias("pause"), policy.retry_after(value, F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("retry"))


@query("SELECT 'b' || (event_id % 20) AS batch_id, count(*)::BIGINT AS records, 'status ' || max(400 + event_id % 20) AS details FROM events GROUP BY 1")
def quarantine_list(spark, sf_dir):
    k = F.col("event_id") % 20
    rejected = table(spark, sf_dir, "events").select(F.concat(F.lit("b"), k).alias("batch_id"), F.concat(F.lit("status "), 400 + k).alias("details"))
    return reports.quarantine_list(rejected)


@query("SELECT 'r' || event_id AS request_id FROM events WHERE event_id % 9 = 4")
def pending_semi(spark, sf_dir):
    rows = _spool(spark, sf_dir)
    pending = rows.where("event_id % 9 = 4").select("request_id").union(spark.range(1).select(F.lit("gone").alias("request_id")))
    return rows.join(pending, "request_id", "left_semi").select("request_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey <> 0 THEN o_custkey ELSE 10485760 END AS flush_bytes, CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE o_orderstatus END AS notice FROM orders")
def handshake_merge(spark, sf_dir):
    new = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(0)
    notice = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.merge_setting(F.lit(10485760).cast("long"), new).alias("flush_bytes"), policy.merge_setting(F.lit("old"), notice).alias("notice"))


# ---- versions, texts, reports

@query("""WITH keys AS (SELECT p_partkey, p_size, row(p_size, p_partkey % 10, p_partkey % 3 <> 1, CASE WHEN p_partkey % 3 = 1 THEN p_partkey % 100 ELSE -1 END) AS key FROM part)
SELECT a.p_partkey, a.key < b.key AS before, CASE WHEN a.p_partkey % 3 = 2 THEN 'unknown' WHEN a.p_size < 25 THEN 'behind' ELSE 'satisfied' END AS standing FROM keys a JOIN keys b ON b.p_partkey = a.p_partkey + 1""")
def version_order(spark, sf_dir):
    k = F.col("p_partkey")
    version = F.concat(F.lit("v"), F.col("p_size"), F.lit("."), k % 10, F.lit(".0"), F.when(k % 3 == 1, F.concat(F.lit("-rc."), k % 100)).otherwise(""), F.lit("+b"), k)
    rows = table(spark, sf_dir, "part").select("p_partkey", policy.version_key(version).alias("key"), policy.version_standing(F.lit("25.0.0-alpha"), F.when(k % 3 == 2, "nightly").otherwise(version)).alias("standing"))
    after = rows.select((k - 1).alias("p_partkey"), F.col("key").alias("next"))
    return rows.join(after, "p_partkey").select("p_partkey", (F.col("key") < F.col("next")).alias("before"), "standing")


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 3 = 0 ORDER BY p_size DESC, p_partkey % 10 DESC, p_partkey LIMIT 1")
def newest_release(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", k.alias("seq"), F.concat(F.col("p_size"), F.lit("."), k % 10, F.lit(".0")).alias("version"), (k % 4 != 1).alias("draft"), (k % 3 == 0).alias("has_archive"), F.lit(True).alias("has_checksums"))
    return reports.newest_release(rows).select("p_partkey")


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.1f GiB', n / 1073741824.0::DOUBLE) WHEN n < 1125899906842624 THEN printf('%.1f TiB', n / 1099511627776.0::DOUBLE) ELSE printf('%.1f PiB', n / 1125899906842624.0::DOUBLE) END AS size
FROM (SELECT o_orderkey, (o_orderkey * 1024 * 64 + o_orderkey % 1000) // (1 + (o_orderkey % 4) * 999999) AS n FROM orders)""")
def human_bytes(spark, sf_dir):
    k = F.col("o_orderkey")
    n = F.floor((k * 1024 * 64 + k % 1000) / (1 + (k % 4) * 999_999)).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.human_bytes(n).alias("size"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || '…' ELSE t END AS safe FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\pL\pM\pN\pP\pS\p{Zs}]', ' ', 'g'), '\p{Zs}+', ' ', 'g'), ' ') AS t FROM documents)""")
def safe_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", policy.safe_text(F.col("text")).alias("safe"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'masked' ELSE substr(c_name, 1, 8) || '…(masked)' END AS token FROM customer")
def mask_token(spark, sf_dir):
    k = F.col("c_custkey") % 3
    return table(spark, sf_dir, "customer").select("c_custkey", policy.mask_token(F.when(k == 0, "").when(k == 1, "short").otherwise(F.col("c_name"))).alias("token"))


@query("SELECT s_suppkey, 'https://redacted@h.example/p?a=redacted&k=redacted' AS masked FROM supplier")
def mask_url(spark, sf_dir):
    url = F.concat(F.lit("https://user:"), F.lit("pw"), F.col("s_suppkey"), F.lit("@h.example/p?k="), F.col("s_suppkey"), F.lit("&a=1"))
    return dealt(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", policy.mask_url_credentials(url).alias("masked"))


@query("""SELECT count(*) FILTER (WHERE event_id % 3 = 0)::BIGINT AS recorded, count(*) FILTER (WHERE event_id % 6 = 0)::BIGINT AS degraded, count(*) FILTER (WHERE event_id % 3 = 1)::BIGINT AS dropped, count(*) FILTER (WHERE event_id % 3 = 2)::BIGINT AS unusable_upstream FROM events""")
def capture_counters(spark, sf_dir):
    k = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select(F.when(k == 0, "recorded").when(k == 1, "dropped").otherwise("unusable_upstream").alias("outcome"), (F.col("event_id") % 2 == 0).alias("garbled"))
    return reports.counters(rows)


@query("SELECT event_id AS seq, 'failed ' || event_id AS message FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 5")
def recent_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    errors = e.join(F.broadcast(first), "event_type", "left_semi").select(F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("failed "), F.col("event_id")).alias("message"))
    return reports.recent_errors(errors).select("seq", "message")
