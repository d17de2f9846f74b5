"""Payload parsing, entity extraction and log lines."""

from pyspark.sql import functions as F

from tidewatch.operators import extract
from tidewatch.plans import adapters as A
from tidewatch.plans.registry import query
from tidewatch.schemas import ENTITY_PATTERNS

# Patterns that occur in the documents; written so that both regex engines read them alike.
TEXT_PATTERNS = {
    "IPv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "Email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]",
}
NEEDLES = {"IPv4": ".", "Email": "@"}
ENTITIES_SQL = "entities AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS type, unnest(regexp_extract_all(text, '{pattern}')) AS name FROM documents"
    for kind, pattern in TEXT_PATTERNS.items()
) + ")"


def document_entities(spark, sf_dir):
    return extract.entity_rows(A.table(spark, sf_dir, "documents"), "doc_id", "text", TEXT_PATTERNS, needles=NEEDLES)


@query("entity_extract", f"WITH {ENTITIES_SQL} SELECT DISTINCT doc_id, type, name FROM entities")
def entity_extract(spark, sf_dir):
    return document_entities(spark, sf_dir)


@query("entity_totals", f"WITH {ENTITIES_SQL} SELECT type, name, count(DISTINCT doc_id) AS documents FROM entities GROUP BY ALL")
def entity_totals(spark, sf_dir):
    # Entities are distinct within a document already, so a plain count per name is the distinct one.
    return document_entities(spark, sf_dir).groupBy("type", "name").agg(F.count(F.lit(1)).alias("documents"))


@query("event_bridge", f"WITH {ENTITIES_SQL} SELECT DISTINCT doc_id, name AS resource_id FROM entities WHERE type = 'Email'")
def event_bridge(spark, sf_dir):
    events = A.table(spark, sf_dir, "documents").select(
        "doc_id", extract.entities_in(F.array("text"), TEXT_PATTERNS, needles=NEEDLES).alias("resources")
    )
    return extract.event_links(events, "Email").select("doc_id", "resource_id")


@query(
    "json_field_defaults",
    """
SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), 'N/A') AS VARCHAR) AS service, 'N/A' AS region, false AS read_only, '' AS error_code FROM events""",
)
def json_field_defaults(spark, sf_dir):
    payload = F.col("p")
    parsed = A.table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("p"))
    return parsed.select(
        "event_id",
        extract.payload_field(payload, "$.k", "string", "N/A").alias("service"),
        extract.payload_field(payload, "$.awsRegion", "string", "N/A").alias("region"),
        extract.payload_field(payload, "$.readOnly", "boolean", False).alias("read_only"),
        extract.payload_field(payload, "$.errorCode", "string", "").alias("error_code"),
    )


@query(
    "string_leaves",
    """
SELECT conv_id, turn, 2::INTEGER AS leaves, role AS first_leaf, length(text) AS last_length, md5(text) AS last_md5 FROM conversations""",
)
def string_leaves(spark, sf_dir):
    payload = F.to_json(F.struct("conv_id", F.struct("role", F.array(F.struct("turn", "text")).alias("parts")).alias("body")))
    leaves = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", extract.string_leaves(payload).alias("l"))
    return leaves.select(
        "conv_id",
        "turn",
        F.size("l").alias("leaves"),
        F.col("l")[0].alias("first_leaf"),
        F.length(F.col("l")[1]).cast("bigint").alias("last_length"),
        F.md5(F.col("l")[1].cast("binary")).alias("last_md5"),
    )


@query(
    "string_leaves_exact",
    """
SELECT conv_id || '/' || turn AS id, '$.body.role' AS path, length(role) AS length, md5(role) AS digest FROM conversations
UNION ALL SELECT conv_id || '/' || turn, '$.body.parts[0].text', length(text), md5(text) FROM conversations
UNION ALL SELECT conv_id || '/' || turn, '$.body.parts[1][0][0]', length(role), md5(role) FROM conversations WHERE turn % 2 = 0""",
)
def string_leaves_exact(spark, sf_dir):
    """The walk of the parsed value on nested texts with escapes, numbers, and arrays of arrays in some."""
    part = F.to_json(F.struct("turn", "text"))
    nested = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(",[["), F.to_json(F.struct(F.col("role").alias("r"))), F.lit("]]"))).otherwise("")
    inner = F.regexp_replace(nested, r'\{"r":(.*)\}\]\]$', "$1]]")
    body = F.concat(F.lit('{"conv_id":1,"body":{"role":"'), F.col("role"), F.lit('","parts":['), part, inner, F.lit("]}}"))
    rows = A.table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), body.alias("t"))
    leaves = extract.string_leaves_exact(rows, "id", "t")
    return leaves.select("id", "path", F.length("value").cast("bigint").alias("length"), F.md5(F.col("value").cast("binary")).alias("digest"))


PATTERN_TEXT = {
    "EC2 Instance": "i-0000000", "Security Group": "sg-0000000", "VPC": "vpc-0000000", "Subnet": "subnet-0000000", "Volume": "vol-0000000", "Network Interface": "eni-0000000",
    "Internet Gateway": "igw-0000000", "NAT Gateway": "nat-0000000", "Auto Scaling": "arn:aws:autoscaling:us:", "Load Balancer": "arn:aws:elasticloadbalancing:us:", "IAM": "arn:aws:iam::",
}
PATTERNS_SQL = " UNION ALL ".join(
    f"SELECT event_id, '{kind}' AS type, unnest(regexp_extract_all(t, '{pattern}')) AS name FROM texts" for kind, pattern in ENTITY_PATTERNS.items()
)


@query(
    "entity_patterns",
    "WITH texts AS (SELECT event_id, concat_ws(' ', " + ", ".join(f"'{start}' || printf('%x', user_id * {i + 16} + 4096)" for i, start in enumerate(PATTERN_TEXT.values()))
    + f") || CASE WHEN event_type = 'error' THEN ' i-12 xvpc-00000000 arn:aws:iam' ELSE '' END AS t FROM events), e AS ({PATTERNS_SQL}) SELECT DISTINCT * FROM e",
)
def entity_patterns(spark, sf_dir):
    """All default patterns in their plain form, which also match inside longer words."""
    ids = [F.concat(F.lit(start), F.lower(F.hex(F.col("user_id") * (i + 16) + 4096))) for i, start in enumerate(PATTERN_TEXT.values())]
    odd = F.when(F.col("event_type") == "error", " i-12 xvpc-00000000 arn:aws:iam").otherwise("")
    rows = A.table(spark, sf_dir, "events").select("event_id", F.concat(F.concat_ws(" ", *ids), odd).alias("t"))
    return extract.entity_rows(rows, "event_id", "t", ENTITY_PATTERNS)


@query(
    "audit_parse",
    """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS event_name, CASE WHEN event_type = 'error' THEN 'N/A' ELSE CAST(user_id AS VARCHAR) END AS username,
  'app-' || event_type AS service, 'N/A' AS region, CASE WHEN value > 100 THEN true ELSE false END AS read_only,
  CASE WHEN event_type = 'error' THEN NULL ELSE '' END AS error_code,
  'EC2 Instance:i-0000000' || user_id % 10 || '1,Network Interface:eni-0000000' || user_id % 10 || '2' AS entities
FROM events""",
)
def audit_parse(spark, sf_dir):
    """Payload text per event with an explicit null, an absent field, entities in keys and a repeated entity."""
    digit = (F.col("user_id") % 10).cast("string")
    instance, interface = F.concat(F.lit("i-0000000"), digit, F.lit("1")), F.concat(F.lit("eni-0000000"), digit, F.lit("2"))
    body = F.to_json(
        F.struct(
            F.concat(F.lit("app-"), F.col("event_type")).alias("eventSource"),
            (F.col("value") > 100).alias("readOnly"),
            F.struct(F.array(instance, interface, instance).alias("ids"), F.lit(1).alias("i-99999999")).alias("request"),
        )
    )
    failed = F.col("event_type") == "error"
    text = F.when(failed, F.concat(F.rtrim(F.substring(body, F.lit(1), F.length(body) - 1)), F.lit(',"errorCode":null}'))).otherwise(body)
    raw = A.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("EventId"),
        A.ts_text("ts").alias("EventTime"),
        F.col("event_type").alias("EventName"),
        F.when(~failed, F.col("user_id").cast("string")).alias("Username"),
        text.alias("CloudTrailEvent"),
    )
    parsed = extract.parse_audit_events(raw, bounded=True)
    names = F.transform("resources", lambda r: F.concat_ws(":", r["type"], r["name"]))
    return parsed.select("event_id", "event_name", "username", "service", "region", "read_only", "error_code", F.array_join(names, ",").alias("entities"))


def _log_lines(spark, sf_dir):
    """Log lines out of events: attempts, failures, skips and other messages."""
    user = F.col("user_id").cast("string")
    message = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("Analyzing "), user, F.lit(" (Attempt 1/4)")))
        .when(F.col("event_type") == "error", F.concat(F.lit("Attempt 1/4 failed for "), user))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Skipping "), user, F.lit(": state")))
        .otherwise(F.concat(F.lit("other "), user))
    )
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARNING").otherwise("INFO")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    return A.table(spark, sf_dir, "events").select("event_id", F.concat_ws(" | ", stamp, level, F.col("event_type"), message).alias("value"))


@query(
    "log_parse",
    """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS level,
  event_type AS logger FROM events""",
)
def log_parse(spark, sf_dir):
    return extract.parse_log_lines(_log_lines(spark, sf_dir)).select("event_id", A.ts_text("ts").alias("at"), "level", "logger")


@query(
    "log_levels",
    """
SELECT event_type AS logger, count(*) AS lines, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS warnings
FROM events GROUP BY ALL""",
)
def log_levels(spark, sf_dir):
    return extract.log_levels(extract.parse_log_lines(_log_lines(spark, sf_dir)))


@query(
    "log_attempts",
    """
SELECT CAST(user_id AS VARCHAR) AS resource_id, count(*) FILTER (event_type = 'view') AS attempts, count(*) FILTER (event_type = 'error') AS failures,
  count(*) FILTER (event_type = 'signup') AS skips FROM events WHERE event_type IN ('view', 'error', 'signup') GROUP BY ALL""",
)
def log_attempts(spark, sf_dir):
    return extract.attempts_from_log(extract.parse_log_lines(_log_lines(spark, sf_dir)))
