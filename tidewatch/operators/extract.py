"""Audit-event parsing, entity extraction and log lines."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schemas import AUDIT_PAYLOAD_FIELDS, ENTITY_PATTERNS

def payload_field(payload: Column, path: str, kind: str, default) -> Column:
    """A field whose default applies only where the key is absent: an explicit null stays null."""
    node = F.try_variant_get(payload, path, "variant")
    return F.when(node.isNull(), F.lit(default)).otherwise(F.try_variant_get(payload, path, kind))


# Stand-ins for an escaped backslash and an escaped quote. JSON text never holds these
# characters as such, because control characters must be escaped in it.
_BACKSLASH, _QUOTE = "\u0001", "\u0002"


def string_leaves(text: Column) -> Column:
    """String values of a JSON text in document order, without keys and escapes resolved.

    Works on flat text: each JSON string is one match, and a string followed by a
    colon is a key. Depth does not matter, so no recursion and no fixed depth. Escaped
    quotes are swapped out first, which leaves a pattern that needs no backtracking and
    takes strings of any length. Only strings with an escape go through the JSON reader.
    """
    swapped = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    strings = F.regexp_extract_all(swapped, F.lit(r'"[^"]*+"(?:\s*+:)?'), F.lit(0))
    values = F.filter(strings, lambda s: ~s.endswith(":"))

    def plain(s):
        restored = F.replace(F.replace(s, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
        read = F.from_json(F.concat(F.lit('{"v":'), restored, F.lit("}")), "v string")["v"]
        escaped = s.contains("\\") | s.contains(_QUOTE) | s.contains(_BACKSLASH)
        return F.when(escaped, F.coalesce(read, restored)).otherwise(F.substring(s, F.lit(2), F.length(s) - 2))

    return F.transform(values, plain)


WALK_DEPTH = 100


def string_leaves_exact(df: DataFrame, key: str, text: str, depth: int = WALK_DEPTH) -> DataFrame:
    """(key, path, value): every string value of JSON texts, by an exact walk of the parsed value.

    A recursive query opens objects and arrays level by level, so keys, escapes, repeats and nesting are what the
    parser says they are. ``path`` is like ``$.a[2].b``. A row in which ``key`` or ``text`` is null, or whose text is no
    JSON, has no leaves; rows that share a key keep their leaves. Objects hold their members by name, not in the
    order of the text (``string_leaves`` keeps that). Texts nested deeper than ``depth`` raise.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.try_parse_json(text).alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull())
    view = f"leaves_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    step = "CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END"
    walked = spark.sql(f"""
        WITH RECURSIVE walk(k, path, v) MAX RECURSION LEVEL {int(depth)} AS (
          SELECT k, '$' AS path, v FROM {view}
          UNION ALL
          SELECT w.k, concat(w.path, {step}), e.value FROM walk w, LATERAL variant_explode(w.v) e)
        SELECT k, path, CAST(v AS STRING) AS value FROM walk WHERE schema_of_variant(v) = 'STRING' LIMIT ALL""")
    return walked.withColumnRenamed("k", key)


def literal_start(pattern: str) -> str:
    """Text that every match must contain: the literal characters a pattern begins with."""
    if "|" in pattern or "(?i" in pattern:
        return ""
    head = re.match(r"[A-Za-z0-9:_/@=-]*", pattern).group()
    return head[:-1] if pattern[len(head):len(head) + 1] in ("*", "?", "{") else head


def entities_in(
    leaves: Column, patterns: dict[str, str] | None = None, bounded: bool = False, needles: dict[str, str] | None = None
) -> Column:
    """Distinct (type, name) pairs of all patterns over all string leaves, in first-seen order.

    ``bounded`` refuses a match that continues a longer word, such as ``i-…`` within
    ``eni-…``; the default accepts it, as the plain patterns do. A pattern is only run
    on leaves that hold its ``needle``, a text without which it cannot match; where none
    is given, the literal start of the pattern serves.
    """
    table = patterns or ENTITY_PATTERNS
    needle_of = {kind: (needles or {}).get(kind) or literal_start(pattern) for kind, pattern in table.items()}
    none = F.array().cast("array<struct<type:string,name:string>>")
    if all(needle_of.values()):
        any_needle = "|".join(sorted({re.escape(n) for n in needle_of.values()}))
        leaves = F.filter(leaves, lambda leaf: leaf.rlike(any_needle))

    def of_kind(leaf, kind, pattern):
        regex = rf"(?<![0-9A-Za-z-]){pattern}" if bounded else pattern
        names = F.regexp_extract_all(leaf, F.lit(regex), F.lit(0))
        found = F.transform(names, lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name")))
        return F.when(leaf.contains(needle_of[kind]), found).otherwise(none) if needle_of[kind] else found

    def of_leaf(leaf):
        return F.concat(*[of_kind(leaf, kind, pattern) for kind, pattern in table.items()])

    return F.array_distinct(F.flatten(F.transform(leaves, of_leaf)))


def parse_audit_events(raw: DataFrame, patterns: dict[str, str] | None = None, bounded: bool = False) -> DataFrame:
    """Flat audit events with their entity list; one pass, no shuffle."""
    parsed = raw.withColumn("_p", F.try_parse_json("CloudTrailEvent"))
    return parsed.select(
        F.coalesce(F.col("EventId"), F.try_variant_get("_p", "$.eventID", "string")).alias("event_id"),
        F.col("EventTime").alias("event_time"),
        F.col("EventName").alias("event_name"),
        F.coalesce("Username", F.lit("N/A")).alias("username"),
        *[payload_field(F.col("_p"), path, kind, default).alias(name) for name, path, kind, default in AUDIT_PAYLOAD_FIELDS],
        entities_in(string_leaves(F.col("CloudTrailEvent")), patterns, bounded).alias("resources"),
    )


def entity_rows(
    df: DataFrame, key: str, text: str, patterns: dict[str, str], bounded: bool = False, needles: dict[str, str] | None = None
) -> DataFrame:
    """(key, type, name) for plain text; distinct within each row, so nothing is shuffled."""
    found = entities_in(F.array(F.col(text)), patterns, bounded, needles)
    return df.select(key, F.explode(found).alias("e")).select(key, "e.type", "e.name")


def event_links(events: DataFrame, only_type: str | None = "EC2 Instance") -> DataFrame:
    """Bridge from events to the entities they name, narrowed to one type unless ``None``."""
    linked = events.select("*", F.posexplode("resources").alias("link_ord", "_r"))
    linked = linked.withColumns({"link_type": F.col("_r.type"), "resource_id": F.col("_r.name")}).drop("_r", "resources")
    if only_type is not None:
        linked = linked.filter(F.col("link_type") == only_type)
    return linked.filter(F.coalesce("resource_id", F.lit("")) != "")


LOG_LINE = r"(?s)^(.*?) \| (\w+) \| (.*?) \| (.*)$"


def parse_log_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """``time | level | logger | message``; other lines keep their text as the message."""
    def part(i):
        return F.nullif(F.regexp_extract(text, LOG_LINE, i), F.lit(""))

    return lines.select(
        "*",
        F.try_to_timestamp(F.replace(part(1), F.lit(","), F.lit(".")), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"),
        part(2).alias("level"),
        part(3).alias("logger"),
        F.coalesce(part(4), F.col(text)).alias("message"),
    )


def log_levels(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("logger").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.count_if(F.col("level") == "WARNING").alias("warnings"),
    )


def attempts_from_log(parsed: DataFrame) -> DataFrame:
    """Attempts, failures and skips per resource, recovered from the analysis messages."""
    message = F.col("message")
    attempt = F.regexp_extract(message, r"^Analyzing (\S+) \(Attempt \d+/\d+\)$", 1)
    failed = F.regexp_extract(message, r"^Attempt \d+/\d+ failed for (\S+)$", 1)
    skipped = F.regexp_extract(message, r"^Skipping (\S+?): ", 1)
    tagged = parsed.select(
        F.coalesce(F.nullif(attempt, F.lit("")), F.nullif(failed, F.lit("")), F.nullif(skipped, F.lit(""))).alias("resource_id"),
        (attempt != "").alias("is_attempt"),
        (failed != "").alias("is_failure"),
        (skipped != "").alias("is_skip"),
    )
    return (
        tagged.filter(F.col("resource_id").isNotNull())
        .groupBy("resource_id")
        .agg(
            F.count_if("is_attempt").alias("attempts"),
            F.count_if("is_failure").alias("failures"),
            F.count_if("is_skip").alias("skips"),
        )
    )
