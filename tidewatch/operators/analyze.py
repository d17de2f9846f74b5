"""Batch analysis: eligibility, the pluggable call with retries, responses, run records."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.schemas import FIRST_RETRY_SECONDS, MAX_ATTEMPTS, REPORT, SKIP_LABELS

OUTCOME = "resource_type string, resource_id string, response string, attempts int, failed_attempts int, error string"


def eligibility(contexts: DataFrame) -> DataFrame:
    """Adds ``state`` and ``eligible``. Unknown states are not analysed; scaling groups always are."""
    state = C.state_text(
        F.col("resource_type"), F.col("instance.snapshot.State"), F.col("load_balancer.state")
    )
    return with_eligibility(contexts, state)


def with_eligibility(rows: DataFrame, state) -> DataFrame:
    staged = rows.withColumn("state_text", state)
    return staged.withColumn("eligible", C.is_analyzed_state(F.col("resource_type"), F.col("state_text")))


def skipped_resources(judged: DataFrame) -> DataFrame:
    label = C.lookup(F.col("resource_type"), SKIP_LABELS, F.lit("Resource"))
    return judged.filter(~F.col("eligible")).select(
        "resource_type",
        "resource_id",
        F.col("state_text").alias("state"),
        F.format_string("%s state '%s' is not eligible for analysis", label, F.col("state_text")).alias("reason"),
    )


def analyze(
    prompts: DataFrame,
    analyze_fn: Callable[[str], str],
    max_attempts: int = MAX_ATTEMPTS,
    first_delay: float = FIRST_RETRY_SECONDS,
    parallel_calls: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Calls ``analyze_fn(text) -> response`` once per prompt, with retries and doubling delays.

    ``parallel_calls`` bounds the concurrent calls by spreading prompts over that many
    tasks. A repeated task calls again, so write or checkpoint the outcome once and key
    it by resource; every later step then reads that table.
    """

    def call(text: str):
        delay = first_delay
        error = None
        for attempt in range(1, max_attempts + 1):
            try:
                return analyze_fn(text), attempt, attempt - 1, None
            except Exception as exc:
                error = str(exc)
                if attempt < max_attempts:
                    sleep(delay)
                    delay *= 2
        return None, max_attempts, max_attempts, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [call(text) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "resource_type": batch["resource_type"],
                    "resource_id": batch["resource_id"],
                    "response": [a[0] for a in answers],
                    "attempts": [a[1] for a in answers],
                    "failed_attempts": [a[2] for a in answers],
                    "error": [a[3] for a in answers],
                }
            )

    spread = prompts.repartition(parallel_calls) if parallel_calls else prompts
    return spread.select("resource_type", "resource_id", "text").mapInPandas(run, OUTCOME)


def parse_responses(outcomes: DataFrame, response: str = "response") -> DataFrame:
    """Typed report columns; text that is not a JSON object is kept whole in ``raw_response``."""
    parsed = F.from_json(response, f"struct<{_columns_of(REPORT)},_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    is_object = F.ltrim(F.col(response)).startswith("{")
    good = F.when(is_object & F.col("_p._bad").isNull(), F.col("_p"))
    staged = outcomes.withColumn("_p", parsed).withColumn("_r", good)
    names = ["severity", "confidence", "root_cause", "summary", "evidence", "recommendations"]
    return staged.select(
        *[c for c in outcomes.columns if c != response],
        *[F.col(f"_r.{n}").alias(n) for n in names],
        F.coalesce(F.col("_r.raw_response"), F.when(F.col("_r").isNull(), F.col(response))).alias("raw_response"),
    )


def _columns_of(ddl: str) -> str:
    return ",".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in ddl.split(", "))


def latest_reports(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current report per key over the appended history."""
    rest = [c for c in history.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def run_counters(judged: DataFrame, outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counters of one run (or per ``keys``): discovered, analysed, skipped, ok, failed, retries, reports.

    Both sides become counter rows and are added up, so no join is needed. ``retries``
    counts every failed attempt, the last one included.
    """
    by = keys or []
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    ok = F.when(F.col("error").isNull(), one).otherwise(zero)
    seen = judged.select(
        *by,
        one.alias("discovered"),
        F.when(F.col("eligible"), one).otherwise(zero).alias("analyzed"),
        F.when(F.col("eligible"), zero).otherwise(one).alias("skipped"),
        zero.alias("successful"), zero.alias("failed"), zero.alias("retries"),
    )
    done = outcomes.select(
        *by, zero.alias("discovered"), zero.alias("analyzed"), zero.alias("skipped"),
        ok.alias("successful"), (one - ok).alias("failed"), F.col("failed_attempts").cast("bigint").alias("retries"),
    )
    names = ["discovered", "analyzed", "skipped", "successful", "failed", "retries"]
    total = seen.unionByName(done).groupBy(*by).agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in names])
    return total.withColumn("reports_generated", F.col("successful"))


def run_records(counters: DataFrame, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Run summary columns: id in the display zone, seconds at 2 dp, derived status."""
    return counters.withColumns(
        {
            "run_id": C.run_id_of(F.col(start)),
            "execution_time_seconds": C.round2(C.seconds_between(F.col(start), F.col(end))),
            "status": C.run_status(F.col("analyzed"), F.col("successful"), F.col("failed")),
            "start_time": C.clock_text_of(F.col(start)),
            "end_time": C.clock_text_of(F.col(end)),
        }
    )


def rule_reports(severities: DataFrame) -> DataFrame:
    """Reports out of the rule score, in the columns of a parsed response; no call is made.

    ``severities`` is the per-resource rule result: severity, breach_minutes, persistent
    and anomalies.
    """
    summary = F.format_string(
        "%s: %s min in breach, longest run %s, %s abnormal samples",
        F.col("severity"), F.col("breach_minutes"), F.col("longest_breach"), F.col("anomalies"),
    )
    keys = [k for k in ("resource_type", "resource_id") if k in severities.columns]
    return severities.select(
        *keys,
        "severity",
        F.lit("1.0").alias("confidence"),
        F.lit("rule score over thresholds and samples").alias("root_cause"),
        summary.alias("summary"),
        F.array(F.concat(F.lit("breach minutes: "), F.col("breach_minutes").cast("string"))).alias("evidence"),
        F.array().cast("array<string>").alias("recommendations"),
        F.lit(None).cast("string").alias("raw_response"),
    )
