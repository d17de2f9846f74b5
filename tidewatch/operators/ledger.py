"""A ledger of analysis calls: what is answered stays answered, whatever happens to the job.

A call is named by resource and text: (resource_type, resource_id, SHA-256 of the prompt). Each call adds
a row, so the ledger is append-only. A job asks it first which prompts are open, works on those in small
chunks that are written one by one, and after a crash the next job goes on behind the last chunk.
Waiting before a repeated call happens between the rounds, on the driver, and holds no task slot.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import FIRST_RETRY_SECONDS, MAX_ATTEMPTS
from tidewatch.session import cut_lineage, scratch_path

KEY = ["resource_type", "resource_id", "prompt_hash"]
CALLS = "resource_type string, resource_id string, prompt_hash string, response string, error string, called_at timestamp"
LEDGER = f"{CALLS}, run_key string, attempt int"

# Calls of one task, and tasks of one chunk: a chunk is what a crash can make a job call again.
TASK_CALLS = 50
CHUNK_TASKS = 16
# Chunks that take less time than so many seconds are doubled, as each is a job and a write of its own.
CHUNK_SECONDS = 10.0


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All calls; empty before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], LEDGER)


def with_hash(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("prompt_hash", F.sha2("text", 256))


def answers(ledger: DataFrame) -> DataFrame:
    """(key, response, answered_at): the first answer of each prompt."""
    good = ledger.where(F.col("error").isNull())
    first = good.groupBy(*KEY).agg(F.min_by("response", "called_at").alias("response"), F.min("called_at").alias("answered_at"))
    return first


def attempts_of(ledger: DataFrame, run_key: str) -> DataFrame:
    """(key, attempts, failed_attempts, error): calls of one run, and the error of the last one if none succeeded."""
    own = ledger.where(F.col("run_key") == run_key)
    failed = F.count("error")
    return own.groupBy(*KEY).agg(
        F.count("*").cast("int").alias("attempts"),
        failed.cast("int").alias("failed_attempts"),
        F.when(failed == F.count("*"), F.max_by("error", "attempt")).alias("error"),
    )


def open_prompts(prompts: DataFrame, ledger: DataFrame, run_key: str, attempt: int) -> DataFrame:
    """Prompts without an answer that this run has called fewer than ``attempt`` times."""
    tried = attempts_of(ledger, run_key).select(*KEY, "attempts")
    unanswered = prompts.join(answers(ledger).select(*KEY), KEY, "left_anti").join(tried, KEY, "left")
    return unanswered.where(F.coalesce("attempts", F.lit(0)) < attempt).drop("attempts")


def _caller(analyze_fn: Callable[[str], str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def call(text: str) -> tuple[str | None, str | None]:
        try:
            return analyze_fn(text), None
        except Exception as failure:
            return None, str(failure) or type(failure).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, times = [], []
            for text in batch["text"]:
                found.append(call(text))
                times.append(pd.Timestamp.now(tz="UTC"))
            done = batch[KEY].copy()
            done["response"], done["error"] = [r for r, _ in found], [e for _, e in found]
            done["called_at"] = pd.Series(times, index=done.index, dtype="datetime64[us, UTC]")
            yield done

    return run


def _next_size(size: int, seconds: float) -> int:
    """Chunks to take together after ``size`` of them have taken ``seconds``."""
    if seconds < CHUNK_SECONDS:
        return 2 * size
    return max(1, int(size * min(1.0, 2 * CHUNK_SECONDS / seconds)))


def answer(
    prompts: DataFrame,
    analyze_fn: Callable[[str], str],
    path: str,
    run_key: str | None = None,
    max_attempts: int = MAX_ATTEMPTS,
    first_delay: float = FIRST_RETRY_SECONDS,
    parallel_calls: int = CHUNK_TASKS,
    task_calls: int = TASK_CALLS,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Outcomes (resource_type, resource_id, response, attempts, failed_attempts, error) of ``prompts``.

    ``analyze_fn(text) -> response`` is called once a round for each prompt that the ledger under ``path`` holds no
    answer to; rounds wait ``first_delay`` seconds, then twice as long each time. A prompt that an earlier run has
    answered is not called and has no attempts. A run that was killed is taken up again under its ``run_key``: its
    attempts count on. At most ``parallel_calls`` tasks call at a time, and after a crash at most the prompts of one chunk
    are called again: ``parallel_calls * task_calls``, or, where calls are so quick that such a chunk takes less than CHUNK_SECONDS,
    as many as take about twice that time. Rows that repeat a resource and a text are one prompt. Two jobs should not work on one ledger at the same time: both would call.
    """
    spark, run_key = prompts.sparkSession, run_key or uuid.uuid4().hex
    wanted = cut_lineage(with_hash(prompts.select("resource_type", "resource_id", "text")).dropDuplicates(KEY))
    for attempt in range(1, max_attempts + 1):
        open_ = cut_lineage(open_prompts(wanted, read_ledger(spark, path), run_key, attempt))
        n = open_.count()
        if not n:
            continue
        if attempt > 1:
            sleep(first_delay * 2 ** (attempt - 2))
        n_chunks = -(-n // (parallel_calls * task_calls))
        chunks = scratch_path(spark, "prompts")
        dealt = open_.withColumn("chunk", F.pmod(F.xxhash64(*KEY), F.lit(n_chunks)).cast("int"))
        dealt.repartition("chunk").write.partitionBy("chunk").parquet(chunks)
        stored = spark.read.parquet(chunks)
        at, size = 0, 1
        while at < n_chunks:
            began = time.monotonic()
            todo = stored.where((F.col("chunk") >= at) & (F.col("chunk") < at + size)).select(*KEY, "text").repartition(parallel_calls)
            done = todo.mapInPandas(_caller(analyze_fn), CALLS)
            done.select("*", F.lit(run_key).alias("run_key"), F.lit(attempt).alias("attempt")).write.mode("append").parquet(path)
            at, size = at + size, _next_size(size, time.monotonic() - began)
    ledger = read_ledger(spark, path)
    tried = attempts_of(ledger, run_key)
    none = F.lit(0)
    return (
        wanted.select(*KEY)
        .join(answers(ledger).drop("answered_at"), KEY, "left")
        .join(tried, KEY, "left")
        .select(
            "resource_type", "resource_id", "response",
            F.coalesce("attempts", none).alias("attempts"), F.coalesce("failed_attempts", none).alias("failed_attempts"), "error",
        )
    )
