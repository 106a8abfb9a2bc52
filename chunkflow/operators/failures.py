"""Kinds of failures and how they are retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases and delays.
CONTEXT = "(?i)context length|context_length|maximum context|too many tokens|reduce the length|input is too long|prompt is too long"
NETWORK = "(?i)network request failed|err_connection|econnreset|etimedout|enotfound|socket|fetch failed|connection (?:reset|closed|refused|aborted)|net::"
FETCH = "(?i)failed to fetch|networkerror|load failed"
CUT_OFF = "(?i)empty model response|invalid json"
TIMEOUT = r"(?i)timeout of [0-9]+\s*ms exceeded"
DELAYS = [1000, 2000, 4000, 8000, 15000, 20000, 30000, 30000, 30000, 30000]
LADDER_MS, CAP_MS, RECONNECT = sum(DELAYS), 120_000, len(DELAYS) + 1


def classify_failures(df: DataFrame) -> DataFrame:
    """status, message, error_name, retry_after_s, offline -> kind, retryable, max_attempts.

    max_attempts is null where there is no limit.
    """
    status, msg, name = F.col("status"), F.coalesce("message", F.lit("")), F.coalesce("error_name", F.lit(""))
    asked = F.when(F.col("retry_after_s") > 0, F.col("retry_after_s") * 1000)
    rules = [
        (status.isin(401, 403), "auth", False, 1),
        (msg.rlike(CONTEXT), "context", False, 1),
        ((status == 429) & (asked > LADDER_MS), "rate", False, 1),
        (status == 429, "rate", True, RECONNECT),
        (status >= 500, "server", True, RECONNECT),
        (status >= 400, "request", False, 1),
        (F.coalesce("offline", F.lit(False)), "network", True, None),
        ((name == "TimeoutError") | msg.rlike(TIMEOUT), "network", True, 2),
        (name == "AbortError", "network", True, RECONNECT),
        (msg.rlike(CUT_OFF) | msg.rlike(NETWORK), "network", True, RECONNECT),
        ((name == "TypeError") | msg.rlike(FETCH), "cors", True, RECONNECT),
        (F.lit(True), "unknown", False, 1),
    ]
    verdict = None
    for test, kind, retry, most in rules:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(retry).alias("retryable"), F.lit(most).cast("int").alias("max_attempts"))
        verdict = F.when(test, value) if verdict is None else verdict.when(test, value)
    return df.withColumn("_v", verdict).select("*", "_v.*").drop("_v")


def retry_plan(failures: DataFrame) -> DataFrame:
    """classify_failures() rows with attempt (from 1) -> attempt_budget, will_retry, delay_ms."""
    after = F.when(F.col("retry_after_s") > 0, F.least(F.col("retry_after_s") * 1000, F.lit(float(CAP_MS))))
    by_time = F.greatest(F.col("max_attempts"), (F.ceil(F.lit(float(LADDER_MS)) / after) + 1).cast("int"))
    budget = F.when(F.col("max_attempts").isNotNull(), F.coalesce(by_time, F.col("max_attempts")))
    ladder = F.element_at(F.array(*map(F.lit, DELAYS)), F.least(F.greatest(F.col("attempt"), F.lit(1)), F.lit(len(DELAYS))).cast("int"))
    out = failures.withColumn("attempt_budget", budget)
    more = F.col("retryable") & (F.col("attempt_budget").isNull() | (F.col("attempt") < F.col("attempt_budget")))
    return out.withColumns({"will_retry": more, "delay_ms": F.when(more, F.coalesce(after.cast("long"), ladder.cast("long")))})
