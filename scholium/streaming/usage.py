"""Usage facts: one row an attempt to answer a model call, however often it is delivered, and what attempts come to by call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The longest names that a fact holds.
MODEL_CHARS, PROVIDER_CHARS = 120, 40
ATTEMPT = ("tenant_id", "request_id", "attempt", "model")


def attempt_id() -> Column:
    """What an attempt is known by: its request, its number in it and the model that was asked."""
    return F.sha2(F.to_json(F.struct(*ATTEMPT), {"ignoreNullFields": "false"}), 256)


def facts(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """attempts (at, tenant_id, request_id, attempt, model, provider, used_fallback, prompt_tokens, completion_tokens, latency_ms, error_type) as facts, each once.

    Rows without a tenant are nobody's usage and go. Names are cut, latencies are
    whole and not negative, tokens are summed. On a stream, an attempt that comes again within
    ``delay`` of its event time is dropped, and what is known of it is forgotten
    after that; of a table's rows the earliest delivery of each attempt stays.
    """
    rows = attempts.where("tenant_id is not null").withColumns({
        "attempt_id": attempt_id(), "model": F.substring("model", 1, MODEL_CHARS), "provider": F.substring("provider", 1, PROVIDER_CHARS),
        "latency_ms": F.greatest(F.bround("latency_ms"), F.lit(0)).cast("long"), "total_tokens": F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))})
    if rows.isStreaming:
        return rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["attempt_id"])
    columns = [c for c in rows.columns if c != "attempt_id"]
    return rows.groupBy("attempt_id").agg(F.min(F.struct("at", *(c for c in columns if c != "at"))).alias("first")).select("attempt_id", *(F.col(f"first.{c}").alias(c) for c in columns))


def by_request(rows: DataFrame) -> DataFrame:
    """tenant_id, request_id and what its attempts (facts) come to: attempts, retries, failed ones, tokens, the model that answered last, whether that was a fallback.

    A retry is any attempt after the first at the same model. The answer is the last
    attempt without an error; a request without one has failed.
    """
    order = F.struct("at", "attempt", "model")
    good = F.col("error_type").isNull()
    return rows.groupBy("tenant_id", "request_id").agg(
        F.count(F.lit(1)).alias("attempts"), (F.count(F.lit(1)) - F.countDistinct("model")).alias("retries"), F.sum((~good).cast("long")).alias("failures"), F.sum("total_tokens").alias("total_tokens"),
        F.max_by("model", F.when(good, order)).alias("answered_by"), F.coalesce(F.max_by("used_fallback", F.when(good, order)), F.lit(False)).alias("fell_back"), F.max_by("error_type", order).alias("last_error"))
