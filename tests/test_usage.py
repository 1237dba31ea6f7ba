"""A stream of attempts, delivered out of order and again, against the same rows as a table."""

import datetime
import random

from scholium.streaming import usage

COLUMNS = "at timestamp, tenant_id string, request_id long, attempt long, model string, provider string, used_fallback boolean, prompt_tokens long, completion_tokens long, latency_ms double, error_type string"


def attempts(seed=1, n=60):
    rng, start, out = random.Random(seed), datetime.datetime(2024, 1, 1), []
    for i in range(n):
        at = start + datetime.timedelta(minutes=i)
        for a in range(1, 2 + i % 3):
            model = "b" * 130 if a == 3 else "a"
            out.append((at + datetime.timedelta(seconds=a), None if i % 13 == 0 else f"t{i % 2}", i, a, model, "p" * 50, a == 3, rng.randrange(100), rng.randrange(50), rng.uniform(-5, 90), "timeout" if a < 1 + i % 3 or i % 5 == 0 else None))
    return out


def test_stream_is_the_table(spark, tmp_path):
    rows = attempts()
    rng = random.Random(2)
    late = sorted(range(2 * len(rows)), key=lambda k: k % len(rows) + rng.randrange(40))  # each twice, some late, in order but for some rows
    for part in range(6):
        size = -(-len(late) // 6)
        spark.createDataFrame([rows[k % len(rows)] for k in late[part * size : (part + 1) * size]], COLUMNS).coalesce(1).write.parquet(f"file://{tmp_path}/in/{part}")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    running = usage.facts(stream, "2 hours").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
    running.awaitTermination(300)
    got, want = spark.read.parquet(f"file://{tmp_path}/out"), usage.facts(spark.createDataFrame(rows * 2, COLUMNS))
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.count() == sum(r[1] is not None for r in rows)
    assert sorted(map(str, usage.by_request(got).collect())) == sorted(map(str, usage.by_request(want).collect()))


def test_facts_are_bounded(spark):
    rows = [r for r in attempts() if r[1]]
    for r in usage.facts(spark.createDataFrame(rows, COLUMNS)).collect():
        assert len(r.model) <= 120 and len(r.provider) == 40 and r.latency_ms >= 0 and r.total_tokens == r.prompt_tokens + r.completion_tokens


def test_requests(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(t(1), "t", 1, 1, "a", "p", False, 1, 1, 1.0, "timeout"), (t(2), "t", 1, 2, "a", "p", False, 1, 1, 1.0, "timeout"), (t(3), "t", 1, 3, "b", "p", True, 2, 2, 1.0, None), (t(1), "t", 2, 1, "a", "p", False, 5, None, 1.0, "refused"), (t(1), "u", 1, 1, "a", "p", False, 3, 3, 1.0, None)]
    got = {(r.tenant_id, r.request_id): tuple(r)[2:] for r in usage.by_request(usage.facts(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert got == {("t", 1): (3, 1, 2, 8, "b", True, None), ("t", 2): (1, 0, 1, 5, None, False, "refused"), ("u", 1): (1, 0, 0, 6, "a", False, None)}
