"""Retrieval, citation, cost and latency metrics, and the regression gate."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scholium.operators.lexical import spread
from scholium.store import fits, small, written

# What marks an answer as a refusal.
REFUSALS = ("i don't have enough information", "not enough information", "not enough evidence", "insufficient evidence", "cannot answer", "can't answer", "cannot be answered", "do not have enough context")


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """One row a question of qrels: recall, precision, mrr, ndcg at k and context precision.

    ``ranked`` (query_id, chunk_id, rank) has ranks from 1 without gaps.
    Precision divides by the number of rows returned up to k.
    """
    need = qrels.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    marked = ranked.where(F.col("rank") <= k).join(qrels.distinct().withColumn("rel", F.lit(1)), ["query_id", "chunk_id"], "left").fillna(0, ["rel"])
    upto = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("hits", upto)
    by = marked.groupBy("query_id").agg(
        F.sum("rel").alias("found"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = need.join(by, "query_id", "left").fillna(0, ["found", "n", "dcg", "precisions"])
    r = lambda c, name: F.round(c, 6).alias(name)
    return out.select("query_id", r(F.col("found") / F.col("n_rel"), "recall"), r(F.when(F.col("n") > 0, F.col("found") / F.col("n")).otherwise(0.0), "precision"),
        r(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "mrr"), r(F.col("dcg") / ideal, "ndcg"), r(F.when(F.col("found") > 0, F.col("precisions") / F.col("found")).otherwise(0.0), "context_precision"))


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, chunk_id of the texts (chunk_id, text) that hold an item (query_id, item).

    The words of an item but the first and the last are whole words of a text that
    holds it. So three of them that follow one another, the longest, find the
    candidates, and whether the text contains the item decides. Items that are few
    enough go to the texts, which are read in one pass and not shuffled; more meet
    them by an equi-join. Items of fewer than five words are compared with every text.
    """
    n = F.size(F.filter(F.split(F.col("item"), r"\s+"), lambda w: w != ""))
    keyed = items.where(n >= 5).select("query_id", "item")
    found = _held_by_few(docs, keyed) if fits(keyed) else _held_by_join(docs, keyed)
    short = items.where(n < 5)
    if short.isEmpty():
        return found
    return found.unionByName(docs.join(short, F.contains(F.col("text"), F.col("item"))).select("query_id", "chunk_id"))


def _held_by_few(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = [tuple(r) for r in items.collect()]  # its size was checked
    keys: dict[tuple[str, ...], list[int]] = {}
    for i, (_, item) in enumerate(rows):
        inner = item.split()[1:-1]
        keys.setdefault(max(zip(inner, inner[1:], inner[2:], strict=False), key=lambda g: sum(map(len, g))), []).append(i)
    sent = docs.sparkSession.sparkContext.broadcast((rows, keys))
    kinds = f"query_id {items.schema['query_id'].dataType.simpleString()}, chunk_id {docs.schema['chunk_id'].dataType.simpleString()}"

    def find(batches):
        rows, keys = sent.value
        asked = keys.keys()
        for batch in batches:
            who, at = [], []
            for place, text in enumerate(batch.column("text").to_pylist()):
                words = text.split() if text else []
                for gram in set(zip(words, words[1:], words[2:], strict=False)) & asked if len(words) > 2 else ():
                    for i in keys[gram]:
                        if rows[i][1] in text:
                            who.append(rows[i][0])
                            at.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(who, ids), batch.column("chunk_id").take(pa.array(at, pa.int64()))], ["query_id", "chunk_id"])

    ids = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string()}[items.schema["query_id"].dataType.typeName()]
    return spread(docs.select("chunk_id", "text")).mapInArrow(find, kinds)


def _held_by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    both = lambda x, y: F.concat_ws(" ", x, y)
    rest = lambda w, i: F.slice(w, F.lit(i), F.greatest(F.size(w), F.lit(1)))
    grams = lambda w: F.zip_with(F.zip_with(w, rest(w, 2), both), rest(w, 3), both)
    n = F.size(words(F.col("item")))
    inner = F.slice(words(F.col("item")), F.lit(2), F.greatest(n - 2, F.lit(0)))
    longest = F.array_max(F.transform(F.slice(grams(inner), F.lit(1), F.greatest(n - 4, F.lit(0))), lambda g: F.struct(F.length(g).alias("size"), g.alias("gram"))))
    keys = items.select("query_id", longest["gram"].alias("gram"))
    said = spread(docs).select("chunk_id", F.explode(F.array_distinct(grams(words(F.col("text"))))).alias("gram"))
    likely = said.join(small(keys), "gram").select("query_id", "chunk_id").distinct().join(items, "query_id").join(docs, "chunk_id")
    return likely.where(F.contains(F.col("text"), F.col("item"))).select("query_id", "chunk_id")


def question_metrics(semantic: DataFrame, lexical: DataFrame, fused: DataFrame, final: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """The ten metrics of each answerable question (one that ``qrels`` has rows of), from the four rank lists (query_id, chunk_id, rank).

    A list without rows of a question scores 0 for it.
    """
    wanted = written(qrels.select("query_id", "chunk_id").distinct(), "qrels")
    lists = {"semantic": semantic, "lexical": lexical, "fused": fused}
    rows = reduce(DataFrame.unionByName, (df.select("query_id", "chunk_id", "rank", F.lit(name).alias("list")) for name, df in lists.items()))
    hit = rows.join(wanted, ["query_id", "chunk_id"])
    upto = lambda name, n: F.count(F.when((F.col("list") == name) & (F.col("rank") <= n), 1))
    by = hit.groupBy("query_id").agg(upto("semantic", 20).alias("s"), upto("lexical", 20).alias("l"), upto("fused", 10).alias("f"), F.min(F.when(F.col("list") == "fused", F.col("rank"))).alias("first"))
    need = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    last = retrieval_metrics(final, wanted, k).select(
        "query_id", F.col("precision").alias(f"precision_at_{k}"), F.col("recall").alias(f"recall_at_{k}"), F.col("mrr").alias(f"mrr_at_{k}"), F.col("ndcg").alias(f"ndcg_at_{k}"), "context_precision", F.col("recall").alias("context_recall"))
    share = lambda c, name: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("n"), 6).alias(name)
    early = need.join(by, "query_id", "left").select("query_id", share("s", "semantic_recall_at_20"), share("l", "lexical_recall_at_20"), share("f", "fused_recall_at_10"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("fused_mrr"))
    return early.join(last, "query_id")


def macro(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.agg(F.count(F.lit(1)).alias("n_questions"), *(F.round(F.avg(c), 6).alias(c) for c in names))


def citation_ids(text: Column) -> Column:
    """Ids like S1 in brackets, in the order of first mention."""
    inside = F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    parts = F.flatten(F.transform(inside, lambda x: F.split(x, r"[,\s]+")))
    return F.array_distinct(F.filter(parts, lambda x: x.rlike(r"^S[0-9]+$")))


def is_refusal(text: Column) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (lowered.contains(p) for p in REFUSALS))


def verified(answers: DataFrame) -> DataFrame:
    """Adds cited, valid, hallucinated, unused, precision and recall to (text, available).

    With nothing cited precision is 1 for a refusal and else 0.
    """
    out = answers.withColumn("cited", citation_ids(F.col("text")))
    out = out.withColumn("valid", F.array_intersect("cited", "available")).withColumn("hallucinated", F.array_except("cited", "available")).withColumn("unused", F.array_except("available", "cited"))
    nothing = F.when(is_refusal(F.col("text")), 1.0).otherwise(0.0)
    return out.withColumn("precision", F.when(F.size("cited") > 0, F.size("valid") / F.size("cited")).otherwise(nothing)).withColumn("recall", F.when(F.size("available") > 0, F.size("valid") / F.size("available")).otherwise(0.0))


def citation_metrics(answers: DataFrame) -> DataFrame:
    """Set metrics against what should have been cited (relevant) and what was offered; nothing cited is 0."""
    cited, relevant, offered = F.array_distinct("cited"), F.array_distinct("relevant"), F.array_distinct("available")
    hit = F.size(F.array_intersect(cited, relevant))
    return answers.select("answer_id", F.when(F.size(cited) > 0, hit / F.size(cited)).otherwise(0.0).alias("precision"), F.when(F.size(relevant) > 0, hit / F.size(relevant)).otherwise(0.0).alias("recall"),
        F.when(F.size(cited) > 0, F.size(F.array_except(cited, offered)) / F.size(cited)).otherwise(0.0).alias("hallucination_rate"))


def judged(verdicts: DataFrame) -> DataFrame:
    """Grades 1 to 5 as 0 to 1, and the share of supported statements."""
    return verdicts.select("answer_id", F.when(F.col("n_statements") > 0, F.col("n_supported") / F.col("n_statements")).alias("faithfulness"), ((F.col("relevance") - 1) / 4.0).alias("relevance"), ((F.col("correctness") - 1) / 4.0).alias("correctness"))


def overlap_grade(share: Column) -> Column:
    return F.when(share >= 0.75, 5).when(share >= 0.5, 4).when(share >= 0.25, 3).when(share >= 0.1, 2).otherwise(1)


def latency(timings: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of ms by stage; stages without timings do not appear."""
    return timings.where("ms is not null").groupBy("stage").agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ms)").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))), F.count(F.lit(1)).alias("n"))


def interpolated(timings: DataFrame) -> DataFrame:
    return timings.where("ms is not null").groupBy("stage").agg(*(F.round(F.percentile("ms", p), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))))


def rates(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg(F.col("fallback_used").cast("double")), 6).alias("fallback_rate"), F.round(F.avg(F.col("error").cast("double")), 6).alias("error_rate"))


def degradation_histogram(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("degraded").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def gate(baseline: DataFrame, current: DataFrame, tolerances: DataFrame) -> DataFrame:
    """metric, verdict of (metric, value, config) against a baseline.

    A metric may fall short by abs + rel * |baseline| in its bad direction. A
    changed configuration refuses the comparison; a metric on one side only or
    without tolerance fails; one that neither side measured is skipped.
    """
    b, c = baseline.select("metric", F.col("value").alias("was"), F.col("config").alias("was_config"), F.lit(True).alias("in_b")), current.select("metric", F.col("value").alias("is"), F.col("config").alias("is_config"), F.lit(True).alias("in_c"))
    both = b.join(c, "metric", "full_outer").join(tolerances, "metric", "left")
    worse = F.when(F.col("higher_is_better"), F.col("was") - F.col("is")).otherwise(F.col("is") - F.col("was"))
    allowed = F.col("abs") + F.col("rel") * F.abs(F.col("was"))
    verdict = F.when(F.col("in_b").isNull() | F.col("in_c").isNull() | F.col("abs").isNull(), "fail").when(F.col("was_config") != F.col("is_config"), "refused").when(F.col("was").isNull() & F.col("is").isNull(), "skipped").when(F.col("was").isNull() | F.col("is").isNull(), "fail").when(worse > allowed, "fail").otherwise("pass")
    return both.select("metric", verdict.alias("verdict"))


# ---- usage -------------------------------------------------------------------


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd and priced: the first listed part of a model's name gives prices a million tokens.

    Distinct models meet the bounded price list, not every usage row.
    """
    models = usage.select("model").distinct()
    hits = models.join(small(prices), F.contains(F.lower("model"), F.col("part")))
    best = hits.groupBy("model").agg(F.min(F.struct("ord", "prompt_price", "completion_price")).alias("p"))
    out = usage.join(best, "model", "left")
    cost = F.col("prompt_tokens") / 1e6 * F.col("p.prompt_price") + F.col("completion_tokens") / 1e6 * F.col("p.completion_price")
    return out.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).withColumn("priced", F.col("p").isNotNull()).drop("p")


def cost_sources(usage: DataFrame, prices: DataFrame, provided: DataFrame) -> DataFrame:
    """Adds cost_usd, priced and source (provider, static, unknown).

    A provider's own price of the very model (``provided``: model, prompt_price,
    completion_price a million tokens) goes first where it gives a cost that is
    positive and finite; else the first listed part of the name; else 0. Negative
    or unknown token counts are 0.
    """
    tokens = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    clean = usage.withColumn("prompt_tokens", tokens("prompt_tokens")).withColumn("completion_tokens", tokens("completion_tokens"))
    own = provided.dropDuplicates(["model"]).select("model", F.struct("prompt_price", "completion_price").alias("_own"))
    out = priced(clean, prices).join(small(own), "model", "left")
    cost = F.col("prompt_tokens") / 1e6 * F.col("_own.prompt_price") + F.col("completion_tokens") / 1e6 * F.col("_own.completion_price")
    good = F.coalesce((cost > 0) & (cost < float("inf")), F.lit(False))
    source = F.when(good, "provider").when(F.col("priced"), "static").otherwise("unknown")
    return out.withColumn("source", source).withColumn("cost_usd", F.when(good, cost).otherwise(F.col("cost_usd"))).withColumn("priced", good | F.col("priced")).drop("_own")


def turn_usage(calls: DataFrame) -> DataFrame:
    """turn_id, tokens, cost and number of a turn's calls; a negative amount adds nothing."""
    up = lambda c: F.sum(F.greatest(F.col(c), F.lit(0))).alias(c)
    return calls.groupBy("turn_id").agg(up("prompt_tokens"), up("completion_tokens"), up("total_tokens"), F.round(F.sum(F.greatest("cost_usd", F.lit(0.0))), 6).alias("cost_usd"), F.count(F.lit(1)).alias("calls"))


def token_summary(usage: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return usage.agg(n.alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.round(F.avg(F.col("priced").cast("double")), 6).alias("priced_fraction"), F.round(F.avg(F.col("fallback_used").cast("double")), 6).alias("fallback_rate"), (F.sum((~F.col("priced")).cast("int")) > 0).alias("partial"))


def histogram(rows: DataFrame, bounds: list[float], value: str, by: list[str]) -> DataFrame:
    """Cumulative counts up to each bound and in all, and the sum."""
    cells = [F.struct(F.lit(str(b)).alias("le"), F.sum((F.col(value) <= b).cast("long")).alias("n")) for b in bounds] + [F.struct(F.lit("+Inf").alias("le"), F.count(value).alias("n"))]
    return rows.groupBy(*by).agg(F.array(*cells).alias("cells")).select(*by, F.explode("cells").alias("x")).select(*by, "x.le", "x.n")


def exposition(samples: DataFrame) -> DataFrame:
    """Prometheus text lines of (name, labels map, value)."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return samples.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("value"))


def breaches(turns: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Adds exit_reasons: the budgets that a turn has reached."""
    return turns.withColumn("exit_reasons", F.array_compact(F.array(*(F.when(F.col(c) >= v, F.lit(c)) for c, v in limits.items()))))
