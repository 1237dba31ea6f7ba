"""The stored index against BM25 over the chunks themselves, through changes and broken runs."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from scholium.operators import index as I, lexical as L

WORDS = [f"w{i}" for i in range(30)]


def rows(spark, seed, ids, tenant=lambda i: f"t{i % 2}"):
    rng = random.Random(seed)
    texts = [(tenant(i), i // 3, i, " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(30)], k=rng.randrange(0, 60)))) for i in ids]
    return spark.createDataFrame(texts, "tenant_id string, document_id long, chunk_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(q, f"t{q % 3}", " ".join(rng.choices(WORDS, k=1 + q % 4))) for q in range(16)] + [(90, "t0", "the and"), (91, "t1", "absent words")], "query_id long, tenant_id string, text string").cache()


def ranked(df):
    return sorted(map(tuple, df.select("query_id", "tenant_id", "chunk_id", "score", "rank").collect()))


@pytest.fixture(scope="module")
def first(spark):
    return L.analysed(rows(spark, 2, range(180))).cache()


@pytest.fixture(scope="module")
def changed(spark):
    return L.analysed(rows(spark, 3, range(0, 180, 2))).where("document_id % 5 = 0").cache()


def after(first, changed, gone):
    return first.join(gone, ["tenant_id", "document_id"], "left_anti").unionByName(changed)


class Breaking(I.Index):
    """Ends before it writes one table."""

    at = None

    def _put(self, df, name, gen):
        if name == self.at:
            raise KeyboardInterrupt(name)
        super()._put(df, name, gen)


def test_same_ranking_through_changes(spark, asked, first, changed, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}/index", buckets=4, block=3)
    assert index.bm25(asked).count() == 0
    assert index.put(first) == 0
    assert ranked(index.bm25(asked, k=4)) == ranked(L.bm25(asked, first, k=4))
    gone = first.where("document_id % 5 = 0 or document_id = 7").select("tenant_id", "document_id").distinct()
    now = after(first, changed, gone).cache()
    assert index.put(changed, gone) == 1
    assert ranked(index.bm25(asked, k=4)) == ranked(L.bm25(asked, now, k=4))
    again = index.put(changed)  # the same once more: nothing changes
    assert again == 2 and ranked(index.bm25(asked, k=7)) == ranked(L.bm25(asked, now, k=7))
    assert index.live_chunks().count() == now.count()
    new = index.compacted(f"file://{tmp_path}/new")
    assert new.generations() == [0] and ranked(new.bm25(asked, k=4)) == ranked(L.bm25(asked, now, k=4)) and new.table("dead").count() == 0


@pytest.mark.parametrize("table", ["postings", "commits"])
def test_a_run_that_broke_off(spark, asked, first, changed, tmp_path, table):
    index = Breaking(spark, f"file://{tmp_path}/index", buckets=2, block=8)
    index.put(first)
    before = ranked(index.bm25(asked, k=5))
    index.at = table
    with pytest.raises(KeyboardInterrupt):
        index.put(changed)
    assert index.generations() == [0] and ranked(index.bm25(asked, k=5)) == before  # what it left is not read
    index.at = None
    assert index.put(changed) == 1
    now = after(first, changed, changed.select("tenant_id", "document_id").distinct())
    assert ranked(index.bm25(asked, k=5)) == ranked(L.bm25(asked, now, k=5))


def test_postings_stay_where_they_are_read(spark, asked, first, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}/index", buckets=4, block=3)
    index.put(first)
    terms = I.written(L.question_terms(asked).withColumn("bucket", I.bucket_of(4)), "asked")
    wanted = I.written(terms.select("tenant_id", "term", "bucket").distinct(), "wanted")
    stats = I.written(index.statistics(wanted), "stats")
    blocks = index.asked_blocks(I.written(terms.join(stats, ["tenant_id", "term", "bucket"]), "terms"), wanted)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "PartitionFilters" in plan


def test_blocks_are_left_out(spark, first, tmp_path):
    """Two frequent terms: chunks that say one of them once cannot be among the best."""
    index = I.Index(spark, f"file://{tmp_path}/index", buckets=2, block=4)
    texts = [("t", i, i, "common " * (9 if i % 30 < 2 else 1) + "filler " * (i % 40) + "usual " * (9 if i % 30 < 2 else i % 2)) for i in range(300)]
    chunks = L.analysed(spark.createDataFrame(texts, "tenant_id string, document_id long, chunk_id long, text string")).cache()
    index.put(chunks)
    asked = spark.createDataFrame([(1, "t", "usual common")], "query_id long, tenant_id string, text string")
    seen = []
    ranked_before = index._ranked
    index._ranked = lambda blocks, *a: (seen.append(blocks.count()), ranked_before(blocks, *a))[1]
    assert ranked(index.bm25(asked, k=5)) == ranked(L.bm25(asked, chunks, k=5))
    assert seen[0] < index.table("postings").where("term in ('usual', 'common')").count()


def test_terms_are_counted_within_their_chunk(monkeypatch):
    """Whatever is counted at a time; null and empty lists of tokens have no terms."""
    monkeypatch.setattr(I, "TOKENS", 50)
    rng = random.Random(5)
    said = [None, [], ["the"], *([rng.choice([*WORDS, "the", "and"]) for _ in range(rng.randrange(80))] for _ in range(60))]
    batch = pa.RecordBatch.from_pylist([{"tenant_id": None if i == 9 else "t", "document_id": i, "chunk_id": i, "token_count": len(x or []), "tokens": x} for i, x in enumerate(said)],
                                       pa.schema([("tenant_id", pa.string()), ("document_id", pa.int64()), ("chunk_id", pa.int64()), ("token_count", pa.int64()), ("tokens", pa.list_(pa.string()))]))
    got = [r for b in I._counted([batch.slice(0, 40), batch.slice(40)]) for r in b.to_pylist()]
    assert [r["chunk_id"] for r in got] == list(range(len(said)))
    assert [dict(zip(r["terms"], r["tfs"], strict=True)) for r in got] == [dict(Counter(w for w in x or [] if w.startswith("w"))) for x in said]


def test_blocks_of_long_runs(monkeypatch):
    """Every posting is in one block of its term, whatever its batch, and none is beyond its block's bounds."""
    monkeypatch.setattr(I, "HELD", 40)
    rng = random.Random(6)
    rows = [{"tenant_id": t, "term": w, "tf": rng.randrange(1, 9), "token_count": rng.randrange(1, 99), "chunk_id": i, "bucket": 3} for t, w, n in (("a", "x", 7), ("b", "x", 200), (None, "y", 1), ("a", "y", 40), ("a", "z", 8)) for i in range(n)]
    table = pa.Table.from_pylist(rows, pa.schema([("tenant_id", pa.string()), ("term", pa.string()), ("tf", pa.int64()), ("token_count", pa.int64()), ("chunk_id", pa.int64()), ("bucket", pa.int32())]))
    for size in (1, 7, 33, 500):
        found = defaultdict(list)
        for b in (r for x in I._folded(8)(table.to_batches(size)) for r in x.to_pylist()):
            assert 1 <= b["n"] == len(b["postings"]) <= 8 and b["bucket"] == 3
            assert b["top_tf"] == max(p["tf"] for p in b["postings"]) and b["least_length"] == min(p["token_count"] for p in b["postings"])
            found[b["tenant_id"], b["term"]] += [(p["tf"], p["token_count"], p["chunk_id"]) for p in b["postings"]]
        want = defaultdict(list)
        for r in rows:
            want[r["tenant_id"], r["term"]].append((r["tf"], r["token_count"], r["chunk_id"]))
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_terms_move_once(spark, first, tmp_path):
    """Terms are shuffled to their bucket, and by nothing else: neither counted nor put in order by a shuffle of their own."""
    index = I.Index(spark, f"file://{tmp_path}/index", buckets=2, block=4)
    seen, put = {}, index._put
    index._put = lambda df, name, gen: (seen.setdefault(name, df), put(df, name, gen))[1]
    index.put(first)
    plan = lambda name: seen[name]._jdf.queryExecution().optimizedPlan().toString()
    assert plan("postings").count("RepartitionByExpression") == 1 and not any(x in plan("postings") for x in ("Aggregate", "Join", "Window"))
    assert not any(x in plan("chunks") for x in ("Aggregate", "Join", "Repartition"))


def test_repeated_chunks_are_one(spark, asked, tmp_path):
    """Rows of one chunk and length are added up."""
    texts = [("t0", 1, 1, "w1 w2"), ("t0", 1, 1, "w2 w3"), ("t0", 2, 2, "w1 w5 w6"), ("t1", 3, 3, "w1")]
    index = I.Index(spark, f"file://{tmp_path}/index", buckets=2, block=4)
    index.put(L.analysed(spark.createDataFrame(texts, "tenant_id string, document_id long, chunk_id long, text string")))
    got = {(r.tenant_id, r.term): sorted((p.tf, p.chunk_id) for p in r.postings) for r in index.table("postings").where("term in ('w1', 'w2')").collect()}
    assert got == {("t0", "w1"): [(1, 1), (1, 2)], ("t0", "w2"): [(2, 1)], ("t1", "w1"): [(1, 3)]}


def test_what_was_replaced_meets_sums(spark, asked, first, changed, tmp_path, monkeypatch):
    """Where too many chunks were replaced to be sent, a question's sums by chunk are shuffled to them, not its postings."""
    index = I.Index(spark, f"file://{tmp_path}/index", buckets=2, block=8)
    index.put(first)
    index.put(changed)
    monkeypatch.setattr(I, "small", lambda df: df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = index.bm25(asked, k=5)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("LeftAnti") == 1 and plan.index("LeftAnti") < plan.index("Aggregate [query_id")
    now = after(first, changed, changed.select("tenant_id", "document_id").distinct())
    assert ranked(got) == ranked(L.bm25(asked, now, k=5))
