"""Plans with their history, and adaptation against a plain version."""

from collections import defaultdict

from pyspark.sql import functions as F

from scholium.operators import revisions as V
from scholium.queries import revisions as queries

D = "/root/testdata/sf0.001"
STEPS = "user_id long, goal string, concept_id long, title string, position long, status string, blocked_by array<long>, hours double"


def steps(spark, rows):
    return spark.createDataFrame(rows, STEPS)


def test_a_batch_twice_writes_nothing(spark, tmp_path):
    plans = V.Plans(spark, f"file://{tmp_path}/plans")
    one = [(1, "g", 10, "a", 0, "available", [], 1.0), (1, "g", 11, "b", 1, "blocked", [10], 2.0), (2, "g", 10, "a", 0, "completed", [], 1.0)]
    assert plans.apply(steps(spark, one), 1) == 2 and plans.apply(steps(spark, one[::-1]), 2) == 0
    files = sorted(p.name for p in (tmp_path / "plans/revisions").iterdir())
    assert files == ["batch=0"]
    other = [(1, "g", 10, "a", 0, "completed", [], 1.0), (1, "g", 11, "b", 1, "available", [], 2.0), (3, "h", 10, "a", 0, "available", [], 1.0)]
    assert plans.apply(steps(spark, other), 3, "progress") == 2 and plans.apply(steps(spark, other), 4) == 0
    got = {(r.user_id, r.goal, r.revision): (r.status, r.superseded_by, r.valid_from, r.valid_to, r.reason) for r in plans.history().collect()}
    assert got == {(1, "g", 1): ("superseded", 2, 1, 3, ""), (1, "g", 2): ("active", None, 3, None, "progress"), (2, "g", 1): ("completed", None, 1, None, ""), (3, "h", 1): ("active", None, 3, None, "progress")}
    assert {(r.goal, r.revision) for r in V.as_of(plans.table("revisions"), 2).where("user_id = 1").collect()} == {("g", 1)}
    assert {(r.user_id, r.goal) for r in V.active(plans.history()).collect()} == {(1, "g"), (3, "h")}
    assert plans.table("steps").where("user_id = 1 and revision = 2").count() == 2


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path):
    plans = V.Plans(spark, f"file://{tmp_path}/plans")
    rows = [(1, "g", 10, "a", 0, "available", [], 1.0)]
    plans.apply(steps(spark, rows), 1)
    changed = steps(spark, [(1, "g", 10, "a", 0, "completed", [], 1.0)])
    V.changes(plans.table("revisions"), changed, 2).steps.write.parquet(f"file://{tmp_path}/plans/steps/batch=1")  # its revisions were never written
    assert plans.history().count() == 1 and plans.table("steps").count() == 1
    assert plans.apply(changed, 2) == 1 and plans.table("steps").count() == 2 and {r.status for r in plans.history().collect()} == {"superseded", "completed"}


def test_what_counts_as_a_change(spark):
    rows = [(1, "g", 10, "a", 0, "blocked", [3, 2], 1.0)]
    same = lambda *x: V.signatures(steps(spark, [(1, "g", *x)])).first().signature == V.signatures(steps(spark, rows)).first().signature
    assert same(10, "a", 0, "blocked", [2, 3], 1.0000000001) and not same(10, "a", 0, "blocked", [2], 1.0)
    assert not same(10, "b", 0, "blocked", [2, 3], 1.0) and not same(10, "a", 0, "pending", [2, 3], 1.0) and not same(10, "a", 0, "blocked", [2, 3], 1.5)


def plain_adapted(steps, mastered, new):
    kept = [[s.concept_id, s.title, s.position, s.status, list(s.blocked_by), s.hours, False] for s in steps if s.status == "completed" or s.concept_id not in mastered]
    present = {k[0] for k in kept}
    for c in sorted(new, key=lambda s: (s.position, s.concept_id)):
        if c.concept_id not in present and c.concept_id not in mastered:
            kept.append([c.concept_id, c.title, len(steps) + sum(k[6] for k in kept), c.status, list(c.blocked_by), c.hours, True])
            present.add(c.concept_id)
    met = mastered | {k[0] for k in kept if k[3] == "completed"}
    left, ordered = [(k, sorted({b for b in k[4] if b not in met})) for k in kept], []
    while True:
        inside = {k[0] for k, _ in left}
        free = [x for x in left if not set(x[1]) & inside]
        if not free:
            break
        best = min(free, key=lambda x: (x[0][2], x[0][6], x[0][1], x[0][0]))
        ordered.append(best)
        left.remove(best)
    first = next((i for i, (k, _) in enumerate(ordered) if k[3] != "completed"), None)
    out = {}
    for i, (k, needs) in enumerate(ordered):
        status = "completed" if k[3] == "completed" else "blocked" if needs else ("in_progress" if k[3] == "in_progress" else "available") if i == first else "pending"
        out[k[0]] = (i, status, tuple(needs), k[6])
    return out


def test_adaptation(spark):
    rows, mastered, new = (x.cache() for x in queries.adaptation(spark, D))
    grouped = [defaultdict(list) for _ in range(3)]
    for into, df in zip(grouped, (rows, mastered, new), strict=True):
        for r in df.collect():
            into[r.user_id, r.goal].append(r)
    want = {}
    for plan in {*grouped[0], *grouped[2]}:
        for c, x in plain_adapted(grouped[0][plan], {r.concept_id for r in grouped[1][plan]}, grouped[2][plan]).items():
            want[(*plan, c)] = x
    got = {(r.user_id, r.goal, r.concept_id): (r.position, r.status, tuple(r.blocked_by), r.inserted) for r in V.adapted(rows, mastered, new).collect()}
    assert got == want and {"completed", "blocked", "in_progress", "available", "pending"} == {x[1] for x in got.values()} and any(x[3] for x in got.values())
    again = V.adapted(rows, mastered.where(F.lit(False)))
    assert again.count() <= rows.count() and again.where("inserted").isEmpty()
