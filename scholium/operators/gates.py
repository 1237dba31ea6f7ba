"""What a batch of extracted relations may add to the concept graph, taken in order.

Some gates depend on what was accepted before: an edge may not close a cycle with
the graph and the edges accepted earlier, a document writes so many edges, an alias
belongs to whoever named it first. Edges are in the order of (document, chunk, place
in the chunk) of their first row.

Only edges within one strongly connected component of the graph and all proposals
can ever close a cycle. Components are found by joins over the whole graph; the
fold in order then runs by component, and everything else is accepted unseen.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from scholium.functions.text import is_slug, slugify
from scholium.operators.extraction import CHUNK_EDGES, DISCARD, DOCUMENT_EDGES, contradictory, evidence, gated, scored
from scholium.operators.graph import MAX_PATH, TRANSITIVE, on_cycles
from scholium.store import written

EDGE = ["source_id", "target_id", "relation"]
#: Where an edge stands in the order: document, chunk and place in the chunk of its first row.
ORDER = ("first_document", "first_chunk", "first_seq")
#: Edges that are still open up to which one task finds their components; beyond, joins take more away.
LOCAL_EDGES = 500_000


# ---- strongly connected components ---------------------------------------------


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, component of the nodes of ``edges`` (at, to) that lie on a cycle.

    Nodes that no cycle holds are taken away, by joins over the edges that are left,
    which are written each time. Long chains need many such rounds for few edges, so
    as soon as at most ``local_edges`` are left one task does the rest. If more are
    left when no round takes any away, the largest name that reaches a node is its
    colour, and what reaches the namesake of a colour within it is one component;
    the rest goes round again.
    """
    open_, found = edges.select("at", "to").where("at <> to").distinct(), None
    while True:
        open_ = on_cycles(open_, local_edges)
        if open_.count() <= local_edges:
            break
        colours = written(_colours(open_), "colours")
        same = open_.join(colours.withColumnRenamed("node", "at"), "at").join(colours.select(F.col("node").alias("to"), F.col("colour").alias("other")), "to")
        same = written(same.where("colour = other").select("at", "to", "colour"), "same-colour")
        members = frontier = written(colours.where("node = colour"), "members")
        while True:
            behind = same.join(frontier.select(F.col("node").alias("to"), "colour"), ["to", "colour"]).select(F.col("at").alias("node"), "colour").distinct()
            frontier = written(behind.join(members, ["node", "colour"], "left_anti"), "frontier")
            if frontier.isEmpty():
                break
            members = written(members.unionByName(frontier), "members")
        found = members if found is None else found.unionByName(members)
        gone = members.select("node")
        open_ = open_.join(gone.withColumnRenamed("node", "at"), "at", "left_anti").join(gone.withColumnRenamed("node", "to"), "to", "left_anti").select("at", "to")
    rest = _few_components(open_)
    return rest if found is None else rest.unionByName(found.select("node", F.col("colour").alias("component")))


def _few_components(edges: DataFrame) -> DataFrame:
    """node, component of few edges, in one task."""

    def whole(batches):
        both = pd.concat([pd.DataFrame({"at": [], "to": []}), *batches])
        codes, names = pd.factorize(np.concatenate([both["at"].to_numpy(), both["to"].to_numpy()]))
        groups = [names[g] for g in components(codes[: len(both)], codes[len(both) :], len(names))]
        if groups:
            yield pd.DataFrame({"node": np.concatenate(groups), "component": np.repeat([max(g) for g in groups], [len(g) for g in groups])})

    kind = edges.schema["at"].dataType.simpleString()
    return edges.select("at", "to").coalesce(1).mapInPandas(whole, f"node {kind}, component {kind}")


def components(at: np.ndarray, to: np.ndarray, n: int) -> list[list[int]]:
    """Strongly connected components of two and more of the nodes 0 to n - 1 (Tarjan's search, without recursion)."""
    while len(at):  # nodes without an edge in or out are on no cycle
        reached, leads = np.zeros(n, bool), np.zeros(n, bool)
        reached[to], leads[at] = True, True
        kept = reached[at] & leads[to]
        if kept.all():
            break
        at, to = at[kept], to[kept]
    order = np.argsort(at, kind="stable")
    ahead, ends = to[order].tolist(), np.searchsorted(at[order], np.arange(n + 1)).tolist()
    seen, low, place, waiting, out = [-1] * n, [0] * n, ends[:-1], [], []
    count, held = 0, [False] * n
    for start in np.unique(at).tolist():
        path = [start] if seen[start] < 0 else []
        while path:
            v = path[-1]
            if seen[v] < 0:
                seen[v] = low[v] = count
                count += 1
                waiting.append(v)
                held[v] = True
            if place[v] < ends[v + 1]:
                w = ahead[place[v]]
                place[v] += 1
                if seen[w] < 0:
                    path.append(w)
                elif held[w]:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                group = []
                while not group or group[-1] != v:
                    group.append(waiting.pop())
                    held[group[-1]] = False
                if len(group) > 1:
                    out.append(group)
    return out


def _colours(edges: DataFrame) -> DataFrame:
    """node, colour: the largest node that leads to each node, itself included."""
    nodes = edges.select(F.col("at").alias("node")).unionByName(edges.select(F.col("to").alias("node"))).distinct()
    state = written(nodes.withColumn("colour", F.col("node")), "colours")
    while True:
        ahead = edges.join(state.withColumnRenamed("node", "at"), "at").groupBy(F.col("to").alias("node")).agg(F.max("colour").alias("reached"))
        step = written(state.join(ahead, "node", "left").select("node", F.greatest("colour", "reached").alias("colour"), (F.col("reached") > F.col("colour")).alias("moved")), "colours")
        state = step.select("node", "colour")
        if step.where("moved").isEmpty():
            return state


# ---- the cycle gate ------------------------------------------------------------


class Ordered:
    """A directed graph that keeps an order of study as edges come, as long as it has one."""

    def __init__(self, edges, max_depth: int):
        self.ahead, self.behind, self.max_depth = defaultdict(set), defaultdict(set), max_depth
        for a, b in edges:
            if a != b:
                self._put(a, b)
        self.place: dict = {}
        waits = {v: len(self.behind[v]) for v in {*self.ahead, *self.behind}}
        free = [v for v, n in waits.items() if not n]
        while free:
            v = free.pop()
            self.place[v] = len(self.place)
            for w in self.ahead[v]:
                waits[w] -= 1
                if not waits[w]:
                    free.append(w)
        self.has_order = len(self.place) == len(waits)

    def _put(self, a, b) -> None:
        self.ahead[a].add(b)
        self.behind[b].add(a)

    def _region(self, start, links, inside, wanted=None, steps=float("inf")) -> dict:
        """Nodes that ``start`` leads to over ``links``, with their distance; at most ``steps`` away, and none further than ``wanted``."""
        far, level = {start: 0}, [start]
        while level and wanted not in far and far[level[0]] < steps:
            ahead = []
            for v in level:
                for w in links[v]:
                    if w not in far and inside(w):
                        far[w] = far[v] + 1
                        ahead.append(w)
            level = ahead
        return far

    def closes(self, a, b) -> bool:
        """Whether b leads to a in at most ``max_depth`` steps, so that an edge a -> b would close a cycle."""
        if a == b:
            return True
        if not self.has_order:
            return a in self._region(b, self.ahead, lambda w: True, a, self.max_depth)
        last = self.place.get(a, -1)
        if self.place.get(b, last + 1) > last:
            return False
        return a in self._region(b, self.ahead, lambda w: self.place[w] <= last, a, self.max_depth)

    def add(self, a, b) -> None:
        if b in self.ahead[a]:
            return
        for v in (a, b):
            if self.has_order and v not in self.place:
                self.place[v] = len(self.place)
        if self.has_order and self.place[b] < self.place[a]:
            first, last = self.place[b], self.place[a]
            after = self._region(b, self.ahead, lambda w: self.place[w] <= last)
            if a in after:  # a cycle longer than the gate looks
                self.has_order = False
            else:  # what leads to a goes before what b leads to, in the places that both had
                before = self._region(a, self.behind, lambda w: self.place[w] >= first)
                moved = sorted(before, key=self.place.__getitem__) + sorted(after, key=self.place.__getitem__)
                for v, at in zip(moved, sorted(self.place[v] for v in moved), strict=True):
                    self.place[v] = at
        self._put(a, b)


def closing(known, proposed, max_depth: int = MAX_PATH) -> list[bool]:
    """Whether each proposed (source, target, enters) closes a cycle with ``known`` edges and those before it that did not and that enter."""
    graph, out = Ordered(known, max_depth), []
    for a, b, enters in proposed:
        out.append(graph.closes(a, b))
        if enters and not out[-1]:
            graph.add(a, b)
    return out


def _named(rows: DataFrame, *more: str) -> DataFrame:
    """The rows whose relation can close a cycle, with their ends (at, to) named by relation."""
    node = lambda c: F.concat("relation", F.lit(":"), F.col(c).cast("string"))
    return rows.where(F.col("relation").isin(*TRANSITIVE)).select(*EDGE, *more, node("source_id").alias("at"), node("target_id").alias("to"))


def cycle_parts(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """node, component of all edges that could be there, whatever is refused of ``proposed``."""
    return written(strong_components(_named(proposed).select("at", "to").unionByName(_named(known).select("at", "to"))), "components")


def cycle_gate(proposed: DataFrame, known: DataFrame, order: tuple[str, ...], max_depth: int = MAX_PATH, parts: DataFrame | None = None) -> DataFrame:
    """Adds ``cycle`` to ``proposed`` (source_id, target_id, relation: one row an edge; enters; the columns of ``order``, which tell all rows apart).

    Edges are judged in order, each against ``known`` edges of its relation and the
    earlier ones that were not refused and that enter the graph. Relations other
    than ``TRANSITIVE`` close no cycle; an edge from a concept to itself does.
    ``parts``: ``cycle_parts`` of these or of more edges.
    """
    own = F.col("relation").isin(*TRANSITIVE)
    parts = cycle_parts(proposed, known) if parts is None else parts

    def within(rows: DataFrame) -> DataFrame:
        return rows.join(parts.withColumnRenamed("node", "at"), "at").join(parts.select(F.col("node").alias("to"), F.col("component").alias("other")), "to").where("component = other").drop("at", "to", "other")

    rows = within(_named(proposed, "enters", *order)).withColumn("old", F.lit(False)).unionByName(within(_named(known.select(*EDGE).distinct())).withColumn("old", F.lit(True)), allowMissingColumns=True)
    kinds = ", ".join(f"{c} {proposed.schema[c].dataType.simpleString()}" for c in EDGE)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        known_edges, new = pdf[pdf["old"]], pdf[~pdf["old"]].sort_values(list(order))
        cycle = closing(zip(known_edges["source_id"], known_edges["target_id"], strict=True), zip(new["source_id"], new["target_id"], new["enters"], strict=True), max_depth)
        return new[EDGE].assign(cycle=cycle)

    folded = written(rows.groupBy("component").applyInPandas(fold, f"{kinds}, cycle boolean").where("cycle"), "cycles")
    return proposed.join(folded, EDGE, "left").withColumn("cycle", F.coalesce("cycle", own & (F.col("source_id") == F.col("target_id"))))


# ---- a whole batch ---------------------------------------------------------------


@dataclass
class Batch:
    """Rows with gate and duplicate, edges with their score and gate; where a gate is null the row counts and the edge is written."""

    rows: DataFrame
    edges: DataFrame

    def counts(self) -> DataFrame:
        """gate, n: how often each gate fired; a duplicate row is counted although its evidence is kept."""
        repeated = self.rows.where("duplicate").select(F.lit("duplicate_edge").alias("gate"))
        return self.rows.select("gate").unionByName(self.edges.select("gate")).unionByName(repeated).where("gate is not null").groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def admitted(rows: DataFrame, known: DataFrame, per_chunk: int = CHUNK_EDGES, per_document: int = DOCUMENT_EDGES, floor: float = DISCARD, max_depth: int = MAX_PATH) -> Batch:
    """A batch of rows as ``extraction.gated`` takes them, with source_id, target_id and seq (the place in the chunk's answer), judged against ``known`` edges (source_id, target_id, relation, verified).

    A chunk's answer is cut before any other gate, so refused rows use it up. A
    repeated edge is no refusal: its evidence joins the first one's. Edges are then
    taken in order: those of a contradictory batch go, a document writes at most
    ``per_document``, cycles go, a verified edge is left as it is, and weak ones go.
    Only written edges use up a document's share and stand in the way of later
    ones. Agreement is with ``known`` as it was before the batch.
    """
    spread = F.when(F.col("chunk_id").isNull(), F.xxhash64("document_id", "seq", "source_name", "target_name"))
    place = F.row_number().over(Window.partitionBy("chunk_id", spread).orderBy("seq"))
    late = F.col("chunk_id").isNotNull() & (F.col("_n") > per_chunk) & ~F.col("gate").eqNullSafe("document_scope")
    rows = gated(rows.withColumn("_n", place)).withColumn("gate", F.when(late, "chunk_edge_cap").otherwise(F.col("gate"))).drop("_n")
    rows = written(rows.withColumn("_order", F.struct("document_id", "chunk_id", "seq")), "gated")
    passed = rows.where("gate is null")
    first = written(passed.groupBy(*EDGE).agg(F.min("_order").alias("first")), "first-rows")  # so that Spark can split the join of a hot edge
    marked = rows.join(first, EDGE, "left").withColumn("duplicate", F.col("gate").isNull() & (F.col("_order") != F.col("first"))).drop("_order", "first")

    circling = contradictory(first.where("relation = 'requires'")).select("source_id", "target_id", F.lit("requires").alias("relation"), F.lit(True).alias("circling"))
    settled = known.where("verified").select(*EDGE, F.lit(True).alias("settled")).distinct()
    edges = scored(evidence(passed), known).join(first, EDGE).join(circling, EDGE, "left").join(settled, EDGE, "left")
    edges = edges.withColumns({"circling": F.coalesce("circling", F.lit(False)), "settled": F.coalesce("settled", F.lit(False))})
    edges = edges.withColumn("enters", ~F.col("settled") & (F.col("confidence") >= floor))
    edges = written(edges.select("*", *(F.col(f"first.{c}").alias(o) for c, o in zip(("document_id", "chunk_id", "seq"), ORDER, strict=True))).drop("first"), "batch-edges")
    return Batch(marked, _in_order(edges, known, per_document, max_depth))


def _in_order(edges: DataFrame, known: DataFrame, per_document: int, max_depth: int) -> DataFrame:
    """Adds gate. What is beyond a document's share depends on what was refused as a cycle before it, and the other way round.

    Both are worked out in turn until they agree. Each round is right for a longer
    stretch of the order, and without a document beyond its share there is one round.
    """
    open_ = edges.where("not circling")
    share = Window.partitionBy(ORDER[0]).orderBy(*ORDER[1:]).rowsBetween(Window.unboundedPreceding, -1)
    over, seen, parts = None, None, cycle_parts(open_, known)
    while True:
        inside = open_ if over is None else open_.join(over, EDGE, "left_anti")
        judged = written(cycle_gate(inside.select(*EDGE, "enters", *ORDER), known, ORDER, max_depth, parts).select(*EDGE, "cycle"), "judged")
        state = open_.join(judged, EDGE, "left").withColumn("written", F.col("enters") & F.coalesce(~F.col("cycle"), F.lit(False)))
        before = F.coalesce(F.sum(F.col("written").cast("long")).over(share), F.lit(0))
        over = written(state.withColumn("before", before).where(F.col("before") >= per_document).select(*EDGE, F.lit(True).alias("over")), "over-share")
        now = tuple(over.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*EDGE).cast("decimal(38,0)"))).first())
        if now == seen or seen is None and not now[0]:
            break
        seen, over = now, over.select(*EDGE)
    marks = edges.join(judged.where("cycle"), EDGE, "left").join(over, EDGE, "left")
    gate = F.when(F.col("circling"), "contradictory_cycle").when(F.col("over"), "document_edge_cap").when(F.col("cycle"), "cycle").when(F.col("settled"), "verified_conflict").when(~F.col("enters"), "confidence_floor")
    return marks.withColumn("gate", gate).drop("circling", "settled", "enters", "cycle", "over", *ORDER)


# ---- aliases -----------------------------------------------------------------------


def assigned_aliases(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` (tenant_id, course_id, concept_id, alias, seq: no two alike in an alias) with alias_norm, owner, gate and new.

    An alias, written as a slug, belongs to the concept that ``stored``
    (tenant_id, course_id, alias_norm, concept_id) has it for in the same tenant and
    course, else to that of its first row. Rows of other concepts are refused
    (``alias_collision``), rows without a slug too (``empty_name``). ``new`` marks
    the one row that goes into the table. A course may be null, which is one of its own.
    """
    key = ["tenant_id", "course_id", "alias_norm"]
    slug = slugify(F.col("alias"))
    rows = written(rows.withColumn("alias_norm", F.when(is_slug(slug), slug)), "aliases")
    claims = rows.where("alias_norm is not null").groupBy(*key).agg(F.min(F.struct("seq", "concept_id")).alias("first"))
    kept = stored.select(*(F.col(c).alias(f"_{c}") for c in key), F.col("concept_id").alias("_owner"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    owners = claims.join(kept, same("tenant_id", "_tenant_id") & same("course_id", "_course_id") & (F.col("alias_norm") == F.col("_alias_norm")), "left")
    owners = owners.select(*(F.col(c).alias(f"_{c}") for c in key), F.coalesce("_owner", "first.concept_id").alias("owner"), F.when(F.col("_owner").isNull(), F.col("first.seq")).alias("_seq"))
    owners = written(owners, "alias-owners")  # so that Spark can split the join of a hot alias
    found = rows.join(owners, same("tenant_id", "_tenant_id") & same("course_id", "_course_id") & (F.col("alias_norm") == F.col("_alias_norm")), "left")
    gate = F.when(F.col("alias_norm").isNull(), "empty_name").when(F.col("concept_id") != F.col("owner"), "alias_collision")
    return found.withColumn("gate", gate).withColumn("new", F.coalesce(F.col("seq") == F.col("_seq"), F.lit(False))).drop("_tenant_id", "_course_id", "_alias_norm", "_seq")


def alias_table(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``stored`` after the batch: tenant_id, course_id, alias_norm, concept_id."""
    columns = ["tenant_id", "course_id", "alias_norm", "concept_id"]
    return stored.select(columns).unionByName(assigned_aliases(rows, stored).where("new").select(columns))
