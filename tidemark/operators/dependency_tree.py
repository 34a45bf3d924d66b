"""Chow-Liu dependency trees over discrete fields, fitted and queried as DataFrames.

Fit: counts of all field pairs in one pass (combined before the shuffle), mutual information of each pair, and the maximum
spanning tree of the fields; only one number per pair reaches the driver. Query: rows with a missing field are reduced to
their distinct evidence, messages pass along the tree towards the missing field, and the posterior's mode comes back.
Candidates of a missing field are the values its most informative neighbour has been seen with, so nothing is expanded to
all values; the other neighbours only score them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Probability of evidence never seen beside a candidate.
UNSEEN = 1e-4
#: Pairs whose information differs by less (in nats) count as tied; then the pair with fewer distinct cells wins.
TIE = 2e-3


#: Count tables of at most that many rows are broadcast where they are joined.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Tree:
    """fields in order; edges (i, j, information); counts: i, j, x, y, n, n_x (how often x occurs on the edge), both directions."""

    fields: tuple[str, ...]
    edges: tuple[tuple[int, int, float], ...]
    counts: DataFrame
    compact: bool

    def neighbours(self, i: int) -> list[int]:
        """Fields beside field i, most informative first."""
        found = [(w, b if a == i else a) for a, b, w in self.edges if i in (a, b)]
        return [n for _, n in sorted(found, key=lambda p: (-p[0], p[1]))]

    def edge(self, i: int, j: int) -> DataFrame:
        """x of field i, y of field j, n and n_x; broadcast if all counts together have proved to be few."""
        rows = self.counts.where((F.col("i") == i) & (F.col("j") == j)).select("x", "y", "n", "n_x")
        return F.broadcast(rows) if self.compact else rows


def fit_tree(rows: DataFrame, fields: tuple[str, ...]) -> Tree:
    """Fit the tree on string fields; NULL is missing and counts for no pair. Without any rows the tree has no counts."""
    entries = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(fields[i]).alias("x"), F.col(fields[j]).alias("y")) for i, j in combinations(range(len(fields)), 2)]
    pairs = cut_lineage(
        rows.select(F.explode(F.array(*entries)).alias("p")).select("p.*").where("x is not null and y is not null").groupBy("i", "j", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    )
    # Joint and marginal counts side by side, so that all entropies come from one pass over the pairs.
    nothing = F.lit(None).cast("string")
    sides = [F.struct(F.lit(side).alias("side"), x.alias("a"), y.alias("b")) for side, x, y in (("xy", F.col("x"), F.col("y")), ("x", F.col("x"), nothing), ("y", nothing, F.col("y")))]
    cells = pairs.select("i", "j", "n", F.explode(F.array(*sides)).alias("s")).groupBy("i", "j", "s.side", "s.a", "s.b").agg(F.sum("n").alias("n"))
    sums = cells.groupBy("i", "j", "side").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("s"), F.count(F.lit(1)).alias("cells"))
    of = {(r.i, r.j, r.side): r for r in sums.collect()}  # three rows per pair of fields
    weighed = []
    for i, j in combinations(range(len(fields)), 2):
        if (i, j, "xy") in of:
            xy, x, y = (of[i, j, side] for side in ("xy", "x", "y"))
            information = math.log(xy.total) - (x.s + y.s - xy.s) / xy.total
            bias = (xy.cells - x.cells - y.cells + 1) / (2 * xy.total)  # Miller and Madow: many cells look informative by chance
            weighed.append((information - bias, xy.cells, i, j))
    weighed.sort(key=lambda p: (-round(p[0] / TIE), p[1], p[2], p[3]))
    root = list(range(len(fields)))

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    edges = []
    for w, _, i, j in weighed:
        if find(i) != find(j):
            root[find(i)] = find(j)
            edges.append((i, j, w))
    kept = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j, _ in edges]
    one_way = pairs.where(F.struct("i", "j").isin(*kept)) if kept else pairs.limit(0)
    two_way = one_way.unionByName(one_way.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    of_x = two_way.groupBy("i", "j", "x").agg(F.sum("n").alias("n_x"))
    counts = cut_lineage(two_way.join(of_x, ["i", "j", "x"]))
    return Tree(tuple(fields), tuple(edges), counts, counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS)


def posterior_modes(tree: Tree, rows: DataFrame, target: str) -> DataFrame:
    """For each distinct evidence of the rows whose target is NULL: the other fields, mode, confidence.

    mode is NULL only if the target was never seen. Ties go to the greater value. confidence is the mode's posterior share.
    """
    at = tree.fields.index(target)
    others = [f for f in tree.fields if f != target]
    evidence = cut_lineage(rows.where(F.col(target).isNull()).select(*others).distinct().withColumn("case_id", F.monotonically_increasing_id()).withColumn(target, F.lit(None).cast("string")))
    missing = evidence.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in tree.fields]).first().asDict()
    scored = _belief(tree, evidence, at, None, missing)
    usual = tree.counts.where(F.col("i") == at).groupBy("x").agg(F.sum("n").alias("n")).agg(F.max_by("x", F.struct("n", "x")).alias("usual"))
    if scored is None:
        best = evidence.select("case_id").limit(0).withColumn("best", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        best = (
            scored.groupBy("case_id").agg(F.max_by(F.struct("x", "score"), F.struct("score", "x")).alias("top"), F.max("score").alias("high"), F.collect_list("score").alias("scores"))
            .select("case_id", F.col("top.x").alias("best"), (1 / F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("high")))).alias("confidence"))
        )
    return evidence.join(best, "case_id", "left").crossJoin(F.broadcast(usual)).select(*others, F.coalesce("best", "usual").alias("mode"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def _belief(tree: Tree, cases: DataFrame, node: int, parent: int | None, missing: dict[str, int]) -> DataFrame | None:
    """case_id, x, score (log): what the tree beyond node, seen from parent, says about the missing node's value.

    A case keeps its fields beside it, so a neighbour that is known says its part by one join with its edge.
    """
    children = [c for c in tree.neighbours(node) if c != parent]
    if not children:
        return None
    edges = {c: tree.edge(node, c) for c in children}
    hidden: dict[int, DataFrame] = {}
    for c in children:
        if missing[tree.fields[c]]:
            deeper = _belief(tree, cases.where(F.col(tree.fields[c]).isNull()), c, node, missing)
            if deeper is not None:
                hidden[c] = cut_lineage(deeper)
    candidates = None
    for c in children:
        offer = cases.select("case_id", F.col(tree.fields[c]).alias("y")).join(edges[c].select("x", "y"), "y").select("case_id", "x")
        if c in hidden:
            offer = offer.unionByName(hidden[c].select("case_id", F.col("x").alias("y")).join(edges[c].select("x", "y"), "y").select("case_id", "x"))
        if candidates is None:
            candidates = offer
        else:
            candidates = candidates.unionByName(offer.join(candidates.select("case_id").distinct(), "case_id", "left_anti"))
    prior = edges[children[0]].groupBy("x").agg(F.first("n_x").alias("seen"))
    scored = candidates.distinct().join(F.broadcast(prior) if tree.compact else prior, "x", "left").join(cases, "case_id")
    score = F.log(F.coalesce("seen", F.lit(1)).cast("double"))
    for c in children:
        says = edges[c].select(F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}"), (F.col("n") / F.col("n_x")).alias(f"m{c}"))
        scored = scored.join(says, (F.col("x") == F.col(f"x{c}")) & (F.col(tree.fields[c]) == F.col(f"y{c}")), "left").drop(f"x{c}", f"y{c}")
        speaks = F.col(tree.fields[c]).isNotNull()
        if c in hidden:
            weighted = hidden[c].select("case_id", F.col("x").alias("y"), "score")
            high = weighted.groupBy("case_id").agg(F.max("score").alias("high"))
            indirect = weighted.join(high, "case_id").join(edges[c], "y").groupBy("case_id", "x").agg(F.sum(F.exp(F.col("score") - F.col("high")) * F.col("n") / F.col("n_x")).alias(f"h{c}"))
            scored = scored.join(indirect, ["case_id", "x"], "left").join(high.select("case_id", F.lit(True).alias(f"spoke{c}")), "case_id", "left")
            scored = scored.withColumn(f"m{c}", F.coalesce(f"m{c}", f"h{c}"))
            speaks |= F.coalesce(f"spoke{c}", F.lit(False))
        score += F.when(speaks, F.log(F.greatest(F.coalesce(f"m{c}", F.lit(UNSEEN)), F.lit(UNSEEN)))).otherwise(0.0)
    return scored.select("case_id", "x", score.alias("score"))
