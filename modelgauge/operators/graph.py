"""The dependency graph: edges, closure, cycles, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modelgauge.functions import exprs as X
from modelgauge.plans.materialize import materialized


def edges(models: DataFrame, refs: DataFrame) -> DataFrame:
    """(parent, child): references (node_id, ref) resolved by name to the first model of that name; others are ignored."""
    named = models.groupBy("name").agg(F.min("node_id").alias("parent"))
    return refs.join(named, refs["ref"] == named["name"]).select("parent", F.col("node_id").alias("child")).distinct()


def fan_in(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("child").alias("node_id")).agg(F.countDistinct("parent").alias("n"))


def fan_out(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("parent").alias("node_id")).agg(F.countDistinct("child").alias("n"))


def leaves(nodes: DataFrame, e: DataFrame) -> DataFrame:
    return nodes.join(e.select(F.col("parent").alias("node_id")), "node_id", "left_anti")


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """(ancestor, descendant) of the paths of left followed by those of right; merged, as a broadcast would go through the driver."""
    right = right.select(F.col("ancestor").alias("_m"), F.col("descendant").alias("_d")).hint("merge")
    return left.join(right, F.col("descendant") == F.col("_m")).select("ancestor", F.col("_d").alias("descendant"))


def _without(pairs: DataFrame, known: DataFrame) -> DataFrame:
    return pairs.join(known.hint("merge"), ["ancestor", "descendant"], "left_anti")


def closure(e: DataFrame, rounds: int = 64) -> DataFrame:
    """(ancestor, descendant) by doubling: as many rounds as the logarithm of the longest shortest path.

    Before round i `known` has the pairs at a distance under 2^i and `far` those at 2^i exactly. A shortest path is made of shortest
    paths, so known, far and known followed by far are all pairs under 2^(i+1), and far followed by far, without these, are those
    at it; with none of them there is nothing beyond. Each pair is written once: `known` is a union of the rounds' parts.
    """
    known, far = None, materialized(e.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct())
    for _ in range(rounds):
        if far.isEmpty():
            return far if known is None else known
        if known is None:
            known = far
        else:
            both = known.union(far)
            known = both.union(materialized(_without(_joined(known, far).distinct(), both)))
        far = materialized(_without(_joined(far, far).distinct(), known))
    raise RuntimeError("the closure did not end")


def trimmed(e: DataFrame, gain: float = 0.1) -> DataFrame:
    """Edges (parent, child), of which those that can't be on a cycle are mostly gone: as an end has no edge that enters or leaves.

    Goes on while a round drops at least this share; all edges on cycles, and between them, stay.
    """
    e = materialized(e.select("parent", "child").distinct())
    n = e.count()
    while n:
        enter = e.select(F.col("child").alias("parent")).distinct()
        leave = e.select(F.col("parent").alias("child")).distinct()
        e = materialized(e.join(leave.hint("merge"), "child", "left_semi").join(enter.hint("merge"), "parent", "left_semi").select("parent", "child"))
        before, n = n, e.count()
        if n > (1 - gain) * before:
            break
    return e


def cycles(reach: DataFrame) -> DataFrame:
    """(cycle_id, members): strongly connected components with a cycle; the id is the least member."""
    back = reach.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("ancestor"))
    mutual = reach.join(back.hint("merge"), ["ancestor", "descendant"])
    own = mutual.groupBy(F.col("ancestor").alias("node_id")).agg(F.min("descendant").alias("cycle_id"))
    return own.groupBy("cycle_id").agg(F.array_sort(F.collect_set("node_id")).alias("members"))


def cycles_of(e: DataFrame) -> DataFrame:
    """The cycles of edges; only what trimming leaves is closed."""
    return cycles(closure(trimmed(e)))


LAYERS = (("source", ("sources/*", "*/sources/*")), ("staging", ("staging/*", "*/staging/*", "stg_*")), ("intermediate", ("intermediate/*", "*/intermediate/*", "int_*")), ("mart", ("marts/*", "*/marts/*", "fct_*", "dim_*")))
ALLOWED = (("source", "staging"), ("staging", "staging"), ("staging", "intermediate"), ("staging", "mart"), ("intermediate", "intermediate"), ("intermediate", "mart"), ("mart", "mart"))


def classify(models: DataFrame, layers=LAYERS) -> DataFrame:
    """Adds layer: the first layer any of whose globs matches the node's id, its name, its path or a right part of its path; null if none."""
    layer = F.lit(None).cast("string")
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    spots = F.concat(F.array("node_id", "name"), tails)
    for name, globs in reversed(layers):
        layer = F.when(F.exists(spots, lambda s: X.matches_any(s, list(globs))), name).otherwise(layer)
    return models.withColumn("layer", layer)


def layer_violations(e: DataFrame, classified: DataFrame, allowed=ALLOWED) -> DataFrame:
    """(parent, child, parent_layer, child_layer) of edges that aren't allowed; an unclassified end allows anything."""
    lay = classified.select("node_id", "layer").where("layer is not null")
    j = e.join(lay.select(F.col("node_id").alias("parent"), F.col("layer").alias("parent_layer")), "parent").join(lay.select(F.col("node_id").alias("child"), F.col("layer").alias("child_layer")), "child")
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("parent_layer") == a) & (F.col("child_layer") == b))
    return j.where(~ok).select("parent", "child", "parent_layer", "child_layer")


def closure_sql(spark: SparkSession, e: DataFrame, depth: int = 100) -> DataFrame:
    """The same closure as a recursive query, for acyclic graphs of bounded depth."""
    e.createOrReplaceTempView("_edges")
    return spark.sql(f"with recursive r(ancestor, descendant, d) as (select parent, child, 1 from _edges union all select r.ancestor, e.child, d + 1 from r join _edges e on r.descendant = e.parent where d < {depth}) select distinct ancestor, descendant from r")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
