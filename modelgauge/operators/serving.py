"""Queries over stored scans: display order, pages, runs, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modelgauge.functions import exprs as X


def display_order(findings: DataFrame) -> list[Column]:
    return [F.col("tier"), X.severity_rank(F.col("severity")), F.col("path"), F.col("line"), F.col("rule_id")]


def top_per_tier(findings: DataFrame, n: int = 100, order: list[str] | None = None) -> DataFrame:
    """The first n findings of each tier, and how many more there are.

    Tiers are few: each is a sort with a limit, for which a task holds n rows, and only these rows are numbered.
    """
    by = [*display_order(findings), *(order or [])]
    sizes = findings.groupBy("tier").agg(F.count(F.lit(1)).alias("size")).collect()
    first = [findings.where(F.col("tier").eqNullSafe(F.lit(x["tier"]))).orderBy(*by).limit(n).withColumn("more", F.lit(max(0, x["size"] - n)).cast("bigint")) for x in sizes]
    top = reduce(DataFrame.union, first) if first else findings.limit(0).withColumn("more", F.lit(0).cast("bigint"))
    return top.select(*findings.columns, F.row_number().over(W.partitionBy("tier").orderBy(*by)).alias("position"), "more")


def page(findings: DataFrame, order: list[str], offset: int = 0, limit: int = 500, **equal: str) -> DataFrame:
    for k, v in equal.items():
        findings = findings.where(F.col(k) == v)
    return findings.orderBy(*order).offset(offset).limit(limit)


def models_list(summary: DataFrame, max_score: int | None = None, sort: str = "score") -> DataFrame:
    if max_score is not None:
        summary = summary.where(F.col("score") <= max_score)
    return summary.orderBy(*{"score": ["score", "name", "node_id"], "name": ["name", "node_id"], "tier": [F.size("tier1_rules").desc(), F.size("tier2_rules").desc(), "name"]}[sort])


def latest_runs(runs: DataFrame, project: Column | None = None, limit: int = 50) -> DataFrame:
    if project is not None:
        runs = runs.where(F.col("project") == project)
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def last_run(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """Projects with their last successful run, if any."""
    last = runs.where("status = 'success'").groupBy("project").agg(F.max(F.struct("started_at", "run_id", "score")).alias("b"))
    return projects.join(last, "project", "left").select("project", "name", F.col("b.run_id").alias("run_id"), F.col("b.score").alias("score"))


def trend(runs: DataFrame, limit: int = 200) -> DataFrame:
    """Each project's successes among its last runs, in order of time: the limit comes before the filter."""
    w = W.partitionBy("project").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).where("status = 'success'").drop("_n").orderBy("project", "started_at", "run_id")


def model_coverage(summary: DataFrame, per_node: DataFrame) -> DataFrame:
    """(node_id, score, dimensions): a full outer join; models without a summary sort as 999."""
    dims = per_node.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", F.struct("covered", "total"))))).alias("dimensions"))
    return summary.select("node_id", "score").join(dims, "node_id", "full_outer").orderBy(F.coalesce("score", F.lit(999)), "node_id")


def upsert_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest record of each run_id; new ones win."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("run_id", "_v")]
    return both.groupBy("run_id").agg(F.max_by(F.struct(*cols), "_v").alias("b")).select("run_id", "b.*")
