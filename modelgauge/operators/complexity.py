"""Cyclomatic complexity of models: 1 + what their SQL and their template branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.functions import exprs as X

PARTS = {"case_arms": "case", "join_count": "join", "boolean_ops": "bool", "set_op_arms": "set", "subqueries": "subquery", "iff_count": "iff"}


def complexity(models: DataFrame, facts: DataFrame) -> DataFrame:
    """models(node_id, content, parse_ok, uncertain) to (node_id, cc, its parts, parse_ok, uncertain)."""
    per = facts.groupBy("node_id").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(p) for p, k in PARTS.items()))
    ifs, fors = X.jinja_branches(F.col("content"))
    j = models.select("node_id", "parse_ok", "uncertain", ifs.alias("jinja_ifs"), fors.alias("jinja_fors")).join(per, "node_id", "left").fillna(0, list(PARTS))
    parts = [*PARTS, "jinja_ifs", "jinja_fors"]
    return j.select("node_id", (1 + sum((F.col(p) for p in parts[1:]), F.col(parts[0]))).cast("int").alias("cc"), *parts, "parse_ok", (F.col("uncertain") | ~F.col("parse_ok")).alias("uncertain"))
