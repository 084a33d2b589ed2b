"""Scores of models: every penalty is bounded, rounded half to even, and taken from 100."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORING = {"column": 25, "meaningful": 25, "unit_cc": 10, "doc": 15, "t1_each": 10, "t1_cap": 40, "t2_each": 3, "t2_cap": 20, "unexec_each": 5, "unexec_cap": 15, "parse_fail": 10, "parse_uncertain": 5, "skip_cap": 5}
PENALTIES = ("column_test", "meaningful_column", "unit_cc", "doc", "tier1", "tier2", "unexec", "parse", "skips")


def rule_counts(waived: DataFrame) -> DataFrame:
    """(node_id, tier1_rules, tier2_rules, waived): distinct rules, sorted; what is suppressed counts as waived only."""
    live = ~F.col("suppressed")
    return waived.where("node_id is not null").groupBy("node_id").agg(
        F.array_sort(F.collect_set(F.when(live & (F.col("tier") == 1), F.col("rule_id")))).alias("tier1_rules"),
        F.array_sort(F.collect_set(F.when(live & (F.col("tier") != 1), F.col("rule_id")))).alias("tier2_rules"),
        F.count_if(F.col("suppressed")).alias("waived"),
    )


def test_counts(results: DataFrame) -> DataFrame:
    return results.where("model is not null").groupBy(F.col("model").alias("node_id")).agg(
        F.count_if(F.col("kind") == "DATA").alias("data_tests"), F.count_if(F.col("kind") == "UNIT").alias("unit_tests"), F.count_if(~F.col("executed")).alias("unexecuted")
    )


def skip_counts(skips: DataFrame) -> DataFrame:
    return skips.where("node_id is not null").groupBy("node_id").agg(F.count(F.lit(1)).alias("skips"))


def node_ratios(facts: DataFrame) -> DataFrame:
    """(node_id, covered and total of the four dimensions that score): one aggregation instead of four joins."""
    names = {"doc": "doc", "column_test": "col", "column_test_meaningful": "mean", "test_unit_weighted_cc": "unit"}
    aggs = []
    for d, short in names.items():
        on = F.col("dimension") == d
        aggs += [F.max(F.when(on, F.bround("covered", 0))).alias(f"{short}_c"), F.max(F.when(on, F.col("total"))).alias(f"{short}_t")]
    return facts.where(F.col("dimension").isin(*names)).groupBy("node_id").agg(*aggs)


def summaries(models: DataFrame, facts: DataFrame, waived: DataFrame, results: DataFrame, skips: DataFrame, cfg: dict | None = None) -> DataFrame:
    """One row a model: (node_id, name, score, penalties, ratios, counts)."""
    s = SCORING | (cfg or {})
    j = models.select("node_id", "name", "parse_ok", "uncertain")
    for side in (node_ratios(facts), rule_counts(waived), test_counts(results), skip_counts(skips)):
        j = j.join(side, "node_id", "left")

    def ratio(short: str, none: float):
        c, t = F.coalesce(f"{short}_c", F.lit(none)), F.coalesce(f"{short}_t", F.lit(1.0))
        return F.when(t > 0, c / t).otherwise(none)

    lost = lambda r, most: F.bround((1 - F.col(r)) * most, 0).cast("int")
    j = j.withColumns({"doc_ratio": ratio("doc", 0.0), "column_ratio": ratio("col", 1.0), "meaningful_ratio": ratio("mean", 1.0), "unit_cc_ratio": ratio("unit", 1.0)})
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = j.withColumns(
        {
            "p_column_test": lost("column_ratio", s["column"]),
            "p_meaningful_column": lost("meaningful_ratio", s["meaningful"]),
            "p_unit_cc": lost("unit_cc_ratio", s["unit_cc"]),
            "p_doc": F.greatest(F.lit(0), lost("doc_ratio", s["doc"])),
            "p_tier1": F.least(F.lit(s["t1_cap"]), s["t1_each"] * F.greatest(F.lit(0), zero(F.size("tier1_rules")))),
            "p_tier2": F.least(F.lit(s["t2_cap"]), s["t2_each"] * F.greatest(F.lit(0), zero(F.size("tier2_rules")))),
            "p_unexec": F.least(F.lit(s["unexec_cap"]), s["unexec_each"] * zero(F.col("unexecuted"))).cast("int"),
            "p_parse": F.when(~F.col("parse_ok"), s["parse_fail"]).when(F.col("uncertain"), s["parse_uncertain"]).otherwise(0),
            "p_skips": F.when(F.col("parse_ok") & ~F.col("uncertain"), F.least(F.lit(s["skip_cap"]), zero(F.col("skips")))).otherwise(0).cast("int"),
        }
    )
    total = sum((F.col(f"p_{p}") for p in PENALTIES[1:]), F.col(f"p_{PENALTIES[0]}"))
    out = j.withColumn("score", F.greatest(F.lit(0), 100 - total).cast("int"))
    ratios = [F.round(r, 4).alias(r) for r in ("doc_ratio", "column_ratio", "meaningful_ratio", "unit_cc_ratio")]
    counts = [zero(F.col(c)).cast("bigint").alias(c) for c in ("data_tests", "unit_tests", "unexecuted", "waived", "skips")]
    rules = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("tier1_rules", "tier2_rules")]
    return out.select("node_id", "name", "score", "parse_ok", "uncertain", *(F.col(f"p_{p}").cast("int").alias(f"p_{p}") for p in PENALTIES), *ratios, *counts, *rules)


def breakdown(summary: DataFrame) -> DataFrame:
    """(node_id, penalty, points), one row a penalty."""
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("penalty"), F.col(f"p_{p}").alias("points")) for p in PENALTIES))).alias("x")
    return summary.select("node_id", pairs).select("node_id", "x.penalty", "x.points")


def headline(waived: DataFrame, summary: DataFrame) -> DataFrame:
    f = waived.where("not suppressed").agg(
        F.count_if(F.col("severity").isin("CRITICAL", "BLOCKER")).alias("critical"), F.count_if(F.col("severity") == "MAJOR").alias("major"), F.count_if(F.col("severity").isin("MINOR", "INFO")).alias("minor")
    )
    m = summary.agg(F.count(F.lit(1)).alias("models"), F.count_if(F.col("score") < 70).alias("at_risk"), F.round(F.avg("score"), 2).alias("mean_score"), F.round(F.median("score"), 2).alias("median_score"))
    return f.crossJoin(F.broadcast(m))


def render_stats(models: DataFrame) -> DataFrame:
    return models.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("uncertain").alias("uncertain"), F.count_if("parse_ok").alias("parsed"), F.count_if(~F.col("parse_ok")).alias("parse_failed"),
        *(F.count_if(F.col("mode") == m).alias(m.lower()) for m in ("MOCK", "PARTIAL", "COMPILED")),
    )


def complexity_summary(complexity: DataFrame) -> DataFrame:
    return complexity.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cc"), 4).alias("mean_cc"), F.max("cc").alias("max_cc"), F.sum("cc").alias("sum_cc"))


def test_grid(results: DataFrame) -> DataFrame:
    """(status, data, unit): executed tests by status and kind, and a row of those that weren't."""
    return results.groupBy(F.when(F.col("executed"), F.col("status")).otherwise("NOT_EXECUTED").alias("status")).pivot("kind", ["DATA", "UNIT"]).agg(F.count(F.lit(1))).select("status", F.coalesce("DATA", F.lit(0)).alias("data"), F.coalesce("UNIT", F.lit(0)).alias("unit"))
