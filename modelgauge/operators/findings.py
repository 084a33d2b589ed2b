"""The algebra of findings: thresholds, dedup, merge, skips, waivers, baseline, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgauge.functions import exprs as X


def postprocess(findings: DataFrame, settings: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Drops what is under the greater of the rule's and the common confidence, and applies severity and tier overrides.

    settings(rule_id, confidence_min, severity, tier, default_severity, default_tier): an override counts only if it differs from the default.
    """
    j = findings.join(F.broadcast(settings.select("rule_id", "confidence_min", F.col("severity").alias("_s"), F.col("tier").alias("_t"), "default_severity", "default_tier")), "rule_id", "left")
    kept = j.where(F.col("confidence") >= F.greatest(F.coalesce("confidence_min", F.lit(0.0)), F.lit(threshold)))
    sev = F.when(F.col("_s").isNotNull() & (F.col("_s") != F.col("default_severity")), F.col("_s")).otherwise(F.col("severity"))
    tier = F.when(F.col("_t").isNotNull() & (F.col("_t") != F.col("default_tier")), F.col("_t")).otherwise(F.col("tier"))
    return kept.withColumn("severity", sev).withColumn("tier", tier).select(findings.columns)


def dedup(findings: DataFrame, order: list[str]) -> DataFrame:
    """The first finding of each fingerprint; an aggregate, so duplicates are combined before the shuffle."""
    rest = [c for c in findings.columns if c not in order and c != "fingerprint"]
    g = findings.groupBy("fingerprint").agg(F.min(F.struct(*order, F.struct(*rest).alias("r"))).alias("b"))
    return g.select("fingerprint", *(F.col(f"b.{c}").alias(c) for c in order), *(F.col(f"b.r.{c}").alias(c) for c in rest)).select(findings.columns)


def merge(batches: DataFrame, order: list[str]) -> DataFrame:
    """Equal fingerprints of several batches become one: the first record, the origins of all in order."""
    rest = [c for c in batches.columns if c not in (*order, "fingerprint", "origins")]
    g = batches.groupBy("fingerprint").agg(
        F.min(F.struct(*order, F.struct(*rest).alias("r"))).alias("b"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, "origins"))), lambda x: x["origins"]))).alias("origins"),
    )
    return g.select("fingerprint", *(F.col(f"b.{c}").alias(c) for c in order), *(F.col(f"b.r.{c}").alias(c) for c in rest), "origins").select(batches.columns)


def stamp_origin(findings: DataFrame, name: str) -> DataFrame:
    return findings.withColumn("origins", F.array_union(F.array(F.lit(name)), "origins"))


def gate_checks(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule_id, node_id, reason): why a rule doesn't run, null if it does; the first reason that holds.

    rules(rule_id, enabled, is_node_rule, required_mode, required_adapter, mode, adapter_state); nodes(node_id, uncertain, parse_ok).
    Project rules, and reasons that concern a rule as a whole, have no node.
    """
    whole = (
        F.when(~F.col("enabled"), "DISABLED")
        .when(F.col("required_mode").isNotNull() & (F.col("required_mode") != F.col("mode")), "MODE_REQUIRED")
        .when(F.col("required_adapter").isNotNull() & F.col("adapter_state").isNull(), "ADAPTER_MISSING")
        .when(F.col("required_adapter").isNotNull() & (F.col("adapter_state") != "ok"), "ADAPTER_FAILED")
    )
    r = rules.withColumn("w", whole)
    at_once = r.where("w is not null or not is_node_rule").select("rule_id", F.lit(None).cast("string").alias("node_id"), F.col("w").alias("reason"))
    each = nodes.crossJoin(F.broadcast(r.where("w is null and is_node_rule").select("rule_id", "requires_ast")))
    reason = F.when(F.col("uncertain"), "RENDER_UNCERTAIN").when(F.col("requires_ast") & ~F.col("parse_ok"), "PARSE_FAILED")
    return at_once.unionByName(each.select("rule_id", "node_id", reason.alias("reason")))


def skip_summary(skips: DataFrame) -> DataFrame:
    """(reason, rule_id, n, nodes) by reason, by rule and in total (null where summed up)."""
    return skips.groupingSets([["reason"], ["rule_id"], []], "reason", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("nodes"))


def effective_share(skips: DataFrame, attempted: int) -> DataFrame:
    n = F.count(F.lit(1))
    pct = F.lit(100.0) if attempted == 0 else F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) * (1 - n / F.lit(float(attempted)))))
    return skips.agg(n.alias("total"), F.bround(pct, 2).alias("effective_pct"))


def aggregated_skips(skips: DataFrame) -> DataFrame:
    """(rule_id, reason, n, nodes, details): nodes sorted, details the least non-null."""
    return skips.groupBy("rule_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("node_id")).alias("nodes"), F.min("details").alias("details"))


def _selects(e: dict) -> Column:
    name = F.substring_index("node_id", ".", -1)
    by = F.lit(False)
    if e.get("node_ids"):
        by = by | F.coalesce(F.col("node_id").isin(*e["node_ids"]), F.lit(False))
    if e.get("paths"):
        by = by | X.matches_any(F.col("path"), e["paths"])
    if e.get("models"):
        by = by | X.matches_any(name, e["models"])
    return by & X.matches_any(F.col("rule_id"), e["waive"])


def entry_key(e: dict) -> str:
    """An override's name: its id, else its selectors and rules, so that it doesn't depend on its place in the list."""
    if e.get("id"):
        return str(e["id"])
    parts = [f"{k}={'|'.join(sorted(map(str, e[k])))}" for k in ("models", "paths", "node_ids", "waive") if e.get(k)]
    return ";".join(parts)


def apply_waivers(findings: DataFrame, overrides: list[dict], baseline: DataFrame | None, today: str) -> DataFrame:
    """Adds suppressed, source, entry_id and expired: the first entry that matches decides, and one that has expired hides the baseline.

    Entries are configuration, so the theta join is folded into one CASE and no rows are multiplied.
    """
    pick = F.lit(None).cast("int")
    for i in reversed(range(len(overrides))):
        pick = F.when(_selects(overrides[i]), i).otherwise(pick)
    out = findings.withColumn("_e", pick)
    expired = F.lit(False)
    entry = F.lit(None).cast("string")
    for i, e in enumerate(overrides):
        if e.get("expires") and str(e["expires"]) < today:
            expired = F.when(F.col("_e") == i, True).otherwise(expired)
        entry = F.when(F.col("_e") == i, entry_key(e)).otherwise(entry)
    out = out.withColumn("entry_id", entry).withColumn("expired", expired)
    if baseline is not None:
        out = out.join(baseline.select("fingerprint").distinct().withColumn("_b", F.lit(True)), "fingerprint", "left")
    else:
        out = out.withColumn("_b", F.lit(None).cast("boolean"))
    source = F.when(F.col("_e").isNotNull(), F.when(~F.col("expired"), "override")).when(F.coalesce("_b", F.lit(False)), "baseline")
    return out.withColumn("source", source).withColumn("suppressed", F.col("source").isNotNull()).withColumn("is_new", ~F.coalesce("_b", F.lit(False))).drop("_e", "_b")


def expired_waivers(waived: DataFrame) -> DataFrame:
    """(entry_id, n): one row for each expired entry that matched any finding."""
    return waived.where("expired").groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))


def capture_baseline(waived: DataFrame) -> DataFrame:
    return waived.where("not suppressed").select("fingerprint", "rule_id", "node_id", "path").distinct()


def diff_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fingerprint, change): added ones and removed ones, by one full outer join."""
    a = current.select("fingerprint").distinct().withColumn("a", F.lit(1))
    b = baseline.select("fingerprint").distinct().withColumn("b", F.lit(1))
    return a.join(b, "fingerprint", "full_outer").where("a is null or b is null").select("fingerprint", F.when(F.col("b").isNull(), "added").otherwise("removed").alias("change"))


def gate_findings(waived: DataFrame, tier: int = 1, new_only: bool = False) -> DataFrame:
    live = waived.where(F.col("tier") <= tier)
    if new_only:
        live = live.where("is_new")
    return live.agg(F.coalesce(F.sum((~F.col("suppressed")).cast("int")), F.lit(0)).alias("failing"), F.coalesce(F.sum(F.col("suppressed").cast("int")), F.lit(0)).alias("suppressed"))


def gate_coverage(rollup: DataFrame, minimums: dict[str, float]) -> DataFrame:
    floor = F.lit(None).cast("double")
    for k, v in minimums.items():
        floor = F.when(F.col("dimension") == k, float(v)).otherwise(floor)
    return rollup.withColumn("minimum", floor).where("ratio < minimum").select("dimension", "ratio", "minimum")


def gate_unexecuted(results: DataFrame, waived: DataFrame) -> DataFrame:
    """Unexecuted tests but those of models with a suppressed T001 finding; a null model equals a null node."""
    excused = waived.where("suppressed and rule_id = 'T001'").select(F.col("node_id").alias("_n")).distinct()
    return results.where("not executed").join(excused, results["model"].eqNullSafe(F.col("_n")), "left_anti")


def gate_skips(skips: DataFrame, maximums: dict[str, int]) -> DataFrame:
    """(reason, n, maximum) of each reason, or TOTAL, over its maximum."""
    by = skips.groupingSets([["reason"], []], "reason").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("reason", F.lit("TOTAL")).alias("reason"), "n")
    most = F.lit(None).cast("int")
    for k, v in maximums.items():
        most = F.when(F.col("reason") == k, int(v)).otherwise(most)
    return by.withColumn("maximum", most).where("n > maximum")
