"""Where scans go: Parquet tables, JSON, SARIF, a console report, a run log."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.operators import serving as K

TABLES = ("findings", "coverage", "coverage_facts", "summaries", "skips", "complexity", "results", "edges")
LEVEL = {"BLOCKER": "error", "CRITICAL": "error", "MAJOR": "warning", "MINOR": "note", "INFO": "note"}


def write_tables(scan, folder: str) -> None:
    """The native sink: a table a relation."""
    for t in TABLES:
        scan.frames[t].write.mode("overwrite").parquet(f"{folder}/{t}")


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row, made by the executors."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(scan, file: str, skip_detail: str = "aggregated") -> None:
    """One document; a project's findings are of a size to be held by one machine."""
    from modelgauge.operators.findings import aggregated_skips

    doc = {"schema_version": 1}
    for t in ("findings", "coverage", "summaries", "complexity", "skips", "results"):
        df = aggregated_skips(scan.frames[t]) if t == "skips" and skip_detail == "aggregated" else scan.frames[t]
        doc[t] = [json.loads(r["value"]) for r in json_rows(df).toLocalIterator()]
    Path(file).write_text(json.dumps(doc, indent=1))


def write_coverage(scan, file: str) -> None:
    """The coverage alone: each dimension, and its facts by model."""
    doc = {"schema_version": 1, **{t: [json.loads(r["value"]) for r in json_rows(scan.frames[t]).toLocalIterator()] for t in ("coverage", "coverage_facts")}}
    Path(file).write_text(json.dumps(doc, indent=1))


class StoredScanError(ValueError):
    """A stored scan can't be read."""


STORED = {
    "findings": "rule_id string, severity string, tier int, confidence double, message string, path string, line int, node_id string, context string, fingerprint string, suppressed boolean, is_new boolean, source string, entry_id string, expired boolean",
    "coverage": "dimension string, covered bigint, total bigint, ratio double",
    "summaries": "node_id string, name string, score int, tier1_rules array<string>, tier2_rules array<string>",
    "skips": "rule_id string, reason string, node_id string, n bigint",
    "results": "model string, test_name string, executed boolean",
}


def read_json(spark, file: str, cfg: dict | None = None):
    """A scan that `write_json` stored, for gates and lists of models; aggregated skips become as many rows as they count."""
    from modelgauge.config import load_config
    from modelgauge.engine import Scan

    try:
        doc = json.loads(Path(file).read_text("utf-8"))
        if not isinstance(doc, dict) or doc.get("schema_version") != 1 or not all(isinstance(doc.get(t), list) for t in STORED):
            raise ValueError("no stored scan")
    except (OSError, ValueError) as e:
        raise StoredScanError(f"{file}: {e}") from e
    one = spark.createDataFrame([(json.dumps({t: doc[t] for t in STORED}),)], "value string")
    shape = ", ".join(f"{t} array<struct<{', '.join(c.replace(' ', ': ', 1) for c in cols.split(', '))}>>" for t, cols in STORED.items())
    parsed = one.select(F.from_json("value", shape).alias("v"))
    frames = {t: parsed.select(F.explode(f"v.{t}").alias("r")).select("r.*") for t in STORED}
    frames["skips"] = frames["skips"].withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(1).cast("bigint"))))).select("rule_id", "node_id", "reason")
    return Scan(cfg or load_config(), frames)


def write_baseline(scan, file: str) -> int:
    """The unsuppressed findings as a baseline file; gives how many."""
    from modelgauge.operators.findings import capture_baseline

    entries = [r.asDict() for r in capture_baseline(scan.findings).orderBy("fingerprint").toLocalIterator()]
    Path(file).parent.mkdir(parents=True, exist_ok=True)
    Path(file).write_text(json.dumps({"version": 1, "entries": entries}, indent=1))
    return len(entries)


def sarif(findings: DataFrame, skips: DataFrame | None = None) -> dict:
    """A SARIF document; skips, if given, become notifications, one a rule and reason."""
    from modelgauge.operators.tree_rules import RULES

    rows = list(findings.orderBy(*K.display_order(findings)).toLocalIterator())
    ids = sorted({r["rule_id"] for r in rows})
    results = []
    for r in rows:
        one = {
            "ruleId": r["rule_id"], "ruleIndex": ids.index(r["rule_id"]), "level": LEVEL[r["severity"]], "message": {"text": r["message"]}, "partialFingerprints": {"modelgauge/v1": r["fingerprint"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": {"startLine": max(1, r["line"] or 1)}}}],
        }
        if r["suppressed"]:
            one["suppressions"] = [{"kind": "external", "justification": r["source"]}]
        results.append(one)
    rules = [{"id": i, "defaultConfiguration": {"level": LEVEL[RULES[i].severity] if i in RULES else "warning"}} for i in ids]
    notes = []
    if skips is not None:
        from modelgauge.operators.findings import aggregated_skips

        for r in aggregated_skips(skips).orderBy("rule_id", "reason").toLocalIterator():
            level = "error" if r["reason"] in ("RULE_ERROR", "ADAPTER_FAILED") else "warning"
            notes.append({"level": level, "associatedRule": {"id": r["rule_id"]}, "message": {"text": f"{r['reason']}: {r['n']}" + (f" ({r['details']})" if r["details"] else "")}})
    invocation = {"executionSuccessful": not any(n["level"] == "error" for n in notes), "toolExecutionNotifications": notes}
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "modelgauge", "rules": rules}}, "invocations": [invocation], "results": results}]}


def console(scan, show_suppressed: bool = False, rows: int = 100) -> str:
    f = scan.findings if show_suppressed else scan.findings.where("not suppressed")
    out = []
    for r in K.top_per_tier(f, rows, ["fingerprint"]).orderBy("tier", "position").toLocalIterator():
        if r["position"] == 1:
            out.append(f"Tier {r['tier']}")
        out.append(f"  {r['severity']:<8} {r['rule_id']:<6} {r['path']}:{r['line']}  {r['message']}")
        if r["position"] == rows and r["more"]:
            out.append(f"  ... {r['more']} more")
    hidden = 0 if show_suppressed else scan.findings.where("suppressed").count()
    if hidden:
        out.append(f"{hidden} suppressed")
    out += [f"{r['dimension']:<24} {r['covered']}/{r['total']} {r['ratio']:.1%}" for r in scan.coverage.orderBy("dimension").collect()]
    for title, name in (("skips", "skips"), ("complexity", "complexity"), ("tests", "results")):
        if name in scan.frames:
            df = scan.frames[name]
            if name == "skips":
                lines = [f"  {r['reason']:<20} {r['count']}" for r in df.groupBy("reason").count().orderBy("reason").collect()]
            elif name == "complexity":
                lines = [f"  {r['node_id']} {r['cc']}" for r in df.orderBy(F.col("cc").desc(), "node_id").limit(10).collect()]
            elif "kind" in df.columns:
                from modelgauge.operators.scoring import test_grid

                lines = [f"  {r['status']:<14} {r['data']:>6} {r['unit']:>6}" for r in test_grid(df).orderBy("status").collect()]
            else:
                lines = []
            out += [title, *lines] if lines else []
    return "\n".join(out)


def append_run(scan, folder: str, run_id: str, project: str, started_at) -> None:
    """A run's headline, appended to the run log."""
    from modelgauge.operators.scoring import headline

    h = headline(scan.findings, scan.summaries).withColumns({"run_id": F.lit(run_id), "project": F.lit(project), "started_at": F.lit(started_at), "status": F.lit("success")})
    h.write.mode("append").partitionBy("project").parquet(folder)
