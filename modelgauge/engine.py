"""The whole scan: files to relations, relations to findings, coverage, scores and a gate."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.config import load_config
from modelgauge.functions import exprs as X
from modelgauge.operators import complexity as CC
from modelgauge.operators import coverage as C
from modelgauge.operators import findings as E
from modelgauge.operators import graph as G
from modelgauge.operators import scoring as M
from modelgauge.operators import serving as K
from modelgauge.operators import tree_rules as T
from modelgauge.plans.materialize import materialized
from modelgauge.plans.plantree import parse_all
from modelgauge.sources import artifacts as A
from modelgauge.sources import project as P

RESULT = "unique_id string, test_name string, test_kind string, kind string, model string, column_name string, path string, malformed_reason string, status string, executed boolean"


@dataclass
class Scan:
    """A scan's relations by name, and its configuration."""

    cfg: dict
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["frames"][name]
        except KeyError:
            raise AttributeError(name) from None

    def models_list(self, sort: str = "score", max_score: int | None = None) -> DataFrame:
        return K.models_list(self.frames["summaries"], max_score, sort)


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def scan(self, path: str, config: str | None = None, given: dict | None = None, manifest: str | None = None, run_results: str | None = None, lint: str | None = None, baseline: DataFrame | None = None, today: str | None = None, compiled: str | None = None) -> Scan:
        s, root = self.spark, P.find_root(path)
        cfg, info = load_config(config, given), P.project_info(root)
        today = today or date.today().isoformat()
        if baseline is None:
            baseline = A.baseline(s, str(root), cfg["baseline"])
        sql = P.files(s, str(root), "*.[sS][qQ][lL]", ("target/*", "*/target/*", "dbt_packages/*"))
        own, errors = P.models(sql, info["name"], info["model_paths"])
        rows = materialized(P.schema_rows(P.files(s, str(root), "*.{yml,yaml}")))
        linked, more = P.link(own, rows)
        known = {r["name"] for r in P.macros(sql).collect()}
        text = P.rendered(linked, known)
        folder = P.compiled_folder(root, info["name"], compiled or cfg["render"]["compiled_dir"])
        text, mode, hits = P.select_renderer(text, P.files(s, str(folder), "*.[sS][qQ][lL]") if folder else None, "COMPILED" if compiled else cfg["render"]["mode"], cfg["render"]["compiled_min_coverage"])
        text = materialized(text)
        parsed, facts = parse_all(s, [(r["node_id"], r["sql"]) for r in text.where("not uncertain").select("node_id", "sql").collect()])
        models = materialized(text.join(parsed, "node_id", "left").withColumn("parse_ok", F.coalesce("parse_ok", F.lit(False))).withColumns({"has_yaml": F.col("yml").isNotNull(), "description": F.col("yml.description"), "n_model_tests": F.coalesce(F.size("yml.tests"), F.lit(0))}))
        columns = models.where("yml is not null").select("node_id", F.explode("yml.columns").alias("c")).select("node_id", "c.name", "c.description", "c.tests", F.size("c.tests").alias("n_tests"))
        tests, ext, version, adapters = A.read(s, manifest, run_results, lint, cfg["lint"]["severities"], str(root))
        results = materialized(tests.select(*(x.split()[0] for x in RESULT.split(", ")))) if tests is not None else s.createDataFrame([], RESULT)
        cc = materialized(CC.complexity(models, facts))
        edges = G.edges(models, models.select("node_id", F.explode("refs").alias("ref")))
        arch = cfg["architecture"]
        layers = G.classify(models, tuple((k, tuple(v)) for k, v in arch["layers"].items()) if arch["layers"] else G.LAYERS)
        r = {"models": models, "columns": columns, "facts": facts, "parsed": models, "results": results, "complexity": cc, "edges": edges, "layers": layers}
        rules = dict(cfg["rules"])
        rules["Q003"] = {**rules.get("Q003", {}), "params": cfg["complexity"] | rules.get("Q003", {}).get("params", {})}
        extra = {"T002": {"dbt_version": version}, "A001": {"allowed": [tuple(x) for x in arch["allowed"] or ()]}, "Q006": {"prefixes": {k: tuple(v) for k, v in (arch["prefixes"] or {}).items()}}}
        for i, x in extra.items():
            rules[i] = {**rules.get(i, {}), "params": {k: v for k, v in x.items() if v} | rules.get(i, {}).get("params", {})}
        crashed: dict[str, str] = {}
        found = T.run_rules(r, rules, crashed).withColumn("fingerprint", X.fingerprint(F.col("rule_id"), F.col("path"), F.col("context"))).withColumn("origins", F.array(F.lit("core")))
        settings = s.createDataFrame([(i, float(x.get("confidence_min") or 0), x.get("severity"), x.get("tier"), T.RULES[i].severity, T.RULES[i].tier) for i, x in rules.items() if i in T.RULES], "rule_id string, confidence_min double, severity string, tier int, default_severity string, default_tier int")
        found = E.postprocess(found, settings, cfg["confidence_threshold"])
        if ext is not None:
            ext = ext.select("rule_id", "severity", F.col("tier").cast("int").alias("tier"), "confidence", "message", "line", F.concat_ws(":", "line", "column", "message").alias("context"), "path")
            ext = ext.join(models.select("path", "node_id"), "path", "left").withColumn("rule_ord", F.lit(1000)).withColumn("fingerprint", X.fingerprint(F.col("rule_id"), F.col("path"), F.col("context"))).withColumn("origins", F.array().cast("array<string>"))
            found = found.unionByName(E.stamp_origin(ext, "lint"))
        broken = [("INTERNAL_CRASH", "BLOCKER", 1, f"rule {i} failed: {e}", i, 3000) for i, e in sorted(crashed.items())] + [("ADAPTER_FAILED", "MINOR", 2, f"adapter {i}: {e}", f"{i}:{k}", 4000) for i, k, e in adapters if k != "ok"]
        if broken:
            own = s.createDataFrame(broken, "rule_id string, severity string, tier int, message string, context string, rule_ord int").withColumns({"confidence": F.lit(1.0), "path": F.lit("config"), "line": F.lit(1), "node_id": F.lit(None).cast("string"), "origins": F.array(F.lit("core"))})
            found = found.unionByName(own.withColumn("fingerprint", X.fingerprint(F.col("rule_id"), F.col("path"), F.col("context"))))
        merged = E.merge(found, ["rule_ord", "node_id", "line", "message"])
        waived = materialized(E.apply_waivers(merged, cfg["overrides"], baseline, today))
        expired = E.expired_waivers(waived).select(
            F.lit("G003").alias("rule_id"), F.lit("MAJOR").alias("severity"), F.lit(1).alias("tier"), F.lit(1.0).alias("confidence"), F.concat(F.lit("waiver expired: "), "entry_id").alias("message"), F.lit("config").alias("path"), F.lit(1).alias("line"),
            F.lit(None).cast("string").alias("node_id"), F.col("entry_id").alias("context"), F.lit(2000).alias("rule_ord"), X.fingerprint(F.lit("G003"), F.lit("config"), F.col("entry_id")).alias("fingerprint"), F.array(F.lit("core")).alias("origins"),
        )
        waived = waived.unionByName(expired.withColumns({"suppressed": F.lit(False), "is_new": F.lit(True), "expired": F.lit(False)}), allowMissingColumns=True)
        enabled = [(i, bool(rules.get(i, {}).get("enabled", True)), x.is_node_rule, x.requires_ast) for i, x in T.RULES.items()]
        gates = s.createDataFrame(enabled, "rule_id string, enabled boolean, is_node_rule boolean, requires_ast boolean")
        for c in ("required_mode", "required_adapter", "mode", "adapter_state"):
            gates = gates.withColumn(c, F.lit(None).cast("string"))
        checks = E.gate_checks(gates, models)
        skips = checks.where("reason is not null and reason <> 'DISABLED'").withColumn("details", F.lit(None).cast("string"))
        if crashed:
            skips = skips.unionByName(s.createDataFrame([(i, None, "RULE_ERROR", e) for i, e in crashed.items()], "rule_id string, node_id string, reason string, details string"))
        dims = tuple(cfg["coverage"]["thresholds"]) or C.DIMENSIONS
        res = results.withColumn("ord", F.coalesce("unique_id", F.lit("")))
        own = {"weights": cfg["coverage"]["weights"], "classes": cfg["coverage"]["classes"], "simple": cfg["coverage"]["unit_test_cc_threshold"], "warn": cfg["complexity"]["warn"]}
        if tests is None:
            dims = tuple(d for d in dims if d != "column_test_meaningful") or ("test",)
        cov = C.all_facts(models, columns, res, cc, ["ord"], dims, own)
        cov = materialized(cov)
        summary = materialized(M.summaries(models, cov, waived, results, skips, cfg["scoring"]))
        frames = r | {
            "findings": waived, "skips": skips, "checks": checks, "coverage_facts": cov, "coverage": C.rollup(cov), "summaries": summary, "render_stats": M.render_stats(models), "scan_errors": errors.unionByName(more),
            "tested": C.tested_models(C.declared(models, columns), results), "column_differences": C.column_differences(columns, T._outer(r).where("name not in ('', '*')").select("node_id", "name")),
            "adapters": s.createDataFrame(adapters, "adapter string, status string, message string"), "renderer": s.createDataFrame([(mode, P.dominant_mode(models), float(hits))], "selected string, dominant string, hit_ratio double"),
            "seeds": P.seeds(s, str(root), info["seed_paths"]), "exposures": rows.where("kind = 'exposure'"), "rules": T.metadata(s),
            "docs": P.doc_blocks(P.files(s, str(root), "*.md")), "sources": rows.where("kind = 'source'"),
        }
        return Scan(cfg, frames)

    def gate(self, scan: Scan) -> tuple[bool, list[str]]:
        """Whether a scan passes, and what it fails."""
        g, why = scan.cfg["gate"], []
        f = E.gate_findings(scan.findings, g["fail_on_tier"], g["fail_on_new_only"]).first()
        if f["failing"]:
            why.append(f"{f['failing']} findings")
        why += [f"coverage {r['dimension']} {r['ratio']:.4f} < {r['minimum']}" for r in E.gate_coverage(scan.coverage, scan.cfg["coverage"]["thresholds"]).orderBy("dimension").collect()]
        n = E.gate_unexecuted(scan.results, scan.findings).count()
        if n > g["unexecuted_max"]:
            why.append(f"{n} tests weren't run")
        why += [f"{r['n']} skips: {r['reason']}" for r in E.gate_skips(scan.skips, g["skips"]).collect()]
        return not why, why

    def exit_code(self, scan: Scan) -> int:
        """0 passes, 1 fails the gate, 2 has no models, 3 failed to parse nine tenths of them."""
        s = scan.render_stats.first()
        if not s["total"]:
            return 2
        if s["parse_failed"] >= 0.9 * s["total"]:
            return 3
        return 0 if self.gate(scan)[0] else 1


def project_root(path: str) -> Path:
    return P.find_root(path)
