"""The engine's queries over the bindings of `plans.bindings`, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.functions import exprs as X
from modelgauge.operators import coverage as C
from modelgauge.operators import findings as E
from modelgauge.operators import graph as G
from modelgauge.operators import scoring as M
from modelgauge.operators import serving as K
from modelgauge.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = "2025-06-30"
OVERRIDES = [
    {"id": "old", "waive": ["R1"], "paths": ["models/1?.sql"], "reason": "expired", "expires": "2025-06-29"},
    {"id": "one", "waive": ["R[12]"], "paths": ["models/1*"], "reason": "path", "expires": "2025-06-30"},
    {"id": "two", "waive": ["*"], "models": ["2[!0-4]"], "reason": "name"},
    {"waive": ["R3"], "node_ids": ["model.p.7", "model.p.8"], "reason": "node"},
]


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda r: _relation(spark, sf_dir, r))
        if sql is not None:
            views = ", ".join(f"{k} as ({v})" for k, v in _VIEWS.items() if k in _needed(sql))
            ORACLE_SQL[name] = f"with {views} {sql}" if views else sql
        return f

    return keep


def _relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in B.ALL:
        return B.relation(spark, sf_dir, name)
    if name == "findings":
        f = B.relation(spark, sf_dir, "findings0")
        return f.withColumn("fingerprint", X.fingerprint(F.col("rule_id"), F.col("path"), F.col("context")))
    if name == "baseline":
        return _relation(spark, sf_dir, "findings").where("origin = 'lint'").select("fingerprint").distinct()
    if name == "waived":
        return E.apply_waivers(_relation(spark, sf_dir, "findings"), OVERRIDES, _relation(spark, sf_dir, "baseline"), TODAY)
    if name == "complexity":
        return B.relation(spark, sf_dir, "models").select("node_id", "cc", "parse_ok")
    if name == "facts":
        r = lambda n: _relation(spark, sf_dir, n)
        return C.all_facts(r("models"), r("columns"), r("results"), r("complexity"), B.ORDER)
    if name == "summary":
        r = lambda n: _relation(spark, sf_dir, n)
        return M.summaries(r("models"), r("facts"), r("waived"), r("results"), r("skips"))
    return B.table(spark, sf_dir, name)


_ORD = ", ".join(B.ORDER)
_RANK = "case status when 'FAIL' then 4 when 'ERROR' then 3 when 'SKIPPED' then 2 when 'PASS' then 1 else 0 end"
_W = "case test_kind when 'not_null' then 0.0 when 'relationships' then 0.25 else 1.0 end"
_SEL = [
    "rule_id = 'R1' and regexp_full_match(path, 'models/1.\\.sql')",
    "rule_id in ('R1', 'R2') and starts_with(path, 'models/1')",
    "regexp_full_match(split_part(node_id, '.', -1), '2[^0-4]')",
    "rule_id = 'R3' and node_id in ('model.p.7', 'model.p.8')",
]
_VIEWS = dict(B.SQL) | {
    "findings": "select *, substr(sha256(concat(rule_id, chr(0), path, chr(0), context)), 1, 16) as fingerprint from findings0",
    "baseline": "select distinct fingerprint from findings where origin = 'lint'",
    "picked": "select f.*, case " + " ".join(f"when coalesce({s}, false) then {i}" for i, s in enumerate(_SEL)) + " end as e, b.fingerprint is not null as based from findings f left join baseline b using (fingerprint)",
    "waived": "select *, case e when 0 then 'old' when 1 then 'one' when 2 then 'two' when 3 then 'node_ids=model.p.7|model.p.8;waive=R3' end as entry_id, coalesce(e = 0, false) as expired, not based as is_new, case when e is not null then case when e <> 0 then 'override' end when based then 'baseline' end as source, (case when e is not null then e <> 0 else based end) as suppressed from picked",
    "worst": f"select * from (select *, row_number() over (partition by test_name, model order by {_RANK} desc, {_ORD}) as rn from results where kind <> 'UNIT') where rn = 1",
    "weights": f"select model as node_id, max({_W}) as weight from worst where status = 'PASS' group by 1",
    "per": "select m.node_id, m.has_yaml, m.description, m.n_model_tests, count(c.name) as n_columns, count(*) filter (c.n_tests > 0) as n_tested, count(*) filter (trim(c.description) <> '') as n_described from models m left join columns c using (node_id) group by all",
    "worstc": f"select * from (select *, row_number() over (partition by model, lower(column_name), test_name order by {_RANK} desc, {_ORD}) as rn from results where kind <> 'UNIT') where rn = 1",
    "goodc": "select distinct model as node_id, lower(column_name) as col from worstc where status = 'PASS' and test_kind = 'singular'",
    "unitp": "select distinct model as node_id from results where kind = 'UNIT' and status = 'PASS'",
    "f_test": "select 'test' as dimension, node_id, cast(n_tested > 0 or n_model_tests > 0 as double) as covered, 1.0::double as total from per",
    "f_doc": "select 'doc' as dimension, node_id, case when has_yaml then (trim(description) <> '')::int + n_described else 0 end::double as covered, case when has_yaml then 1 + n_columns else 1 end::double as total from per",
    "f_col": "select 'column_test' as dimension, node_id, n_tested::double as covered, n_columns::double as total from per where n_columns > 0",
    "f_colm": "select 'column_test_meaningful' as dimension, c.node_id, count(g.col)::double as covered, count(*)::double as total from columns c left join goodc g on c.node_id = g.node_id and lower(c.name) = g.col group by c.node_id",
    "f_mean": "select 'test_meaningful' as dimension, node_id, coalesce(weight >= 1, false)::double as covered, 1.0::double as total from models left join weights using (node_id)",
    "f_wcc": "select 'test_weighted_cc' as dimension, node_id, coalesce(weight, 0)::double * cc as covered, cc::double as total from models left join weights using (node_id)",
    "f_unit": "select 'test_unit' as dimension, node_id, (node_id in (select model from results where kind = 'UNIT'))::double as covered, 1.0::double as total from models",
    "f_uwcc": "select 'test_unit_weighted_cc' as dimension, node_id, case when cc <= 3 or node_id in (select node_id from unitp) then cc else 0 end::double as covered, cc::double as total from models",
    "f_cc": "select 'complexity' as dimension, node_id, (parse_ok and cc <= 15)::double as covered, parse_ok::double as total from models",
    "facts": " union all ".join(f"select * from f_{k}" for k in ("test", "doc", "col", "colm", "mean", "wcc", "unit", "uwcc", "cc")),
    "ratios": "select node_id, " + ", ".join(f"max(round_even(covered, 0)) filter (dimension = '{d}') as {s}_c, max(total) filter (dimension = '{d}') as {s}_t" for d, s in (("doc", "doc"), ("column_test", "col"), ("column_test_meaningful", "mean"), ("test_unit_weighted_cc", "unit"))) + " from facts group by node_id",
    "rules": "select node_id, count(distinct case when not suppressed and tier = 1 then rule_id end) as n1, count(distinct case when not suppressed and tier <> 1 then rule_id end) as n2, string_agg(distinct case when not suppressed and tier = 1 then rule_id end, ',' order by case when not suppressed and tier = 1 then rule_id end) as r1, string_agg(distinct case when not suppressed and tier <> 1 then rule_id end, ',' order by case when not suppressed and tier <> 1 then rule_id end) as r2, count(*) filter (suppressed) as waived from waived where node_id is not null group by node_id",
    "tests": "select model as node_id, count(*) filter (kind = 'DATA') as data_tests, count(*) filter (kind = 'UNIT') as unit_tests, count(*) filter (not executed) as unexecuted from results group by model",
    "skipn": "select node_id, count(*) as skips from skips where node_id is not null group by node_id",
    "joined": "select m.*, coalesce(case when doc_t > 0 then doc_c / doc_t end, 0) as doc_ratio, coalesce(case when col_t > 0 then col_c / col_t end, 1) as column_ratio, coalesce(case when mean_t > 0 then mean_c / mean_t end, 1) as meaningful_ratio, coalesce(case when unit_t > 0 then unit_c / unit_t end, 1) as unit_cc_ratio, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2, coalesce(r1, '') as r1, coalesce(r2, '') as r2, coalesce(waived, 0) as waived, coalesce(data_tests, 0) as data_tests, coalesce(unit_tests, 0) as unit_tests, coalesce(unexecuted, 0) as unexecuted, coalesce(skips, 0) as skips from models m left join ratios using (node_id) left join rules using (node_id) left join tests using (node_id) left join skipn using (node_id)",
    "points": "select *, round_even((1 - column_ratio) * 25, 0)::int as p_column_test, round_even((1 - meaningful_ratio) * 25, 0)::int as p_meaningful_column, round_even((1 - unit_cc_ratio) * 10, 0)::int as p_unit_cc, greatest(0, round_even((1 - doc_ratio) * 15, 0))::int as p_doc, least(40, 10 * n1)::int as p_tier1, least(20, 3 * n2)::int as p_tier2, least(15, 5 * unexecuted)::int as p_unexec, case when not parse_ok then 10 when uncertain then 5 else 0 end as p_parse, case when parse_ok and not uncertain then least(5, skips) else 0 end::int as p_skips from joined",
    "summary": "select *, greatest(0, 100 - " + " - ".join(f"p_{p}" for p in M.PENALTIES) + ")::int as score from points",
}
# edges without the constant cycle are a forest, so recursion ends
_CLOSURE = "with recursive e as (" + B.SQL["edges"] + "), r(ancestor, descendant) as (select parent, child from e union select r.ancestor, e.child from r join e on r.descendant = e.parent) "


def _needed(sql: str) -> set[str]:
    import re

    todo, seen = {sql}, set()
    while todo:
        text = todo.pop()
        for k, v in _VIEWS.items():
            if k not in seen and re.search(rf"\b(?:from|join)\s+{k}\b", text):
                seen.add(k)
                todo.add(v)
    return seen


def _rolled(view: str, empty: float) -> str:
    return f"select dimension, round_even(sum(covered), 0)::bigint as covered, sum(total)::bigint as total, round(coalesce(case when sum(total) > 0 then least(1.0, sum(covered) / sum(total)) end, {empty}), 9) as ratio from {view} group by dimension"


def _ratio(facts: DataFrame) -> DataFrame:
    return C.rollup(facts).withColumn("ratio", F.round("ratio", 9))


for _name, _view, _make in (
    ("c_test", "f_test", lambda r: C.test(C.declared(r("models"), r("columns")))),
    ("c_doc", "f_doc", lambda r: C.doc(C.declared(r("models"), r("columns")))),
    ("c_col", "f_col", lambda r: C.column_test(C.declared(r("models"), r("columns")))),
    ("c_colm", "f_colm", lambda r: C.column_test_meaningful(r("columns"), r("results"), B.ORDER)),
    ("c_mean", "f_mean", lambda r: C.test_meaningful(r("models"), C.best_weights(r("results"), B.ORDER))),
    ("c_wcc", "f_wcc", lambda r: C.test_weighted_cc(r("models"), r("complexity"), C.best_weights(r("results"), B.ORDER))),
    ("c_unit", "f_unit", lambda r: C.test_unit(r("models"), r("results"))),
    ("c_uwcc", "f_uwcc", lambda r: C.test_unit_weighted_cc(r("models"), r("complexity"), r("results"))),
    ("c_cc", "f_cc", lambda r: C.complexity_dim(r("complexity"))),
):
    query(_name, _rolled(_view, 1.0 if _name in ("c_test", "c_doc", "c_col") else 0.0))(lambda r, m=_make: _ratio(m(r)))


@query("c_all", "select dimension, node_id, round_even(covered, 0)::bigint as covered, total::bigint as total from facts")
def _(r):
    return C.per_node(r("facts"))


@query("c_class", "select test_kind, case test_kind when 'not_null' then 'TRIVIAL' when 'relationships' then 'STRUCTURAL' else 'LOGICAL' end as class, count(*) as n from results group by all")
def _(r):
    return r("results").groupBy("test_kind").agg(F.count(F.lit(1)).alias("n")).select("test_kind", X.test_class(F.col("test_kind")).alias("class"), "n")


@query("c_worst", "select model, test_name, status, test_kind from worst")
def _(r):
    return C.worst(r("results").where("kind <> 'UNIT'"), ["test_name", "model"], B.ORDER)


_PS = ", ".join(f"p_{p}" for p in M.PENALTIES)


@query("m_score", f"select node_id, name, score, parse_ok, uncertain, {_PS}, round(doc_ratio, 4) as doc_ratio, round(column_ratio, 4) as column_ratio, round(meaningful_ratio, 4) as meaningful_ratio, round(unit_cc_ratio, 4) as unit_cc_ratio, data_tests, unit_tests, unexecuted, waived, skips, r1 as tier1_rules, r2 as tier2_rules from summary")
def _(r):
    return r("summary").withColumn("tier1_rules", F.array_join("tier1_rules", ",")).withColumn("tier2_rules", F.array_join("tier2_rules", ","))


@query("m_breakdown", " union all ".join(f"select node_id, '{p}' as penalty, p_{p} as points from summary" for p in M.PENALTIES))
def _(r):
    return M.breakdown(r("summary"))


@query("m_rules", "select node_id, coalesce(r1, '') as tier1_rules, coalesce(r2, '') as tier2_rules, waived from rules")
def _(r):
    return M.rule_counts(r("waived")).withColumn("tier1_rules", F.array_join("tier1_rules", ",")).withColumn("tier2_rules", F.array_join("tier2_rules", ","))


@query("m_tests", "select * from tests")
def _(r):
    return M.test_counts(r("results"))


@query("m_skip", "select * from skipn")
def _(r):
    return M.skip_counts(r("skips"))


@query("m_tgrid", "select case when executed then status else 'NOT_EXECUTED' end as status, count(*) filter (kind = 'DATA') as data, count(*) filter (kind = 'UNIT') as unit from results group by 1")
def _(r):
    return M.test_grid(r("results"))


@query("m_headline", "select f.*, m.* from (select count(*) filter (severity in ('CRITICAL', 'BLOCKER')) as critical, count(*) filter (severity = 'MAJOR') as major, count(*) filter (severity in ('MINOR', 'INFO')) as minor from waived where not suppressed) f, (select count(*) as models, count(*) filter (score < 70) as at_risk, round(avg(score), 2) as mean_score, round(median(score), 2) as median_score from summary) m")
def _(r):
    return M.headline(r("waived"), r("summary"))


@query("m_render", "select count(*) as total, count(*) filter (uncertain) as uncertain, count(*) filter (parse_ok) as parsed, count(*) filter (not parse_ok) as parse_failed, count(*) filter (mode = 'MOCK') as mock, count(*) filter (mode = 'PARTIAL') as partial, count(*) filter (mode = 'COMPILED') as compiled from models")
def _(r):
    return M.render_stats(r("models"))


@query("m_ccsum_top", "select node_id, cc from models order by cc desc, node_id limit 10")
def _(r):
    return r("complexity").orderBy(F.col("cc").desc(), "node_id").limit(10).select("node_id", "cc")


_F = "fingerprint, rule_id, tier, severity, path, node_id, line, confidence, ord"


@query("e_fp", "select ord, fingerprint from findings")
def _(r):
    return r("findings").select("ord", "fingerprint")


@query("e_dedup", f"select {_F} from (select *, row_number() over (partition by fingerprint order by ord) as rn from findings) where rn = 1")
def _(r):
    return E.dedup(r("findings").select(*_F.split(", ")), ["ord"])


@query("e_merge", f"select {', '.join('f.' + c for c in _F.split(', '))}, o.origins from (select *, row_number() over (partition by fingerprint order by ord) as rn from findings) f join (select fingerprint, string_agg(origin, ',' order by m) as origins from (select fingerprint, origin, min(ord) as m from findings group by all) group by fingerprint) o on f.fingerprint = o.fingerprint where rn = 1")
def _(r):
    f = r("findings").select(*_F.split(", "), F.array("origin").alias("origins"))
    return E.merge(f, ["ord"]).withColumn("origins", F.array_join("origins", ","))


@query("e_post", "select ord, case when rule_id = 'R2' then 'INFO' else severity end as severity, case when rule_id = 'R3' then 1 else tier end as tier from findings where confidence >= greatest(case when rule_id = 'R1' then 0.9 else 0 end, 0.7)")
def _(r):
    f = r("findings")
    settings = f.sparkSession.sql("select * from values ('R1', 0.9D, null, null, 'MAJOR', 2), ('R2', 0.1D, 'INFO', null, 'MAJOR', 2), ('R3', null, 'MAJOR', 1, 'MAJOR', 2) as v(rule_id, confidence_min, severity, tier, default_severity, default_tier)")
    return E.postprocess(f, settings).select("ord", "severity", "tier")


@query("e_skipsum", "select reason, rule_id, count(*) as n, count(distinct node_id) as nodes from skips group by grouping sets ((reason), (rule_id), ())")
def _(r):
    return E.skip_summary(r("skips"))


@query("e_skipagg", "select rule_id, reason, count(*) as n, coalesce(string_agg(distinct node_id, ',' order by node_id), '') as nodes, min(details) as details from skips group by all")
def _(r):
    return E.aggregated_skips(r("skips")).withColumn("nodes", F.array_join("nodes", ","))


@query("e_effective", "select count(*) as total, round_even(greatest(0, least(100, 100.0 * (1 - count(*) / 20000.0))), 2) as effective_pct from skips")
def _(r):
    return E.effective_share(r("skips"), 20000)


_GATE_RULES = "values ('A', true, true, null, null, 'MOCK', null, true), ('B', true, true, null, null, 'MOCK', null, false), ('C', false, true, null, null, 'MOCK', null, false), ('D', true, false, null, null, 'MOCK', null, false), ('E', true, true, 'COMPILED', null, 'MOCK', null, false), ('F', true, true, null, 'dbt', 'MOCK', 'failed', false), ('G', true, true, null, 'lint', 'MOCK', null, false)"


@query("e_gate", "select 'A' as rule_id, node_id, case when uncertain then 'RENDER_UNCERTAIN' when not parse_ok then 'PARSE_FAILED' end as reason from models union all select 'B', node_id, case when uncertain then 'RENDER_UNCERTAIN' end from models union all values ('C', null, 'DISABLED'), ('D', null, null), ('E', null, 'MODE_REQUIRED'), ('F', null, 'ADAPTER_FAILED'), ('G', null, 'ADAPTER_MISSING')")
def _(r):
    m = r("models")
    rules = m.sparkSession.sql(f"select * from {_GATE_RULES} as v(rule_id, enabled, is_node_rule, required_mode, required_adapter, mode, adapter_state, requires_ast)")
    return E.gate_checks(rules, m)


@query("e_attempted", "select count(*) filter (reason is null) as attempted, count(reason) as skipped from (select case when uncertain then 'u' when not parse_ok then 'p' end as reason from models union all select case when uncertain then 'u' end from models union all values ('DISABLED'), (null))")
def _(r):
    m = r("models")
    rules = m.sparkSession.sql("select * from values ('A', true, true, true), ('B', true, true, false), ('C', false, true, false), ('D', true, false, false) as v(rule_id, enabled, is_node_rule, requires_ast)")
    for c in ("required_mode", "required_adapter", "mode", "adapter_state"):
        rules = rules.withColumn(c, F.lit(None).cast("string"))
    return E.gate_checks(rules, m).agg(F.count_if(F.col("reason").isNull()).alias("attempted"), F.count("reason").alias("skipped"))


@query("w_first", "select ord, entry_id from waived where entry_id is not null")
def _(r):
    return r("waived").where("entry_id is not null").select("ord", "entry_id")


@query("w_apply", "select ord, entry_id, expired, source, suppressed, is_new from waived")
def _(r):
    return r("waived").select("ord", "entry_id", "expired", "source", "suppressed", "is_new")


@query("w_g003", "select entry_id, count(*) as n from waived where expired group by 1")
def _(r):
    return E.expired_waivers(r("waived"))


@query("w_capture", "select distinct fingerprint, rule_id, node_id, path from waived where not suppressed")
def _(r):
    return E.capture_baseline(r("waived"))


@query("w_diff", "select coalesce(a.fingerprint, b.fingerprint) as fingerprint, case when b.fingerprint is null then 'added' else 'removed' end as change from (select distinct fingerprint from findings) a full join (select fingerprint from baseline union select substr(sha256(concat(rule_id, chr(0), reason, chr(0), coalesce(node_id, ''))), 1, 16) from skips) b on a.fingerprint = b.fingerprint where a.fingerprint is null or b.fingerprint is null")
def _(r):
    # a baseline that has one adapter's findings, and others of rules that were skipped since
    gone = r("skips").select(X.fingerprint(F.col("rule_id"), F.col("reason"), F.coalesce("node_id", F.lit(""))).alias("fingerprint"))
    return E.diff_baseline(r("findings"), r("baseline").union(gone))


@query("g_fan_in", "select child as node_id, count(distinct parent) as n from edges group by 1")
def _(r):
    return G.fan_in(r("edges"))


@query("g_fan_out", "select parent as node_id, count(distinct child) as n from edges group by 1")
def _(r):
    return G.fan_out(r("edges"))


@query("g_leaf", "select node_id from models where node_id not in (select parent from edges)")
def _(r):
    return G.leaves(r("models").select("node_id"), r("edges"))


@query("g_desc")
def _(r):
    return G.closure(r("edges"))


@query("g_anc")
def _(r):
    return G.closure(r("edges")).groupBy(F.col("descendant").alias("node_id")).agg(F.count(F.lit(1)).alias("n_ancestors"))


@query("g_cycle")
def _(r):
    return G.cycles_of(r("edges")).select("cycle_id", F.array_join("members", ",").alias("members"))


ORACLE_SQL["g_desc"] = _CLOSURE + "select ancestor, descendant from r"
ORACLE_SQL["g_anc"] = _CLOSURE + "select descendant as node_id, count(*) as n_ancestors from r group by 1"
ORACLE_SQL["g_cycle"] = _CLOSURE + "select cycle_id, string_agg(node_id, ',' order by node_id) as members from (select a.ancestor as node_id, min(a.descendant) as cycle_id from r a join r b on a.ancestor = b.descendant and a.descendant = b.ancestor group by 1) group by 1"
_LAYER = "case when starts_with(path, 'sources/') then 'source' when starts_with(path, 'staging/') then 'staging' when starts_with(path, 'intermediate/') then 'intermediate' when starts_with(path, 'marts/') then 'mart' end"


@query("g_layer", f"select node_id, {_LAYER} as layer from models")
def _(r):
    return G.classify(r("models")).select("node_id", "layer")


@query("g_edgeok", f"select e.parent, e.child, a.layer as parent_layer, b.layer as child_layer from edges e join (select node_id, {_LAYER} as layer from models) a on e.parent = a.node_id join (select node_id, {_LAYER} as layer from models) b on e.child = b.node_id where concat(a.layer, '>', b.layer) not in ({', '.join(repr(f'{a}>{b}') for a, b in G.ALLOWED)}) and a.layer is not null and b.layer is not null")
def _(r):
    return G.layer_violations(r("edges"), G.classify(r("models")))


@query("q_find", "select coalesce(sum((not suppressed)::int), 0)::bigint as failing, coalesce(sum(suppressed::int), 0)::bigint as suppressed from waived where tier <= 1 and is_new")
def _(r):
    return E.gate_findings(r("waived"), 1, True)


@query("q_cov", "select dimension, round(ratio, 9) as ratio, minimum from (" + _rolled("facts", 0.0) + ") join (values ('test', 0.99::double), ('doc', 0.2), ('test_unit', 0.95)) v(dimension, minimum) using (dimension) where ratio < minimum")
def _(r):
    return E.gate_coverage(_ratio(r("facts")), {"test": 0.99, "doc": 0.2, "test_unit": 0.95})


@query("q_unex", "select model, count(*) as n from results where not executed and model not in (select node_id from waived where suppressed and rule_id = 'R1' and node_id is not null) group by 1")
def _(r):
    w = r("waived").withColumn("rule_id", F.when(F.col("rule_id") == "R1", "T001").otherwise(F.col("rule_id")))
    return E.gate_unexecuted(r("results"), w).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("q_skip", "select * from (select coalesce(reason, 'TOTAL') as reason, count(*) as n from skips group by grouping sets ((reason), ())) join (values ('PARSE_FAILED', 10), ('RULE_ERROR', 0), ('TOTAL', 100)) v(reason, maximum) using (reason) where n > maximum")
def _(r):
    return E.gate_skips(r("skips"), {"PARSE_FAILED": 10, "RULE_ERROR": 0, "TOTAL": 100})


_SEV = "case severity when 'BLOCKER' then 0 when 'CRITICAL' then 1 when 'MAJOR' then 2 when 'MINOR' then 3 else 4 end"


@query("k_display", f"select tier, ord, position, more from (select *, row_number() over (partition by tier order by {_SEV}, path, line, rule_id, ord) as position, greatest(0, count(*) over (partition by tier) - 100) as more from findings) where position <= 100")
def _(r):
    return K.top_per_tier(r("findings"), 100, ["ord"]).select("tier", "ord", "position", "more")


@query("k_page", "select ord, rule_id, severity from findings where severity = 'MAJOR' order by ord limit 500 offset 100")
def _(r):
    return K.page(r("findings"), ["ord"], 100, 500, severity="MAJOR").select("ord", "rule_id", "severity")


@query("k_models", "select node_id, score from summary where score <= 60")
def _(r):
    return K.models_list(r("summary"), 60).select("node_id", "score")


@query("k_topk_runs", "select run_id, project, status from runs order by started_at desc, run_id desc limit 50")
def _(r):
    return K.latest_runs(r("runs")).select("run_id", "project", "status")


@query("k_lastrun", "select c_custkey as project, c_name as name, run_id, round(score, 6) as score from customer left join (select *, row_number() over (partition by project order by started_at desc, run_id desc) as rn from runs where status = 'success') x on c_custkey = project and rn = 1")
def _(r):
    p = r("customer").select(F.col("c_custkey").alias("project"), F.col("c_name").alias("name"))
    return K.last_run(p, r("runs")).withColumn("score", F.round("score", 6))


@query("k_trend", "select project, run_id, round(score, 6) as score from (select *, row_number() over (partition by project order by started_at desc, run_id desc) as rn from runs) where rn <= 200 and status = 'success'")
def _(r):
    return K.trend(r("runs")).select("project", "run_id", F.round("score", 6).alias("score"))


@query("k_pmc", "select coalesce(s.node_id, f.node_id) as node_id, s.score, coalesce(f.n, 0) as n_dimensions from (select node_id, score from summary) s full join (select model as node_id, count(distinct kind) as n from results group by 1) f on s.node_id = f.node_id")
def _(r):
    # models without a test have no dimension of tests; tests of what is no model have no score
    kinds = r("results").groupBy(F.col("model").alias("node_id"), F.col("kind").alias("dimension")).agg(F.count_if("executed").alias("covered"), F.count(F.lit(1)).alias("total"))
    out = K.model_coverage(r("summary"), kinds)
    return out.select("node_id", "score", F.coalesce(F.when(F.col("dimensions").isNotNull(), F.size("dimensions")), F.lit(0)).cast("bigint").alias("n_dimensions"))


@query("s_status", "select l_returnflag as raw, case when l_returnflag = 'A' then 'PASS' when l_returnflag = 'N' then 'FAIL' else 'UNKNOWN' end as status, count(*) as n from lineitem group by all")
def _(r):
    raw = F.when(F.col("l_returnflag") == "A", " Warn ").when(F.col("l_returnflag") == "N", "FAIL").otherwise("odd")
    return r("lineitem").groupBy(F.col("l_returnflag").alias("raw"), X.map_status(raw).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("s_testjoin", "select o_orderkey as uid, max(l_linenumber) is not null as executed, max(l_linenumber) as last_line from orders left join lineitem on o_orderkey = l_orderkey and l_returnflag = 'R' group by 1")
def _(r):
    from modelgauge.sources.artifacts import join_results

    tests = r("orders").select(F.col("o_orderkey").alias("unique_id"))
    runs = r("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("unique_id")).agg(F.max("l_linenumber").alias("last_line"))
    return join_results(tests, runs).select(F.col("unique_id").alias("uid"), "executed", "last_line")


@query("s_first_wins", "select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1")
def _(r):
    return G.first_of(r("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("s_unitbad", "select case p_size % 5 when 0 then 'given_missing' when 1 then 'given_empty' when 2 then 'expect_missing' when 3 then 'expect_rows_empty' end as reason, count(*) as n from part group by 1")
def _(r):
    k = F.col("p_size") % 5
    one = F.array(F.lit("x"))
    none = F.array().cast("array<string>")
    reason = X.unit_test_defect(F.when(k == 1, none).when(k > 1, one), F.when(k != 2, F.lit("e")), F.when(k == 3, none).otherwise(one))
    return r("part").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("t_norm", "select event_id, lower(trim(regexp_replace(props, '\\s+', ' ', 'g'))) as snippet from events")
def _(r):
    return r("events").select("event_id", X.normalize_snippet(F.col("props")).alias("snippet"))


@query("t_glob", "select p_partkey from part where regexp_full_match(p_name, '(?s).*1[^2-4]..*')")
def _(r):
    return r("part").where(X.matches_any(F.col("p_name"), ["*1[!2-4]?*"])).select("p_partkey")


from modelgauge import rule_queries  # noqa: E402

QUERIES |= rule_queries.QUERIES
ORACLE_SQL |= rule_queries.ORACLE_SQL
