"""The domain's relations over the tables of a scale factor: what a project's metadata would be, at any size.

`SQL` gives the same relations as common table expressions, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MODELS = """select concat('model.p.', cast(p_partkey as {s})) as node_id, p_name as name,
 concat(case when p_size % 5 = 0 then 'sources' when p_size % 5 = 1 then 'staging' when p_size % 5 = 2 then 'intermediate' when p_size % 5 = 3 then 'marts' else 'misc' end, '/', cast(p_partkey as {s}), '.sql') as path,
 case when p_partkey % 3 = 0 then ' ' else p_type end as description, p_partkey % 7 <> 0 as has_yaml, case when p_partkey % 5 = 0 then 1 else 0 end as n_model_tests,
 p_size as cc, p_partkey % 11 <> 0 as parse_ok, p_partkey % 13 = 0 as uncertain, case when p_partkey % 4 = 0 then 'MOCK' when p_partkey % 4 = 1 then 'PARTIAL' else 'COMPILED' end as mode
 from part"""
_COLUMNS = """select concat('model.p.', cast(p_partkey as {s})) as node_id, concat('C', cast(i as {s})) as name,
 case when (p_partkey + i) % 2 = 0 then '' else 'd' end as description, cast((p_partkey + i) % 3 as int) as n_tests
 from part cross join (values (0), (1), (2)) v(i) where p_partkey % 7 <> 0 and i < p_size % 4"""
_RESULTS = """select concat('model.p.', cast(l_partkey as {s})) as model, concat('c', cast(l_linenumber % 4 as {s})) as column_name, concat('t', cast(l_linenumber as {s})) as test_name,
 case when l_returnflag = 'N' then 'not_null' when l_returnflag = 'R' then 'relationships' else 'singular' end as test_kind,
 case when l_linenumber = 7 then 'UNIT' else 'DATA' end as kind,
 case when l_linestatus = 'O' and l_quantity < 10 then 'FAIL' when l_linestatus = 'O' and l_quantity < 20 then 'SKIPPED' else 'PASS' end as status,
 l_tax < 0.07 as executed, l_orderkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag from lineitem"""
_FINDINGS = """select concat('R', substring(o_orderpriority, 1, 1)) as rule_id, case when o_orderstatus = 'F' then 1 else 2 end as tier,
 case when o_orderkey % 5 = 0 then 'BLOCKER' when o_orderkey % 5 = 1 then 'CRITICAL' when o_orderkey % 5 = 2 then 'MAJOR' when o_orderkey % 5 = 3 then 'MINOR' else 'INFO' end as severity,
 concat('models/', cast(o_custkey % 500 as {s}), '.sql') as path, cast(o_custkey % 50 as {s}) as context,
 case when o_orderkey % 10 = 0 then null else concat('model.p.', cast(o_custkey % 300 as {s})) end as node_id,
 cast(o_orderkey % 40 + 1 as int) as line, round(o_totalprice - floor(o_totalprice), 2) as confidence, case when o_orderkey % 3 = 0 then 'lint' else 'core' end as origin, o_orderkey as ord from orders"""
_EDGES = """select concat('model.p.', cast({half} as {s})) as parent, concat('model.p.', cast(p_partkey as {s})) as child from part where p_partkey > 0
 union all select * from (values ('x.a', 'x.b'), ('x.b', 'x.c'), ('x.c', 'x.a'), ('x.c', 'x.d')) v(parent, child)"""
_RUNS = """select event_id as run_id, user_id as project, case when event_type = 'error' or event_id % 9 = 0 then 'failed' else 'success' end as status, ts as started_at, value as score from events"""
_SKIPS = """select concat('R', substring(o_orderpriority, 1, 1)) as rule_id, case when o_orderkey % 3 = 0 then 'PARSE_FAILED' when o_orderkey % 3 = 1 then 'RENDER_UNCERTAIN' else 'RULE_ERROR' end as reason,
 case when o_orderkey % 4 = 0 then null else concat('model.p.', cast(o_custkey % 300 as {s})) end as node_id, case when o_orderkey % 6 = 0 then concat('d', cast(o_custkey % 9 as {s})) end as details from orders where o_orderstatus <> 'O'"""
ALL = {"models": _MODELS, "columns": _COLUMNS, "results": _RESULTS, "findings0": _FINDINGS, "edges": _EDGES, "runs": _RUNS, "skips": _SKIPS}
SQL = {k: v.format(s="varchar", half="p_partkey // 2") for k, v in ALL.items()}
ORDER = ["l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ALL[name].format(s="string", half="p_partkey div 2")
    for t in ("part", "lineitem", "orders", "events"):
        if f"from {t}" in text:
            return spark.sql(text.replace(f"from {t}", f"from {{{t}}}"), **{t: table(spark, sf_dir, t)})
    raise KeyError(name)
