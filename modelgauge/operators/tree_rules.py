"""Rules over the plans' facts and the metadata: each is a filter or a small aggregate with one output schema.

A rule gives (rule_id, severity, tier, confidence, message, path, line, node_id, context); the engine unions them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modelgauge.functions import exprs as X
from modelgauge.operators import graph as G
from modelgauge.operators import metadata_rules as R
from modelgauge.plans.materialize import materialized

COLUMNS = ("rule_id", "severity", "tier", "confidence", "message", "path", "line", "node_id", "context")


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    tier: int
    confidence: float
    make: Callable[[dict, dict], DataFrame]
    requires_ast: bool = True
    is_node_rule: bool = True


RULES: dict[str, Rule] = {}


def rule(id_: str, severity: str, tier: int, confidence: float, ast: bool = True, node: bool = True):
    """Registers a function of (relations, parameters) to a DataFrame with node_id, message, line and context."""

    def keep(f):
        RULES[id_] = Rule(id_, severity, tier, confidence, f, ast, node)
        return f

    return keep


def _hits(r: dict, kind: str, where: Column | None = None) -> DataFrame:
    f = r["facts"].where(F.col("kind") == kind)
    return f if where is None else f.where(where)


def _out(df: DataFrame, message: Column | str, context: Column | str, line: Column | str = "line") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("node_id", lit(message).alias("message"), (F.col(line) if isinstance(line, str) else line).cast("int").alias("line"), lit(context).alias("context"), *(c for c in ("severity", "tier", "confidence") if c in df.columns))


@rule("Q001", "MAJOR", 2, 0.95)
def select_star(r, p):
    hit = _hits(r, "star", None if p.get("strict_star") else F.col("ok")).dropDuplicates(["node_id", "line"])
    return _out(hit, "all columns are selected", F.concat_ws(":", F.lit("Q001"), "detail", F.col("line").cast("string")))


@rule("Q002", "CRITICAL", 1, 1.0, ast=False)
def missing_key(r, p):
    m = r["models"].select("node_id", "name", F.col("yml").isNotNull().alias("has_yaml"), F.from_json(F.coalesce(F.element_at("yml.meta", "primary_key"), F.lit("[]")), "array<string>").alias("many"), F.element_at("yml.meta", "primary_key").alias("one"))
    m = m.withColumn("primary_key", F.when(F.col("many").isNotNull(), F.col("many")).otherwise(F.array("one")))
    bad = R.missing_keys(m, r["columns"])
    k = F.col("problem")
    bad = bad.withColumns({"severity": F.when(k == "no_key", "MINOR").otherwise("CRITICAL"), "tier": F.when(k == "no_key", 2).otherwise(1), "confidence": F.when(k == "no_key", 0.7).when(k == "not_listed", 0.8).otherwise(1.0)})
    return _out(bad, F.concat(F.lit("primary key: "), k), F.concat_ws(":", F.lit("Q002"), "column", k), F.lit(1))


@rule("Q003", "MAJOR", 2, 0.95)
def complex_model(r, p):
    warn, block = p.get("warn", 15), p.get("block", 30)
    own = F.col("cc") if p.get("include_jinja", True) else F.greatest(F.lit(1), F.col("cc") - F.col("jinja_ifs") - F.col("jinja_fors"))
    c = r["complexity"].withColumn("cc", own).where((F.col("cc") >= warn) & ~X.matches_any(F.col("node_id"), p.get("exempt_models", [])))
    parts = ("case_arms", "join_count", "boolean_ops", "set_op_arms", "subqueries", "iff_count", "jinja_ifs", "jinja_fors")
    top = F.slice(F.sort_array(F.filter(F.array(*(F.struct(F.col(k).cast("int").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(parts))), lambda x: x["n"] > 0), asc=False), 1, 3)
    c = c.withColumns({"severity": F.when(F.col("cc") >= block, "CRITICAL").otherwise("MAJOR"), "tier": F.when(F.col("cc") >= block, 1).otherwise(2)})
    return _out(c, F.concat(F.lit("complexity "), F.col("cc").cast("string"), F.lit(": "), F.array_join(F.transform(top, lambda x: F.concat(x["k"], F.lit("="), x["n"].cast("string"))), ", ")), F.concat(F.lit("Q003:"), F.col("cc").cast("string")), F.lit(1))


@rule("Q004", "MINOR", 2, 0.95, ast=False, node=False)
def no_description(r, p):
    return _out(r["models"].where("trim(coalesce(yml.description, '')) = ''"), "no description", "Q004", F.lit(1))


def _outer(r: dict) -> DataFrame:
    """Projections of each model's first outermost select."""
    pr = _hits(r, "projection", ~F.col("in_cte"))
    return pr.withColumn("_d", F.min("depth").over(W.partitionBy("node_id"))).where("depth = _d").drop("_d")


@rule("Q005", "MINOR", 2, 0.85)
def undocumented_column(r, p):
    pre = p.get("ignore_prefixes", ["_"])
    skip = F.lit(False)
    for x in pre:
        skip = skip | F.col("name").startswith(x)
    known = r["columns"].select("node_id", F.lower("name").alias("low")).distinct()
    withyml = r["models"].where("yml is not null").select("node_id")
    bad = _outer(r).where((F.col("name") != "") & (F.col("name") != "*") & ~skip).withColumn("low", F.lower("name")).join(known, ["node_id", "low"], "left_anti").join(withyml, "node_id", "left_semi")
    bad = G.first_of(bad, ["node_id", "low"], ["n", "line"])
    w = W.partitionBy("node_id")
    ranked = bad.withColumn("k", F.row_number().over(w.orderBy("n", "low"))).withColumn("all", F.count(F.lit(1)).over(w))
    few = _out(ranked.where("k <= 15"), F.concat(F.lit("no description of column "), "name"), F.concat(F.lit("Q005:"), "name"))
    rest = _out(ranked.where("k = 16"), F.concat((F.col("all") - 15).cast("string"), F.lit(" more columns without a description")), "Q005:more", F.lit(1))
    return few.unionByName(rest)


@rule("Q006", "MAJOR", 1, 0.95, ast=False, node=False)
def naming(r, p):
    return _out(R.bad_names(r["layers"], p.get("prefixes") or R.PREFIXES), F.concat(F.lit("name doesn't fit layer "), "layer"), "Q006", F.lit(1))


@rule("Q007", "MINOR", 2, 0.8)
def casing(r, p):
    low, up = F.col("name").rlike("^[a-z0-9_]+$"), F.col("name").rlike("[A-Z]") & F.col("name").rlike("[a-z]") & ~F.col("name").contains("_")
    g = _outer(r).where("name not in ('', '*')").groupBy("node_id").agg(F.array_sort(F.collect_set(F.when(low, F.col("name")))).alias("snake"), F.array_sort(F.collect_set(F.when(up, F.col("name")))).alias("camel"))
    g = g.where("size(snake) > 0 and size(camel) > 0").withColumn("few", F.when(F.size("camel") <= F.size("snake"), F.col("camel")).otherwise(F.col("snake")))
    return _out(g, F.concat(F.lit("mixed casing: "), F.array_join(F.slice("few", 1, 5), ", ")), "Q007", F.lit(1))


@rule("P001", "CRITICAL", 1, 0.95)
def cross_join(r, p):
    hit = _hits(r, "cross").withColumn("confidence", F.when(F.col("detail") == "explicit", 0.95).otherwise(0.85))
    return _out(hit, F.concat(F.lit("cross join with "), "name"), F.concat_ws(":", F.lit("P001"), "name", F.col("line").cast("string")))


for _id, _kind, _sev, _tier, _conf, _msg in (
    ("P002", "wrapped", "MAJOR", 2, 0.75, "a function wraps a column in WHERE"),
    ("P003", "self_inequality", "CRITICAL", 1, 0.85, "self join by inequality only"),
    ("P004", "unbounded", "MAJOR", 2, 0.85, "window frame without bounds"),
    ("P005", "distinct_over", "MAJOR", 2, 0.9, "COUNT(DISTINCT) over a window"),
    ("P006", "fan_out", "CRITICAL", 1, 0.6, "join without a key column"),
    ("P007", "order", "MINOR", 2, 0.85, "ORDER BY without LIMIT in a subquery"),
    ("R003", "single_use_cte", "MINOR", 2, 0.8, "CTE is used once"),
    ("R004", "dead_cte", "MAJOR", 2, 0.95, "CTE is never used"),
):
    _more = () if _id in ("R003", "R004") else ("line",)  # of a CTE there is one; other findings of a file differ by place
    rule(_id, _sev, _tier, _conf)(lambda r, p, k=_kind, m=_msg, i=_id, more=_more: _out(_hits(r, k), m, F.concat_ws(":", F.lit(i), "name", *more)))


@rule("P008", "MINOR", 2, 0.8)
def many_ctes(r, p):
    return _out(_hits(r, "with", F.col("n") > p.get("max_depth", 8)), "too many CTEs", F.concat(F.lit("P008:"), F.col("n").cast("string")))


def _setting(name: str) -> Column:
    source = F.nullif(F.regexp_extract("content", rf"\b{name}\s*=\s*['\"]?([\w+]+)", 1), F.lit(""))
    return F.coalesce(F.element_at("yml.config", name), source)


@rule("P009", "MINOR", 2, 0.85, ast=False, node=False)
def popular_view(r, p):
    n = G.fan_out(r["edges"]).where(F.col("n") > p.get("threshold", 5))
    return _out(r["models"].where(_setting("materialized") == "view").join(n, "node_id"), "a view has many children", F.concat(F.lit("P009:"), F.col("n").cast("string")), F.lit(1))


@rule("P010", "CRITICAL", 1, 0.9, ast=False, node=False)
def incremental_key(r, p):
    lost = F.array_compact(F.array(*(F.when(_setting(k).isNull() & ~F.col("content").rlike(rf"\b{k}\s*="), k) for k in ("unique_key", "incremental_strategy"))))
    m = r["models"].where(_setting("materialized") == "incremental").withColumn("lost", lost).where("size(lost) > 0")
    return _out(m, F.concat(F.lit("incremental without "), F.array_join("lost", ", ")), F.concat(F.lit("P010:"), F.array_join("lost", ",")), F.lit(1))


@rule("R001", "MAJOR", 1, 0.85, node=False)
def near_duplicates(r, p):
    """Pairs of models whose sets of three-token shingles agree by at least the threshold: an exact join of the sets' prefixes.

    Shingles are 64-bit hashes. In each set they are put in order of how many models have them, then of the hash; two sets that agree
    by t share one of their first n - ceil(t n) + 1, so only these are joined, without those of one model, and every pair so found
    is compared in full. Texts are cut once, into a checkpoint, and no join may be a broadcast: sizes are unknown after explode.
    """
    t = float(p.get("threshold", 0.85))
    tokens = F.filter(F.split(F.lower("sql"), r"\W+"), lambda x: x != "")
    one = F.transform(F.sequence(F.lit(0), F.size("t") - 3), lambda i: F.xxhash64(F.get("t", i), F.get("t", i + 1), F.get("t", i + 2)))
    text = r["parsed"].where("parse_ok").select("node_id", "sql").repartition("node_id").select("node_id", tokens.alias("t"))
    sh = materialized(text.select(F.monotonically_increasing_id().alias("id"), "node_id", F.when(F.size("t") >= 6, F.array_distinct(one)).alias("s")))
    e = sh.select("id", F.size("s").alias("n"), F.explode("s").alias("x")).withColumn("c", F.count(F.lit(1)).over(W.partitionBy("x"))).where("c > 1")
    e = e.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("o")).withColumn("first", F.col("n") - F.size("o"))
    prefix = F.slice("o", F.lit(1), F.greatest(F.lit(0), (F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1 - F.col("first")).cast("int")))
    pre = materialized(e.select("id", "n", "first", F.posexplode(prefix).alias("i", "v")).select("id", "n", (F.col("n") - F.col("first") - F.col("i")).alias("rest"), F.col("v.x").alias("x")))
    a, b = (pre.select("x", F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("rest").alias(f"r{k}")) for k in "ab")
    # of a pair's first common shingle the overlap is bounded by what follows in each set
    least = (F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-9
    found = a.join(b.hint("merge"), "x").where((F.col("a") < F.col("b")) & (F.least("ra", "rb") >= least)).select("a", "b").distinct()
    for k in "ab":
        found = found.join(sh.select(F.col("id").alias(k), F.col("node_id").alias(f"node_{k}"), F.col("s").alias(f"s{k}")).hint("merge"), k)
    pairs = found.select("node_a", "node_b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("k"))
    pairs = pairs.withColumn("sim", F.col("k") / (F.col("n") - F.col("k"))).where(F.col("sim") >= t)
    both = pairs.select("sim", F.explode(F.array(*(F.struct(F.col(x).alias("node_id"), F.col(y).alias("o")) for x, y in (("node_a", "node_b"), ("node_b", "node_a"))))).alias("p")).select("p.*", "sim")
    return _out(both.withColumn("confidence", F.col("sim")), F.concat(F.lit("nearly the same as "), "o"), F.concat(F.lit("R001:"), "o"), F.lit(1))


@rule("R002", "MAJOR", 2, 0.85)
def god_model(r, p):
    c = _hits(r, "with", F.col("depth") == 0).groupBy("node_id").agg(F.max("n").alias("ctes"))
    n = _outer(r).groupBy("node_id").agg(F.count(F.lit(1)).alias("cols"))
    hit = c.join(n, "node_id").join(r["complexity"].select("node_id", "cc"), "node_id").where((F.col("ctes") > p.get("ctes", 6)) & (F.col("cols") > p.get("columns", 30)) & (F.col("cc") >= p.get("cc", 25)))
    return _out(hit, "a model that does too much", F.concat_ws(":", F.lit("R002"), F.col("cc").cast("string")), F.lit(1))


def _repeated(df: DataFrame, text: str, rule_id: str, what: str) -> DataFrame:
    g = df.groupBy(F.md5(text).alias("h")).agg(F.array_sort(F.collect_set("node_id")).alias("ids")).where("size(ids) >= 3")
    g = g.withColumn("node_id", F.get("ids", 0))
    return _out(g, F.concat(F.lit(f"{what} also in "), F.array_join(F.slice("ids", 2, 3), ", ")), F.concat(F.lit(f"{rule_id}:"), "h"), F.lit(1))


@rule("R005", "MINOR", 2, 0.75, node=False)
def repeated_expression(r, p):
    return _repeated(_outer(r).where(F.length("detail") >= 40), "detail", "R005", "expression")


@rule("R006", "MINOR", 2, 0.75, node=False)
def repeated_case(r, p):
    return _repeated(_hits(r, "case", F.col("n") >= 3), "name", "R006", "CASE")


@rule("A001", "MAJOR", 1, 0.95, ast=False, node=False)
def layer_violation(r, p):
    v = G.layer_violations(r["edges"], r["layers"], p.get("allowed") or G.ALLOWED)
    return _out(v.withColumn("node_id", F.col("child")), F.concat("child_layer", F.lit(" reads "), "parent_layer", F.lit(": "), "parent"), F.concat(F.lit("A001:"), "parent"), F.lit(1))


@rule("A002", "MAJOR", 2, 0.9, ast=False, node=False)
def wide_fan_in(r, p):
    return _out(G.fan_in(r["edges"]).where(F.col("n") > p.get("threshold", 15)), "too many parents", F.concat(F.lit("A002:"), F.col("n").cast("string")), F.lit(1))


@rule("A003", "MAJOR", 1, 0.95, ast=False)
def source_bypass(r, p):
    return _out(r["layers"].where("size(sources) > 0 and layer not in ('source', 'staging')"), "reads a source past staging", "A003", F.lit(1))


@rule("A004", "CRITICAL", 1, 1.0, ast=False, node=False)
def cycle(r, p):
    c = G.cycles_of(r["edges"]).withColumnRenamed("cycle_id", "node_id")
    return _out(c, F.concat(F.lit("cycle: "), F.array_join("members", " -> ")), F.concat(F.lit("A004:"), F.array_join("members", ",")), F.lit(1))


@rule("A005", "MINOR", 2, 0.7)
def leaky_staging(r, p):
    st = r["layers"].where("layer = 'staging'").select("node_id")
    return _out(_outer(r).join(st, "node_id", "left_semi").where("name not in ('', '*') and not rlike(name, '^[a-z0-9_]+$')"), F.concat(F.lit("staging column isn't snake case: "), "name"), F.concat(F.lit("A005:"), "name"))


@rule("T001", "MAJOR", 1, 1.0, ast=False, node=False)
def unexecuted(r, p):
    return _out(R.unexecuted_tests(r["results"]), F.coalesce(F.concat(F.lit("test wasn't run: "), "test_name"), F.concat(F.col("n").cast("string"), F.lit(" tests, none was run"))), F.concat(F.lit("T001:"), F.coalesce("test_name", F.lit("all"))), F.lit(1))


@rule("T002", "MINOR", 2, 0.9, ast=False)
def no_unit_test(r, p):
    v = p.get("dbt_version")
    old = not v or tuple(int(x) for x in str(v).split(".")[:2]) < (1, 8)
    unit = r["results"].where("kind = 'UNIT'").select(F.col("model").alias("node_id"))
    m = r["models"].where(F.lit(not old) & ~F.array_contains(F.split("path", "/"), "staging") & ~X.matches_any(F.col("node_id"), p.get("exempt_models", [])))
    return _out(m.join(unit, "node_id", "left_anti"), "no unit test", "T002", F.lit(1))


@rule("T003", "MAJOR", 2, 1.0, ast=False, node=False)
def malformed_unit_test(r, p):
    return _out(r["results"].where("kind = 'UNIT' and malformed_reason is not null").withColumn("node_id", F.col("model")), F.concat(F.lit("unit test: "), "malformed_reason"), F.concat(F.lit("T003:"), "test_name"), F.lit(1))


PII = ("ssn", "social_security\\w*", "email(_address)?", "phone(_number)?", "date_of_birth|dob", "passport\\w*", "credit_card\\w*", "first_name", "last_name|surname", "(home_|street_)?address", "ip_address")


@rule("S001", "CRITICAL", 1, 0.75)
def unmasked(r, p):
    hit = _outer(r).where(F.col("ok") & F.lower("name").rlike("^(" + "|".join(PII) + ")$")).withColumn("low", F.lower("name"))
    hit = G.first_of(hit, ["node_id", "low"], ["line", "n"])
    return _out(hit, F.concat(F.lit("personal data unmasked: "), "name"), F.concat(F.lit("S001:"), "low"))


SECRETS = (("aws_access_key", r"AKIA[0-9A-Z]{16}"), ("github_token", r"gh[pousr]_[0-9A-Za-z]{36}"), ("stripe_key", r"sk_live_[0-9A-Za-z]{24,}"), ("jwt", r"eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}"))


@rule("S002", "BLOCKER", 1, 0.95)
def secret(r, p):
    kind = F.lit(None).cast("string")
    if p.get("high_entropy"):
        kind = F.when(F.col("name").rlike(r"^[0-9A-Za-z+/_=-]{40,}$"), "high_entropy")
    for name, pattern in reversed(SECRETS):
        kind = F.when(F.col("name").rlike(pattern), name).otherwise(kind)
    return _out(_hits(r, "literal").withColumn("secret", kind).where("secret is not null"), F.concat(F.lit("secret in the text: "), "secret"), F.concat(F.lit("S002:"), "secret"))


@rule("G001", "MINOR", 2, 0.95, ast=False, node=False)
def no_owner(r, p):
    return _out(R.ownerless(r["models"].withColumn("meta", F.col("yml.meta"))), "no owner", "G001", F.lit(1))


def run_rules(r: dict, settings: dict[str, dict] | None = None, crashed: dict[str, str] | None = None) -> DataFrame:
    """The findings of all enabled rules; rules that need a tree see only models that were parsed.

    A rule whose function raises, or gives columns that can't be resolved, is left out and named in `crashed`, if that is given.
    """
    settings = settings or {}
    out = None
    for k, (i, x) in enumerate(RULES.items()):
        s = settings.get(i, {})
        if not s.get("enabled", True):
            continue
        try:
            f = x.make(r, s.get("params", {}))
            for c, v in (("severity", x.severity), ("tier", x.tier), ("confidence", x.confidence)):
                if c not in f.columns:
                    f = f.withColumn(c, F.lit(v))
            f = f.select(F.lit(i).alias("rule_id"), "severity", F.col("tier").cast("int").alias("tier"), F.col("confidence").cast("double").alias("confidence"), "message", "line", "node_id", "context", F.lit(k).alias("rule_ord"))
        except Exception as e:  # whatever a rule does wrong, the others still count
            if crashed is None:
                raise
            crashed[i] = f"{type(e).__name__}: {str(e).strip().split(chr(10))[0][:200]}"
            continue
        out = f if out is None else out.unionByName(f)
    if out is None:
        if not crashed:
            raise ValueError("no rule is enabled")
        out = r["models"].sparkSession.createDataFrame([], "rule_id string, severity string, tier int, confidence double, message string, line int, node_id string, context string, rule_ord int")
    return out.join(r["models"].select("node_id", "path"), "node_id", "left").fillna({"path": "manifest.json"})


def metadata(spark) -> DataFrame:
    """(rule_id, severity, tier, confidence, requires_ast, is_node_rule) of every rule."""
    return spark.createDataFrame([(x.id, x.severity, x.tier, x.confidence, x.requires_ast, x.is_node_rule) for x in RULES.values()], "rule_id string, severity string, tier int, confidence double, requires_ast boolean, is_node_rule boolean")
