"""Coverage dimensions, facts first: (dimension, node_id, covered, total) of each model, then one rollup.

Inputs: models(node_id, ...), columns(node_id, name, description, n_tests), results(model, column_name, test_name,
test_kind, kind, status, <order columns>), complexity(node_id, cc, parse_ok).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.functions import exprs as X

DIMENSIONS = ("test", "doc", "column_test", "column_test_meaningful", "test_meaningful", "test_weighted_cc", "test_unit", "test_unit_weighted_cc", "complexity")
EMPTY_RATIO = {"test": 1.0, "doc": 1.0, "column_test": 1.0}


def _fact(df: DataFrame, dimension: str, covered, total) -> DataFrame:
    return df.select(F.lit(dimension).alias("dimension"), "node_id", covered.cast("double").alias("covered"), total.cast("double").alias("total"))


def declared(models: DataFrame, columns: DataFrame) -> DataFrame:
    """Each model with what its columns declare: one aggregation that the declared dimensions share."""
    described = F.coalesce(F.trim("description"), F.lit("")) != ""
    per = columns.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if(F.col("n_tests") > 0).alias("n_tested"),
        F.count_if(described).alias("n_described"),
    )
    return models.join(per, "node_id", "left").fillna(0, ["n_columns", "n_tested", "n_described"])


def test(d: DataFrame) -> DataFrame:
    return _fact(d, "test", ((F.col("n_tested") > 0) | (F.col("n_model_tests") > 0)).cast("int"), F.lit(1))


def doc(d: DataFrame) -> DataFrame:
    own = (F.coalesce(F.trim("description"), F.lit("")) != "").cast("int")
    return _fact(d, "doc", F.when(F.col("has_yaml"), own + F.col("n_described")).otherwise(0), F.when(F.col("has_yaml"), 1 + F.col("n_columns")).otherwise(1))


def column_test(d: DataFrame) -> DataFrame:
    return _fact(d.where("n_columns > 0"), "column_test", F.col("n_tested"), F.col("n_columns"))


def worst(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the results that share the keys the one of worst status, the first in order of them; combines before the shuffle."""
    pick = F.min(F.struct((-X.status_rank(F.col("status"))).alias("r"), *order, "status", "test_kind")).alias("b")
    return results.groupBy(*keys).agg(pick).select(*keys, F.col("b.status").alias("status"), F.col("b.test_kind").alias("test_kind"))


def passing(deduped: DataFrame, results: DataFrame) -> DataFrame:
    """Drops what doesn't pass, if any result has a known status at all."""
    known = results.agg(F.coalesce(F.bool_or(F.col("status") != "UNKNOWN"), F.lit(False)).alias("_known"))
    return deduped.crossJoin(F.broadcast(known)).where("not _known or status = 'PASS'").drop("_known")


def best_weights(results: DataFrame, order: list[str], weights: dict | None = None, classes: dict | None = None) -> DataFrame:
    """(node_id, weight): the weight of each model's best passing data test; classes: the user's globs of kinds by class."""
    data = results.where("kind <> 'UNIT'")
    ok = passing(worst(data, ["test_name", "model"], order), data)
    return ok.where("model is not null").groupBy(F.col("model").alias("node_id")).agg(F.max(X.class_weight(X.test_class(F.col("test_kind"), **(classes or {})), weights)).alias("weight"))


def test_meaningful(models: DataFrame, weights: DataFrame, least: float = X.WEIGHTS["LOGICAL"]) -> DataFrame:
    j = models.select("node_id").join(weights, "node_id", "left")
    return _fact(j, "test_meaningful", (F.coalesce("weight", F.lit(0.0)) >= least).cast("int"), F.lit(1))


def test_weighted_cc(models: DataFrame, complexity: DataFrame, weights: DataFrame) -> DataFrame:
    j = models.select("node_id").join(complexity.select("node_id", "cc"), "node_id", "left").join(weights, "node_id", "left")
    cc = F.coalesce("cc", F.lit(1))
    return _fact(j, "test_weighted_cc", F.coalesce("weight", F.lit(0.0)) * cc, cc)


def column_test_meaningful(columns: DataFrame, results: DataFrame, order: list[str], weights: dict | None = None, classes: dict | None = None) -> DataFrame:
    data = results.where("kind <> 'UNIT'")
    named = data.where("coalesce(column_name, '') <> ''").withColumn("col", F.lower("column_name"))
    ok = passing(worst(named, ["model", "col", "test_name"], order), data)
    good = ok.where(X.class_weight(X.test_class(F.col("test_kind"), **(classes or {})), weights) >= (weights or X.WEIGHTS)["LOGICAL"]).select(F.col("model").alias("node_id"), "col", F.lit(1).alias("hit")).distinct()
    per = columns.withColumn("col", F.lower("name")).join(good, ["node_id", "col"], "left").groupBy("node_id").agg(F.count("hit").alias("c"), F.count(F.lit(1)).alias("t"))
    return _fact(per, "column_test_meaningful", F.col("c"), F.col("t"))


def test_unit(models: DataFrame, results: DataFrame) -> DataFrame:
    has = results.where("kind = 'UNIT'").select(F.col("model").alias("node_id")).distinct().withColumn("hit", F.lit(1))
    return _fact(models.select("node_id").join(has, "node_id", "left"), "test_unit", F.coalesce("hit", F.lit(0)), F.lit(1))


def test_unit_weighted_cc(models: DataFrame, complexity: DataFrame, results: DataFrame, simple: int = 3) -> DataFrame:
    unit = results.where("kind = 'UNIT'")
    has = passing(unit.select("model", "status"), unit).select(F.col("model").alias("node_id")).distinct().withColumn("hit", F.lit(1))
    j = models.select("node_id").join(complexity.select("node_id", "cc"), "node_id", "left").join(has, "node_id", "left")
    cc = F.coalesce("cc", F.lit(1))
    return _fact(j, "test_unit_weighted_cc", F.when(F.col("hit").isNotNull() | (cc <= simple), cc).otherwise(0), cc)


def complexity_dim(complexity: DataFrame, warn: int = 15) -> DataFrame:
    ok = F.col("parse_ok")
    return _fact(complexity, "complexity", (ok & (F.col("cc") <= warn)).cast("int"), ok.cast("int"))


def rollup(facts: DataFrame) -> DataFrame:
    """(dimension, covered, total, ratio): counts are rounded half to even, the ratio isn't made from rounded ones."""
    empty = F.lit(0.0)
    for k, v in EMPTY_RATIO.items():
        empty = F.when(F.col("dimension") == k, v).otherwise(empty)
    g = facts.groupBy("dimension").agg(F.sum("covered").alias("c"), F.sum("total").alias("t"))
    return g.select("dimension", F.bround("c", 0).cast("bigint").alias("covered"), F.col("t").cast("bigint").alias("total"), F.when(F.col("t") > 0, F.least(F.lit(1.0), F.col("c") / F.col("t"))).otherwise(empty).alias("ratio"))


def per_node(facts: DataFrame) -> DataFrame:
    return facts.select("dimension", "node_id", F.bround("covered", 0).cast("bigint").alias("covered"), F.col("total").cast("bigint").alias("total"))


def all_facts(models: DataFrame, columns: DataFrame, results: DataFrame, complexity: DataFrame, order: list[str], dimensions: tuple[str, ...] = DIMENSIONS, cfg: dict | None = None) -> DataFrame:
    """The facts of all chosen dimensions, as one union; cfg: weights by class, globs of kinds by class, simple, warn."""
    cfg = cfg or {}
    weights = X.WEIGHTS | {k.upper(): v for k, v in (cfg.get("weights") or {}).items()}
    classes = cfg.get("classes") or {}
    d = declared(models, columns)
    w = best_weights(results, order, weights, classes)
    made = {
        "test": lambda: test(d),
        "doc": lambda: doc(d),
        "column_test": lambda: column_test(d),
        "column_test_meaningful": lambda: column_test_meaningful(columns, results, order, weights, classes),
        "test_meaningful": lambda: test_meaningful(models, w, weights["LOGICAL"]),
        "test_weighted_cc": lambda: test_weighted_cc(models, complexity, w),
        "test_unit": lambda: test_unit(models, results),
        "test_unit_weighted_cc": lambda: test_unit_weighted_cc(models, complexity, results, cfg.get("simple", 3)),
        "complexity": lambda: complexity_dim(complexity, cfg.get("warn", 15)),
    }
    frames = [made[k]() for k in dimensions if k in made]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tested_models(models: DataFrame, results: DataFrame) -> DataFrame:
    """(node_id, test_covered): whether a model has a test, by the results if there are any at all, else by its YAML.

    models(node_id, n_model_tests, n_tested).
    """
    n = results.where("model is not null").groupBy(F.col("model").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    some = results.agg((F.count(F.lit(1)) > 0).alias("some"))
    j = models.join(n, "node_id", "left").crossJoin(F.broadcast(some))
    return j.select("node_id", F.when(F.col("some"), F.coalesce("n", F.lit(0)) > 0).otherwise((F.col("n_model_tests") > 0) | (F.col("n_tested") > 0)).alias("test_covered"))


def column_differences(declared_: DataFrame, actual: DataFrame) -> DataFrame:
    """(node_id, undeclared, missing): columns that a model selects and its YAML lacks, and the other way round; letter case counts, names are sorted.

    declared_(node_id, name), actual(node_id, name).
    """
    a = declared_.groupBy("node_id").agg(F.collect_set("name").alias("d"))
    b = actual.groupBy("node_id").agg(F.collect_set("name").alias("a"))
    none = F.array().cast("array<string>")
    j = a.join(b, "node_id", "full_outer").select("node_id", F.coalesce("d", none).alias("d"), F.coalesce("a", none).alias("a"))
    return j.select("node_id", F.array_sort(F.array_except("a", "d")).alias("undeclared"), F.array_sort(F.array_except("d", "a")).alias("missing"))
