"""Rules that need only metadata: names, descriptions, keys, owners, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIXES = {"staging": ("stg_",), "intermediate": ("int_",), "mart": ("fct_", "dim_")}


def bad_names(classified: DataFrame, prefixes: dict[str, tuple[str, ...]] = PREFIXES) -> DataFrame:
    """Models of a layer with prefixes whose name has none of them."""
    bad = F.lit(False)
    for layer, starts in prefixes.items():
        good = F.lit(False)
        for s in starts:
            good = good | F.col("name").startswith(s)
        bad = F.when(F.col("layer") == layer, ~good).otherwise(bad)
    return classified.where(bad)


def missing_keys(models: DataFrame, columns: DataFrame) -> DataFrame:
    """(node_id, column, problem) of models with YAML: no key found, a key that isn't listed, or one without unique or not_null.

    models(node_id, name, has_yaml, primary_key array); columns(node_id, name, tests array of test names).  The key is primary_key,
    else a column `id`, else one `<model>_id`.
    """
    listed = columns.groupBy("node_id").agg(F.collect_set("name").alias("names"))
    j = models.where("has_yaml").join(listed, "node_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    own = F.concat("name", F.lit("_id"))
    key = F.when(F.size(F.coalesce("primary_key", F.array().cast("array<string>"))) > 0, F.col("primary_key")).when(F.array_contains("names", "id"), F.array(F.lit("id"))).when(F.array_contains("names", own), F.array(own)).otherwise(F.array().cast("array<string>"))
    k = j.withColumn("key", key)
    none = k.where("size(key) = 0").select("node_id", F.lit(None).cast("string").alias("column"), F.lit("no_key").alias("problem"))
    each = k.select("node_id", F.explode("key").alias("column"))
    t = columns.select("node_id", F.col("name").alias("column"), "tests")
    j2 = each.join(t, ["node_id", "column"], "left")
    lost = F.array_except(F.array(F.lit("unique"), F.lit("not_null")), "tests")
    problem = F.when(F.col("tests").isNull(), "not_listed").when(F.size(lost) > 0, F.concat(F.lit("missing "), F.array_join(lost, "+")))
    return none.unionByName(j2.select("node_id", "column", problem.alias("problem")).where("problem is not null"))


def unexecuted_tests(results: DataFrame) -> DataFrame:
    """(node_id, test_name, n): each unexecuted test, or one row without a node if several tests exist and none was executed."""
    t = results.where("not executed")
    s = results.agg(F.bool_or("executed").alias("any"), F.count_if(~F.col("executed")).alias("n"))
    j = t.crossJoin(F.broadcast(s))
    each = j.where("any or n = 1").select(F.col("model").alias("node_id"), "test_name", F.lit(1).cast("bigint").alias("n"))
    one = s.where("not any and n > 1").select(F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("test_name"), "n")
    return each.unionByName(one)


def ownerless(models: DataFrame) -> DataFrame:
    filled = lambda k: F.coalesce(F.trim(F.element_at("meta", k)), F.lit("")).isin("", "null", "false", '""')
    return models.where(F.col("meta").isNull() | (filled("owner") & filled("team")))
