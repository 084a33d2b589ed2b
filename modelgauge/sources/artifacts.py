"""Test artifacts: a manifest of tests and the results of a run, joined on the tests' ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.functions import exprs as X

MANIFEST = """metadata struct<dbt_schema_version: string, dbt_version: string, project_name: string>,
nodes map<string, struct<resource_type: string, unique_id: string, name: string, column_name: string, original_file_path: string, path: string,
  test_metadata: struct<name: string, namespace: string>, depends_on: struct<nodes: array<string>>>>,
unit_tests map<string, struct<unique_id: string, name: string, model: string, original_file_path: string, path: string,
  given: array<string>, expect: struct<rows: array<string>>, depends_on: struct<nodes: array<string>>>>"""
RUN = """metadata struct<dbt_schema_version: string, dbt_version: string>, results array<struct<unique_id: string, status: string, execution_time: double, message: string>>"""


class UnsupportedSchema(ValueError):
    """An artifact of a format version that is too old."""


def _checked(df: DataFrame, least: int) -> DataFrame:
    found = df.select("metadata.dbt_schema_version").first()
    number = (found and found[0] or "").rstrip("/").rsplit("/", 1)[-1].removesuffix(".json").removeprefix("v")
    if not number.isdigit() or int(number) < least:
        raise UnsupportedSchema(f"format version {number or 'unknown'} is under {least}")
    return df


def manifest_tests(spark: SparkSession, path: str) -> DataFrame:
    """(unique_id, test_name, test_kind, kind, model, column_name, path, malformed_reason)."""
    doc = _checked(spark.read.schema(MANIFEST).option("multiLine", True).json(path), 10)
    n = doc.select(F.explode("nodes").alias("id", "n")).where("n.resource_type = 'test'")
    refs = F.array_distinct(F.filter(F.coalesce("n.depends_on.nodes", F.array().cast("array<string>")), lambda x: x.startswith("model.")))
    meta = F.col("n.test_metadata")
    generic = F.when(meta["namespace"].isNotNull(), F.concat(meta["namespace"], F.lit("."), meta["name"])).otherwise(meta["name"])
    data = n.select(
        F.coalesce("n.unique_id", "id").alias("unique_id"), F.coalesce("n.name", "id").alias("test_name"), F.when(meta.isNotNull(), F.coalesce(generic, F.lit("unknown"))).otherwise("singular").alias("test_kind"),
        F.lit("DATA").alias("kind"), F.get(refs, 0).alias("model"), F.col("n.column_name").alias("column_name"), F.coalesce("n.original_file_path", "n.path").alias("path"), F.lit(None).cast("string").alias("malformed_reason"),
    )
    u = doc.select(F.explode("unit_tests").alias("id", "n"))
    unit = u.select(
        F.coalesce("n.unique_id", "id").alias("unique_id"), F.coalesce("n.name", "id").alias("test_name"), F.lit("unit_test").alias("test_kind"), F.lit("UNIT").alias("kind"), F.coalesce(F.get(refs, 0), "n.model").alias("model"),
        F.lit(None).cast("string").alias("column_name"), F.coalesce("n.original_file_path", "n.path").alias("path"), X.unit_test_defect(F.col("n.given"), F.col("n.expect"), F.col("n.expect.rows")).alias("malformed_reason"),
    )
    return data.unionByName(unit)


def run_results(spark: SparkSession, path: str, warn_passes: bool = True) -> DataFrame:
    """(unique_id, status, execution_time, message): the last entry of each test."""
    doc = _checked(spark.read.schema(RUN).option("multiLine", True).json(path), 4)
    r = doc.select(F.posexplode("results").alias("pos", "r")).where("r.unique_id like 'test.%' or r.unique_id like 'unit_test.%'")
    last = r.groupBy("r.unique_id").agg(F.max_by("r", "pos").alias("b"))
    return last.select("unique_id", X.map_status(F.col("b.status"), warn_passes).alias("status"), "b.execution_time", "b.message")


def join_results(tests: DataFrame, runs: DataFrame) -> DataFrame:
    """Tests with what ran of them; executed tells whether anything did."""
    r = runs.withColumn("_ran", F.lit(True))
    out = tests.join(r, "unique_id", "left")
    return out.withColumn("executed", F.coalesce("_ran", F.lit(False))).drop("_ran")


def test_results(spark: SparkSession, manifest: str, results: str | None) -> DataFrame:
    tests = manifest_tests(spark, manifest)
    if results is None:
        return tests.withColumn("status", F.lit("UNKNOWN")).withColumn("executed", F.lit(False))
    return join_results(tests, run_results(spark, results)).withColumn("status", F.coalesce("status", F.lit("UNKNOWN")))


LINT = "filepath string, violations array<struct<line_no: int, line_pos: int, start_line_no: int, start_line_pos: int, code: string, name: string, description: string, warning: boolean>>"


def lint_findings(spark: SparkSession, path: str, severities: dict[str, str] | None = None, root: str = "") -> DataFrame:
    """Findings of a lint report, a list or under `files`: severity by code, then by its first three characters, then MINOR."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.coalesce(F.from_json("value", f"array<struct<{LINT.replace(' string', ': string', 1).replace(' array<', ': array<', 1)}>>"), F.from_json("value", f"files array<struct<{LINT.replace(' string', ': string', 1).replace(' array<', ': array<', 1)}>>")["files"])).alias("f"))
    v = rows.select(F.col("f.filepath").alias("path"), F.explode("f.violations").alias("v"))
    line = F.greatest(F.lit(1), F.coalesce("v.start_line_no", "v.line_no", F.lit(1)))
    col = F.greatest(F.lit(1), F.coalesce("v.start_line_pos", "v.line_pos", F.lit(1)))
    sev = F.lit("MINOR")
    for code, s in sorted((severities or {}).items(), key=lambda x: len(x[0]) != 3):
        sev = F.when((F.col("v.code") == code) | ((F.length(F.lit(code)) == 3) & F.col("v.code").startswith(code)), s).otherwise(sev)
    weak = F.when(F.coalesce("v.warning", F.lit(False)) & (X.severity_rank(sev) <= 2), "MINOR").otherwise(sev)
    rel = F.when(F.lit(bool(root)) & F.col("path").startswith(root.rstrip("/") + "/"), F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")).otherwise(F.col("path"))
    out = v.select(F.concat(F.lit("SQLF."), "v.code").alias("rule_id"), weak.alias("severity"), F.lit(2).alias("tier"), F.lit(0.9).alias("confidence"), F.coalesce("v.description", "v.name").alias("message"), rel.alias("path"), line.alias("line"), col.alias("column"))
    return out.where("not startswith(path, '/')").dropDuplicates(["path", "line", "column", "rule_id"])


def tool_version(spark: SparkSession, manifest: str) -> str | None:
    """The version of the tool that wrote a manifest."""
    row = spark.read.schema(MANIFEST).option("multiLine", True).json(manifest).select("metadata.dbt_version").first()
    return row[0] if row else None


def baseline(spark: SparkSession, root: str, given: str | None = None) -> DataFrame | None:
    """(fingerprint) of the baseline file that is given, else of .modelgauge/baseline.json; None if there is none or it is no JSON of entries.

    Entries without a fingerprint are left out.
    """
    from pathlib import Path

    file = Path(given) if given else Path(root) / ".modelgauge" / "baseline.json"
    if not file.is_file():
        return None
    rows = spark.read.text(str(file), wholetext=True).select(F.from_json("value", "entries array<struct<fingerprint: string>>")["entries"].alias("e"))
    if rows.where("e is not null").isEmpty():
        return None
    return rows.select(F.explode("e.fingerprint").alias("fingerprint")).where("coalesce(fingerprint, '') <> ''").distinct()


def read(spark: SparkSession, manifest: str | None, results: str | None, lint: str | None, severities: dict | None = None, root: str = "") -> tuple[DataFrame | None, DataFrame | None, str | None, list[tuple[str, str, str]]]:
    """(test results, lint findings, tool version, [(adapter, status, message)]): an adapter that fails costs its own part only.

    Tests whose results can't be read stay, as ones that weren't executed.
    """
    tests = found = version = None
    status: list[tuple[str, str, str]] = []

    def attempt(name: str, kind: str, f):
        try:
            out = f()
            out.limit(1).count()  # what can't be read shows here, not within the scan
            return out
        except Exception as e:  # an artifact may be wrong in any way
            status.append((name, kind, f"{type(e).__name__}: {str(e).strip().split(chr(10))[0][:200]}"))
            return None

    if lint:
        found = attempt("lint", "read_failed", lambda: lint_findings(spark, lint, severities, root))
        if found is not None:
            status.append(("lint", "ok", ""))
    if manifest:
        alone = attempt("tests", "read_failed", lambda: test_results(spark, manifest, None))
        if alone is not None:
            version = tool_version(spark, manifest)
            tests = attempt("tests", "read_failed", lambda: test_results(spark, manifest, results)) if results else alone
            if tests is None:
                tests = alone
            else:
                status.append(("tests", "ok", ""))
    return tests, found, version, sorted(status)
