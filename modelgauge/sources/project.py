"""A project's files as DataFrames: SQL models, YAML metadata, documentation blocks, macros.

Templates are never executed.  `render` replaces a fixed vocabulary (ref, source, var, config, this, known macros,
is_incremental) and calls everything else uncertain.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.operators.graph import first_of
from modelgauge.shipping import ship

LARGEST = 10 * 1024 * 1024
PROJECT_FILES = ("dbt_project.yml", "config/dbt_project.yml", "conf/dbt_project.yml")


class ConfigError(ValueError):
    """A project or its configuration can't be used."""


def find_root(start: str) -> Path:
    at = Path(start).resolve()
    for p in (at, *at.parents):
        if any((p / f).is_file() for f in PROJECT_FILES):
            return p
    raise ConfigError(f"no project file at or above {start}")


def project_info(root: Path) -> dict:
    """Name and model folders; env_var defaults are taken, and a file that isn't YAML gives the defaults."""
    import yaml

    info = {"name": root.name, "model_paths": ["models"], "test_paths": ["tests"], "macro_paths": ["macros"], "seed_paths": ["seeds"]}
    file = next((root / f for f in PROJECT_FILES if (root / f).is_file()), None)
    if file is None:
        return info
    text = re.sub(r"\{\{\s*env_var\(\s*'[^']*'\s*(?:,\s*'([^']*)'\s*)?\)\s*\}\}", lambda m: m[1] or "", file.read_text("utf-8"))
    try:
        data = yaml.safe_load(text) or {}
    except yaml.YAMLError:
        m = re.search(r"^name:\s*['\"]?([\w-]+)", text, re.M)
        return info | ({"name": m[1]} if m else {})
    old = {"model_paths": "source-paths", "seed_paths": "data-paths"}
    for k in info:
        for key in (k.replace("_", "-"), k, old.get(k)):
            if key and data.get(key):
                info[k] = data[key]
                break
    return info


def files(spark: SparkSession, root: str, pattern: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(path relative to root, content, source_hash) of files up to 10 MiB; text that isn't UTF-8 is read as Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(str(root)).where(F.col("length") <= LARGEST)
    base = Path(root).resolve().as_posix()
    rel = F.regexp_replace(F.col("path"), "^file:/+", "/")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    out = raw.select(F.substring(rel, len(base) + 2, 1 << 20).alias("path"), text.alias("content"), F.substring(F.sha2("content", 256), 1, 16).alias("source_hash"))
    from modelgauge.functions.exprs import matches_any

    return out.where(~matches_any(F.col("path"), list(excludes)))


def models(sql: DataFrame, project: str, dirs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(models, errors): a model's id is made of its file's stem; of equal stems the first path stays."""
    under = F.lit(False)
    for d in dirs:
        under = under | F.col("path").startswith(d.rstrip("/") + "/")
    m = sql.where(under).withColumn("name", F.regexp_extract("path", r"([^/]+)\.[sS][qQ][lL]$", 1)).withColumn("node_id", F.concat(F.lit(f"model.{project}."), "name"))
    kept = first_of(m, ["node_id"], ["path"])
    lost = m.join(kept.select("path"), "path", "left_anti").select("path", F.lit("duplicate model").alias("error"))
    return kept, lost


YAML_ROW = "kind string, name string, description string, config map<string,string>, meta map<string,string>, columns array<struct<name:string,description:string,tests:array<string>,meta:map<string,string>>>, tests array<string>, path string, line int, ord int, error string"


def parse_yaml(path: str, text: str) -> list[dict]:
    """Models, sources' tables and errors of one schema file."""
    import yaml

    def flat(m: object) -> dict:
        return {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in m.items()} if isinstance(m, dict) else {}

    def names(x: dict) -> list[str]:
        out = []
        for t in x.get("tests") or x.get("data_tests") or []:
            out.append(t if isinstance(t, str) else next(iter(t), "") if isinstance(t, dict) else str(t))
        return [str(t) for t in out]

    def row(kind: str, x: dict, name: str, n: int) -> dict:
        cols = [{"name": str(c.get("name")), "description": c.get("description"), "tests": names(c), "meta": flat(c.get("meta"))} for c in x.get("columns") or [] if isinstance(c, dict) and c.get("name")]
        found = re.search(rf"^\s*-\s*name:\s*['\"]?{re.escape(name.split('.')[-1])}\b", text, re.M)
        return {"kind": kind, "name": name, "description": x.get("description"), "config": flat(x.get("config")), "meta": flat(x.get("meta") or (x.get("config") or {}).get("meta")), "columns": cols, "tests": names(x), "path": path, "line": text[: found.start()].count("\n") + 1 + text[found.start() : found.end()].startswith("\n") if found else 1, "ord": n, "error": None}

    try:
        data = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        return [{"kind": "error", "name": None, "description": None, "config": {}, "meta": {}, "columns": [], "tests": [], "path": path, "line": 1, "ord": 0, "error": str(e).split("\n")[0]}]
    out: list[dict] = []
    if isinstance(data, dict):
        for m in data.get("models") or []:
            if isinstance(m, dict) and m.get("name"):
                out.append(row("model", m, str(m["name"]), len(out)))
        for s in data.get("sources") or []:
            for t in (s.get("tables") or []) if isinstance(s, dict) else []:
                if isinstance(t, dict) and t.get("name"):
                    out.append(row("source", t, f"{s.get('name')}.{t['name']}", len(out)))
        for x in data.get("exposures") or []:
            if isinstance(x, dict) and x.get("name"):
                out.append(row("exposure", x | {"meta": {"depends_on": x.get("depends_on"), "type": x.get("type"), **(x.get("meta") or {})}}, str(x["name"]), len(out)))
    return out


def _yaml(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in YAML_ROW.replace("map<string,string>", "m").replace("array<struct<name:string,description:string,tests:array<string>,meta:m>>", "c").split(", ")]
    for f in frames:
        rows = [r for p, t in zip(f["path"], f["content"]) for r in parse_yaml(p, t)]
        yield pd.DataFrame(rows, columns=names)


def schema_rows(yml: DataFrame) -> DataFrame:
    ship(yml.sparkSession)
    keep = yml.where(~F.regexp_like("path", F.lit(r"(^|/)dbt_project\.ya?ml$")))
    return keep.select("path", "content").mapInPandas(_yaml, YAML_ROW)


def link(m: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models with their YAML, errors): the first YAML of a name wins; YAML without a model is an error."""
    own = rows.where("kind = 'model'")
    kept = first_of(own, ["name"], ["path", "ord"])
    y = kept.select("name", F.struct("description", "config", "meta", "columns", "tests", F.col("path").alias("yml_path"), F.col("line").alias("yml_line")).alias("yml"))
    twice = own.join(kept.select("name", "path", "ord"), ["name", "path", "ord"], "left_anti").select("path", F.lit("duplicate YAML").alias("error"))
    alone = kept.join(m.select("name"), "name", "left_anti").select("path", F.lit("YAML without a model").alias("error"))
    bad = rows.where("kind = 'error'").select("path", "error")
    return m.join(y, "name", "left"), twice.unionByName(alone).unionByName(bad)


def doc_blocks(md: DataFrame) -> DataFrame:
    """(name, text, path): the last block of a name wins."""
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(r"(?s)\{%-?\s*docs\s+(\w+)\s*-?%\}(.*?)\{%-?\s*enddocs\s*-?%\}"), F.lit(1)).alias("name"), F.regexp_extract_all("content", F.lit(r"(?s)\{%-?\s*docs\s+(\w+)\s*-?%\}(.*?)\{%-?\s*enddocs\s*-?%\}"), F.lit(2)).alias("text"))
    e = md.select("path", F.posexplode(pairs).alias("pos", "d")).select("path", "pos", "d.name", F.trim("d.text").alias("text"))
    return e.groupBy("name").agg(F.max(F.struct("path", "pos", "text")).alias("b")).select("name", "b.text", "b.path")


def macros(sql: DataFrame) -> DataFrame:
    return sql.select(F.explode(F.regexp_extract_all("content", F.lit(r"\{%-?\s*macro\s+(\w+)\s*\("), F.lit(1))).alias("name")).distinct()


_STR = r"""['"]([^'"]*)['"]"""
_INCREMENTAL = re.compile(r"\{%-?\s*if\s+is_incremental\(\)\s*-?%\}(.*?)(?:\{%-?\s*else\s*-?%\}(.*?))?\{%-?\s*endif\s*-?%\}", re.S)


def render(source: str, known: set[str] = frozenset()) -> tuple[str, bool, list[str], list[list[str]]]:
    """(sql, uncertain, refs, sources); lines stay where they were."""
    word = lambda s: re.sub(r"\W", "_", s)
    lines = lambda s: "\n" * s.count("\n")
    text = re.sub(r"\{#.*?#\}", lambda m: lines(m[0]), source, flags=re.S)
    refs = list(dict.fromkeys(re.findall(rf"\bref\(\s*(?:{_STR}\s*,\s*)?{_STR}[^)]*\)", text) and [m[1] for m in re.findall(rf"\bref\(\s*(?:{_STR}\s*,\s*)?{_STR}[^)]*\)", text)]))
    sources = list(dict.fromkeys(re.findall(rf"\bsource\(\s*{_STR}\s*,\s*{_STR}\s*\)", text)))
    out = _INCREMENTAL.sub(lambda m: lines(m[0]) if m[2] is None else lines(m[0][: m.start(2) - m.start()]) + m[2] + lines(m[0][m.end(2) - m.start() :]), text)
    if re.search(r"\{%", re.sub(r"\{%-?\s*(?:set|do)\s+config.*?%\}", "", out, flags=re.S)):
        return source, True, refs, [list(s) for s in sources]
    doubt = False

    def value(m: re.Match) -> str:
        nonlocal doubt
        e = m[1].strip().strip("-").strip()
        if r := re.fullmatch(rf"ref\(\s*(?:{_STR}\s*,\s*)?{_STR}[^)]*\)", e):
            return f"__REF_{word(r[2])}__" + lines(m[0])
        if r := re.fullmatch(rf"source\(\s*{_STR}\s*,\s*{_STR}\s*\)", e):
            return f"__SRC_{word(r[1])}_{word(r[2])}__" + lines(m[0])
        if e.startswith("config("):
            return lines(m[0])
        if r := re.fullmatch(rf"var\(\s*{_STR}\s*(?:,\s*(?:{_STR}|([\w.]+))\s*)?\)", e):
            return (r[2] if r[2] is not None else r[3] or f"__VAR_{word(r[1])}__") + lines(m[0])
        if e == "this":
            return "__THIS__"
        if (r := re.match(r"(\w+)\(", e)) and r[1] in known:
            return f"__MACRO_{r[1]}__" + lines(m[0])
        doubt = True
        return m[0]

    out = re.sub(r"\{\{(.*?)\}\}", value, out, flags=re.S)
    return (source if doubt else out), doubt, refs, [list(s) for s in sources]


def _render(known: set[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [render(c, known) for c in f["content"]]
            yield pd.DataFrame({"node_id": f["node_id"], "sql": [g[0] for g in got], "uncertain": [g[1] for g in got], "refs": [g[2] for g in got], "sources": [[".".join(s) for s in g[3]] for g in got]})

    return run


def rendered(m: DataFrame, known: set[str]) -> DataFrame:
    """Models with sql, uncertain, refs, sources."""
    ship(m.sparkSession)
    r = m.select("node_id", "content").mapInPandas(_render(known), "node_id string, sql string, uncertain boolean, refs array<string>, sources array<string>")
    return m.join(r, "node_id")


def with_compiled(m: DataFrame, compiled: DataFrame) -> DataFrame:
    """Compiled text, where there is any, in place of rendered text; refs and sources stay those of the template."""
    c = compiled.select("path", F.col("content").alias("_c"))
    return m.join(c, "path", "left").withColumn("mode", F.when(F.col("_c").isNull(), "MOCK").otherwise("COMPILED")).withColumn("sql", F.coalesce("_c", "sql")).withColumn("uncertain", F.col("uncertain") & F.col("_c").isNull()).drop("_c")


def compiled_folder(root: Path, project: str, given: str | None = None) -> Path | None:
    """Where compiled models are: the folder that is given, else target/compiled/<project>, else target/compiled."""
    for p in ([Path(given)] if given else []) + [root / "target" / "compiled" / project, root / "target" / "compiled"]:
        p = p if p.is_absolute() else root / p
        if p.is_dir():
            return p
    return None


def select_renderer(m: DataFrame, compiled: DataFrame | None, mode: str = "AUTO", least: float = 0.5) -> tuple[DataFrame, str, float]:
    """(models with mode, the mode, the share of models with a compiled text).

    COMPILED takes compiled texts and renders what has none; AUTO is COMPILED if the share is at least `least`.
    """
    if mode not in ("AUTO", "COMPILED", "MOCK"):
        raise ConfigError(f"render.mode is {mode}")
    ratio = 0.0
    if compiled is not None and mode != "MOCK":
        both = with_compiled(m, compiled)
        n = both.agg(F.count(F.lit(1)), F.count_if(F.col("mode") == "COMPILED")).first()
        ratio = n[1] / n[0] if n[0] else 0.0
        if mode == "COMPILED" or ratio >= least:
            return both, "COMPILED", ratio
    return m.withColumn("mode", F.lit("MOCK")), "MOCK", ratio


def dominant_mode(m: DataFrame) -> str:
    """The mode that most models have; MOCK without any model."""
    row = m.groupBy("mode").count().orderBy(F.col("count").desc(), "mode").first()
    return row["mode"] if row else "MOCK"


def seeds(spark: SparkSession, root: str, dirs: list[str]) -> DataFrame:
    """(node name, path, source_hash) of the CSV files in the seed folders."""
    csv = files(spark, root, "*.csv")
    under = F.lit(False)
    for d in dirs:
        under = under | F.col("path").startswith(d.rstrip("/") + "/")
    return csv.where(under).select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("name"), "path", "source_hash")
