"""Operators on small cases, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import fnmatch
import glob
import hashlib
import math
import os
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modelgauge import queries as Q
from modelgauge.functions import exprs as X
from modelgauge.operators import findings as E
from modelgauge.operators import graph as G
from modelgauge.operators import metadata_rules as R
from modelgauge.operators import serving as K
from modelgauge.operators import tree_rules as T
from modelgauge.streaming.run_log import follow

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cur = duck.execute(Q.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda t: tuple((x is None, str(x)) for x in t)
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab/.*?[!]^", max_size=6), st.text("ab/.^", max_size=6))
def test_globs_are_those_of_the_shell(pattern, text):
    if "[" in pattern:
        return
    assert bool(re.match(X.glob_regex(pattern), text)) == fnmatch.fnmatchcase(text, pattern)


def test_fingerprint_is_a_plain_hash(spark):
    got = spark.range(1).select(X.fingerprint(F.lit("R"), F.lit("p"), F.lit("c"))).first()[0]
    assert got == hashlib.sha256(b"R\0p\0c").hexdigest()[:16]


def test_dedup_is_idempotent_and_ignores_order(spark):
    rows = [("f", i % 3, f"m{i}") for i in range(9)] + [("g", 5, "x")]
    a = spark.createDataFrame(rows, "fingerprint string, ord int, message string")
    b = spark.createDataFrame(rows[::-1], a.schema)
    one = E.dedup(a, ["ord", "message"])
    assert sorted(one.collect()) == sorted(E.dedup(b, ["ord", "message"]).collect()) == sorted(E.dedup(one, ["ord", "message"]).collect())


def test_first_override_decides_and_expired_hides_baseline(spark):
    f = spark.createDataFrame([("f1", "R1", "a.sql", "m.p.a", 1), ("f2", "R1", "b.sql", None, 1)], "fingerprint string, rule_id string, path string, node_id string, tier int")
    base = f.select("fingerprint")
    got = {r["fingerprint"]: r for r in E.apply_waivers(f, [{"id": "x", "waive": ["R*"], "models": ["a"], "expires": "2024-12-31"}, {"id": "y", "waive": ["*"], "node_ids": ["m.p.a"]}], base, "2025-01-01").collect()}
    assert got["f1"]["expired"] and not got["f1"]["suppressed"] and got["f2"]["source"] == "baseline"
    same_day = E.apply_waivers(f, [{"waive": ["R1"], "paths": ["*.sql"], "expires": "2025-01-01"}], None, "2025-01-01")
    assert same_day.where("suppressed").count() == 2


def test_closure_cycles_and_recursive_query(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("p", "q"), ("q", "r")], "parent string, child string")
    reach = G.closure(e)
    assert reach.count() == 3 * 4 + 1 + 3
    assert {(r["cycle_id"], tuple(r["members"])) for r in G.cycles(reach).collect()} == {("a", ("a", "b", "c")), ("x", ("x",))}
    tree = e.where("parent in ('p', 'q')")
    assert sorted(G.closure_sql(spark, tree).collect()) == sorted(G.closure(tree).collect())


def test_keys_owners_and_unexecuted(spark):
    m = spark.createDataFrame([("1", "a", True, None), ("2", "b", True, ["k", "z"]), ("3", "c", False, None), ("4", "d", True, None)], "node_id string, name string, has_yaml boolean, primary_key array<string>")
    c = spark.createDataFrame([("1", "id", ["unique"]), ("2", "k", ["unique", "not_null"])], "node_id string, name string, tests array<string>")
    assert {tuple(r) for r in R.missing_keys(m, c).collect()} == {("1", "id", "missing not_null"), ("2", "z", "not_listed"), ("4", None, "no_key")}
    t = spark.createDataFrame([("m", "a", False), ("m", "b", False)], "model string, test_name string, executed boolean")
    assert [tuple(r) for r in R.unexecuted_tests(t).collect()] == [(None, None, 2)]
    assert R.unexecuted_tests(t.limit(1)).count() == 1


def test_upsert_and_stream(spark, tmp_path):
    old = spark.createDataFrame([(1, "p", "running", 0.0)], "run_id bigint, project string, status string, score double")
    new = spark.createDataFrame([(1, "p", "success", 5.0), (2, "p", "failed", 1.0)], old.schema)
    assert {(r["run_id"], r["status"]) for r in K.upsert_runs(old, new).collect()} == {(1, "success"), (2, "failed")}
    runs = spark.sql("select id as run_id, 'p' as project, if(id % 2 = 0, 'failed', 'success') as status, timestamp'2025-01-01' + make_interval(0,0,0,0,cast(id as int),0,0) as started_at, 1.0D as score from range(24)")
    runs.write.parquet(str(tmp_path / "in"))
    q = follow(spark.readStream.schema(runs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 21 and got.agg(F.max("runs")).first()[0] == 1


def no_broadcast(monkeypatch, *modules):
    """The plans that are written down; none may send a side of a join to the driver, whatever its estimated size."""
    plans = []
    for m in modules:
        keep = m.materialized
        monkeypatch.setattr(m, "materialized", lambda df, keep=keep: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    return plans


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 1.0])
def test_near_duplicates_equal_brute_force_and_broadcast_nothing(spark, monkeypatch, tmp_path, threshold):
    rnd = random.Random(5)
    texts = []
    for i in range(60):  # a common head, and a tail that later models copy with few changes
        tail = list(rnd.choice(texts)) if texts and i % 3 else [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 30))]
        for _ in range(rnd.randrange(3)):
            tail[rnd.randrange(len(tail))] = f"w{rnd.randrange(40)}"
        texts.append(tail)
    sql = {f"m{i}": " ".join(["select a b c d from"[: 8 + i % 12], *t]) for i, t in enumerate(texts)} | {"short": "select a b", "bad": "select a b c d from w1 w2"}
    plans = no_broadcast(monkeypatch, T)
    parsed = spark.createDataFrame([(k, v, k != "bad") for k, v in sql.items()] + [("none", None, True)], "node_id string, sql string, parse_ok boolean")
    parsed.coalesce(1).write.parquet(str(tmp_path / "in"))  # of a file the size is known, and small enough to be broadcast
    parsed = spark.read.parquet(str(tmp_path / "in"))
    df = T.near_duplicates({"parsed": parsed}, {"threshold": threshold})
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in x for x in plans)
    cut = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, v in sql.items() if k != "bad" and len(w := v.split()) >= 6}
    want = {(a, f"R001:{b}"): len(x & y) / len(x | y) for a, x in cut.items() for b, y in cut.items() if a != b and x & y and len(x & y) / len(x | y) >= threshold}
    got = [(r["node_id"], r["context"], r["confidence"]) for r in df.collect()]
    assert want and {(a, c): v for a, c, v in got} == want and len(got) == len(want)


def reachable(edges):
    out = {}
    for a in {a for a, _ in edges}:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            new = {c for p, c in edges if p == x} - seen
            seen |= new
            todo += new
        out[a] = seen
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_and_cycles_of_any_graph_by_few_rounds_without_broadcast(spark, monkeypatch, tmp_path, seed):
    rnd = random.Random(seed)
    edges = {(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range((20, 35, 60)[seed])}
    edges |= {(f"c{i}", f"c{i + 1}") for i in range(21)} | {("c3", "c9"), ("c20", "c12"), ("z", "z")}
    e = spark.createDataFrame(sorted(edges) * 2, "parent string, child string")
    plans = no_broadcast(monkeypatch, G)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))  # of a file the size is known, and small enough to be broadcast
    e = spark.read.parquet(str(tmp_path / "in"))
    reach = G.closure(e)
    assert len(plans) <= 2 * 6 + 1 and not any("Broadcast" in x for x in plans)
    want = reachable(edges)
    got = [tuple(r) for r in reach.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, d) for a, ds in want.items() for d in ds}
    del plans[:]
    found = G.cycles_of(e)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in x for x in plans)
    groups = {tuple(sorted(b for b in want[a] if a in want.get(b, ()))) for a in want if a in want[a]}
    assert {(r["cycle_id"], tuple(r["members"])) for r in found.collect()} == {(g[0], g) for g in groups}


def test_trimming_leaves_no_edge_of_a_tree_and_all_of_cycles(spark):
    tree = [(f"t{i // 2}", f"t{i}") for i in range(1, 64) if i > 1]
    loops = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")]
    frame = lambda rows: spark.createDataFrame(rows, "parent string, child string")
    assert G.trimmed(frame(tree)).count() == 0 and G.cycles_of(frame(tree)).count() == 0
    assert {tuple(r) for r in G.trimmed(frame(tree + loops + [("t5", "a"), ("d", "e")])).collect()} == set(loops)


def test_first_of_each_tier_take_bounded_memory(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 2, 7, None]), rnd.choice(X.SEVERITIES), f"p{rnd.randrange(4)}", rnd.randrange(3), "R", i) for i in range(300)] + [(9, "INFO", "p", 1, "R", 300)]
    f = spark.createDataFrame(rows, "tier int, severity string, path string, line int, rule_id string, ord int")
    df = K.top_per_tier(f, 5, ["ord"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject(limit=5") == 5 and plan.count("Window [") == 1
    want = set()
    for t in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == t), key=lambda r: (X.SEVERITIES.index(r[1]), *r[2:]))
        want |= {(*r, k + 1, max(0, len(mine) - 5)) for k, r in enumerate(mine[:5])}
    assert df.columns == [*f.columns, "position", "more"] and sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert K.top_per_tier(f.where("false")).count() == 0
