"""Secret scans with an incremental blob ledger (operator 9).

A version of a document is a blob, named by the SHA-256 of its text.  The ledger holds the (blob, rule, version) triples that
have been scanned.  `scan` finds the blobs that lack a triple, scans one row of each, by those rules only, and gives
findings of blobs, and the ledger's new rows; `by_path` joins findings back to all documents (paths) whose text they are in.

Secrets themselves are never given out, only how often a rule matches.

Defined cases: a null text is no blob and has no finding; an empty one is a blob without findings; a null doc_id is a path like
others; rows that share a doc_id are versions of one path; rows alike give one finding; an empty ledger or table is fine;
a rule's new version is scanned again for all blobs, an old one never; texts of any length are scanned whole; no order decides
anything, so there are no ties; only doc_id and text are read, so extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.llm import textcore as tc

SMALL_BYTES, ROW_BYTES = 1 << 26, 128  # what may be broadcast, and what a blob's row takes in a hash table


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    keywords: tuple[str, ...]  # in lower case; a text without any of them can't match
    pattern: str  # of the syntax that Java and RE2 share


RULES = (
    Rule("assigned_hex", 2, ("token", "secret", "passw", "key"), r"(?i)(token|secret|passwd|password|api_?key|access_?key)[\"']?[ \t]*[:=]+[ \t]*[\"'][0-9a-f]{32,128}[\"']"),
    Rule("assigned_base64", 2, ("secret", "key"), r"(?i)(secret|private_?key|client_?secret)[\"']?[ \t]*[:=]+[ \t]*[\"'][0-9a-z+/]{40,}={0,2}[\"']"),
    Rule("aws_access_key", 1, ("akia",), r"AKIA[0-9A-Z]{16}"),
    Rule("github_token", 1, ("gh",), r"gh[pousr]_[0-9A-Za-z]{36}"),
    Rule("stripe_key", 1, ("sk_live_",), r"sk_live_[0-9A-Za-z]{24,}"),
    Rule("json_web_token", 1, ("eyj",), r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}"),
    Rule("private_key_block", 1, ("private key-----",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack_token", 1, ("xox",), r"xox[baprs]-[0-9A-Za-z-]{10,}"),
    Rule("google_api_key", 1, ("aiza",), r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_password", 1, ("://",), r"[a-z][a-z0-9+.-]*://[^/ \n\t:@]+:[^/ \n\t:@]+@"),
)
LEDGER = "blob string, rule string, version int"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def _hashed(docs: DataFrame) -> DataFrame:
    return tc.ids_texts(docs).where("text is not null").withColumn("blob", F.sha2("text", 256))


def scan(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, small: int = SMALL_BYTES) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows): (blob, rule, version, hits) with hits over 0, and (blob, rule, version); at most 63 rules."""
    rows = _hashed(docs)
    blobs = rows.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    bit = F.lit(0).cast("bigint")
    for i, r in enumerate(rules):
        bit = F.when((F.col("rule") == r.name) & (F.col("version") == r.version), F.lit(1 << i).cast("bigint")).otherwise(bit)
    known = ledger.groupBy("blob").agg(F.bit_or(bit).alias("done"))
    missing = F.lit((1 << len(rules)) - 1).cast("bigint").bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("bigint"))))
    todo = tc.checkpointed(blobs.join(known, "blob", "left").select("blob", "doc_id", missing.alias("todo")).where("todo <> 0"))
    side = todo.select(F.unhex("blob").alias("_b"), F.col("doc_id").alias("_d"), F.col("todo"))
    side = F.broadcast(side) if todo.count() * ROW_BYTES <= small else side.hint("shuffle_hash")
    unseen = rows.join(side, (F.unhex("blob") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d"))).withColumn("low", F.lower("text"))
    wanted = [F.col("todo").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0 for i in range(len(rules))]

    def keyed(r: Rule):
        out = F.lit(False)
        for k in r.keywords:
            out = out | F.col("low").contains(k)
        return out

    hits = [F.when(w & keyed(r), F.regexp_count("text", F.lit(r.pattern))).otherwise(0) for w, r in zip(wanted, rules)]
    found = unseen.select("blob", F.explode(F.filter(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), h.alias("hits")) for r, h in zip(rules, hits))), lambda x: x["hits"] > 0)).alias("f"))
    each = F.array_compact(F.array(*(F.when(w, F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"))) for w, r in zip(wanted, rules))))
    return found.select("blob", "f.rule", "f.version", "f.hits").distinct(), todo.select("blob", F.explode(each).alias("t")).select("blob", "t.rule", "t.version")


def scanned_twice(docs: DataFrame) -> DataFrame:
    """Findings of all rules in two scans: the second, with the first's ledger, scans only for the rules that came later."""
    early = RULES[::2]
    first, ledger = scan(docs, empty_ledger(docs.sparkSession), early)
    second, _ = scan(docs, tc.checkpointed(ledger), RULES)
    return first.unionByName(second)


def by_path(docs: DataFrame, findings: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """(doc_id, blob, rule, version, hits): findings at every path that has the blob."""
    found = tc.checkpointed(findings)
    side = F.broadcast(found) if found.count() * ROW_BYTES <= small else found
    return _hashed(docs).select("doc_id", "blob").distinct().join(side, "blob").select("doc_id", "blob", "rule", "version", "hits")


def _sql() -> str:
    def quoted(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    one = [f"select doc_id, blob, '{r.name}' as rule, {r.version} as version, len(regexp_extract_all(text, {quoted(r.pattern)})) as hits from b" for r in RULES]
    return "with b as (select distinct doc_id, sha256(text) as blob, text from documents where text is not null), f as (" + " union all ".join(one) + ") select doc_id, blob, rule, cast(version as int) as version, cast(hits as int) as hits from f where hits > 0"


SQL = _sql()
