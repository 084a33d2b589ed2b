"""Host-level quality rules (operator 8).

Each document is judged by simple rules of its text; failures are counted by host and rule.  A host's failure rate is shrunk
to that of all hosts by a beta prior whose parameters are fitted to the hosts' rates by the method of moments, so a host
with three documents isn't condemned for one.  A host fails if any of its shrunk rates is over ``LIMIT``; the
verdict is joined back to its documents.

Defined cases: a null text is judged as an empty one; a null host is a host of its own (''); host names are trimmed and put in
lower case; repeated rows count as often as they occur; with one host, or equal rates, the prior is so strong that
every host has the common rate; an empty table gives an empty result; only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm import textcore as tc

LIMIT, STRONGEST, SMALL = 0.3, 1e6, 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = ("empty", "symbols", "shouting", "repetition", "long_words")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, host, one 0/1 column for each rule)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim(F.coalesce(F.col("source").cast("string"), F.lit("")))).alias("host"), text.alias("t"))
    base = base.withColumn("words", F.expr("filter(split(lower(t), '[ \\n\\r\\t]+'), x -> x <> '')")).withColumn("n", F.size("words"))
    chars = F.length("t")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return base.select(
        "doc_id",
        "host",
        flag(F.col("n") == 0).alias("empty"),
        flag((chars - F.length(F.translate("t", "#$%&*|!<>{}~", ""))) > 0.05 * chars).alias("symbols"),
        flag((chars - F.length(F.translate("t", UPPER, ""))) > 0.4 * chars).alias("shouting"),
        flag((F.col("n") >= 20) & (F.size(F.array_distinct("words")) < 0.2 * F.col("n"))).alias("repetition"),
        flag((F.col("n") > 0) & (chars > 25 * F.col("n"))).alias("long_words"),
    )


def host_verdicts(flags: DataFrame) -> DataFrame:
    """(host, n_docs, worst_rate, host_ok)."""
    counts = flags.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(r).alias(r) for r in RULES))
    means = [F.avg(F.col(r) / F.col("n")).alias(f"m_{r}") for r in RULES] + [F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}") for r in RULES]
    prior = counts.agg(*means)
    strength = {r: F.when(F.col(f"v_{r}") > 1e-12, F.least(F.lit(STRONGEST), F.greatest(F.lit(1.0), F.col(f"m_{r}") * (1 - F.col(f"m_{r}")) / F.col(f"v_{r}") - 1))).otherwise(F.lit(STRONGEST)) for r in RULES}
    rates = [((F.col(r) + strength[r] * F.col(f"m_{r}")) / (F.col("n") + strength[r])) for r in RULES]
    worst = counts.crossJoin(F.broadcast(prior)).select("host", F.col("n").alias("n_docs"), F.round(F.greatest(*rates), 6).alias("worst_rate"))
    return worst.withColumn("host_ok", F.col("worst_rate") <= LIMIT)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_failed, worst_rate, host_ok, keep) of every document; keep: its host passes and so does it."""
    flags = tc.checkpointed(failures(docs))
    verdicts = tc.checkpointed(host_verdicts(flags))
    side = F.broadcast(verdicts) if verdicts.count() <= SMALL else verdicts
    out = flags.join(side, "host").withColumn("n_failed", sum((F.col(r) for r in RULES[1:]), F.col(RULES[0])))
    return out.select("doc_id", "host", "n_failed", "worst_rate", "host_ok", (F.col("host_ok") & (F.col("n_failed") == 0)).alias("keep"))


def _sql() -> str:
    flag = {
        "empty": "n = 0",
        "symbols": "length(t) - length(translate(t, '#$%&*|!<>{}~', '')) > 0.05 * length(t)",
        "shouting": f"length(t) - length(translate(t, '{UPPER}', '')) > 0.4 * length(t)",
        "repetition": "n >= 20 and len(list_distinct(words)) < 0.2 * n",
        "long_words": "n > 0 and length(t) > 25 * n",
    }
    flags = ", ".join(f"cast({v} as int) as {k}" for k, v in flag.items())
    sums = ", ".join(f"sum({r}) as {r}" for r in RULES)
    moments = ", ".join(f"avg({r} / n) as m_{r}, var_pop({r} / n) as v_{r}" for r in RULES)
    power = {r: f"(case when v_{r} > 1e-12 then least({STRONGEST}, greatest(1.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) else {STRONGEST} end)" for r in RULES}
    rates = ", ".join(f"({r} + {power[r]} * m_{r}) / (n + {power[r]})" for r in RULES)
    return f"""
with base as (select doc_id, lower(trim(coalesce(source, ''))) as host, coalesce(text, '') as t from documents),
cut as (select *, list_filter(string_split_regex(lower(t), '[ \\n\\r\\t]+'), lambda x: x <> '') as words from base),
sized as (select *, len(words) as n from cut),
flags as (select doc_id, host, {flags} from sized),
counts as (select host, cast(count(*) as double) as n, {sums} from flags group by host),
prior as (select {moments} from counts),
verdict as (select host, round(greatest({rates}), 6) as worst_rate from counts, prior)
select doc_id, host, {" + ".join(RULES)} as n_failed, worst_rate, worst_rate <= {LIMIT} as host_ok,
       worst_rate <= {LIMIT} and {" + ".join(RULES)} = 0 as keep
from flags join verdict using (host)"""


SQL = _sql()
